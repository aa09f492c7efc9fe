"""Reports as JSON and plain HTML, and what a differentially private release may show."""

from __future__ import annotations

import html
from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame

from tabforge.schema import EngineError, canonical_json

#: Fields that never leave with a private release, whatever their depth.
FORBIDDEN = {
    "source_count", "source_counts", "source_row_count", "source_rows", "raw_source_count", "private_domain", "private_domains", "exact_private_domain", "holdout",
    "holdout_metrics", "real_holdout", "real_holdout_metrics", "attack", "attacks", "attack_metrics", "anonymeter", "dcr", "nndr", "example", "examples", "raw_example",
    "raw_examples", "fit_timing", "timing", "fit_duration", "rss", "peak_rss", "worker_rss", "fit_seed", "private_seed", "rng_seed", "seed", "raw_dataset_digest",
    "dataset_digest", "source_digest", "dataset_manifest_digest",
}
#: Fields of the privacy ledger and of the output that a release shows.
LEDGER = {
    "adjacency", "privacy_unit", "epsilon", "epsilon_model", "epsilon_preprocess", "delta", "mechanism", "accountant", "conversion", "package", "package_version",
    "wheel_sha256", "package_wheel_sha256", "public_metadata_hashes", "run_id", "model_id", "privacy_scope_id", "public_target_count", "public_target_count_provenance",
    "release_count", "composition_version", "epsilon_total", "delta_total", "spent_runs", "lock_sha256", "rng_policy", "rule_postprocessing", "limitations",
}
OUTPUT = {
    "requested_rows", "actual_rows", "schema", "schema_order", "column_order", "columns", "dtypes", "null_counts", "category_counts", "hard_rule_violations",
    "artifact_hashes", "artifacts", "rule_violations", "canonical_content_sha256", "parquet_content_sha256", "csv_content_sha256",
}
SCOPES = ("downloadable", "dp_release", "internal")


def forbidden_in(value: Any) -> list[str]:
    """The forbidden fields anywhere inside a value."""
    if isinstance(value, Mapping):
        return sorted({k for k in value if k.lower() in FORBIDDEN}.union(*(forbidden_in(v) for v in value.values())))
    if isinstance(value, list | tuple):
        return sorted(set().union(*(forbidden_in(v) for v in value)))
    return []


def release(ledger: Mapping[str, Any], output: Mapping[str, Any]) -> dict[str, dict]:
    """The allowed fields of ledger and output; a forbidden field inside what is left is an error."""
    out = {"privacy": {k: v for k, v in ledger.items() if k in LEDGER}, "output": {k: v for k, v in output.items() if k in OUTPUT}}
    if bad := forbidden_in(out):
        raise EngineError("REPORT_NOT_RELEASE_SAFE", "forbidden fields", fields=bad)
    return out


def visible(artifacts: DataFrame, scope: str) -> DataFrame:
    """Artifacts of a scope; internal ones are never listed with the others."""
    if scope not in SCOPES:
        raise ValueError(scope)
    return artifacts.where(artifacts["scope"] == scope)


def as_json(report: Mapping[str, Any]) -> str:
    return canonical_json(report)


def as_html(report: Mapping[str, Any], title: str = "Report") -> str:
    """A page of nested tables."""

    def cell(v: Any) -> str:
        if isinstance(v, Mapping):
            return "<table>" + "".join(f"<tr><th>{html.escape(str(k))}</th><td>{cell(x)}</td></tr>" for k, x in v.items()) + "</table>"
        if isinstance(v, list | tuple):
            return "<ol>" + "".join(f"<li>{cell(x)}</li>" for x in v) + "</ol>"
        return html.escape("" if v is None else str(v))

    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1>{cell(report)}</body></html>"
