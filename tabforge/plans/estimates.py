"""Driver-side estimates: disk, batch size of candidates, and states of datasets and jobs."""

from __future__ import annotations

import math
from collections.abc import Mapping
from decimal import Decimal

from tabforge.schema import EngineError

GIB = 1 << 30
#: What a state may become.
DATASET_NEXT = {
    "uploading": ("staged",), "staged": ("inspecting",), "inspecting": ("parse_options_required", "sheet_required", "raw_ready", "failed"),
    "parse_options_required": ("inspecting",), "sheet_required": ("inspecting",), "raw_ready": ("profiling",), "profiling": ("profiled", "failed"),
    "profiled": ("schema_ready",), "schema_ready": ("normalizing", "profiled"), "normalizing": ("normalized", "failed", "profiled"),
    "normalized": ("profiled",), "failed": ("staged", "raw_ready", "schema_ready"),
}


def step(now: str, then: str, table: Mapping[str, tuple[str, ...]] = DATASET_NEXT) -> str:
    if then not in table[now]:
        raise EngineError("INVALID_STATE", f"{now} to {then}")
    return then


def disk(source_bytes: int, raw_ratio: Decimal, rows: int, row_bytes: Decimal, output_rows: int, synth_row_bytes: Decimal, csv_row_bytes: Decimal, workspace: int, memory_limit: int, csv: bool = True, archive: bool = True, existing: tuple[str, ...] = ()) -> dict[str, int]:
    """Bytes of each artifact with its margin, reserves, and the free bytes that a job needs beyond ``existing`` artifacts."""
    up = lambda *f: math.ceil(math.prod(map(Decimal, f)))
    out = {"raw_parquet": up(source_bytes, raw_ratio, "1.30"), "normalized_parquet": up(rows, row_bytes, "1.30"), "model_workspace": workspace, "generated_parquet": up(output_rows, synth_row_bytes, "1.50"), "csv": up(output_rows, csv_row_bytes, "1.50") if csv else 0}
    out["parquet_zip64"] = up(out["generated_parquet"], "1.01") if archive else 0
    pending = [v for k, v in out.items() if k not in existing]
    spill = max(8 * GIB, 2 * memory_limit)
    atomic = max([spill, *pending])
    return out | {"spill_reserve": spill, "atomic_reserve": atomic, "required": sum(pending) + atomic + 22 * GIB}


def candidate_batch(row_bytes: float, budget: int = 128 << 20, least: int = 10_000, most: int = 250_000) -> int:
    """How many candidates to make at a time: what fits the budget, between 10,000 and 250,000."""
    return max(least, min(most, int(budget / row_bytes)))
