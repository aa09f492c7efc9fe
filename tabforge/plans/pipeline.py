"""The whole run: audit, split, model view, fit, generate, rebuild, validate, accept, evaluate."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabforge.operators import distances, export, rules, sampling
from tabforge.operators.synth import Model
from tabforge.plans.rules import CompiledRules
from tabforge.schema import CANDIDATE_INDEX, ROW_ID, EngineError

FACTOR = 20


@dataclass(frozen=True)
class Result:
    rows: DataFrame
    counts: dict[str, int]
    examined: int
    rejected: int
    distances: DataFrame


def generate_exactly(model: Model, compiled: CompiledRules, wanted: int, batch: int, domains: dict[str, DataFrame] | None = None, factor: int = FACTOR) -> tuple[DataFrame, int, int]:
    """(exactly ``wanted`` valid rows, candidates examined, candidates rejected) from at most ``factor`` times as many candidates.

    Batches of candidates are made, rebuilt and validated until enough are valid; whole batches count as examined.  Identifiers
    follow the order of acceptance.
    """
    parts, valid, made = [], 0, 0
    while valid < wanted and made < wanted * factor:
        stop = min(made + batch, wanted * factor)
        rebuilt = rules.rebuilt(model.generate(made, stop), compiled, domains, CANDIDATE_INDEX)
        part = rules.validated(rebuilt, compiled, domains).persist()
        valid += part.where("__violations = 0").count()
        parts.append(part)
        made = stop
    every = reduce(DataFrame.unionByName, parts) if parts else None
    if valid < wanted or every is None:
        raise EngineError("RULE_FEASIBILITY_EXHAUSTED", f"{valid} of {wanted} rows from {made} candidates", examined=made, accepted=valid)
    out = rules.accepted(every, CANDIDATE_INDEX, wanted)
    columns = compiled.columns
    out = out.withColumns({c.name: rules.identifier(c, F.col("accepted_id")) for c in compiled.schema if c.kind == "identifier"})
    return out.select("accepted_id", *(rules.q(c) for c in columns if c in out.columns)), made, made - valid


def run(df: DataFrame, compiled: CompiledRules, fit: Callable[[DataFrame], Model], key: bytes, wanted: int, batch: int = 250_000) -> Result:
    """From a normalized table (with row ids) to exactly ``wanted`` rows and their distances to an untouched holdout."""
    source, counts = rules.audited_source(df, compiled)
    own, apart = sampling.train(source, key), sampling.holdout(source, key)
    domains = {r.id: rules.domain_of(source, r, compiled) for r in compiled.rules if r.kind == "fixed_combination"}
    view = rules.model_view(own, compiled, domains)
    rows, examined, rejected = generate_exactly(fit(view), compiled, wanted, batch, domains)
    names = [c.name for c in compiled.schema if c.role != "excluded"]
    # both sides of an evaluation go through the same view and reconstruction
    same = lambda side: rules.rebuilt(rules.model_view(side, compiled, domains), compiled, domains).drop(ROW_ID, "__invalid")
    evaluated = [c for c in compiled.schema if c.role in ("model", "derived")]
    found = distances.primary(same(own), same(apart), rows, evaluated)
    return Result(rows.select("accepted_id", *(n for n in names if n in rows.columns)), counts, examined, rejected, found)


def publish(result: Result, folder: str, schema: Sequence) -> dict:
    """Parquet in acceptance order, its shard manifest, and a CSV whose rows are checked to be the same."""
    spark = result.rows.sparkSession
    export.publish_parquet(result.rows.orderBy("accepted_id").drop("accepted_id"), f"{folder}/parquet")
    table = spark.read.parquet(f"{folder}/parquet")
    marker = export.write_csv(table, f"{folder}/csv", schema)
    if not export.equivalent(table, f"{folder}/csv", marker, schema).first()["equal"]:
        raise EngineError("CHECKSUM_MISMATCH", "the CSV differs from the Parquet rows")
    return export.manifest(spark, f"{folder}/parquet", schema) | {"null_marker": marker}
