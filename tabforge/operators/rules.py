"""Compiled rules on DataFrames: audit, filter, model view, reconstruction and validation, all as Column expressions."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping
from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabforge.functions.cells import fits, from_units, in_int64, literal, units
from tabforge.plans.rules import Compare, CompiledRules, ConditionalSet, FixedCombination, Rule, SumEquals, When, unit_of
from tabforge.schema import ColumnSchema, EngineError, canonical_json

TUPLE_CAP = 1_000_000
_BROADCAST_TUPLES = 10_000


def q(name: str) -> Column:
    return F.col(f"`{name}`")


def two_valued(predicate: Column, null: bool = False) -> Column:
    return F.coalesce(predicate, F.lit(null))


def holds(when: When, columns: Mapping[str, ColumnSchema]) -> Column:
    """The condition, false where the column is null."""
    c = q(when.column)
    if when.kind == "is_null":
        return c.isNull()
    v = literal(when.value, columns[when.column])
    return two_valued({"eq": c == v, "ne": c != v, "lt": c < v, "lte": c <= v, "gt": c > v, "gte": c >= v}[when.op])


def _sum(rule: SumEquals, columns) -> Column:
    return reduce(add, (units(q(s), columns[s]) for s in rule.sources))


def _in_tuples(rule: FixedCombination, columns) -> Column:
    rows = (reduce(lambda a, b: a & b, (q(c).eqNullSafe(literal(v, columns[c])) for c, v in zip(rule.columns, t, strict=True))) for t in rule.allowed_tuples)
    return reduce(or_, rows)


def violated(rule: Rule, compiled: CompiledRules, output: bool = False) -> Column:
    """Whether a row violates the rule: never null.  On output sums have no tolerance.

    A combination without stated tuples is not violated; see ``domain_of`` and ``validated`` for inferred ones.
    """
    columns = compiled.columns
    if rule.kind == "not_null":
        return q(rule.column).isNull()
    if rule.kind == "mask_prefix":
        return F.lit(False)
    if rule.kind in ("allowed_values", "range"):
        c, column = q(rule.column), columns[rule.column]
        if rule.kind == "allowed_values":
            ok = c.isin(*(literal(v, column) for v in rule.values))
        else:
            low, high = literal(rule.min, column), literal(rule.max, column)
            ok = (c >= low if rule.inclusive_min else c > low) & (c <= high if rule.inclusive_max else c < high)
            if column.kind == "float":
                ok = ok & ~F.isnan(c)
        return ~two_valued(ok, column.nullable)
    if rule.kind == "fixed_combination":
        return ~_in_tuples(rule, columns) if rule.allowed_tuples else F.lit(False)
    if rule.kind == "conditional_set":
        return holds(rule.when, columns) & ~q(rule.target).eqNullSafe(literal(rule.value, columns[rule.target]))
    if rule.kind == "sum_equals":
        target = columns[rule.target]
        total = _sum(rule, columns)
        off = F.lit(str(0 if output else rule.tolerance.scaleb(target.decimal_places or 0))).cast("decimal(38,6)")
        good = F.abs(units(q(rule.target), target) - total) <= off
        if rule.id in compiled.checked_sums:
            good = good & in_int64(total)
        empty = F.lit(target.nullable) & q(rule.target).isNull()
        return ~F.when(total.isNull(), empty).otherwise(two_valued(good))
    left, right = units(q(rule.left), columns[rule.left]), units(q(rule.right), columns[rule.right])
    return ~two_valued({"<": left < right, "<=": left <= right, ">": left > right, ">=": left >= right}[rule.op])


def _flagged(df: DataFrame, compiled: CompiledRules, output: bool = False) -> DataFrame:
    """Only the rules' verdicts, v0, v1, ...: the scan reads only the columns that rules read."""
    rules = compiled.source
    return df.select(*(violated(r, compiled, output).alias(f"v{i}") for i, r in enumerate(rules))) if rules else df.select(F.lit(False).alias("v0"))


def _count(predicate: Column) -> Column:
    return F.count_if(predicate).cast("long")


def _number(indices: list[int]) -> Column:
    return reduce(add, (F.col(f"v{i}").cast("int") for i in indices), F.lit(0))


def audit(df: DataFrame, compiled: CompiledRules) -> DataFrame:
    """(rule_id, violations) in one pass: each rule, then counts of rows by how many rules they violate (ids beginning with __)."""
    rules = compiled.source
    every = list(range(len(rules)))
    block, drop = ([i for i in every if rules[i].source_action == a] for a in ("block", "drop_row"))
    counters = [(r.id, _count(F.col(f"v{i}"))) for i, r in enumerate(rules)]
    counters += [("__source", F.count(F.lit(1))), ("__union", _count(_number(every) > 0)), ("__overlap", _count(_number(every) > 1)), ("__block_union", _count(_number(block) > 0)), ("__block_overlap", _count(_number(block) > 1)), ("__drop_union", _count(_number(drop) > 0)), ("__drop_overlap", _count(_number(drop) > 1)), ("__retained", _count(_number(drop) == 0))]
    one = _flagged(df, compiled).agg(*(c.cast("long").alias(f"n{i}") for i, (_, c) in enumerate(counters)))
    return one.select(F.explode(F.array(*(F.struct(F.lit(name).alias("rule_id"), F.col(f"n{i}").alias("violations")) for i, (name, _) in enumerate(counters)))).alias("r")).select("r.*")


def drops(compiled: CompiledRules) -> Column:
    """Whether any rule whose action is drop_row is violated."""
    return reduce(or_, (violated(r, compiled) for r in compiled.source if r.source_action == "drop_row"), F.lit(False))


def kept(df: DataFrame, compiled: CompiledRules) -> DataFrame:
    """Rows that no drop rule removes."""
    return df.where(~drops(compiled))


def audited_source(df: DataFrame, compiled: CompiledRules) -> tuple[DataFrame, dict[str, int]]:
    """The rows to use and the audit's counts; raises if a blocking rule is violated, before anything is written."""
    counts = {r["rule_id"]: r["violations"] for r in audit(df, compiled).collect()}  # one row for each rule
    if counts["__block_union"]:
        raise EngineError("SOURCE_RULE_VIOLATION", "blocking rules are violated", counts=counts)
    return kept(df, compiled), counts


def denominators(df: DataFrame, compiled: CompiledRules) -> DataFrame:
    """(rule_id, denominator): the rows that each rule is about: all, those with a value, or those whose condition holds."""
    columns, out = compiled.columns, []
    for r in compiled.source:
        if r.kind == "conditional_set":
            about = holds(r.when, columns)
        elif r.kind in ("allowed_values", "range"):
            about = q(r.column).isNotNull()
        else:
            about = F.lit(True)
        out.append((r.id, _count(about)))
    one = df.agg(*(c.alias(f"n{i}") for i, (_, c) in enumerate(out)))
    return one.select(F.explode(F.array(*(F.struct(F.lit(name).alias("rule_id"), F.col(f"n{i}").alias("denominator")) for i, (name, _) in enumerate(out)))).alias("r")).select("r.*")


def domain_of(df: DataFrame, rule: FixedCombination, compiled: CompiledRules, cap: int = TUPLE_CAP) -> DataFrame:
    """(code, columns...): stated tuples in their order, or those of the rows that drop rules keep, ordered by canonical JSON.

    At most ``cap`` tuples: the domain is bounded, and more are an error.
    """
    spark, columns = df.sparkSession, compiled.columns
    if rule.allowed_tuples:
        tuples = list(rule.allowed_tuples)
    else:
        got = kept(df, compiled).select(*(q(c) for c in rule.columns)).distinct().limit(cap + 1).collect()
        if len(got) > cap:
            raise EngineError("RESOURCE_LIMIT", f"{rule.id}: more than {cap} tuples")
        tuples = sorted((tuple(r) for r in got), key=lambda t: canonical_json([v.replace(tzinfo=dt.UTC) if isinstance(v, dt.datetime) and v.tzinfo is None else v for v in t]))
    fields = ", ".join(f"`{c}` {columns[c].spark_type.simpleString()}" for c in rule.columns)
    return spark.createDataFrame([(i, *t) for i, t in enumerate(tuples)], f"code long, {fields}")


def _with_domain(df: DataFrame, rule: FixedCombination, domain: DataFrame, name: str) -> DataFrame:
    """Adds each row's tuple code; null where the tuple is not in the domain.  A join on null-safe equality."""
    small = F.broadcast(domain) if domain.limit(_BROADCAST_TUPLES + 1).count() <= _BROADCAST_TUPLES else domain
    side = small.select(F.col("code").alias(name), *(q(c).alias(f"__d_{i}") for i, c in enumerate(rule.columns)))
    on = reduce(lambda a, b: a & b, (q(c).eqNullSafe(F.col(f"__d_{i}")) for i, c in enumerate(rule.columns)))
    return df.join(side, on, "left").drop(*(f"__d_{i}" for i in range(len(rule.columns))))


def masked(c: Column, keep: int) -> Column:
    """The first ``keep`` code points and a star for each other; short texts and nulls as they are."""
    return F.when(F.length(c) <= keep, c).otherwise(F.concat(F.substring(c, 1, keep), F.repeat(F.lit("*"), F.length(c) - keep)))


def delta(rule: Compare, compiled: CompiledRules) -> Column:
    """The non-negative distance that a comparison leaves open, in order units; null if there is none."""
    columns = compiled.columns
    left, right = units(q(rule.left), columns[rule.left]), units(q(rule.right), columns[rule.right])
    step = F.lit(unit_of(rule, columns[rule.right]) if rule.op in ("<", ">") else 0)
    d = (right - left if rule.op in ("<", "<=") else left - right) - step
    if columns[rule.right].kind == "float":
        return F.when((d >= 0) & (d < float("inf")), d)
    d = d.cast("decimal(38,0)")
    return F.when((d >= 0) & in_int64(d), d.cast("long"))


def model_view(df: DataFrame, compiled: CompiledRules, domains: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """What a synthesizer sees: masked text, a code for each fixed combination and a distance for each comparison; columns that
    follow from others, and those not modelled, are left out."""
    columns, domains = compiled.columns, dict(domains or {})
    gone = {c.name for c in compiled.schema if c.role != "model"}
    for r in compiled.masks:
        df = df.withColumn(r.column, masked(q(r.column), r.keep_chars))
    latent = {}
    for r in compiled.rules:
        if r.kind == "compare":
            latent[compiled.latent(r)] = delta(r, compiled)
    df = df.withColumns(latent)
    for r in compiled.rules:
        gone |= r.structural
        if r.kind == "fixed_combination":
            df = _with_domain(df, r, domains[r.id] if r.id in domains else domain_of(df, r, compiled), compiled.latent(r))
    return df.drop(*(c for c in gone if c in columns))


def rebuilt(df: DataFrame, compiled: CompiledRules, domains: Mapping[str, DataFrame] | None = None, index: str | None = None) -> DataFrame:
    """Columns reconstructed in the compiled order from the model's view, in the schema's order, with ``__invalid`` for rows
    whose sums, distances or codes give no value.  Identifiers follow from ``index``; sums beyond 64 bits are an error."""
    columns, domains = compiled.columns, dict(domains or {})
    df = df.withColumn("__invalid", F.lit(False))
    for i in compiled.rebuild:
        r = compiled.rule(i)
        if r.kind == "fixed_combination":
            name = compiled.latent(r)
            if name not in df.columns:  # rows that are whole already
                continue
            domain = domains[r.id]
            small = F.broadcast(domain) if domain.limit(_BROADCAST_TUPLES + 1).count() <= _BROADCAST_TUPLES else domain
            df = df.join(small.withColumnRenamed("code", "__code"), F.col(name) == F.col("__code"), "left")
            df = df.withColumn("__invalid", F.col("__invalid") | F.col("__code").isNull()).drop("__code", name)
        elif r.kind == "conditional_set":
            df = df.withColumn(r.target, F.when(holds(r.when, columns), literal(r.value, columns[r.target])).otherwise(q(r.target)))
        elif r.kind == "sum_equals":
            total = _sum(r, columns)
            if r.id in compiled.checked_sums:
                total = F.when(total.isNull() | in_int64(total), total).otherwise(F.raise_error(F.lit("OUTPUT_INVALID: int64_overflow")).cast("decimal(38,0)"))
            df = df.withColumn(r.target, from_units(total, columns[r.target]))
            if not columns[r.target].nullable:
                df = df.withColumn("__invalid", F.col("__invalid") | q(r.target).isNull())
        elif r.kind == "compare":
            name = compiled.latent(r)
            if name not in df.columns:
                continue
            column = columns[r.right]
            step = F.lit(unit_of(r, column) if r.op in ("<", ">") else 0)
            move = F.col(name) + step
            left = units(q(r.left), columns[r.left])
            value = left + move if r.op in ("<", "<=") else left - move
            value = value if column.kind == "float" else value.cast("decimal(38,0)")
            df = df.withColumn(r.right, from_units(value, column))
            df = df.withColumn("__invalid", F.col("__invalid") | (F.col(name) < 0) | (q(r.right).isNull() & F.lit(not column.nullable))).drop(name)
    if index is not None:
        df = df.withColumns({c.name: identifier(c, F.col(index)) for c in compiled.schema if c.kind == "identifier"})
    own = [c.name for c in compiled.schema if c.name in df.columns]
    return df.select(*(c for c in df.columns if c not in columns and c != "__invalid"), *map(q, own), two_valued(F.col("__invalid"), True).alias("__invalid"))


def identifier(column: ColumnSchema, index: Column) -> Column:
    """The identifier of a 0-based index: its successor as text, or a UUID made of its hash."""
    from tabforge.functions.keyed import uuid4_of

    return uuid4_of(index) if column.identifier_strategy == "uuid4" else (index + 1).cast("string")


def validated(df: DataFrame, compiled: CompiledRules, domains: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """df with ``__violations``: how many rules a row violates on output, a row that does not fit the schema counting as one more."""
    bad_cells = reduce(or_, (~fits(q(c.name), c) for c in compiled.schema if c.name in df.columns), F.lit(False))
    if "__invalid" in df.columns:
        bad_cells = bad_cells | F.col("__invalid")
    number = bad_cells.cast("int")
    for r in compiled.source:
        if r.kind == "fixed_combination" and not r.allowed_tuples and domains and r.id in domains:
            df = _with_domain(df, r, domains[r.id], f"__code_{r.id}")
            number = number + F.col(f"`__code_{r.id}`").isNull().cast("int")
        else:
            number = number + violated(r, compiled, output=True).cast("int")
    out = df.withColumn("__violations", number)
    return out.drop(*(c for c in out.columns if c.startswith("__code_")))


def accepted(candidates: DataFrame, index: str, wanted: int) -> DataFrame:
    """The first ``wanted`` valid candidates (``__violations`` = 0) by global index, renumbered 0, 1, ... as ``accepted_id``.

    No window over all rows: valid rows are counted by ranges of the index (the counts go to the driver), and each range
    numbers its own rows from its offset.
    """
    valid = candidates.where("__violations = 0").drop("__violations")
    width = max(1, -(-20 * max(1, wanted) // 1024))
    ranged = valid.withColumn("__range", F.floor(F.col(index) / width).cast("long"))
    counts = ranged.groupBy("__range").count().orderBy("__range").collect()  # at most as many as ranges of the 20 * wanted candidates
    offsets, seen = [], 0
    for r in counts:
        if seen < wanted:
            offsets.append((r["__range"], seen))
        seen += r["count"]
    if seen < wanted:
        raise EngineError("RULE_FEASIBILITY_EXHAUSTED", f"{seen} of {wanted} rows", accepted=seen)
    starts = candidates.sparkSession.createDataFrame(offsets or [(-1, 0)], "__range long, __offset long")
    numbered = ranged.join(F.broadcast(starts), "__range").withColumn("accepted_id", F.row_number().over(Window.partitionBy("__range").orderBy(index)) - 1 + F.col("__offset"))
    return numbered.where(F.col("accepted_id") < wanted).drop("__range", "__offset")


__all__ = ["ConditionalSet", "accepted", "audit", "audited_source", "delta", "denominators", "domain_of", "drops", "holds", "identifier", "kept", "masked", "model_view", "rebuilt", "two_valued", "validated", "violated"]
