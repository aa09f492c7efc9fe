"""Profiling of raw or typed tables: aggregates of all columns in one pass, frequencies of all columns in one shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabforge.functions.cells import BOOLEAN_RE, DATE_RE, DATETIME_RE, FLOAT_RE, INTEGER_RE, is_null_text
from tabforge.operators import ranges
from tabforge.schema import ROW_ID

FREQUENT = 256
#: Columns whose aggregates go into one job: more would leave whole-stage code generation.
_TOGETHER = 24


def q(name: str) -> Column:
    return F.col(f"`{name}`")


def parse_success(c: Column) -> dict[str, Column]:
    """Whether raw text is of each kind that can be proposed."""
    t = F.trim(c)
    x = t.try_cast("double")
    return {
        "integer": t.rlike(INTEGER_RE) & t.try_cast("bigint").isNotNull(),
        "float": t.rlike(FLOAT_RE) & x.isNotNull() & (F.abs(x) < float("inf")),
        "boolean": F.lower(t).rlike(BOOLEAN_RE),
        "date": t.rlike(DATE_RE) & t.try_cast("date").isNotNull(),
        "datetime": t.rlike(DATETIME_RE) & t.try_cast("timestamp").isNotNull(),
    }


def _rows(df: DataFrame, per_column: dict[str, dict[str, Column]], key: str = "column") -> DataFrame:
    """One row for each column, from one aggregation over all of them."""
    names = list(next(iter(per_column.values())))
    one = df.agg(*(e.alias(f"c{i}_{n}") for i, own in enumerate(per_column.values()) for n, e in own.items()))
    parts = [F.struct(F.lit(c).alias(key), *(F.col(f"c{i}_{n}").alias(n) for n in names)) for i, c in enumerate(per_column)]
    return one.select(F.explode(F.array(*parts)).alias("r")).select("r.*")


def aggregates(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, n, n_null, n_distinct_approx, min_length, max_length, min_text, max_text) of each column.

    Empty text counts as null.  Wide tables take a few jobs of some columns each, each of which reads only its own.
    """
    columns = [c for c in columns or df.columns if c != ROW_ID]
    out = None
    for lo in range(0, len(columns), _TOGETHER):
        own = {}
        for c in columns[lo : lo + _TOGETHER]:
            text = q(c).cast("string")
            value = F.when(~is_null_text(text), text)
            own[c] = {
                "n": F.count(F.lit(1)), "n_null": F.count_if(value.isNull()).cast("long"), "n_distinct_approx": F.approx_count_distinct(value),
                "min_length": F.min(F.length(value)).cast("long"), "max_length": F.max(F.length(value)).cast("long"), "min_text": F.min(value), "max_text": F.max(value),
            }
        part = _rows(df.select(*map(q, own)), own)
        out = part if out is None else out.union(part)
    return out


def parse_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, n_value, integer, float, boolean, date, datetime): how many values parse as each kind."""
    own = {}
    for c in columns:
        text = q(c).cast("string")
        has = ~is_null_text(text)
        own[c] = {"n_value": F.count_if(has).cast("long")} | {k: F.count_if(has & F.coalesce(e, F.lit(False))).cast("long") for k, e in parse_success(text).items()}
    return _rows(df.select(*map(q, columns)), own)


def quantiles(df: DataFrame, columns: Sequence[str], at: Sequence[float] = (0.25, 0.5, 0.75), exact: bool = False) -> DataFrame:
    """(column, quantiles...): linear-interpolated if exact, else within Spark's default accuracy in bounded memory."""
    names = [f"q{round(p * 100):02d}" for p in at]
    if exact:
        found = ranges.quantiles(df, {c: q(c) for c in columns}, at)
        return found.select("column", *(F.col(f"q{i}").alias(n) for i, n in enumerate(names)))
    return _rows(df.select(*map(q, columns)), {c: {n: F.percentile_approx(q(c).cast("double"), p) for n, p in zip(names, at, strict=True)} for c in columns})


def _unpivoted(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value as text or null) of each cell."""
    value = lambda c: F.when(~is_null_text(q(c).cast("string")), q(c).cast("string"))
    return df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), value(c).alias("value")) for c in columns))).alias("r")).select("r.*")


def frequencies(df: DataFrame, columns: Sequence[str], most: int = FREQUENT) -> DataFrame:
    """(column, value, n, rank) of columns with at most ``most`` distinct values; exact distinct counts follow from it.

    One shuffle of pre-aggregated counts for all columns.  Columns with more values drop out: their values are ranked only up to
    one beyond the limit, by a window group limit.
    """
    counts = _unpivoted(df, columns).where("value is not null").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), "value"))).where(F.col("rank") <= most + 1)
    return ranked.withColumn("__all", F.max("rank").over(Window.partitionBy("column"))).where(F.col("__all") <= most).drop("__all")


def proposed_kinds(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, kind, needs_confirmation, alternatives): what a raw column most likely is.

    Digits only: a category to confirm (perhaps an integer or identifier), as codes look like numbers.  Else, if every value parses: boolean, date,
    datetime, float; a text with all values different is an identifier to confirm; few values are a category; the rest text.
    """
    stats = aggregates(df, columns).join(parse_counts(df, columns), "column").join(frequencies(df, columns).groupBy("column").agg(F.count(F.lit(1)).alias("distinct_exact")), "column", "left")
    v, distinct = F.col("n_value"), F.coalesce("distinct_exact", "n_distinct_approx")
    unique = (v > 1) & (distinct >= 0.98 * v)
    kind = F.when(v == 0, "text").when(F.col("integer") == v, "categorical").when(F.col("boolean") == v, "boolean").when(F.col("date") == v, "date").when(F.col("datetime") == v, "datetime").when(F.col("float") == v, "float").when(unique, "identifier").when(distinct <= FREQUENT, "categorical").otherwise("text")
    digits = (v > 0) & (F.col("integer") == v)
    other = F.when(digits, "integer,identifier").when(kind == "identifier", "text").otherwise("")
    return stats.select("column", kind.alias("kind"), (digits | (kind == "identifier")).alias("needs_confirmation"), other.alias("alternatives"))


def fixed_length(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, fixed_length): the length all values share, or null."""
    return aggregates(df, columns).select("column", F.when(F.col("min_length") == F.col("max_length"), F.col("min_length")).alias("fixed_length"))


def row_id_check(df: DataFrame, row_id: str = ROW_ID) -> DataFrame:
    """(n, least, n_distinct, ok) of row ids: none null, none negative, none twice.

    Distinct ids are counted by a shuffle of the ids; nothing is collected.
    """
    one = df.agg(F.count(F.lit(1)).alias("n"), F.min(q(row_id)).alias("least"), F.countDistinct(q(row_id)).alias("n_distinct"))
    return one.select("n", "least", "n_distinct", F.coalesce((F.col("n") == F.col("n_distinct")) & (F.col("least") >= 0), F.col("n") == 0).alias("ok"))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]
