"""Per-column distances between train, holdout and synthetic rows.

All columns go through one long table of (column, value) histograms: one shuffle of pre-aggregated counts for
Kolmogorov-Smirnov distances of numbers, one for total variation of categories.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabforge.functions.cells import numeric
from tabforge.operators.ranges import place
from tabforge.schema import ColumnSchema

TOP = 100
OTHER = "__OTHER__"
NUMERIC_KINDS = ("integer", "fixed_decimal", "float", "date", "datetime")
CATEGORY_KINDS = ("categorical", "boolean")
BOOTSTRAP_REPS = 500


def q(name: str) -> Column:
    return F.col(f"`{name}`")


def _long(df: DataFrame, columns: dict[str, Column], kind: str) -> DataFrame:
    return df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), e.cast(kind).alias("value")) for c, e in columns.items()))).alias("r")).select("r.*").where("value is not null")


def _sides(a: DataFrame, b: DataFrame, columns: dict[str, Column], kind: str) -> DataFrame:
    """(column, value, a, b): counts of each value on both sides, from one shuffle."""
    both = _long(a, columns, kind).withColumn("side", F.lit(0)).unionByName(_long(b, columns, kind).withColumn("side", F.lit(1)))
    return both.groupBy("column", "value").agg(F.count_if(F.col("side") == 0).cast("long").alias("a"), F.count_if(F.col("side") == 1).cast("long").alias("b"))


def ks(a: DataFrame, b: DataFrame, columns: dict[str, Column], ranges: int = 256) -> DataFrame:
    """(column, distance): the greatest difference of the two empirical distributions; null if a side has no values.

    Running sums are two-level: within ranges of values (cut at approximate quantiles of each column) and over the ranges'
    totals, so that no column's values need to meet in one task.
    """
    hist = _sides(a, b, columns, "double")
    cuts = hist.groupBy("column").agg(F.percentile_approx("value", [i / ranges for i in range(1, ranges)], 10 * ranges).alias("cuts"))
    ranged = hist.join(F.broadcast(cuts), "column").withColumn("range", place(F.col("value"), F.col("cuts"), ranges)).drop("cuts")
    parts = ranged.groupBy("column", "range").agg(F.sum("a").alias("pa"), F.sum("b").alias("pb"))
    order = Window.partitionBy("column").orderBy("range")
    all_ = Window.partitionBy("column")
    totals = parts.select("column", "range", (F.sum("pa").over(order) - F.col("pa")).alias("ba"), (F.sum("pb").over(order) - F.col("pb")).alias("bb"), F.sum("pa").over(all_).alias("na"), F.sum("pb").over(all_).alias("nb"))
    within = Window.partitionBy("column", "range").orderBy("value")
    running = ranged.select("column", "range", F.sum("a").over(within).alias("ra"), F.sum("b").over(within).alias("rb")).join(F.broadcast(totals), ["column", "range"])
    gap = F.when((F.col("na") > 0) & (F.col("nb") > 0), F.abs((F.col("ra") + F.col("ba")) / F.col("na") - (F.col("rb") + F.col("bb")) / F.col("nb")))
    found = running.groupBy("column").agg(F.max(gap).alias("distance"))
    return _every(a, columns, found)


def _every(df: DataFrame, columns: dict[str, Column], found: DataFrame) -> DataFrame:
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    return names.join(F.broadcast(found), "column", "left")


def top_values(df: DataFrame, columns: dict[str, Column], top: int = TOP) -> DataFrame:
    """(column, value, n, rank): each column's most frequent values, ties by value."""
    counts = _long(df, columns, "string").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), "value"))).where(F.col("rank") <= top)


def grouped(df: DataFrame, columns: dict[str, Column], tops: DataFrame) -> DataFrame:
    """(column, value, n) with values beyond the top ones as one other value; the top list is small (top values a column)."""
    counts = _long(df, columns, "string").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    known = F.broadcast(tops.select("column", "value", F.lit(True).alias("known")))
    return counts.join(known, ["column", "value"], "left").groupBy("column", F.when(F.col("known"), F.col("value")).otherwise(OTHER).alias("value")).agg(F.sum("n").alias("n"))


def tvd(a: DataFrame, b: DataFrame, columns: dict[str, Column], tops: DataFrame) -> DataFrame:
    """(column, distance): half the summed differences of shares over top values and the rest; null if a side is empty."""
    both = grouped(a, columns, tops).withColumn("side", F.lit(0)).unionByName(grouped(b, columns, tops).withColumn("side", F.lit(1)))
    cells = both.groupBy("column", "value").agg(F.sum(F.when(F.col("side") == 0, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("side") == 1, F.col("n")).otherwise(0)).alias("b"))
    w = Window.partitionBy("column")  # at most the top values and one more a column
    shares = cells.withColumn("na", F.sum("a").over(w)).withColumn("nb", F.sum("b").over(w))
    found = shares.groupBy("column").agg(F.when((F.max("na") > 0) & (F.max("nb") > 0), F.sum(F.abs(F.col("a") / F.col("na") - F.col("b") / F.col("nb"))) / 2).alias("distance"))
    return _every(a, columns, found)


def omitted_mass(df: DataFrame, columns: dict[str, Column], top: int = TOP) -> DataFrame:
    """(column, omitted): the share of values beyond the top ones."""
    total = _long(df, columns, "string").groupBy("column").agg(F.count(F.lit(1)).alias("total"))
    return top_values(df, columns, top).groupBy("column").agg(F.sum("n").alias("kept")).join(F.broadcast(total), "column").select("column", ((F.col("total") - F.col("kept")) / F.col("total")).alias("omitted"))


def missing(a: DataFrame, b: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, difference): absolute difference of null rates."""
    from tabforge.operators.profile import _rows

    rate = lambda df: _rows(df.select(*map(q, columns)), {c: {"rate": F.avg(q(c).isNull().cast("double"))} for c in columns})
    return rate(a).withColumnRenamed("rate", "ra").join(rate(b).withColumnRenamed("rate", "rb"), "column").select("column", F.abs(F.col("ra") - F.col("rb")).alias("difference"))


def primary(train: DataFrame, holdout: DataFrame, synthetic: DataFrame, schema: Sequence[ColumnSchema], top: int = TOP) -> DataFrame:
    """(column, baseline, synthetic, excess, missing_baseline, missing_synthetic).

    Baseline is train against holdout, synthetic is holdout against synthetic, excess what the latter is more.  Numbers and times by
    Kolmogorov-Smirnov, categories by total variation over the training rows' top values; identifiers and text are left out.
    """
    numbers = {c.name: numeric(q(c.name), c) for c in schema if c.kind in NUMERIC_KINDS}
    categories = {c.name: q(c.name) for c in schema if c.kind in CATEGORY_KINDS}
    parts = []
    if numbers:
        parts.append((ks(train, holdout, numbers), ks(holdout, synthetic, numbers)))
    if categories:
        tops = top_values(train, categories, top)
        parts.append((tvd(train, holdout, categories, tops), tvd(holdout, synthetic, categories, tops)))
    out = None
    for base, syn in parts:
        rows = base.withColumnRenamed("distance", "baseline").join(syn.withColumnRenamed("distance", "synthetic"), "column")
        out = rows if out is None else out.union(rows)
    names = [*numbers, *categories]
    excess = F.when(F.col("baseline").isNotNull() & F.col("synthetic").isNotNull(), F.greatest(F.lit(0.0), F.col("synthetic") - F.col("baseline")))
    gaps = missing(train, holdout, names).withColumnRenamed("difference", "missing_baseline").join(missing(holdout, synthetic, names).withColumnRenamed("difference", "missing_synthetic"), "column")
    return out.withColumn("excess", excess).join(gaps, "column")


def summary(distances: DataFrame) -> DataFrame:
    """(n_columns, median, p95, greatest) of the excess over columns that have one."""
    e = F.col("excess")
    return distances.where(e.isNotNull()).agg(F.count(F.lit(1)).alias("n_columns"), F.percentile(e, F.lit(0.5)).alias("median"), F.percentile(e, F.lit(0.95)).alias("p95"), F.max(e).alias("greatest"))


def bootstrap_ks(a: DataFrame, b: DataFrame, columns: dict[str, Column], reps: int = BOOTSTRAP_REPS, seed: int = 0, bins: int = 4096) -> DataFrame:
    """(column, distance, low, high): percentile interval of the distance, by multinomial resampling of histograms.

    Rows are never resampled: each side's counts over at most ``bins`` quantile bins are, in one task a column.  The distance over bins
    equals the exact one where a column has no more distinct values than bins.
    """
    hist = _sides(a, b, columns, "double")
    cuts = hist.groupBy("column").agg(F.percentile_approx("value", [i / bins for i in range(1, bins)], 10 * bins).alias("cuts"))
    binned = hist.join(F.broadcast(cuts), "column").withColumn("bin", F.size(F.filter("cuts", lambda c: c < F.col("value")))).groupBy("column", "bin").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))

    def resample(pdf: pd.DataFrame) -> pd.DataFrame:
        import zlib

        pdf = pdf.sort_values("bin")
        x, y = pdf["a"].to_numpy(float), pdf["b"].to_numpy(float)
        if not x.sum() or not y.sum():
            return pd.DataFrame({"column": [pdf["column"].iloc[0]], "distance": [None], "low": [None], "high": [None]})
        draw = np.random.default_rng([seed, zlib.crc32(pdf["column"].iloc[0].encode())])
        one = lambda p, r: np.abs(np.cumsum(p / p.sum()) - np.cumsum(r / r.sum())).max()
        reps_ = [one(draw.multinomial(int(x.sum()), x / x.sum()).astype(float), draw.multinomial(int(y.sum()), y / y.sum()).astype(float)) for _ in range(reps)]
        low, high = np.quantile(reps_, [0.025, 0.975])
        return pd.DataFrame({"column": [pdf["column"].iloc[0]], "distance": [one(x, y)], "low": [low], "high": [high]})

    return binned.groupBy("column").applyInPandas(resample, "column string, distance double, low double, high double")
