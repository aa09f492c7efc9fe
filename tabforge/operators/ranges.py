"""Order statistics in ranges of values: no column's values meet in one task, and no aggregate holds them all."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGES = 256


def place(value: Column, cuts: Column, ranges: int = RANGES) -> Column:
    """How many of an ascending array's (at most ``ranges`` - 1) entries are less than the value, by bisection; ``ranges`` is a power of two."""
    steps = [ranges >> i for i in range(1, ranges.bit_length())]
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda p, s: F.when(value > F.get(cuts, p + s - 1), p + s).otherwise(p))


def long_values(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """(column, value) of all numbers that are there."""
    return df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), e.cast("double").alias("value")) for c, e in columns.items()))).alias("r")).select("r.*").where("value is not null")


def placed(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """(column, value, n, before, total): each distinct value, its rows, the rows with lesser values, and all rows of the column.

    Ranges are cut at approximate quantiles of the distinct values: whatever the cuts, the counts are exact.
    """
    hist = long_values(df, columns).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    cuts = hist.groupBy("column").agg(F.percentile_approx("value", [i / RANGES for i in range(1, RANGES)], 10 * RANGES).alias("cuts"))
    ranged = hist.join(F.broadcast(cuts), "column").select("column", "value", "n", place(F.col("value"), F.col("cuts")).alias("range"))  # one row a column
    parts = ranged.groupBy("column", "range").agg(F.sum("n").alias("s"))
    order, every = Window.partitionBy("column").orderBy("range"), Window.partitionBy("column")  # RANGES rows a column
    offsets = parts.select("column", "range", (F.sum("s").over(order) - F.col("s")).alias("offset"), F.sum("s").over(every).alias("total"))
    inside = Window.partitionBy("column", "range").orderBy("value")
    running = ranged.withColumn("inside", F.sum("n").over(inside) - F.col("n"))
    return running.join(F.broadcast(offsets), ["column", "range"]).select("column", "value", "n", (F.col("inside") + F.col("offset")).alias("before"), "total")


def interpolated(low: Column, high: Column, share: Column) -> Column:
    """A value between two neighbours, low * (1 - share) + high * share with the first product fused into the sum, as DuckDB has it: the last
    bit counts where an edge meets rows.  Through a Java method: for a few rows only."""
    return F.when(low.isNotNull() & high.isNotNull(), F.java_method(F.lit("java.lang.Math"), F.lit("fma"), low, 1 - share, high * share).cast("double"))


def quantiles(df: DataFrame, columns: dict[str, Column], at: Sequence[float]) -> DataFrame:
    """(column, q0, q1, ...): linear-interpolated quantiles of each column, exact; null where it has no values."""
    found = placed(df, columns)
    picked = []
    for i, p in enumerate(at):
        position = F.lit(float(p)) * (F.col("total") - 1)
        for name, index in (("low", F.floor(position)), ("high", F.ceil(position))):
            picked.append(F.max(F.when((F.col("before") <= index) & (index < F.col("before") + F.col("n")), F.col("value"))).alias(f"{name}{i}"))
    one = found.groupBy("column").agg(F.max("total").alias("total"), *picked)
    share = lambda p: F.lit(float(p)) * (F.col("total") - 1) - F.floor(F.lit(float(p)) * (F.col("total") - 1))
    values = one.select("column", *(interpolated(F.col(f"low{i}"), F.col(f"high{i}"), share(p)).alias(f"q{i}") for i, p in enumerate(at)))
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    return names.join(F.broadcast(values), "column", "left")  # one row a column


def quantiles_of(df: DataFrame, columns: dict[str, Column], at: Sequence[float]) -> dict[str, list[float] | None]:
    """The same on the driver: a few numbers a column, or None where it has no values."""
    if not columns:
        return {}
    return {r["column"]: None if r["q0"] is None else list(r)[1:] for r in quantiles(df, columns, at).collect()}
