"""Relations of column pairs: correlations, joint and conditional distributions, and what a table omits from them."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabforge.functions.cells import numeric
from tabforge.operators import ranges
from tabforge.operators.distances import OTHER, top_values
from tabforge.schema import ColumnSchema, EngineError

MOST_PAIRS, TOP, INNER_EDGES, TOGETHER = 2415, 50, 19, 300
FAMILIES = ("numeric_numeric", "categorical_categorical", "mixed")


def q(name: str) -> Column:
    return F.col(f"`{name}`")


def pair_families(schema: Sequence[ColumnSchema]) -> list[tuple[str, str, str]]:
    """(family, left, right) of all pairs of modelled numbers and categories; at most 2,415."""
    numbers = {c.name for c in schema if c.kind in ("integer", "fixed_decimal", "float", "date", "datetime")}
    own = [c.name for c in schema if c.name in numbers or c.kind in ("categorical", "boolean")]
    out = [("numeric_numeric" if a in numbers and b in numbers else "mixed" if (a in numbers) != (b in numbers) else "categorical_categorical", a, b) for a, b in combinations(own, 2)]
    if len(out) > MOST_PAIRS:
        raise EngineError("RESOURCE_LIMIT", f"more than {MOST_PAIRS} pairs")
    return out


def _correlation(a: Column, b: Column) -> Column:
    """Pearson over complete pairs; null for a constant side or fewer than two pairs."""
    x, y = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    return F.when((F.min(x) < F.max(x)) & (F.min(y) < F.max(y)), F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))


def pearson(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """(left, right, r): some hundred pairs to a job, each one aggregation without a shuffle of rows."""
    out = None
    for lo in range(0, len(pairs), TOGETHER):
        part = pairs[lo : lo + TOGETHER]
        columns = sorted({c for p in part for c in p})
        one = df.select(*(q(c).cast("double").alias(c) for c in columns)).agg(*(_correlation(q(a), q(b)).alias(f"r{i}") for i, (a, b) in enumerate(part)))
        rows = one.select(F.explode(F.array(*(F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(part)))).alias("x")).select("x.*")
        out = rows if out is None else out.union(rows)
    return out


def average_ranks(df: DataFrame, column: str, name: str) -> DataFrame:
    """(column value, average rank) by counts of distinct values in ranges: a window over the histogram, not over rows."""
    return ranges.placed(df, {column: q(column)}).select(F.col("value").alias("__v"), (F.col("before") + (F.col("n") + 1) / 2).alias(name))


def spearman(df: DataFrame, left: str, right: str) -> DataFrame:
    """(left, right, rho): Pearson of average ranks over complete pairs."""
    both = df.select(q(left).cast("double").alias("a"), q(right).cast("double").alias("b")).where("a is not null and b is not null")
    ranked = both.join(average_ranks(both, "a", "ra"), F.col("a") == F.col("__v")).drop("__v").join(average_ranks(both, "b", "rb"), F.col("b") == F.col("__v"))
    return ranked.agg(_correlation(F.col("ra"), F.col("rb")).alias("rho")).select(F.lit(left).alias("left"), F.lit(right).alias("right"), "rho")


def _token(c: Column, tops: Sequence[str]) -> Column:
    text = c.cast("string")
    return F.when(text.isNull(), F.lit("__MISSING__")).when(text.isin(list(tops)), text).otherwise(OTHER)


def tops_of(df: DataFrame, columns: Sequence[str], top: int = TOP) -> dict[str, list[str]]:
    """Each column's top values: at most ``top`` of each reach the driver."""
    out: dict[str, list[str]] = {c: [] for c in columns}
    for r in top_values(df, {c: q(c) for c in columns}, top).orderBy("column", "rank").collect():
        out[r["column"]].append(r["value"])
    return out


def joint_tvd(a: DataFrame, b: DataFrame, left: str, right: str, top: int = TOP) -> DataFrame:
    """(left, right, distance): total variation over the pair's cells; categories are the first table's top values."""
    tops = tops_of(a, [left, right], top)
    cells = lambda df, side: df.select(_token(q(left), tops[left]).alias("x"), _token(q(right), tops[right]).alias("y"), F.lit(side).alias("side"))
    counts = cells(a, 0).union(cells(b, 1)).groupBy("x", "y").agg(F.count_if(F.col("side") == 0).alias("a"), F.count_if(F.col("side") == 1).alias("b"))
    totals = counts.agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    return counts.crossJoin(F.broadcast(totals)).agg((F.sum(F.abs(F.col("a") / F.col("na") - F.col("b") / F.col("nb"))) / 2).alias("distance")).select(F.lit(left).alias("left"), F.lit(right).alias("right"), "distance")


def edges(df: DataFrame, column: str, inner: int = INNER_EDGES) -> list[float]:
    """The distinct inner quantiles, exact."""
    at = [i / (inner + 1) for i in range(1, inner + 1)]
    return sorted(set(ranges.quantiles_of(df, {column: q(column)}, at)[column] or []))


def binned(c: Column, cuts: Sequence[float]) -> Column:
    """How many edges are at most the value; the one beyond the last for nulls and NaN."""
    x = c.cast("double")
    n = F.size(F.filter(F.array(*map(F.lit, cuts)) if cuts else F.array().cast("array<double>"), lambda e: e <= x))
    return F.when(x.isNull() | F.isnan(x), len(cuts) + 1).otherwise(n)


def conditional_tvd(a: DataFrame, b: DataFrame, number: str, category: str, top: int = TOP) -> DataFrame:
    """(number, category, distance): total variation of the category inside each bin of the number, weighted by the first
    table's bins; a bin that the second table lacks counts in full."""
    cuts, tops = edges(a, number), tops_of(a, [category], top)[category]
    cells = lambda df, side: df.select(binned(q(number), cuts).alias("x"), _token(q(category), tops).alias("y"), F.lit(side).alias("side"))
    counts = cells(a, 0).union(cells(b, 1)).groupBy("x", "y").agg(F.count_if(F.col("side") == 0).alias("a"), F.count_if(F.col("side") == 1).alias("b"))
    w = Window.partitionBy("x")  # at most top + 2 rows a bin
    shares = counts.withColumn("na", F.sum("a").over(w)).withColumn("nb", F.sum("b").over(w)).where("na > 0")
    per_bin = shares.groupBy("x").agg(F.max("na").alias("na"), F.when(F.max("nb") == 0, F.lit(1.0)).otherwise(F.sum(F.abs(F.col("a") / F.col("na") - F.when(F.col("nb") > 0, F.col("b") / F.col("nb")).otherwise(0.0))) / 2).alias("d"))
    return per_bin.agg((F.sum(F.col("na") * F.col("d")) / F.sum("na")).alias("distance")).select(F.lit(number).alias("number"), F.lit(category).alias("category"), "distance")


def compared(train: DataFrame, holdout: DataFrame, synthetic: DataFrame, schema: Sequence[ColumnSchema], top: int = TOP) -> DataFrame:
    """(family, left, right, control, synthetic): how far each pair's relation in holdout and synthetic rows is from that in training rows.

    Two numbers: the difference of their correlations.  Two categories: total variation over their cells.  A number and a category: total
    variation of the category inside each of the number's bins, weighted by the bins' training rows.  Categories (top values) and bins
    (inner quantiles) are those of the training rows.  All pairs share one scan a table and one shuffle of counts.
    """
    own = {c.name: c for c in schema}
    families = pair_families(schema)
    sides = {"t": train, "h": holdout, "s": synthetic}
    found = [part for part in (_correlations(sides, [f for f in families if f[0] == FAMILIES[0]], own), _variations(sides, [f for f in families if f[0] != FAMILIES[0]], own, top)) if part is not None]
    if not found:
        return train.sparkSession.createDataFrame([], "family string, left string, right string, control double, synthetic double")
    return found[0] if len(found) == 1 else found[0].unionByName(found[1])


def _correlations(sides: dict[str, DataFrame], pairs: Sequence[tuple[str, str, str]], own: dict[str, ColumnSchema]) -> DataFrame | None:
    if not pairs:
        return None
    names = sorted({n for _, a, b in pairs for n in (a, b)})
    r = {k: pearson(df.select(*(numeric(q(n), own[n]).alias(n) for n in names)), [(a, b) for _, a, b in pairs]).withColumnRenamed("r", k) for k, df in sides.items()}
    gap = lambda k: F.abs(F.col(k) - F.col("t"))
    return r["t"].join(r["h"], ["left", "right"]).join(r["s"], ["left", "right"]).select(F.lit(FAMILIES[0]).alias("family"), "left", "right", gap("h").alias("control"), gap("s").alias("synthetic"))


def _variations(sides: dict[str, DataFrame], pairs: Sequence[tuple[str, str, str]], own: dict[str, ColumnSchema], top: int) -> DataFrame | None:
    if not pairs:
        return None
    names = sorted({n for _, a, b in pairs for n in (a, b)})
    numbers = [n for n in names if own[n].kind in ("integer", "fixed_decimal", "float", "date", "datetime")]
    tops = tops_of(sides["t"], [n for n in names if n not in numbers], top)
    cuts = ranges.quantiles_of(sides["t"], {n: numeric(q(n), own[n]) for n in numbers}, [i / (INNER_EDGES + 1) for i in range(1, INNER_EDGES + 1)])
    state = {n: binned(numeric(q(n), own[n]), sorted(set(cuts[n] or []))).cast("string") if n in numbers else _token(q(n), tops[n]) for n in names}

    def cell(i: int, a: str, b: str) -> Column:
        """The bin that a category is seen in (one for two categories) and what is counted there."""
        group, value = (q(a), q(b)) if a in numbers else (q(b), q(a)) if b in numbers else (F.lit(""), F.to_json(F.array(q(a), q(b))))
        return F.struct(F.lit(i).alias("pair"), group.alias("group"), value.alias("value"))

    cells = F.array(*(cell(i, a, b) for i, (_, a, b) in enumerate(pairs)))
    long = None
    for k, df in sides.items():
        part = df.select(*(e.alias(n) for n, e in state.items())).select(F.lit(k).alias("side"), F.explode(cells).alias("c"))
        long = part if long is None else long.union(part)
    counts = long.groupBy("c.pair", "c.group", "c.value").agg(*(F.count_if(F.col("side") == k).alias(k) for k in sides))
    w = Window.partitionBy("pair", "group")  # at most (top + 2) squared rows
    shares = counts.select("*", *(F.sum(k).over(w).alias(f"n{k}") for k in sides)).where("nt > 0")
    gap = lambda k: F.when(F.max(f"n{k}") == 0, 1.0).otherwise(F.sum(F.abs(F.col("t") / F.col("nt") - F.when(F.col(f"n{k}") > 0, F.col(k) / F.col(f"n{k}")).otherwise(0.0))) / 2)
    groups = shares.groupBy("pair", "group").agg(F.max("nt").alias("n"), gap("h").alias("h"), gap("s").alias("s"))
    mean = groups.groupBy("pair").agg(*((F.sum(F.col("n") * F.col(k)) / F.sum("n")).alias(name) for k, name in (("h", "control"), ("s", "synthetic"))))
    labels = F.array(*(F.struct(F.lit(f).alias("family"), F.lit(a).alias("left"), F.lit(b).alias("right")) for f, a, b in pairs))
    return mean.select(labels[F.col("pair")].alias("l"), "control", "synthetic").select("l.*", "control", "synthetic")
