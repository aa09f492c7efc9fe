"""Keyed partition and samples: deterministic, without joins to score tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabforge.functions.keyed import hmac_hex, in_train, priority
from tabforge.schema import ROW_ID, EngineError

SALTS = 64


def partitioned(df: DataFrame, key: bytes, row_id: str = ROW_ID) -> DataFrame:
    """Adds ``in_train``."""
    return df.withColumn("in_train", in_train(F.col(row_id), key))


def train(df: DataFrame, key: bytes, row_id: str = ROW_ID) -> DataFrame:
    return df.where(in_train(F.col(row_id), key))


def holdout(df: DataFrame, key: bytes, row_id: str = ROW_ID) -> DataFrame:
    return df.where(~in_train(F.col(row_id), key))


def counts(df: DataFrame, key: bytes, row_id: str = ROW_ID) -> DataFrame:
    """(n_train, n_holdout)"""
    t = in_train(F.col(row_id), key)
    return df.select(t.alias("t")).agg(F.count_if("t").cast("long").alias("n_train"), F.count_if(~F.col("t")).cast("long").alias("n_holdout"))


def priority_sample(df: DataFrame, key: bytes, most: int, row_id: str = ROW_ID) -> DataFrame:
    """The ``most`` training rows that come first by keyed priority, with ``priority``: a distributed top-k, not a global window."""
    return train(df, key, row_id).withColumn("priority", priority(F.col(row_id), key)).orderBy("priority", row_id).limit(most)


def hamilton(strata: DataFrame, by: Sequence[str], target: int) -> DataFrame:
    """Adds ``quota`` to (strata..., n): largest remainders, ties by the tagged stratum; quotas sum to the target exactly.

    The table has one row for each stratum, so its window is small.
    """
    tag = F.to_json(F.array(*(F.when(F.col(c).isNull(), F.array(F.lit("null"))).otherwise(F.array(F.lit("value"), F.col(c).cast("string"))) for c in by)))
    pop = F.sum("n").over(Window.partitionBy())
    whole = strata.withColumn("__pop", pop).withColumn("__k", F.least(F.lit(target).cast("long"), F.col("__pop")))
    whole = whole.withColumn("__floor", F.expr("cast(cast(n as decimal(38,0)) * __k div __pop as long)")).withColumn("__rest", F.expr("cast(cast(n as decimal(38,0)) * __k % __pop as long)")).withColumn("__tag", tag)
    left = F.col("__k") - F.sum("__floor").over(Window.partitionBy())
    extra = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("__rest"), "__tag")) <= left
    return whole.withColumn("quota", F.col("__floor") + extra.cast("long")).select(*by, "n", "quota")


def stratified_sample(df: DataFrame, key: bytes, target: int, by: Sequence[str], row_id: str = ROW_ID) -> DataFrame:
    """Training rows by Hamilton quotas of at most two strata columns (nulls are strata), the first by priority in each.

    Rows are ranked in salted parts of each stratum first, and only the parts' first rows together: a hot stratum is never in one task.
    """
    if not 1 <= len(by) <= 2:
        raise EngineError("RESOURCE_LIMIT", "one or two strata columns")
    own = train(df, key, row_id).withColumn("priority", priority(F.col(row_id), key))
    quotas = hamilton(own.groupBy(*by).agg(F.count(F.lit(1)).alias("n")), by, target)
    small = quotas.select(*(F.col(c).alias(f"__s{i}") for i, c in enumerate(by)), F.col("quota").alias("__quota"))
    on = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"__s{i}")) for i, c in enumerate(by)))
    joined = own.join(small, on).withColumn("__salt", F.pmod(F.xxhash64(row_id), F.lit(SALTS)))
    for parts in ([*by, "__salt"], by):
        rank = F.row_number().over(Window.partitionBy(*parts).orderBy("priority", row_id))
        joined = joined.withColumn("__rank", rank).where(F.col("__rank") <= F.col("__quota"))
    return joined.drop("__rank", "__quota", "__salt", *(f"__s{i}" for i in range(len(by))))


def smallest_hmac(df: DataFrame, key: bytes, most: int, identity: str, domain: bytes = b"tabforge/sample/v1\0") -> DataFrame:
    """The rows with the ``most`` smallest keyed hashes of an identity column, in its order."""
    h = hmac_hex(F.col(identity).cast("string").cast("binary"), key, domain)
    return df.withColumn("__h", h).orderBy("__h", identity).limit(most).drop("__h").orderBy(identity)


def content_selected(df: DataFrame, key: bytes, rate: float, columns: Sequence[str]) -> DataFrame:
    """Rows whose keyed hash of their JSON (columns by name) is below the rate: by content alone, never cut to a number."""
    from fractions import Fraction

    text = F.to_json(F.struct(*(F.col(c) for c in sorted(columns))), {"ignoreNullFields": "false"})
    if rate >= 1:
        return df
    below = format(int(Fraction(str(rate)) * (1 << 256)), "064x")
    return df.where(hmac_hex(text.cast("binary"), key) < below)
