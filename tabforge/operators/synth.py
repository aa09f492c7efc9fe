"""Synthesizers: cyclic (deterministic, for tests) and an autoregressive conditional-frequency model.

The second stands in for an external neural engine: columns in order, numbers in quantile bins, each column's distribution given the one
before it, sampled by inverse distribution functions of hashed uniforms.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabforge.operators.normalize import numbered
from tabforge.schema import CANDIDATE_INDEX, ColumnSchema

BINS = 32
#: Parts of [0, 1) that a distribution is dealt into.
SLOTS = 64


class Model(Protocol):
    def generate(self, start: int, stop: int) -> DataFrame:
        """Candidates with indices from start up to stop."""


@dataclass(frozen=True)
class Cyclic:
    """Training rows over and over, from ``seed`` modulo their number."""

    rows: DataFrame
    n: int
    seed: int

    @classmethod
    def fit(cls, df: DataFrame, order: Sequence[str], seed: int) -> Cyclic:
        rows = numbered(df, order, "__place").persist()
        return cls(rows, rows.count(), seed)

    def generate(self, start: int, stop: int) -> DataFrame:
        wanted = self.rows.sparkSession.range(start, stop).withColumnRenamed("id", CANDIDATE_INDEX)
        place = F.pmod(F.lit(self.seed % self.n) + F.col(CANDIDATE_INDEX), F.lit(self.n))
        return wanted.withColumn("__place", place).join(self.rows, "__place").drop("__place")


def shards(wanted: int, count: int, seed: bytes, factor: int = 20) -> list[tuple[int, int, int]]:
    """(start, stop, seed) of ``count`` disjoint ranges over ``factor`` times the wanted rows, with different 32-bit seeds."""
    total, out, used = wanted * factor, [], set()
    for i in range(count):
        start, stop, n = total * i // count, total * (i + 1) // count, 0
        while (s := int.from_bytes(hashlib.sha256(seed + i.to_bytes(8, "big") + n.to_bytes(8, "big")).digest()[:4], "big")) in used:
            n += 1
        used.add(s)
        out.append((start, stop, s))
    return out


def uniform(index: Column, salt: str, seed: int) -> Column:
    """A number in [0, 1) that depends on the index, a salt and the seed only."""
    return F.pmod(F.xxhash64(index, F.lit(salt), F.lit(seed)), F.lit(1 << 53)) / F.lit(float(1 << 53))


@dataclass(frozen=True)
class Conditional:
    """Each column given the column before it.

    ``tables[i]`` has (given, slot, state, low, high): cumulative shares of a column's states for each state of the column before, once for
    each slot of [0, 1) that they touch, so that candidates of one frequent state meet its distribution in many tasks.  States are
    quantile bins of numbers and all values of others.
    """

    schema: tuple[ColumnSchema, ...]
    tables: tuple[DataFrame, ...]
    cuts: dict[str, list[float]]
    seed: int

    @classmethod
    def fit(cls, df: DataFrame, schema: Sequence[ColumnSchema], seed: int, bins: int = BINS) -> Conditional:
        numbers = [c.name for c in schema if c.kind in ("integer", "fixed_decimal", "float")]
        cuts: dict[str, list[float]] = {}
        if numbers:
            at = [i / bins for i in range(bins + 1)]
            one = df.agg(*(F.percentile_approx(F.col(c).cast("double"), at, 10_000).alias(c) for c in numbers)).first()
            cuts = {c: sorted(set(one[c] or [0.0])) for c in numbers}
        state = {c.name: cls._state(c, cuts) for c in schema}
        tables, before = [], None
        for c in schema:
            given = F.lit("") if before is None else state[before.name]
            counts = df.select(given.alias("given"), state[c.name].alias("state")).groupBy("given", "state").agg(F.count(F.lit(1)).alias("n"))
            rank = F.row_number().over(Window.partitionBy("given").orderBy(F.desc("n"), "state"))
            top = counts.withColumn("__r", rank)
            w = Window.partitionBy("given").orderBy("__r")
            total = F.sum("n").over(Window.partitionBy("given"))
            shares = top.select("given", "state", ((F.sum("n").over(w) - F.col("n")) / total).alias("low"), (F.sum("n").over(w) / total).alias("high"))
            slots = F.sequence(F.floor(F.col("low") * SLOTS), F.least(F.ceil(F.col("high") * SLOTS), F.lit(SLOTS)) - 1)
            tables.append(shares.withColumn("slot", F.explode(slots)).persist())
            before = c
        return cls(tuple(schema), tuple(tables), cuts, seed)

    @staticmethod
    def _state(c: ColumnSchema, cuts: dict[str, list[float]]) -> Column:
        if c.name in cuts:
            x = F.col(c.name).cast("double")
            inner = cuts[c.name][1:-1]
            bin_ = F.size(F.filter(F.array(*map(F.lit, inner)), lambda e: e <= x)) if inner else F.lit(0)
            return F.when(x.isNull(), "null").otherwise(bin_.cast("string"))
        return F.when(F.col(c.name).isNull(), "null").otherwise(F.concat(F.lit("v"), F.col(c.name).cast("string")))

    def generate(self, start: int, stop: int) -> DataFrame:
        spark: SparkSession = self.tables[0].sparkSession
        out = spark.range(start, stop).withColumnRenamed("id", CANDIDATE_INDEX)
        index, before = F.col(CANDIDATE_INDEX), None
        for c, table in zip(self.schema, self.tables, strict=True):
            u = uniform(index, c.name, self.seed)
            given = F.lit("") if before is None else F.col(f"__s_{before.name}")
            t = table.select(F.col("given").alias("__g"), F.col("slot").alias("__slot"), F.col("state").alias(f"__s_{c.name}"), F.col("low").alias("__low"), F.col("high").alias("__high"))
            out = out.withColumn("__u", u).join(t, (given == F.col("__g")) & (F.floor(F.col("__u") * SLOTS) == F.col("__slot")) & (F.col("__u") >= F.col("__low")) & (F.col("__u") < F.col("__high"))).drop("__g", "__slot", "__low", "__high", "__u")
            before = c
        return out.select(index, *(self._value(c, index).alias(c.name) for c in self.schema))

    def _value(self, c: ColumnSchema, index: Column) -> Column:
        s = F.col(f"__s_{c.name}")
        if c.name in self.cuts:
            cuts = self.cuts[c.name]
            low, high = (F.element_at(F.array(*map(F.lit, cuts)), F.least(s.try_cast("int") + 1 + k, F.lit(len(cuts)))) for k in (0, 1))
            x = low + (high - low) * uniform(index, c.name + "/in", self.seed)
            return F.when(s == "null", F.lit(None)).otherwise(F.round(x, 0 if c.kind == "integer" else c.decimal_places if c.kind == "fixed_decimal" else 6)).cast(c.spark_type)
        return F.when(s == "null", F.lit(None)).otherwise(F.substring(s, 2, 1 << 30)).cast(c.spark_type)
