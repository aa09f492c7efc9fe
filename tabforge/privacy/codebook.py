"""Public codebooks: columns as codes over declared categories or bins, and back."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabforge.operators.synth import uniform
from tabforge.plans.rules import normalized
from tabforge.schema import ColumnSchema, EngineError

#: What the marginal synthesizer admits.
MOST_COLUMNS, MOST_STATES, MOST_CELLS, MOST_BYTES = 32, 256, 1_000_000, 512 << 20


@dataclass(frozen=True)
class Codebook:
    """The only domain that private code sees.  A nullable column has one state more, the last, for null."""

    columns: tuple[ColumnSchema, ...]

    @classmethod
    def of(cls, schema: Sequence[ColumnSchema]) -> Codebook:
        for c in schema:
            if (c.public_categories is None) == (c.public_bins is None):
                raise EngineError("DP_METADATA_NOT_PUBLIC", f"{c.name}: either categories or bins are public")
            if c.public_bins is not None:
                edges = [normalized(e, c) for e in c.public_bins]
                if any(a >= b for a, b in zip(edges, edges[1:], strict=False)):
                    raise EngineError("DP_METADATA_NOT_PUBLIC", f"{c.name}: bins ascend")
        return cls(tuple(schema))

    @classmethod
    def from_json(cls, records: Sequence[Mapping]) -> Codebook:
        return cls.of([ColumnSchema(**r) for r in records])

    def values(self, c: ColumnSchema) -> list:
        return [normalized(v, c) for v in (c.public_categories or ())]

    def edges(self, c: ColumnSchema) -> list:
        return [normalized(v, c) for v in (c.public_bins or ())]

    def domain(self) -> dict[str, int]:
        return {c.name: (len(c.public_categories) if c.public_categories is not None else len(c.public_bins) - 1) + c.nullable for c in self.columns}

    @staticmethod
    def _lit(v, c: ColumnSchema) -> Column:
        return F.lit(str(v) if c.kind == "fixed_decimal" else v).cast(c.spark_type)

    def code(self, c: ColumnSchema) -> Column:
        """The state of a value; null outside the domain.  Bins are closed below, the last above too."""
        x, size = F.col(f"`{c.name}`"), self.domain()[c.name]
        if c.public_categories is not None:
            place = F.array_position(F.array(*(self._lit(v, c) for v in self.values(c))), x)
            code = F.when(place > 0, place - 1)
        else:
            edges = [self._lit(e, c) for e in self.edges(c)]
            at = F.size(F.filter(F.array(*edges), lambda e: e <= x)) - 1
            code = F.when((x >= edges[0]) & (x <= edges[-1]), F.least(at, F.lit(len(edges) - 2)))
        return (F.when(x.isNull(), F.lit(size - 1) if c.nullable else F.lit(None)).otherwise(code)).cast("int")

    def encode(self, df: DataFrame) -> DataFrame:
        """Codes of all columns; a value outside its public domain is an error when the rows are read."""
        safe = lambda c: F.coalesce(self.code(c), F.raise_error(F.lit(f"OUTPUT_INVALID: {c.name} is outside its public domain")).cast("int"))
        return df.select(*(safe(c).alias(c.name) for c in self.columns))

    def decode(self, codes: DataFrame, index: str, seed: int = 0) -> DataFrame:
        """Values of codes: categories as declared, bins by a uniform value that depends on index, column and seed only."""
        return codes.select(index, *(self._value(c, F.col(f"`{c.name}`"), uniform(F.col(index), c.name, seed)).alias(c.name) for c in self.columns))

    def _value(self, c: ColumnSchema, code: Column, u: Column) -> Column:
        size = self.domain()[c.name]
        null = (code == size - 1) if c.nullable else F.lit(False)
        if c.public_categories is not None:
            value = F.get(F.array(*(self._lit(v, c) for v in self.values(c))), code)
        else:
            edges = [float((e - dt.date(1970, 1, 1)).days) if c.kind == "date" else e.timestamp() * 1e6 if c.kind == "datetime" else float(e) for e in self.edges(c)]
            low, high = (F.get(F.array(*map(F.lit, edges)), code + k) for k in (0, 1))
            if c.kind == "float":
                value = low + (high - low) * u
            else:
                scale = 10 ** (c.decimal_places or 0)
                last = (code == len(edges) - 2).cast("int")  # the last bin holds its upper edge
                steps = F.floor(u * ((high - low) * scale + last))
                whole = low * scale + steps
                value = F.date_from_unix_date(whole.cast("int")) if c.kind == "date" else F.timestamp_micros(whole.cast("long")) if c.kind == "datetime" else (whole / scale)
        return F.when(null, F.lit(None)).otherwise(value).cast(c.spark_type)

    def state_counts(self, df: DataFrame) -> DataFrame:
        """(column, state, n): exact one-way marginals, for the curator only."""
        coded = self.encode(df)
        long = coded.select(F.explode(F.array(*(F.struct(F.lit(c.name).alias("column"), F.col(f"`{c.name}`").alias("state")) for c in self.columns))).alias("r")).select("r.*")
        return long.groupBy("column", "state").agg(F.count(F.lit(1)).alias("n"))


def capacity(domain: Mapping[str, int]) -> dict[str, int | bool]:
    """Whether the marginal synthesizer admits a domain, and the bytes it may need.

    At most 32 columns of 256 states, no pair above a million cells, and eight copies of all one-way marginals and of the d - 1 largest pairs
    within 512 MiB.
    """
    sizes = sorted(domain.values(), reverse=True)
    pairs = sorted((a * b for i, a in enumerate(sizes) for b in sizes[i + 1 :]), reverse=True)
    largest = pairs[0] if pairs else 0
    need = 8 * (sum(sizes) + sum(pairs[: max(0, len(sizes) - 1)])) * 8
    ok = 0 < len(sizes) <= MOST_COLUMNS and sizes[0] <= MOST_STATES and largest <= MOST_CELLS and need <= MOST_BYTES
    return {"columns": len(sizes), "largest_pair": largest, "bytes": need, "admitted": ok}


def admit(domain: Mapping[str, int]) -> None:
    if not (found := capacity(domain))["admitted"]:
        raise EngineError("DP_DOMAIN_TOO_LARGE", "the public domain is too large", **found)
