"""What generators return, put into declared types; tokens of categories; and plans and samples around evaluation."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabforge.functions.keyed import big_endian, hmac_hex
from tabforge.schema import ROW_ID, ColumnSchema, EngineError

NESTED_DOMAIN = b"tabforge/fit-validation/v1\0"


def q(name: str) -> Column:
    return F.col(f"`{name}`")


def boolean_text(c: Column) -> Column:
    """true or false in any case; anything else is null."""
    low = F.lower(F.trim(c.cast("string")))
    return F.when(low == "true", True).when(low == "false", False)


def coerced(c: Column, own: T.DataType, column: ColumnSchema) -> Column:
    """A candidate's value in the declared type; null where it does not fit.

    Whole numbers must be exact and within 64 bits, decimals are rounded half to even and have at most 38 digits, floats are finite.
    """
    if column.kind == "integer":
        if isinstance(own, T.BooleanType):
            return F.lit(None).cast("long")
        if isinstance(own, T.FloatType | T.DoubleType):
            return F.when((c == F.floor(c.cast("decimal(38,6)"))) & (F.abs(c) < 2.0**63), c.try_cast("long"))
        if isinstance(own, T.DecimalType):
            return F.when(c == F.floor(c), c.try_cast("long"))
        return c.try_cast("long")
    if column.kind == "fixed_decimal":
        p = column.decimal_places
        exact = c.try_cast(f"decimal(38,{min(18, p + 6)})")
        return F.bround(exact, p).try_cast(f"decimal(38,{p})")
    if column.kind == "float":
        x = c.try_cast("double")
        return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)
    if column.kind == "boolean":
        return c if isinstance(own, T.BooleanType) else boolean_text(c)
    return c.try_cast(column.spark_type)


def typed_candidates(df: DataFrame, schema: Sequence[ColumnSchema]) -> DataFrame:
    """df with declared types and ``__invalid``: rows where a value did not fit, or is null where it must not be."""
    own = {f.name: f.dataType for f in df.schema}
    columns = [c for c in schema if c.name in own]
    values = {c.name: coerced(q(c.name), own[c.name], c) for c in columns}
    bad = reduce(or_, ((q(c.name).isNotNull() & values[c.name].isNull()) | (F.lit(not c.nullable) & q(c.name).isNull()) for c in columns), F.lit(False))
    others = [q(n) for n in own if n not in values]
    return df.select(*others, *(v.alias(n) for n, v in values.items()), bad.alias("__invalid"))


def category_token(c: Column, own: T.DataType) -> Column:
    """A text that tells values of different types apart: ["missing"], ["bool",...], ["int",...], ["float",...] or ["str",...]."""
    tag = "bool" if isinstance(own, T.BooleanType) else "int" if isinstance(own, T.IntegralType) else "float" if isinstance(own, T.FractionalType) else "str"
    return F.when(c.isNull(), F.lit('["missing"]')).otherwise(F.to_json(F.array(F.lit(tag), c.cast("string"))))


def content_priority_sample(df: DataFrame, key: bytes, most: int, columns: Sequence[str]) -> DataFrame:
    """The ``most`` rows with the smallest keyed hash of their content, in that order; equal rows are interchangeable."""
    own = {f.name: f.dataType for f in df.schema}
    text = F.concat_ws("\x1f", *(F.concat(F.lit(f"{n}\x1e"), category_token(q(n), own[n])) for n in columns))
    return df.withColumn("__h", hmac_hex(text.cast("binary"), key)).orderBy("__h").limit(most).drop("__h")


def nested_split(df: DataFrame, key: bytes, row_id: str = ROW_ID) -> DataFrame:
    """Adds ``for_fit``: nine tenths of the rows, by a stream of its own; the rest stops training early."""
    below = format((1 << 64) * 9 // 10, "016x")
    return df.withColumn("for_fit", F.substring(hmac_hex(big_endian(q(row_id)), key, NESTED_DOMAIN), 1, 16) < below)


def generation_plan(wanted: int, processes: int, factor: int = 20) -> list[tuple[int, int]]:
    """Contiguous candidate ranges of each process, whose sizes differ by one at most."""
    if wanted < 1 or processes < 1:
        raise EngineError("RESOURCE_LIMIT", "a plan needs rows and processes")
    total = wanted * factor
    return [(total * i // processes, total * (i + 1) // processes) for i in range(min(processes, total))]


def advanced_sections(scope: str, sections: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The sections that a scope may show: a release has no empirical privacy, and no section sums up the others."""
    if scope not in ("curator", "release"):
        raise ValueError(scope)
    return {k: v for k, v in sections.items() if scope == "curator" or k != "empirical_privacy"}
