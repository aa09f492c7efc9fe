"""Raw text to typed columns: one pass of checks for all columns, then one projection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabforge.functions.cells import is_null_text, parsed
from tabforge.operators.profile import _rows, q
from tabforge.operators.ranges import place
from tabforge.schema import ROW_ID, ColumnSchema, EngineError, check_columns

#: Rows of the sample that ranges are cut by.
SAMPLE = 20_000


def typed(c: Column, column: ColumnSchema) -> Column:
    return F.when(~is_null_text(c), parsed(c, column))


def cast_report(df: DataFrame, schema: Sequence[ColumnSchema]) -> DataFrame:
    """(column, n_null, n_invalid, n_valid) of each declared column, in one pass."""
    own = {}
    for column in schema:
        c = q(column.name)
        null, value = is_null_text(c), typed(c, column)
        own[column.name] = {"n_null": F.count_if(null).cast("long"), "n_invalid": F.count_if(~null & value.isNull()).cast("long"), "n_valid": F.count(value)}
    return _rows(df.select(*(q(c.name) for c in schema)), own)


def project(df: DataFrame, schema: Sequence[ColumnSchema]) -> DataFrame:
    """Typed columns; values that do not parse are null.  A row id comes first, if there."""
    own = [typed(q(c.name), c).alias(c.name) for c in schema]
    return df.select(*([q(ROW_ID)] if ROW_ID in df.columns else []), *own)


def normalize(df: DataFrame, schema: Sequence[ColumnSchema]) -> DataFrame:
    """The typed table, or SCHEMA_INVALID with counts for each column if any value does not parse or a null is not allowed."""
    check_columns(df.columns, schema)
    counts = {r["column"]: r for r in cast_report(df, schema).collect()}  # one row for each column
    bad = {c.name: counts[c.name].asDict() for c in schema if counts[c.name]["n_invalid"] or counts[c.name]["n_null"] and not c.nullable}
    if bad:
        raise EngineError("SCHEMA_INVALID", "values do not fit the schema", columns=bad)
    return project(df, schema)


def write_normalized(df: DataFrame, path: str, row_group_bytes: int = 192 << 20) -> None:
    """ZSTD Parquet in row-id order, by ranges; refuses to overwrite."""
    ordered = df.repartitionByRange(ROW_ID).sortWithinPartitions(ROW_ID)
    ordered.write.mode("errorifexists").option("compression", "zstd").option("parquet.block.size", row_group_bytes).parquet(path)


def numbered(df: DataFrame, order: Sequence[str], name: str = ROW_ID, ranges: int = 256) -> DataFrame:
    """Adds 0, 1, ... in the order of the columns, without a window over all rows.

    Rows are put into ranges of the whole sort key, cut at tuples of a bounded sample (any cuts give the same numbers); each range
    numbers its own rows from the count of rows before it.
    """
    keys = [q(c) for c in order]
    sample = df.select(*keys).where(keys[0].isNotNull()).orderBy(F.xxhash64(*keys)).limit(SAMPLE).distinct().orderBy(*keys).collect()
    chosen = [sample[len(sample) * i // ranges] for i in range(1, ranges)] if len(sample) >= ranges else sample[: ranges - 1]
    tuple_ = F.struct(*keys)
    literals = [F.struct(*(F.lit(v).cast(df.schema[c].dataType).alias(c) for v, c in zip(r, order, strict=True))) for r in dict.fromkeys(chosen)]
    ranged = df.withColumn("__range", F.when(keys[0].isNull(), -1).otherwise(place(tuple_, F.array(*literals), ranges) if literals else F.lit(0)))
    counts = ranged.groupBy("__range").count().orderBy("__range").collect()  # at most `ranges` rows
    at, starts = 0, []
    for r in counts:
        starts.append((r["__range"], at))
        at += r["count"]
    offsets = df.sparkSession.createDataFrame(starts or [(0, 0)], "__range int, __offset long")
    within = Window.partitionBy("__range").orderBy(*order)
    return ranged.join(F.broadcast(offsets), "__range").withColumn(name, F.row_number().over(within) - 1 + F.col("__offset")).drop("__range", "__offset")
