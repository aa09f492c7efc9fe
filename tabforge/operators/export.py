"""Sinks: content digests, Parquet with a shard manifest, CSV with a null marker, archives, and exact output scans."""

from __future__ import annotations

import hashlib
import uuid
import zipfile
from collections.abc import Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabforge.functions.cells import row_bytes
from tabforge.operators.profile import _rows, q
from tabforge.schema import ColumnSchema, EngineError, canonical_json
from tabforge.sources.tables import scan_csv

#: Fixed values.
NULL_MARKER = "__NULL_{}__"
DIGEST_RANGES = 256


def content_sha256(df: DataFrame, schema: Sequence[ColumnSchema], order: Sequence[str] | None = None) -> str:
    """One SHA-256 over all cells' canonical bytes in row order.

    Cells are encoded in parallel; SHA-256 itself is sequential, so rows stream through the driver one partition at a time.  For large tables use
    ``content_tree``.
    """
    encoded = df.select(*(q(c) for c in order or ()), row_bytes(schema).alias("__bytes"))
    digest = hashlib.sha256()
    for r in (encoded.orderBy(*order) if order else encoded).select("__bytes").toLocalIterator():
        digest.update(r[0])
    return digest.hexdigest()


def row_digests(df: DataFrame, schema: Sequence[ColumnSchema], key: str, normal: bool = True) -> DataFrame:
    """(key, digest) of each row."""
    return df.select(q(key), F.sha2(row_bytes(schema, normal), 256).alias("digest"))


def content_tree(df: DataFrame, schema: Sequence[ColumnSchema], key: str, ranges: int = DIGEST_RANGES) -> DataFrame:
    """(n, digest): row digests folded in key order within key ranges of equal width, and those in order: all in parallel.

    Where ranges begin depends on the keys' least and greatest values only, so the digest does not depend on partitions.
    """
    rows = row_digests(df, schema, key)
    low, high = rows.agg(F.min(key), F.max(key)).first()
    if low is None:
        return rows.agg(F.lit(0).cast("long").alias("n"), F.lit(hashlib.sha256(b"").hexdigest()).alias("digest"))
    width = (high - low) // ranges + 1
    parts = rows.withColumn("__r", F.floor((F.col(key) - low) / width)).withColumn("__p", F.floor((F.col(key) - low) / max(1, width // 1024 + 1)))
    fold = lambda x: F.sha2(F.concat_ws("", F.transform(F.sort_array(F.collect_list(x)), lambda s: s["digest"])), 256).alias("digest")
    inner = parts.groupBy("__r", "__p").agg(F.count(F.lit(1)).alias("n"), fold(F.struct(F.col(key).alias("k"), "digest")))
    middle = inner.groupBy("__r").agg(F.sum("n").alias("n"), fold(F.struct(F.col("__p").alias("k"), "digest")))
    return middle.agg(F.sum("n").alias("n"), fold(F.struct(F.col("__r").alias("k"), "digest")))


def exact_scan(df: DataFrame, schema: Sequence[ColumnSchema]) -> DataFrame:
    """(column, n, n_null, n_distinct, n_duplicate, n_format) of each output column, in one aggregation."""
    own = {}
    for c in schema:
        x = q(c.name)
        bad = F.count_if(~x.rlike(rf"\A(?:{c.format})\z")) if c.format and c.kind == "identifier" else F.lit(0)
        distinct = F.countDistinct(x) if c.kind == "identifier" else F.lit(None)
        own[c.name] = {"n": F.count(F.lit(1)), "n_null": F.count_if(x.isNull()).cast("long"), "n_distinct": distinct.cast("long"), "n_duplicate": (F.count(x) - distinct).cast("long"), "n_format": bad.cast("long")}
    return _rows(df.select(*(q(c.name) for c in schema)), own)


def category_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, n), by pre-aggregated counts of all columns in one shuffle."""
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), q(c).cast("string").alias("value")) for c in columns))).alias("r")).select("r.*")
    return long.where("value is not null").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def check_output(df: DataFrame, schema: Sequence[ColumnSchema], rows: int) -> dict[str, dict]:
    """Checks names, order, types, the row number, nulls, identifiers and formats; OUTPUT_INVALID says what is wrong."""
    want = [(c.name, c.spark_type) for c in schema]
    if [(f.name, f.dataType) for f in df.schema] != want:
        raise EngineError("OUTPUT_INVALID", "columns or types differ from the schema")
    found = {r["column"]: r.asDict() for r in exact_scan(df, schema).collect()}  # one row for each column
    bad = [c.name for c in schema if found[c.name]["n"] != rows or found[c.name]["n_null"] and not c.nullable or found[c.name]["n_duplicate"] or found[c.name]["n_format"]]
    if bad:
        raise EngineError("OUTPUT_INVALID", "the output does not keep its contract", columns=bad, found=found)
    return found


@dataclass(frozen=True)
class Shard:
    ordinal: int
    name: str
    sha256: str
    size_bytes: int


def publish_parquet(df: DataFrame, folder: str, order: str | None = None) -> None:
    """Writes to a staging folder beside the target and renames it; an existing target is never replaced."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path
    target, staging = path(folder), path(f"{folder}._staging-{uuid.uuid4().hex}")
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(target):
        raise EngineError("IMMUTABLE_PATH_EXISTS", folder)
    out = df.repartitionByRange(order).sortWithinPartitions(order) if order else df
    out.write.option("compression", "zstd").parquet(staging.toString())
    if not fs.rename(staging, target):
        fs.delete(staging, True)
        raise EngineError("IMMUTABLE_PATH_EXISTS", folder)


def shards(spark, folder: str) -> list[Shard]:
    """Each part file with its hash and size; files are hashed on the executors."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(folder)
    rows = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("sha256"), "length").orderBy("name").collect()  # one row for each file
    return [Shard(i, r["name"], r["sha256"], r["length"]) for i, r in enumerate(rows)]


def manifest(spark, folder: str, schema: Sequence[ColumnSchema], order: Sequence[str] | None = None) -> dict:
    df = spark.read.parquet(folder)
    return {"columns": [asdict(c) for c in schema], "row_count": df.count(), "content_sha256": content_sha256(df, schema, order), "shards": [asdict(s) for s in shards(spark, folder)]}


def verify_manifest(spark, folder: str, stated: dict, schema: Sequence[ColumnSchema], order: Sequence[str] | None = None) -> None:
    if canonical_json(manifest(spark, folder, schema, order)) != canonical_json(stated):
        raise EngineError("CHECKSUM_MISMATCH", "the shards differ from their manifest")


def null_marker(df: DataFrame, schema: Sequence[ColumnSchema]) -> str:
    """A text that no cell has: a hash of the schema, with a number if need be."""
    base = NULL_MARKER.format(hashlib.sha256(canonical_json([asdict(c) for c in schema]).encode()).hexdigest()[:16])
    texts = [q(c.name) for c in schema if c.spark_type.simpleString() == "string"]
    n, marker = 0, base
    while texts and df.where(F.array_contains(F.array(*texts), marker)).limit(1).count():
        n += 1
        marker = f"{base}_{n}"
    return marker


def write_csv(df: DataFrame, folder: str, schema: Sequence[ColumnSchema]) -> str:
    """A CSV with a header, all values quoted, nulls as a marker that no cell has; returns the marker."""
    marker = null_marker(df, schema)
    df.select(*(q(c.name) for c in schema)).write.options(header=True, quoteAll=True, nullValue=marker, emptyValue="", escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, timestampFormat="yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").csv(folder)
    return marker


def equivalent(df: DataFrame, csv_folder: str, marker: str, schema: Sequence[ColumnSchema]) -> DataFrame:
    """(n, n_csv, equal): whether the CSV, read back, has the same rows: counts and order-free sums of row digests agree."""
    back = scan_csv(df.sparkSession, csv_folder, schema, marker)
    mark = lambda d: d.select(F.sha2(row_bytes(schema), 256).alias("h")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.conv(F.substring("h", 1, 15), 16, 10).cast("decimal(38,0)")).alias("s"), F.sum(F.conv(F.substring("h", 16, 15), 16, 10).cast("decimal(38,0)")).alias("t"))
    a, b = mark(df), mark(back)
    return a.select("n", "s", "t").crossJoin(b.select(F.col("n").alias("n_csv"), F.col("s").alias("s2"), F.col("t").alias("t2"))).select("n", "n_csv", ((F.col("n") == F.col("n_csv")) & F.col("s").eqNullSafe(F.col("s2")) & F.col("t").eqNullSafe(F.col("t2"))).alias("equal"))  # one row each


def archive(files: dict[str, str], target: str) -> str:
    """A stored ZIP64 archive of local files by name, equal for equal content; returns its SHA-256."""
    with zipfile.ZipFile(target, "x", zipfile.ZIP_STORED, allowZip64=True) as z:
        for name in sorted(files):
            info = zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))
            info.external_attr = 0o644 << 16
            with open(files[name], "rb") as source, z.open(info, "w", force_zip64=True) as out:
                while part := source.read(1 << 20):
                    out.write(part)
    with open(target, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def ordered_union(frames: Sequence[DataFrame]) -> DataFrame:
    """Shards one after another, with the shard's number."""
    out = None
    for i, f in enumerate(frames):
        part = f.withColumn("__shard", F.lit(i))
        out = part if out is None else out.unionByName(part)
    return out


__all__ = ["archive", "category_counts", "check_output", "content_sha256", "content_tree", "equivalent", "exact_scan", "manifest", "null_marker", "ordered_union", "publish_parquet", "row_digests", "shards", "verify_manifest", "write_csv"]
