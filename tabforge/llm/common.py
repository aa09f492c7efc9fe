"""Written intermediate tables, fixed-size bitmaps and connected components."""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabforge.sources.tables import shared_folder

BITMAP_BITS = 1 << 23
BATCH_BYTES = 4 << 20
ROWS_A_FILE = 250_000
#: So many edges at most (16 bytes each) are one task's work.
TASK_EDGES = 1_000_000
TEXT_ROWS = 8_000


def kind_of(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def text_digest(column: str) -> Column:
    """A digest of a text's bytes; null for null."""
    return F.unhex(F.sha2(F.col(column), 256))


def written(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """The rows of df, written once to the shared folder and read back: what follows never computes them again.

    ``rows``, a bound of their number, keeps small tables in few files.
    """
    df = df if rows is None else df.coalesce(max(1, -(-rows // ROWS_A_FILE)))
    bounded(df.sparkSession)
    path = f"{shared_folder(df.sparkSession)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded(spark: SparkSession) -> None:
    """Python workers get texts in batches of a few megabytes, however long the rows are (a smaller setting stays)."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    size = spark.conf.get(key, None)
    if size is None or not size.isdigit() or not 0 < int(size) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def release() -> None:
    """Gives memory that is free in this Python worker back to the system: Spark keeps idle workers for later tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)


def map_arrow(df: DataFrame, make: Callable, schema) -> DataFrame:
    """mapInArrow with a worker that is small again after each task."""

    def run(batches):
        yield from make(batches)
        release()

    return df.mapInArrow(run, schema)


def few(df: DataFrame, rows: int) -> DataFrame:
    """df in no more partitions than its rows of text are worth, nor in fewer than there are cores: not many tiny tasks and files."""
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // TEXT_ROWS)))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    bounded(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def bitmap(df: DataFrame, key: Column, bits: int = BITMAP_BITS) -> np.ndarray:
    """A packed bitmap of the 64-bit keys, of fixed size: bits / 8 bytes reach the driver, whatever the rows.  Keys beyond what
    it can tell apart only let more rows through; an exact join follows each use."""
    slot = F.pmod(key, F.lit(bits))
    words = df.where(key.isNotNull()).groupBy((slot / 64).cast("int").alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(slot, F.lit(64)).cast("int"))).alias("set"))

    def pack(batches):  # a task's words as two byte strings a batch: rows of their own would take the driver a hundred bytes and more each
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([c.to_numpy().tobytes()], pa.binary()) for c in b.columns], ["at", "set"])

    out = np.zeros(bits // 64, np.uint64)
    for r in words.mapInArrow(pack, "at binary, set binary").collect():
        out[np.frombuffer(r["at"], np.int32)] = np.frombuffer(r["set"], np.uint64)
    return out.view(np.uint8)


def opened(packed: np.ndarray) -> np.ndarray:
    return np.unpackbits(packed, bitorder="little").astype(bool)


def among(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each key (signed or unsigned 64 bits) may be in the opened bitmap."""
    return bits[keys.astype(np.uint64, copy=False) & np.uint64(len(bits) - 1)]


def among_packed(packed: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """``among`` for a bitmap that is too large to be opened."""
    at = keys.astype(np.uint64, copy=False) & np.uint64(8 * len(packed) - 1)
    return (packed[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


class Forest:
    """Union-find over 0..n-1; the root of a set is its least member."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)


def _spanned(batches):
    """(u, v): for each node of all batches but the least ones of their components, that least one."""
    parts = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches]
    if parts:
        u, v = (np.concatenate(p) for p in zip(*parts, strict=True))
        ids, both = np.unique(np.concatenate([u, v]), return_inverse=True)
        forest = Forest(len(ids))
        for i, j in zip(both[: len(u)].tolist(), both[len(u) :].tolist(), strict=True):
            forest.join(i, j)
        roots = np.array([forest.root(i) for i in range(len(ids))], np.int64)
        own = roots != np.arange(len(ids))
        yield pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array(ids[roots[own]])], ["u", "v"])


def components(edges: DataFrame, rows: int | None = None, rounds: int = 60) -> DataFrame:
    """(node, component): the least node of each connected component of the edges (a, b), by alternating large and small stars.

    Up to TASK_EDGES distinct edges are one task with a union-find; more take rounds.  Each round joins each edge with the least neighbour of its end; its result is written, so lineage stays short.  Hubs are
    safe (``rows``: about how many edges there are, for the number of files): least neighbours are pre-aggregated, and written apart from the joins, which Spark can then split where a key is hot.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges", rows)
    n = now.count()
    if n <= TASK_EDGES:
        now, rounds = written(map_arrow(now.coalesce(1), _spanned, "u long, v long"), "spanned"), 0
    for _ in range(rounds):
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least", 2 * n)
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, "large", 2 * n)
        least = written(large.groupBy("u").agg(F.min("v").alias("m")), "least", 2 * n)
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        now = written(small, "small", 2 * n)
        n, ends = now.agg(F.count(F.lit(1)), F.countDistinct("u")).first()
        # stars alone are left once each node has one edge, to a node that has none of its own
        if n == ends and not now.join(now.select(F.col("v").alias("u")).distinct(), "u", "left_semi").head(1):
            break
    else:
        if rounds:
            raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v"), F.col("v")).distinct())


_KEY, ID = "__tabforge_key", "__tabforge_id"


def identified(docs: DataFrame) -> DataFrame:
    """docs with a column ID: doc_id, or, where any doc_id has several rows, (doc_id, hash of the text).  Null without doc_id.

    So rows that share a doc_id but not their text are different documents; rows that repeat both are the same one.
    """
    repeats = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return docs.withColumn(ID, F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", F.xxhash64("text").alias("h"))) if repeats.head(1) else F.col("doc_id"))


def id_of(df: DataFrame, column: str) -> Column:
    """The doc_id of a column made by ``identified``."""
    return F.col(column)["doc_id"] if isinstance(df.schema[column].dataType, T.StructType) else F.col(column)


def changes(*columns: pa.Array) -> np.ndarray:
    """For each row but the first, whether one of the columns differs from the row before."""
    out = np.zeros(max(0, len(columns[0]) - 1), bool)
    for c in columns:
        for part in c.flatten() if pa.types.is_struct(c.type) else (c,):
            out |= pc.not_equal(part[1:], part[:-1]).to_numpy(zero_copy_only=False)
    return out


def split(docs: DataFrame, ids: DataFrame, on: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(rows of docs that may have one of the ids' keys, rows that surely have none), told apart by a bitmap of fixed size.

    ``on`` names the key's columns, the first of which is null in rows without a key.  Only the first part, little more than the rows with
    such a key, then needs an exact join; the other never moves.
    """
    packed = docs.sparkSession.sparkContext.broadcast(bitmap(ids, F.xxhash64(*on)))

    def picking(wanted: bool):
        def pick(batches):
            bits = opened(packed.value)
            for b in batches:
                key = b.column(b.num_columns - 1)
                may = among(bits, key.fill_null(0).to_numpy(zero_copy_only=False)) & key.is_valid().to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays(b.columns[:-1], b.schema.names[:-1]).filter(pa.array(may == wanted))

        return pick

    keyed = docs.withColumn(_KEY, F.when(F.col(on[0]).isNotNull(), F.xxhash64(*on)))
    return map_arrow(keyed, picking(True), docs.schema), map_arrow(keyed, picking(False), docs.schema)


def without(docs: DataFrame, ids: DataFrame, on: Sequence[str] = ("doc_id",), once: DataFrame | None = None) -> DataFrame:
    """The rows of docs whose key is not among those of ids, and one row only of each key in ``once``; rows whose first key column is null stay."""
    n = docs.count()
    marks = ids.select(*on).distinct().withColumn(_KEY, F.lit(True))
    if once is not None:
        marks = marks.union(once.select(*on).distinct().withColumn(_KEY, F.lit(False)))
    may, never = split(docs, marks, on)
    marked = may.join(marks, list(on), "left")
    if once is None:
        kept = marked.where(F.col(_KEY).isNull())
    else:
        kept = marked.where(F.col(_KEY).isNull()).union(marked.where(~F.col(_KEY)).dropDuplicates(list(on)))
    return few(never, n).union(few(kept.select(*docs.columns), n))
