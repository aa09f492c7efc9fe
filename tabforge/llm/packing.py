"""Best-fit-decreasing packing of tokenised documents into sequences of fixed capacity.

Lengths are whole numbers up to the capacity, so best-fit decreasing needs only how many pieces have each length: a driver-side
plan of bounded size, made with a segment tree over remaining capacities that finds the tightest open bin in logarithmic time,
places runs of equal pieces into runs of equal bins.  It opens as many bins as packing piece by piece would.  Each piece
then finds its own place by its rank among the pieces of its length, which comes from per-bucket ranks and bucket offsets.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabforge.llm.common import few, map_arrow, table, written
from tabforge.llm.text import lists
from tabforge.llm.tokens import byte_tokenizer

CAPACITY, END = 1024, 2
#: Pieces whose ranks one bucket gives, about.
BUCKET_ROWS, LEAST_BUCKETS = 200_000, 256


class OpenBins:
    """A segment tree over remaining capacities 0..n: which of them have open bins."""

    def __init__(self, n: int):
        self.leaves = 1 << n.bit_length()
        self.any = [False] * (2 * self.leaves)

    def mark(self, capacity: int, has: bool) -> None:
        i = capacity + self.leaves
        self.any[i] = has
        while i > 1:
            i //= 2
            self.any[i] = self.any[2 * i] or self.any[2 * i + 1]

    def tightest(self, need: int) -> int | None:
        """The least remaining capacity of at least ``need`` that has an open bin."""
        i = need + self.leaves
        if self.any[i]:
            return need
        while i > 1:
            if i % 2 == 0 and self.any[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.any[2 * i] else 2 * i + 1
                return i - self.leaves
            i //= 2
        return None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Best-fit decreasing over pieces by length.  Rows (length, first rank, bin of that rank, pieces a bin, offset in the bin)."""
    tree, groups, rows, bins = OpenBins(capacity), defaultdict(list), [], 0

    def put(left: int, first: int, n: int) -> None:
        if n and left:
            groups[left].append((first, n))
            tree.mark(left, True)

    for length in sorted(counts, reverse=True):
        rank, more = 0, counts[length]
        while more:
            left = tree.tightest(length)
            if left is None:
                left, first, n = capacity, bins, -(-more // (capacity // length))
                bins += n
            else:
                first, n = groups[left].pop()
                if not groups[left]:
                    tree.mark(left, False)
            each = left // length
            full = min(n, more // each)
            rows.append((length, rank, first, each, capacity - left))
            taken = full * each
            put(left - each * length, first, full)
            if full < n and more > taken:  # the last pieces of this length do not fill a bin's share
                put(left - (more - taken) * length, first + full, 1)
                put(left, first + full + 1, n - full - 1)
                taken = more
            else:
                put(left, first + full, n - full)
            rank, more = rank + taken, more - taken
    return np.array(rows, np.int64).reshape(-1, 5)


def pieces(docs: DataFrame, capacity: int = CAPACITY, end: int = END, tokenizers: str | None = None, ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of each document's tokens and the end token; null text is empty.

    Documents of more than ``capacity`` ids are cut into pieces of that many, of which the first may be shorter.  Rows with
    the same or no doc_id are documents of their own, and so are repeated rows.  Texts of any length are read as a whole.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def make(batches):
        encode = byte_tokenizer(tokenizers).ids
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                doc, piece, start, length, crc, own = [], [], [], [], [], []
                for i, text in enumerate(part.column("text").to_pylist()):
                    all_ids = np.append(encode(text or ""), np.uint32(end)).astype("<u4")
                    cuts = [0, *range(len(all_ids) % capacity or capacity, len(all_ids) + 1, capacity)]
                    for k, (a, z) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        doc.append(i)
                        piece.append(k)
                        start.append(a)
                        length.append(z - a)
                        crc.append(zlib.crc32(all_ids[a:z].tobytes()))
                        if ids:
                            own.append(all_ids[a:z].astype(np.int32))
                columns = [part.column("doc_id").take(pa.array(doc, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                yield pa.RecordBatch.from_arrays(columns + [lists(own, pa.int32())] * ids, names + ["ids"] * ids)

    return map_arrow(few(docs.select("doc_id", "text"), docs.count()), make, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * ids)


def pack(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to rows with a ``length`` of 1 to ``capacity``, by best-fit decreasing over all of them.

    ``rows`` are written once to the shared folder first.  Which of several equal-length rows takes which place is arbitrary but fixed by
    the written table.
    """
    spark = rows.sparkSession
    own = [c for c in rows.columns if c != "ids"]
    # the bucket is written with the row, so that rows which are equal in all columns spread too
    stored = written(rows.withColumn("_bucket", F.xxhash64(*own, F.monotonically_increasing_id())), "pieces")
    rows = stored.drop("_bucket")
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    if any(not 1 <= n <= capacity for n in counts):
        raise ValueError(f"lengths must be from 1 to {capacity}")
    steps = plan(counts, capacity)
    buckets = max(LEAST_BUCKETS, sum(counts.values()) // BUCKET_ROWS)
    keyed = stored.withColumn("_bucket", F.pmod("_bucket", F.lit(buckets)).cast("int"))
    offsets = keyed.groupBy("_bucket", "length").agg(F.count("*").alias("_n"))
    offsets = offsets.withColumn("_base", F.sum("_n").over(Window.partitionBy("length").orderBy("_bucket")) - F.col("_n")).drop("_n")
    rank = F.row_number().over(Window.partitionBy("_bucket", "length").orderBy(*own)) - 1
    ranked = keyed.withColumn("_rank", rank).join(offsets, ["_bucket", "length"]).withColumn("_rank", F.col("_rank") + F.col("_base")).select(*rows.columns, "_rank")
    by = np.lexsort((steps[:, 1], steps[:, 0]))
    shared = spark.sparkContext.broadcast(steps[by])  # bounded by the capacity, not by the rows

    def place(batches):
        s = shared.value
        keys = s[:, 0] * (1 << 48) + s[:, 1]
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("_rank").to_numpy()
            p = s[np.searchsorted(keys, length * (1 << 48) + rank, "right") - 1]
            t = rank - p[:, 1]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(p[:, 2] + t // p[:, 3]), pa.array(p[:, 4] + t % p[:, 3] * length)], [*b.schema.names[:-1], "sequence_id", "offset"])

    return map_arrow(few(ranked, sum(counts.values())), place, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema)}, sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the sequences themselves, from packed pieces that carry their ids; each holds at most the capacity."""
    inner = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(inner, lambda x: x["ids"])).alias("ids"))


def op3_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """The pieces of all ``documents`` and their places in sequences of 1024 tokens; see ``pieces`` and ``pack``."""
    return pack(pieces(table(spark, sf_dir, "documents")))
