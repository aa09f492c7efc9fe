"""Similarity join of documents on the Jaccard coefficient of their word n-grams, with Bayesian candidate pruning.

1. Rows with equal texts form copy classes, and texts with equal n-gram sets one node, which goes on alone with its number of texts.
2. Banded MinHash gives candidates: 44 bands of 5 values each meet for a pair at similarity 0.8 but for odds of 3e-8.
   A band value (a bucket) links its members to its smallest one, so a hot value gives as many links as it has members.
3. Connected components of these links hold every candidate pair.  A component of at most a block is compared as a whole.  A larger one
   is compared bucket by bucket, buckets of the same members once, or as a whole where that is fewer pairs (copies of copies, which
   meet in nearly every band).  Groups beyond a block are dealt into blocks by size class (a pair's sizes are within the
   threshold of each other) and salt; a task gets two blocks at most.
4. Pruning: in a task, pairs are compared on 64 further MinHash values, some at a time.  A pair goes when the posterior
   probability (uniform prior) that its similarity reaches the threshold falls below the tolerance.  A task returns its documents
   that have a pair left, never the pairs.
5. Only these get their n-gram sets joined; the pairs left are verified exactly.  Tasks return link counts and a spanning forest.
6. Classes are the connected components of the verified links.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from fractions import Fraction
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabforge.llm.common import Forest, among, bitmap, components, few, kind_of, map_arrow, opened, table, text_digest, written
from tabforge.llm.text import mix, shingles, words

N, THRESHOLD, TOLERANCE = 5, 0.8, 1e-9
BANDS, ROWS = 44, 5
COMPARED, STEP = 64, 16
#: A block holds about so many documents or n-grams at most.
BLOCK_DOCS, BLOCK_GRAMS = 512, 400_000

_state = mix(np.arange(1, 2 * (BANDS * ROWS + COMPARED) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_MULT, _ADD = (_state[: BANDS * ROWS + COMPARED] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (_state[BANDS * ROWS + COMPARED :] >> np.uint64(32)).astype(np.uint32)


def minhashes(grams_: np.ndarray, at: np.ndarray, first: int, n: int) -> np.ndarray:
    """n MinHash values (columns) of each set of grams ``at[i]:at[i+1]``, none of them empty."""
    low, high = (grams_ & np.uint64(0xFFFFFFFF)).astype(np.uint32), (grams_ >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(at) - 1, n), np.uint32)
    for j in range(n):
        x = low * _MULT[first + j] + high
        x ^= x >> np.uint32(15)
        x *= _MULT[(first + j + 7) % len(_MULT)]
        x ^= _ADD[first + j]
        out[:, j] = np.minimum.reduceat(x, at[:-1])
    return out


def least_matches(threshold: float, tolerance: float) -> dict[int, int]:
    """For each number of compared values, the fewest matches whose posterior of reaching the threshold is at least the tolerance.

    With a uniform prior the posterior after m of n matches is Beta(m + 1, n - m + 1), whose upper tail at t is the
    probability that a Binomial(n + 1, t) is at most m.
    """
    out = {}
    for n in range(STEP, COMPARED + 1, STEP):
        tail, m = 0.0, -1
        while tail < tolerance:
            m += 1
            tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out[n] = m
    return out


class Records(NamedTuple):
    """Documents of a task: places in its table, numbers of n-grams, MinHash values to compare."""

    at: np.ndarray
    sizes: np.ndarray
    values: np.ndarray


def pruned(left: Records, right: Records | None, threshold: float, tolerance: float, elsewhere: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of the pairs of ``left`` with ``right``, or within ``left``, that may still reach the threshold, but for those marked as
    compared ``elsewhere``."""
    own = right is None
    right = left if own else right
    na, nb = left.sizes, right.sizes
    may = (na[:, None] >= threshold * nb[None, :] - 1e-6) & (nb[None, :] >= threshold * na[:, None] - 1e-6)
    if own:
        may &= np.tri(len(na), len(nb), -1, dtype=bool).T
    if elsewhere is not None:
        may &= ~elsewhere
    i, j = np.nonzero(may)
    same = np.zeros(len(i), np.int64)
    for n, fewest in least_matches(threshold, tolerance).items():
        for lo in range(0, len(i), 1 << 18):
            part = slice(lo, lo + (1 << 18))
            same[part] += (left.values[i[part], n - STEP : n] == right.values[j[part], n - STEP : n]).sum(axis=1)
        keep = same >= fewest
        i, j, same = i[keep], j[keep], same[keep]
    return i, j


def verified(i: np.ndarray, j: np.ndarray, left: list[np.ndarray], right: list[np.ndarray] | None, threshold: float) -> np.ndarray:
    """Which of the pairs of n-gram sets reach the threshold, exactly."""
    own = right is None
    right = left if own else right
    na, nb = (np.array([len(r) for r in x]) for x in (left, right))
    exact = Fraction(str(threshold))
    if len(i) <= 4 * (len(na) + len(nb)):
        inter = np.array([len(np.intersect1d(left[x], right[y], assume_unique=True)) for x, y in zip(i, j, strict=True)], np.int64)
    else:  # many pairs: all intersections at once, some n-grams at a time
        every = left + ([] if own else right)
        _, inverse = np.unique(np.concatenate(every), return_inverse=True)
        owner = np.repeat(np.arange(len(every)), [len(x) for x in every])
        counted = np.bincount(inverse)
        number = np.cumsum(counted > 1) - 1
        keep = counted[inverse] > 1
        column, owner = number[inverse[keep]], owner[keep]
        order = np.argsort(column, kind="stable")
        column, owner = column[order], owner[order]
        total = np.zeros((len(na), len(nb)), np.float32)
        for lo in range(0, int(number[-1]) + 1, 4096):
            s, e = np.searchsorted(column, [lo, lo + 4096])
            m = np.zeros((len(every), 4096), np.float32)
            m[owner[s:e], column[s:e] - lo] = 1
            total += m[: len(na)] @ (m if own else m[len(na) :]).T
        inter = total[i, j].astype(np.int64)
    return inter * exact.denominator >= exact.numerator * (na[i] + nb[j] - inter)


def _first_pass(docs: DataFrame, n: int) -> DataFrame:
    """(row, doc_id, copy, same, size, bands, sample): digest of the text; of texts with words, digest and size of the n-gram set, band values
    and values to compare (else null)."""

    def make(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 2048):
                part = b.slice(lo, 2048)
                size, same, bands, sample = np.zeros(part.num_rows, np.int64), [None] * part.num_rows, [None] * part.num_rows, [None] * part.num_rows
                for w in words(part.column("text")):
                    have = np.flatnonzero(np.diff(w.at))
                    if not len(have):
                        continue
                    distinct = [shingles(w.of(i), n) for i in have]
                    at = np.concatenate([[0], np.cumsum([len(d) for d in distinct])])
                    every = np.concatenate(distinct)
                    values = minhashes(every, at, 0, BANDS * ROWS).astype(np.uint64).reshape(len(have), BANDS, ROWS)
                    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(have), BANDS)).copy()
                    for r in range(ROWS):
                        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + values[:, :, r])
                    compared = minhashes(every, at, BANDS * ROWS, COMPARED).astype("<u2")
                    size[w.first + have] = np.diff(at)
                    for x, own, row, v in zip(w.first + have, distinct, key, compared, strict=True):
                        same[x] = hashlib.blake2b(own, digest_size=16).digest()
                        bands[x] = row.view(np.int64)
                        sample[x] = v.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), part.column("doc_id"), part.column("copy"), pa.array(same, pa.binary()), pa.array(size), pa.array(bands, pa.list_(pa.int64())), pa.array(sample, pa.binary())],
                    ["row", "doc_id", "copy", "same", "size", "bands", "sample"],
                )

    some = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", text_digest("text").alias("copy"), "text")
    return written(map_arrow(few(some, docs.count()), make, f"row long, doc_id {kind_of(docs, 'doc_id')}, copy binary, same binary, size long, bands array<long>, sample binary"), "bands")


def _records(docs: DataFrame, copies: DataFrame, n: int) -> DataFrame:
    """(copy, grams): sorted distinct n-grams of the texts that may be among copies; a task gives each text once."""
    packed = docs.sparkSession.sparkContext.broadcast(bitmap(copies, F.xxhash64("copy")))

    def make(batches):
        bits, seen = opened(packed.value), set()
        for b in batches:
            b = b.filter(pa.array(among(bits, b.column("key").to_numpy())))
            new = [c not in seen and not seen.add(c) for c in b.column("copy").to_pylist()]
            b = b.filter(pa.array(new, pa.bool_()))
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                own: list[bytes] = [b""] * part.num_rows
                for w in words(part.column("text")):
                    for i in range(len(w.at) - 1):
                        own[w.first + i] = shingles(w.of(i), n).astype("<u8").tobytes()
                yield pa.RecordBatch.from_arrays([part.column("copy"), pa.array(own, pa.binary())], ["copy", "grams"])

    copy = text_digest("text")
    some = docs.where("doc_id is not null").select(copy.alias("copy"), F.xxhash64(copy).alias("key"), "text")
    return map_arrow(few(some, docs.count()), make, "copy binary, grams binary")


_RECORD = ("node", "copy", "weight", "size", "sample")


def _groups(nodes: DataFrame, components_: DataFrame) -> DataFrame:
    """(comp, bucket, node, buckets): the groups of documents that are compared, and of each document the groups of its component.

    A component of at most a block is one group (bucket null).  Of larger ones each bucket of a band value is one, unless all pairs of the
    component are fewer than all pairs of its buckets.  Buckets with the same members are one.
    """
    whole = written(components_.groupBy("comp").agg(F.count("*").alias("docs")), "sizes")
    large = whole.where(F.col("docs") > BLOCK_DOCS)
    small = components_.join(whole.where(F.col("docs") <= BLOCK_DOCS).select("comp"), "comp").select("comp", F.lit(None).cast("long").alias("bucket"), "node", F.lit(None).cast("array<long>").alias("buckets"))
    if not large.head(1):
        return small
    banded = written(components_.join(large.select("comp"), "comp").join(nodes.select("node", "bands"), "node").select("comp", "node", F.explode("bands").alias("bucket")), "banded")
    sign = lambda seed: F.sum(F.xxhash64(F.lit(seed), "node").cast("decimal(38,0)"))
    stats = banded.groupBy("comp", "bucket").agg(F.count("*").alias("n"), sign(1).alias("s"), sign(2).alias("t")).where("n > 1")
    one = written(stats.groupBy("comp", "n", "s", "t").agg(F.min("bucket").alias("bucket")).select("comp", "bucket", "n"), "buckets")
    cost = one.groupBy("comp").agg(F.sum(F.col("n").cast("double") * F.col("n")).alias("cost")).join(large, "comp").where(F.col("cost") < F.col("docs").cast("double") * F.col("docs")).select("comp")
    cost = written(cost, "by-bucket")
    dense = components_.join(large.join(cost, "comp", "left_anti").select("comp"), "comp").select("comp", F.lit(None).cast("long").alias("bucket"), "node", F.lit(None).cast("array<long>").alias("buckets"))
    chosen = written(banded.join(one.select("comp", "bucket"), ["comp", "bucket"]).join(cost, "comp").select("comp", "bucket", "node"), "members")
    lists = chosen.groupBy("node").agg(F.sort_array(F.collect_list("bucket")).alias("buckets"))  # at most one for each band
    return small.union(dense).union(chosen.join(lists, "node").select("comp", "bucket", "node", "buckets"))


def _block_keys(sized: DataFrame) -> DataFrame:
    """Rows of sized (comp, bucket, node, level, ...) for each task that they go to, with its key and their part (level, sub) in it.

    Groups of at most a block go whole, several to a task.  Of larger ones each size class is dealt by salt into blocks, and each
    pair of blocks of the same or of neighbouring classes is a task.
    """
    group = ["comp", "bucket"]
    same = lambda a, b: a["comp"].eqNullSafe(b["comp"]) & a["bucket"].eqNullSafe(b["bucket"])
    classes = written(sized.groupBy(*group, "level").agg(F.count("*").alias("docs"), F.sum("size").alias("sum")), "classes")
    whole = classes.groupBy(*group).agg(F.sum("docs").alias("docs"), F.sum("sum").alias("sum")).where((F.col("docs") > BLOCK_DOCS) | (F.col("sum") > BLOCK_GRAMS))
    big_groups = written(whole.select(*group), "big")
    bins = max(1, sized.count() // 256)
    key = lambda c, b, *rest: F.struct(c.alias("c"), b.alias("b"), *(F.lit(v).alias(k) if isinstance(v, int) else v.alias(k) for k, v in zip("lmxy", rest, strict=True))).alias("key")
    one = sized.join(big_groups, same(sized, big_groups), "left_anti").withColumn("sub", F.lit(0)).withColumn("key", key(F.pmod(F.xxhash64(*group), F.lit(bins)), F.lit(None).cast("long"), -1, -1, 0, 0))
    if not big_groups.head(1):
        return one
    blocks = classes.join(big_groups, same(classes, big_groups), "left_semi").select(*group, "level", F.greatest(F.ceil(F.col("docs") / BLOCK_DOCS), F.ceil(F.col("sum") / BLOCK_GRAMS)).cast("int").alias("blocks"))
    big = sized.join(big_groups, same(sized, big_groups), "left_semi")
    for name, shift in (("here", 0), ("up", -1), ("down", 1)):
        own = blocks.select(F.col("comp").alias("_c"), F.col("bucket").alias("_b"), (F.col("level") + shift).alias("_l"), F.col("blocks").alias(name))
        big = big.join(own, big["comp"].eqNullSafe(own["_c"]) & big["bucket"].eqNullSafe(own["_b"]) & (big["level"] == own["_l"]), "inner" if name == "here" else "left").drop("_c", "_b", "_l")
    big = big.withColumn("sub", F.pmod(F.xxhash64("node"), F.col("here")).cast("int"))
    keys = F.expr("""concat(
        transform(sequence(0, here - 1), o -> struct(comp as c, bucket as b, level as l, level as m, least(sub, o) as x, greatest(sub, o) as y)),
        if(up is null, array(), transform(sequence(0, up - 1), o -> struct(comp as c, bucket as b, level as l, level + 1 as m, sub as x, o as y))),
        if(down is null, array(), transform(sequence(0, down - 1), o -> struct(comp as c, bucket as b, level - 1 as l, level as m, o as x, sub as y))))""")
    return one.unionByName(big.withColumn("key", F.explode(keys)).drop("here", "up", "down"))


def _tasks(table_: pa.Table) -> Iterator[tuple[Records, Records | None, np.ndarray | None]]:
    """The comparisons of a task: (left, right or None for pairs within left, pairs that are compared in another group)."""
    column = lambda c: table_.column(c).to_pylist()
    sizes, values = table_.column("size").to_numpy(), [np.frombuffer(v, "<u2") for v in column("sample")]
    comps, buckets, lists = column("comp"), column("bucket"), column("buckets")
    tasks: dict[tuple, tuple[list, list]] = {}
    for at, (comp, bucket, lev, sub, key) in enumerate(zip(comps, buckets, column("level"), column("sub"), column("key"), strict=True)):
        tasks.setdefault((comp, bucket, key["l"], key["m"], key["x"], key["y"]), ([], []))[(lev, sub) != (key["l"], key["x"]) and key["l"] >= 0].append(at)
    records = lambda at: Records(np.array(at), sizes[at], np.stack([values[k] for k in at]))
    for (_, bucket, l, m, x, y), (left, right) in tasks.items():  # noqa: E741
        own = (l, x) == (m, y) or l < 0
        if len(left) + len(right) < 2 or not own and not (left and right):
            continue
        elsewhere = None
        if bucket is not None:  # a pair belongs to the least bucket that it shares
            members: dict[int, tuple[list, list]] = {}
            for side, side_at in enumerate((left, left if own else right)):
                for k, at in enumerate(side_at):
                    for other in lists[at]:
                        if other >= bucket:
                            break
                        members.setdefault(other, ([], []))[side].append(k)
            elsewhere = np.zeros((len(left), len(left if own else right)), bool)
            for a, b in members.values():
                elsewhere[np.ix_(a, b)] = True
        yield records(left), None if own else records(right), elsewhere


def jaccard_join(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """One row for each row of docs: doc_id, copy (digest of the text), n_grams, copy_id, class_id, n_links, kept.

    ``copy_id`` is the smallest doc_id with the same text, ``class_id`` the smallest doc_id of its connected component of links
    (copies included), ``n_links`` the number of other texts whose sets of n-word shingles reach the threshold.  ``kept`` marks
    the rows that stand for their class: those with its smallest doc_id and, of several such texts, the one with the least digest.

    A text of fewer than n words has one shingle, all its words.  Null, empty and other texts without words have no links, are no copies of
    each other and are kept; so are rows without doc_id (null classes).  Texts of any length are read as a whole.  Rows that share a doc_id but not
    their text are judged each by its own text; repeated rows have equal results.  Other columns are not read, whatever their names.

    Bands are meant for thresholds of 0.8 and more.  Odds of losing a pair at the threshold: 3e-8 by the bands, and about the
    tolerance for each comparison step by pruning.
    """
    if threshold < 0.8:
        raise ValueError("the bands are made for thresholds of at least 0.8")
    seen = _first_pass(docs, n)
    took_part, n_docs = seen.where("doc_id is not null and size > 0"), seen.count()
    texts = written(took_part.groupBy("same", "copy").agg(F.min("doc_id").alias("copy_id"), F.min(F.struct("doc_id", "row")).alias("at")), "texts", n_docs)
    nodes = texts.groupBy("same").agg(F.min(F.struct("at", "copy")).alias("first"), F.count("*").alias("weight"))
    nodes = written(nodes.select("same", F.col("first.at.row").alias("node"), F.col("first.copy").alias("copy"), "weight"), "nodes", n_docs)
    level = F.floor(F.log(F.col("size").cast("double")) / -math.log(threshold)).cast("int")
    first = took_part.select(F.col("row").alias("node"), "size", "bands", "sample").join(nodes.select("node", "copy", "weight"), "node").withColumn("level", level)
    first = written(few(first, n_docs), "first")  # rows of half a kilobyte: as many files as texts are worth
    banded = first.select("node", F.explode("bands").alias("band"))
    hubs = banded.groupBy("band").agg(F.min("node").alias("hub"), F.max("node").alias("most")).where("hub <> most").select("band", "hub")
    edges = banded.join(hubs, "band").where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    groups = written(_groups(first, components(edges, 4 * n_docs).withColumnRenamed("component", "comp")), "groups", n_docs)
    sized = written(few(groups.join(first.select(*_RECORD, "level"), "node"), n_docs), "sized")
    dealt = _block_keys(sized)
    fields = [f for f in dealt.schema.fields if f.name != "key"]
    key_fields = "struct<c: long, b: long, l: int, m: int, x: int, y: int>"

    def prune(t: pa.Table) -> pa.Table:
        keep = np.zeros(t.num_rows, bool)
        for left, right, elsewhere in _tasks(t):
            i, j = pruned(left, right, threshold, tolerance, elsewhere)
            keep[left.at[i]] = True
            keep[(left if right is None else right).at[j]] = True
        return t.filter(pa.array(keep))

    dealt = dealt.select(*(f.name for f in fields), F.col("key").cast(key_fields).alias("key"))
    left_over = written(few(dealt.groupBy("key").applyInArrow(prune, dealt.schema), n_docs), "left-over")
    records = written(_records(docs, left_over, n).join(left_over.select("copy").distinct(), "copy", "left_semi"), "records")
    with_grams = left_over.join(records.dropDuplicates(["copy"]), "copy")

    def compare(t: pa.Table) -> pa.Table:
        ids, weights, grams_ = t.column("node").to_pylist(), t.column("weight").to_numpy(), [np.frombuffer(g, "<u8") for g in t.column("grams").to_pylist()]
        out: list[tuple[int, int, int]] = []
        for left, right, elsewhere in _tasks(t):
            i, j = pruned(left, right, threshold, tolerance, elsewhere)
            keep = verified(i, j, [grams_[k] for k in left.at], None if right is None else [grams_[k] for k in right.at], threshold)
            i, j = left.at[i[keep]], (left if right is None else right).at[j[keep]]
            forest = Forest(t.num_rows)
            for p, q in zip(i.tolist(), j.tolist(), strict=True):
                forest.join(p, q)
            count = np.bincount(np.concatenate([i, j]), weights=np.concatenate([weights[j], weights[i]]), minlength=t.num_rows)
            out += [(ids[p], int(count[p]), ids[forest.root(int(p))]) for p in np.flatnonzero(count)]
        return pa.table([pa.array([o[k] for o in out], pa.int64()) for k in range(3)], ["node", "links", "root"])

    found = written(few(with_grams.groupBy("key").applyInArrow(compare, "node long, links long, root long"), n_docs), "links")
    linked = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")), n_docs)
    links = found.groupBy("node").agg(F.sum("links").alias("links")).join(linked, "node")
    by_text = texts.select("same", "copy", "copy_id").join(nodes.select("same", "node", "weight"), "same").join(links, "node", "left").withColumn("root", F.coalesce("component", "node"))
    by_text = written(by_text.select("copy", "copy_id", "root", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).cast("long").alias("n_links")), "by-text", n_docs)
    classes = written(by_text.groupBy("root").agg(F.min(F.struct("copy_id", "copy")).alias("first")), "by-class", n_docs)
    by_text = written(by_text.join(classes, "root").select("copy", "copy_id", F.col("first.copy_id").alias("class_id"), F.col("first.copy").alias("first"), "n_links"), "classes", n_docs)
    out = seen.select("doc_id", "copy", F.col("size").alias("n_grams"), (F.col("doc_id").isNotNull() & (F.col("size") > 0)).alias("took")).join(by_text, "copy", "left")
    mine = lambda c, other: F.when(F.col("took"), F.col(c)).otherwise(other)
    return out.select("doc_id", "copy", "n_grams", mine("copy_id", F.col("doc_id")).alias("copy_id"), mine("class_id", F.col("doc_id")).alias("class_id"), mine("n_links", F.lit(0).cast("long")).alias("n_links"),
                      (~F.col("took") | (F.col("doc_id") == F.col("class_id")) & (F.col("copy") == F.col("first"))).alias("kept"))


def op10_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    """All of ``documents``: doc_id, copy_id, class_id and n_links at five words and 0.8; see ``jaccard_join``."""
    return jaccard_join(table(spark, sf_dir, "documents")).select("doc_id", "copy_id", "class_id", "n_links")
