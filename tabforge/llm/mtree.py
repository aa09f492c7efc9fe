"""Exact top-k inner-product search by best-first search of M-trees.

Vectors of whole numbers are lifted by one coordinate that gives all of one length the same norm; the distance from a query (lifted by
zero) then falls as the inner product rises, and is a metric.  Candidates are dealt to their nearest of a bounded number of pivots, so that blocks are
balls; a pivot's vectors beyond a block's size are dealt on by hash.  Each block's M-tree is bulk-loaded once into pages, which hold
routing objects with covering radii and distances to their parents, or entries with their distance to the page's routing object.

The blocks' root pages (one centre and radius each) route queries: each query searches its nearest block first, and then only blocks whose ball
its bound still reaches; within a block the bound prunes pages and entries.  Each task searches one block for one part of its queries.
"""

from __future__ import annotations

import heapq
import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabforge.llm.common import map_arrow, table, written

K, BLOCK, FANOUT, LEAF = 20, 32_768, 16, 256
#: Pivots of one length of vectors at most, each chosen from so many sampled vectors.  More vectors than they can have make more blocks a pivot.
MOST_PIVOTS, SAMPLED = 4096, 8
#: A task searches for so many queries at most, and for no fewer than the second number for the sake of parallelism alone.
MOST_QUERIES, LEAST_QUERIES = 16_384, 512


def whole(rows: DataFrame, scale: float = 64.0) -> DataFrame:
    """(row, vec_id, v): components floor(scale * x) of usable vectors.

    Rows without vec_id or vector, or with a null or non-finite component take no part.  Repeated rows are rows of their own: each is a query
    and each other's candidate.  Empty vectors have inner products of 0 with each other.
    """
    x = F.transform("embedding", lambda x: x.cast("double"))
    finite = F.forall(x, lambda x: F.coalesce((F.abs(x) < float("inf")), F.lit(False)) & ~F.isnan(x))
    some = rows.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(finite)
    return some.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda x: F.floor(x * scale)).alias("v"))


class _Builder:
    def __init__(self, vectors: np.ndarray, top: float):
        self.v = vectors.astype(np.float64)
        norm = (self.v * self.v).sum(1)
        self.top = top
        self.lift = np.sqrt(np.maximum(self.top - norm, 0))
        self.pages: list[dict] = []
        self.draw = np.random.default_rng(len(vectors))

    def away(self, which: np.ndarray, center: int) -> np.ndarray:
        d = self.v[which] - self.v[center]
        return np.sqrt((d * d).sum(1) + (self.lift[which] - self.lift[center]) ** 2)

    def load(self, which: np.ndarray, center: int, to_parent: float) -> int:
        """The page of these vectors around a routing object; returns its number."""
        number, from_center = len(self.pages), self.away(which, center)
        page = {"center": center, "radius": float(from_center.max()), "to_parent": to_parent, "children": [], "entries": None}
        self.pages.append(page)
        if len(which) <= LEAF:
            page["entries"] = (which, from_center)
            return number
        pivots = self.draw.choice(which, FANOUT, replace=False)
        far = np.stack([self.away(which, p) for p in pivots])
        nearest = far.argmin(0)
        groups = [(int(p), which[nearest == k]) for k, p in enumerate(pivots)]
        if max(len(g) for _, g in groups) > 0.9 * len(which):  # copies or nearly: deal them evenly
            groups = [(int(part[0]), part) for part in np.array_split(which, FANOUT)]
        for p, group in groups:
            if len(group):
                page["children"].append(self.load(group, p, float(self.away(np.array([p]), center)[0])))
        return number


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """The vectors of a list column, all of one length."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def _pages(block: pa.Table) -> pa.Table:
    """The pages of the M-tree of one block."""
    first = {c: block.column(c)[0].as_py() for c in ("dim", "pivot", "sub", "top")}
    m = matrix(block.column("v").combine_chunks(), first["dim"])
    small = next(t for t in (m.astype(np.int16), m.astype(np.int32), m) if (t == m).all())
    ids, rows = block.column("vec_id").to_numpy(), block.column("row").to_numpy()
    b = _Builder(m, first["top"])
    b.load(np.arange(len(m)), 0, 0.0)
    out = []
    for number, p in enumerate(b.pages):
        entries, far = p["entries"] if p["entries"] is not None else (np.zeros(0, np.int64), np.zeros(0))
        out.append(first | {"page": number, "width": small.itemsize, "center": small[p["center"]].tobytes(), "radius": p["radius"], "to_parent": p["to_parent"], "children": p["children"], "ids": ids[entries].tobytes(), "rows": rows[entries].tobytes(), "vectors": small[entries].tobytes(), "far": far.tobytes()})
    return pa.Table.from_pylist(out, _PAGE)


_PAGE = pa.schema([("dim", pa.int32()), ("pivot", pa.int32()), ("sub", pa.int32()), ("top", pa.float64()), ("page", pa.int32()), ("width", pa.int32()), ("center", pa.binary()), ("radius", pa.float64()), ("to_parent", pa.float64()), ("children", pa.list_(pa.int32())), ("ids", pa.binary()), ("rows", pa.binary()), ("vectors", pa.binary()), ("far", pa.binary())])
_PAGE_SQL = "dim int, pivot int, sub int, top double, page int, width int, center binary, radius double, to_parent double, children array<int>, ids binary, rows binary, vectors binary, far binary"
_BLOCK = ("dim", "pivot", "sub")


class Space(NamedTuple):
    """Vectors of one length: the greatest squared norm, and pivots (maybe one, for all)."""

    top: float
    pivots: np.ndarray


def _lifted(m: np.ndarray, top: float) -> np.ndarray:
    norm = (m * m).sum(1)
    return np.column_stack([m, np.sqrt(np.maximum(top - norm, 0))])


def spread(sample: np.ndarray, n: int) -> np.ndarray:
    """n rows of the sample that lie far apart: each next one is the farthest from those before."""
    far, chosen = np.full(len(sample), np.inf), [0]
    while len(chosen) < n:
        d = sample - sample[chosen[-1]]
        far = np.minimum(far, (d * d).sum(1))
        chosen.append(int(far.argmax()))
    return sample[chosen]


def _spaces(vectors: DataFrame, block: int) -> dict[int, Space]:
    """By length of vectors: as many pivots as make blocks of about the given size, up to MOST_PIVOTS, from a bounded sample (the least hashes)."""
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    out = {}
    for r in vectors.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"), F.max(norm).alias("top")).collect():  # a row for each length
        n = min(MOST_PIVOTS, -(-r["n"] // block))
        chosen = vectors.where(F.size("v") == r["dim"]).orderBy(F.xxhash64("row"), "row").limit(SAMPLED * n).select("v").collect() if n > 1 else []
        sample = np.array([c["v"] for c in chosen], float).reshape(len(chosen), r["dim"])
        out[r["dim"]] = Space(r["top"], spread(_lifted(sample, r["top"]), n)[:, : r["dim"]] if n > 1 else sample)
    return out


def build_index(vectors: DataFrame, block: int = BLOCK) -> DataFrame:
    """The pages of an M-tree over each block of about ``block`` vectors (row, vec_id, v), written to the shared folder."""
    spaces = _spaces(vectors, block)
    shared = vectors.sparkSession.sparkContext.broadcast(spaces)

    def assign(batches):
        for b in batches:
            dims, column = b.column("v").value_lengths().to_numpy(), b.column("v")
            pivot, top = np.zeros(b.num_rows, np.int32), np.zeros(b.num_rows)
            for dim in np.unique(dims):
                own, space = np.flatnonzero(dims == dim), shared.value[int(dim)]
                top[own] = space.top
                if len(space.pivots):
                    to = _lifted(space.pivots, space.top)
                    for lo in range(0, len(own), 4096):
                        part = own[lo : lo + 4096]
                        x = _lifted(matrix(column.take(pa.array(part)), int(dim)).astype(float), space.top)
                        pivot[part] = ((to * to).sum(1)[None, :] - 2 * x @ to.T).argmin(1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(dims.astype(np.int32)), pa.array(pivot), pa.array(top)], [*b.schema.names, "dim", "pivot", "top"])

    near = written(map_arrow(vectors.select("row", "vec_id", "v"), assign, "row long, vec_id long, v array<long>, dim int, pivot int, top double"), "near")
    sizes = near.groupBy("dim", "pivot").agg(F.ceil(F.count("*") / (2 * block)).cast("int").alias("parts"))
    dealt = near.join(F.broadcast(sizes), ["dim", "pivot"]).withColumn("sub", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int"))
    return written(dealt.groupBy(*_BLOCK).applyInArrow(_pages, _PAGE_SQL), "pages")


class Tree:
    """A tree of pages in memory."""

    def __init__(self, rows: list[dict]):
        rows = sorted(rows, key=lambda r: r["page"])
        whole_numbers = lambda r, c: np.frombuffer(r[c], f"<i{r['width']}").astype(np.int64)
        big = max(int(np.abs(whole_numbers(r, "vectors")).max(initial=0)) for r in rows)
        self.exact = big * big * rows[0]["dim"] < 1 << 52  # then sums of float products are exact whole numbers
        self.big, self.top, self.computed = big, rows[0]["top"], 0
        self.pages = []
        center = [whole_numbers(r, "center").astype(float) for r in rows]
        for r in rows:
            c = r["children"]
            v = whole_numbers(r, "vectors").reshape(len(r["ids"]) // 8, r["dim"])
            own = (np.frombuffer(r["ids"], np.int64), np.frombuffer(r["rows"], np.int64), v.astype(float) if self.exact else v, np.frombuffer(r["far"], np.float64))
            self.pages.append((np.array(c), np.stack([center[k] for k in c]) if c else None, np.array([rows[k]["radius"] for k in c]), np.array([rows[k]["to_parent"] for k in c]), *own))
        self.root = center[0]

    def search(self, own: int, query: np.ndarray, k: int, least: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k greatest inner products, ties to smaller ids; the row ``own`` is left out, and scores below ``least`` may be."""
        q = query.astype(float)
        exact = self.exact and self.big * int(np.abs(query).max(initial=0)) * len(query) < 1 << 52
        level = float(q @ q) + self.top
        slack = 1e-6 * (1 + math.sqrt(level))
        bound = lambda score: math.sqrt(max(0.0, level - 2 * float(score))) + slack
        ids, scores, reach = np.zeros(0, np.int64), np.zeros(0), math.inf if least is None else bound(least)
        heap = [(0.0, 0, math.sqrt(max(0.0, level - 2 * float(self.root @ q))))]
        while heap:
            low, page, from_center = heapq.heappop(heap)
            if low > reach:
                break
            children, centers, radii, to_parent, entries, rows, vectors, far = self.pages[page]
            if centers is not None:
                near = np.flatnonzero(np.abs(from_center - to_parent) - radii <= reach)
                d = np.sqrt(np.maximum(level - 2 * (centers[near] @ q), 0))
                self.computed += len(near)
                for child, away, low in zip(children[near].tolist(), d.tolist(), (d - radii[near]).tolist(), strict=True):
                    if low <= reach:
                        heapq.heappush(heap, (max(low, 0.0), child, away))
                continue
            near = np.flatnonzero(np.abs(from_center - far) <= reach)
            if not len(near):
                continue
            self.computed += len(near)
            got = vectors[near] @ q if exact else np.array([sum(int(a) * int(b) for a, b in zip(v, query, strict=True)) for v in vectors[near]], object)
            keep = np.flatnonzero((rows[near] != own) & ((got >= scores[-1]) if len(ids) == k else True))
            if len(keep):
                ids, scores = np.concatenate([ids, entries[near[keep]]]), np.concatenate([scores, got[keep]])
                best = np.lexsort((ids, -scores.astype(float)))[:k] if exact else np.array(sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[:k])
                ids, scores = ids[best], scores[best]
                if len(ids) == k:
                    reach = min(reach, bound(scores[-1]))
        return ids, scores


def _searched(index: DataFrame, asked: DataFrame, k: int, query_block: int) -> DataFrame:
    """(query, query_id, vec_id, score) of the blocks that queries (query, query_id, v, least, block's key) ask for."""
    parts = asked.groupBy(*_BLOCK).agg(F.ceil(F.count("*") / query_block).cast("int").alias("parts"))
    dealt = asked.join(F.broadcast(parts), list(_BLOCK)).withColumn("part", F.pmod(F.xxhash64("query"), F.col("parts")).cast("int")).drop("parts")
    pages = index.join(F.broadcast(parts), list(_BLOCK)).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({c: pa.array([], pa.int64()) for c in ("query", "query_id", "vec_id", "score")})
        tree = Tree(left.drop_columns(["part"]).to_pylist())
        out = []
        for row, i, v, least in zip(*(right.column(c).to_pylist() for c in ("query", "query_id", "v", "least")), strict=True):
            out.append((row, i, *tree.search(row, np.array(v, np.int64), k, least)))
        n = [len(o[2]) for o in out]
        cat = lambda j: np.concatenate([o[j] for o in out]).astype(np.int64) if out else np.zeros(0, np.int64)
        return pa.table({"query": np.repeat(np.array([o[0] for o in out], np.int64), n), "query_id": np.repeat(np.array([o[1] for o in out], np.int64), n), "vec_id": cat(2), "score": cat(3)})

    by = (*_BLOCK, "part")
    return pages.groupBy(*by).cogroup(dealt.groupBy(*by)).applyInArrow(search, "query long, query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, block: int = BLOCK, query_block: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k greatest inner products with the vectors of other rows, ties to smaller vec_id.

    Both frames have (row, vec_id, v) as ``whole`` gives them, written, so that a row's number is the same in both.  Inner products are only between
    vectors of one length, and must fit in 64 bits.  A query with fewer than k such candidates gets them all.
    """
    index = build_index(vectors, block)
    whole_numbers = lambda r: np.frombuffer(r["center"], f"<i{r['width']}").astype(float)
    balls: dict[int, dict] = {}
    roots = index.where("page = 0").select(*_BLOCK, "top", "width", "center", "radius").collect()  # one centre a block, for each pivot a few
    for dim in {r["dim"] for r in roots}:
        own = [r for r in roots if r["dim"] == dim]
        balls[dim] = {"key": [(r["pivot"], r["sub"]) for r in own], "top": own[0]["top"], "center": np.stack([whole_numbers(r) for r in own]), "radius": np.array([r["radius"] for r in own])}
    spark = queries.sparkSession
    shared = spark.sparkContext.broadcast(balls)

    def route(bounded: bool):
        """The nearest block of each query; or, with the bound that it gave, the others that may hold better ones."""

        def make(batches):
            for b in batches:
                at, keys = [], []
                for i, v in enumerate(b.column("v").to_pylist()):
                    own = shared.value.get(len(v))
                    if own is None:
                        continue
                    q = np.array(v, float)
                    level = float(q @ q) + own["top"]
                    d = np.sqrt(np.maximum(level - 2 * (own["center"] @ q), 0))
                    low, slack = np.maximum(d - own["radius"], 0), 1e-6 * (1 + math.sqrt(level))
                    first = int(np.lexsort((d, low))[0])
                    to = [first]
                    if bounded:
                        least = b.column("least")[i].as_py()
                        reach = math.inf if least is None else math.sqrt(max(0.0, level - 2 * float(least))) + slack
                        to = [int(x) for x in np.flatnonzero(low <= reach) if x != first]
                    at += [i] * len(to)
                    keys += [(len(v), *own["key"][x]) for x in to]
                got = b.take(pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays([*got.columns, *(pa.array([key[j] for key in keys], pa.int32()) for j in range(3))], [*got.schema.names, *_BLOCK])

        return make

    n, tasks = queries.count(), 2 * spark.sparkContext.defaultParallelism
    query_block = query_block or max(min(MOST_QUERIES, -(-n // tasks)), LEAST_QUERIES)
    schema = "query long, query_id long, v array<long>, least long, dim int, pivot int, sub int"
    asked = queries.select(F.col("row").alias("query"), F.col("vec_id").alias("query_id"), "v", F.lit(None).cast("long").alias("least"))
    near = written(_searched(index, map_arrow(asked, route(False), schema), k, query_block), "nearest")
    if len(roots) > 1:
        # the k-th best score so far: fewer than k found bound nothing
        kth = near.groupBy("query").agg(F.when(F.count("*") >= k, F.min("score")).alias("least"))
        again = map_arrow(asked.drop("least").join(kth, "query", "left").select("query", "query_id", "v", "least"), route(True), schema)
        near = near.union(_searched(index, written(again, "asked"), k, query_block))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    return near.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def op7_exact_top_k(spark, sf_dir: str) -> DataFrame:
    """The 20 best of all other ``embeddings`` for each row whose vec_id is divisible by 20; see ``whole`` and ``top_k``."""
    vectors = written(whole(table(spark, sf_dir, "embeddings")), "vectors")
    return top_k(vectors, vectors.where("vec_id % 20 = 0"))


SQL = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, CASE WHEN len(q.v) = 0 THEN 0 ELSE CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) END AS score
  FROM v q JOIN v c ON q.r <> c.r AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
"""
