"""Substring deduplication: fuzzy passages that repeat across documents, by collinear chaining.

1. Seeds are minimisers: of each ``WINDOW`` neighbouring grams of ``GRAM`` words the least hash; any 8 words that two documents
   share give both a common seed.
2. A seed's anchor is its first place in the smallest doc_id that has it.  Other documents' places are joined with the anchor
   only, so a passage that many documents share gives as many matches as it has places, not their square.  Seeds of one document alone
   stay behind a bitmap of bounded size before they would be shuffled for the join.
3. The matches of a document with one anchor document are chained: the best-scoring collinear chain under a gap cost, through a
   Fenwick tree of prefix maxima, then the next on what it left.
4. Chains are aligned word by word, between their seeds and beyond their ends, and cut where words stop to match.
5. Aligned parts of one document that touch are one passage; those of at least ``LEAST`` words count.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabforge.llm.common import ID, among, among_packed, bitmap, changes, few, id_of, identified, kind_of, map_arrow, opened, split, table, written
from tabforge.llm.text import grams, inside, mix, window_min, words

GRAM, WINDOW, LEAST, SIMILARITY = 5, 4, 50, 0.8
#: A chain ends where either text has a gap of more words, and has seeds over so many words; what a seed is worth and a word of gap costs; words looked at beyond a chain.
MAX_GAP, LEAST_SPAN, SEED_WORTH, GAP_COST, BEYOND = 40, 9, 4.0, 0.1, 64
#: A part ends at so many unmatched words in a row; parts of a passage may be so many words apart; an end is given up at this loss.
BREAK, APART, DROP = 8, 3, 6
#: The bitmap of seeds that several documents have takes this many bits at most (8 MB); beyond it only lets more seeds through.
MOST_BITS = 1 << 26


def seeds(docs: DataFrame, gram: int = GRAM, window: int = WINDOW, least: int = LEAST, only: DataFrame | None = None, n_only: int = 0) -> DataFrame:
    """(seed, ID, place) of documents (ID, text) of at least ``least`` words; with ``only``, but those that may be among its seeds.

    A seed's later places in a document are given twice: as that seed with -1 - place, so that they can match the first place
    elsewhere, and as a seed of their own made of hash and ordinal, so that texts which repeat themselves match in step.
    """
    packed = None if only is None else docs.sparkSession.sparkContext.broadcast(bitmap(only, F.col("seed"), min(MOST_BITS, 1 << max(20, (8 * n_only).bit_length()))))

    def make(batches):
        for b in batches:
            for w in words(b.column("text")):
                g = grams(w.hashes, gram)
                low = window_min(g, window)
                low_ok = inside(w.at, len(low), gram + window - 1)
                chosen = np.zeros(len(g), bool)
                for o in range(window if len(low) else 0):
                    chosen[o : o + len(low)] |= (g[o : o + len(low)] == low) & low_ok
                size = np.diff(w.at)
                at = np.flatnonzero(chosen)
                doc = np.searchsorted(w.at, at, "right") - 1
                long = size[doc] >= least
                at, doc = at[long], doc[long]
                if len(at):
                    seed, place = g[at].view(np.int64), at - w.at[doc]
                    order = np.lexsort((place, seed, doc))
                    new = np.ones(len(at), bool)
                    new[1:] = (seed[order[1:]] != seed[order[:-1]]) | (doc[order[1:]] != doc[order[:-1]])
                    ordinal = np.empty(len(at), np.int64)
                    ordinal[order] = np.arange(len(at)) - np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
                    again = np.flatnonzero(ordinal)
                    own = mix(seed[again].view(np.uint64) + ordinal[again].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
                    seed, doc, place = np.concatenate([seed, own]), np.concatenate([doc, doc[again]]), np.concatenate([np.where(ordinal > 0, -1 - place, place), place[again]])
                    if packed is not None:
                        keep = among_packed(packed.value, seed)
                        seed, doc, place = seed[keep], doc[keep], place[keep]
                    yield pa.RecordBatch.from_arrays([pa.array(seed), b.column(ID).take(pa.array(w.first + doc)), pa.array(place.astype(np.int32))], ["seed", ID, "place"])

    return map_arrow(docs.where(F.col(ID).isNotNull()).select(ID, "text"), make, f"seed long, {ID} {kind_of(docs, ID)}, place int")


class PrefixMax:
    """A Fenwick tree of (value, which) with the greatest value of each prefix."""

    def __init__(self, n: int):
        self.best = [(-1e18, -1)] * (n + 1)

    def put(self, i: int, value: tuple[float, int]) -> None:
        i += 1
        while i < len(self.best):
            if value > self.best[i]:
                self.best[i] = value
            i += i & -i

    def before(self, i: int) -> tuple[float, int]:
        """The greatest among places less than i."""
        out = (-1e18, -1)
        while i:
            if self.best[i] > out:
                out = self.best[i]
            i -= i & -i
        return out


def chains(x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """Collinear chains of matches (sorted by x, then y) over LEAST_SPAN words or more, as places in x; each match is in one chain at most."""
    if len(x) < 2:
        return []
    shift, count = np.unique(y - x, return_counts=True)
    main = np.flatnonzero(y - x == shift[np.argmax(count)])
    if len(main) == len(np.unique(x)):  # one diagonal explains every place
        found = [main]
    else:
        _, rank = np.unique(y, return_inverse=True)
        tree, score, back, waiting = PrefixMax(int(rank.max()) + 1), [], [], []
        for i, (xi, yi, r) in enumerate(zip(x.tolist(), y.tolist(), rank.tolist(), strict=True)):
            if i and xi != x[i - 1]:
                for args in waiting:
                    tree.put(*args)
                waiting = []
            value, j = tree.before(r)
            gain = value - GAP_COST * (xi + yi)
            score.append(SEED_WORTH + max(0.0, gain))
            back.append(j if gain > 0 else -1)
            waiting.append((r, (score[-1] + GAP_COST * (xi + yi), i)))
        used, found = [False] * len(x), []
        for i in sorted(range(len(x)), key=lambda i: -score[i]):
            own = []
            while i >= 0 and not used[i]:
                used[i] = True
                own.append(i)
                i = back[i]
            if len(own) > 1:
                found.append(np.array(own[::-1]))
    out = []
    for c in found:
        far = np.flatnonzero((np.diff(x[c]) > MAX_GAP + GRAM) | (np.diff(y[c]) > MAX_GAP + GRAM)) + 1
        out += [p for p in np.split(c, far) if x[p[-1]] - x[p[0]] + GRAM >= LEAST_SPAN]
    return out


def _chained(matches: DataFrame) -> DataFrame:
    """(ID, ref, xs, ys) of each chain, from matches (ID, ref, x, y) dealt by document and sorted."""

    def flush(parts: list[pa.RecordBatch]):
        t = pa.Table.from_batches(parts).combine_chunks()
        own, ref = (c.combine_chunks() if c.num_chunks else pa.array([], c.type) for c in (t.column(0), t.column(1)))
        x, y = t.column("x").to_numpy(), t.column("y").to_numpy()
        begin = np.concatenate([[0], np.flatnonzero(changes(own, ref)) + 1])
        end = np.append(begin[1:], len(x))
        wide = x[end - 1] - x[begin] + GRAM >= LEAST_SPAN  # sorted by x
        at, found = [], []
        for lo, hi in zip(begin[wide].tolist(), end[wide].tolist(), strict=True):
            px, py = x[lo:hi], y[lo:hi]
            new = np.ones(len(px), bool)
            new[1:] = (px[1:] != px[:-1]) | (py[1:] != py[:-1])
            px, py = px[new], py[new]
            own_chains = chains(px, py)
            at += [lo] * len(own_chains)
            found += [(px[c], py[c]) for c in own_chains]
        if found:
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(f[0]) for f in found])]).astype(np.int32))
            flat = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([f[k] for f in found]).astype(np.int32))) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([own.take(pa.array(at)), ref.take(pa.array(at)), *flat], [ID, "ref", "xs", "ys"])

    def make(batches):
        held: list[pa.RecordBatch] = []  # of one document, which may go on
        for b in batches:
            if not b.num_rows:
                continue
            last = np.flatnonzero(changes(b.column(0)))
            last = int(last[-1]) + 1 if len(last) else 0
            if last or held and held[-1].column(0)[-1] != b.column(0)[0]:
                if held or last:
                    yield from flush([*held, b.slice(0, last)])
                held = [b.slice(last)]
            else:
                held.append(b)
        if held:
            yield from flush(held)

    dealt = matches.select(ID, "ref", "x", "y").repartition(ID).sortWithinPartitions(ID, "ref", "x", "y")
    return map_arrow(dealt, make, f"{ID} {kind_of(matches, ID)}, ref {kind_of(matches, 'ref')}, xs array<int>, ys array<int>")


def _word_table(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(ID, words) of the documents that may be among ids: 4 bytes of hash a word.  A task gives no document twice."""
    packed = docs.sparkSession.sparkContext.broadcast(bitmap(ids, F.xxhash64(ID)))

    def make(batches):
        bits, seen = opened(packed.value), set()
        for b in batches:
            b = b.filter(pa.array(among(bits, b.column("key").to_numpy())))
            b = b.filter(pa.array([k not in seen and not seen.add(k) for k in b.column("key").to_pylist()], pa.bool_()))
            at, own = [], []
            for w in words(b.column("text")):
                at += range(w.first, w.first + len(w.at) - 1)
                own += [w.of(i).astype("<u4").tobytes() for i in range(len(w.at) - 1)]
            yield pa.RecordBatch.from_arrays([b.column(ID).take(pa.array(at, pa.int64())), pa.array(own, pa.binary())], [ID, "words"])

    some = docs.where(F.col(ID).isNotNull()).select(ID, F.xxhash64(ID).alias("key"), "text")
    return map_arrow(some, make, f"{ID} {kind_of(docs, ID)}, words binary")


def _reach(same: np.ndarray) -> int:
    """How far an end goes on: to the greatest score (match 1, mismatch -1) before the score has dropped by DROP."""
    score = np.cumsum(np.where(same, 1, -1))
    drop = np.flatnonzero(np.maximum.accumulate(np.maximum(score, 0)) - score >= DROP)
    score = score[: drop[0]] if len(drop) else score
    return int(np.argmax(score)) + 1 if len(score) and score.max() > 0 else 0


def _common(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A longest common subsequence of two short word lists: places in each."""
    n, m = len(a), len(b)
    best = np.zeros((n + 1, m + 1), np.int32)
    for i in range(n - 1, -1, -1):
        row = np.maximum(best[i + 1, :-1], np.where(b == a[i], best[i + 1, 1:] + 1, 0))
        best[i, :-1] = np.maximum.accumulate(row[::-1])[::-1]
    i = j = 0
    out = []
    while i < n and j < m:
        if a[i] == b[j] and best[i, j] == best[i + 1, j + 1] + 1:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1, j] >= best[i, j + 1]:
            i += 1
        else:
            j += 1
    both = np.array(out, np.int64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def align(own: np.ndarray, ref: np.ndarray, xs: np.ndarray, ys: np.ndarray, gram: int = GRAM) -> list[tuple[int, int, int, int, int]]:
    """Parts (start, end, ref start, ref end, matched words) of a chain with seeds at xs, ys of the two word lists.

    Seeds on one diagonal are compared word by word with all that lies between them; gaps between diagonals by a longest
    common subsequence; ends go on along their diagonal while it pays.
    """
    partner = np.full(len(own), -1, np.int64)
    shift = ys - xs
    cut = np.flatnonzero(np.diff(shift)) + 1
    at = (0, 0)
    for lo, hi in zip([0, *cut], [*cut, len(xs)], strict=True):
        d = int(shift[lo])
        x0, x1 = int(xs[lo]), int(xs[hi - 1]) + gram
        if lo == 0:
            n = min(x0, x0 + d)
            x0 -= _reach((own[x0 - n : x0] == ref[x0 + d - n : x0 + d])[::-1])
        else:
            x0 = max(x0, at[0], at[1] - d)
            if x0 > at[0] and x0 + d > at[1]:
                i, j = _common(own[at[0] : x0], ref[at[1] : x0 + d])
                partner[at[0] + i] = at[1] + j
        if hi == len(xs):
            n = min(len(own) - x1, len(ref) - x1 - d)
            x1 += _reach(own[x1 : x1 + n] == ref[x1 + d : x1 + d + n])
        if x1 > x0:
            span = np.arange(x0, x1)
            span = span[own[span] == ref[span + d]]
            partner[span] = span + d
            at = (x1, x1 + d)
    hit = np.flatnonzero(partner >= 0)
    if not len(hit):
        return []
    out = []
    for p in np.split(hit, np.flatnonzero(np.diff(hit) > BREAK) + 1):
        start, end = int(p[0]), int(p[-1]) + 1
        if len(p) >= SIMILARITY * (end - start):
            out.append((start, end, int(partner[p[0]]), int(partner[p[-1]]) + 1, len(p)))
    return out


def merge(parts: list[tuple], least: int = LEAST) -> list[tuple]:
    """Passages (start, end, ref, ref start, ref end) of one document from its parts (the same).

    Parts that overlap or are at most APART words apart are one passage; it refers to its longest part.
    """
    out: list[list] = []
    for p in sorted(parts, key=lambda p: p[:2]):
        if out and p[0] <= out[-1][1] + APART:
            out[-1][1] = max(out[-1][1], p[1])
            if p[1] - p[0] > out[-1][2][1] - out[-1][2][0]:
                out[-1][2] = p
        else:
            out.append([p[0], p[1], p])
    return [(s, e, *p[2:5]) for s, e, p in out if e - s >= least]


def passages(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, start, end, ref_doc_id, ref_start, ref_end, ID): repeated passages of at least ``least`` words, places in words.

    Each lies in a document with a larger doc_id than the document it refers to, whose own passage is not listed: the first place of
    a passage stays.  Repeats inside one document are not looked for.  Null and empty texts, texts of fewer words and rows without doc_id have
    none; texts of any length are read as a whole.  Rows that share a doc_id but not their text are different documents (of which the one with the
    least hash counts as smaller), told apart by ID; rows that repeat both are one.  Other columns are not read.
    """
    docs = identified(docs)
    n, unique = docs.count(), docs.schema[ID].dataType == docs.schema["doc_id"].dataType
    every = seeds(docs, least=least)
    first = F.when(F.col("place") >= 0, F.col(ID))
    anchors = every.groupBy("seed").agg(F.min(ID).alias("ref"), F.min_by("place", first).alias("y"), F.max(ID).alias("most")).where("ref <> most").drop("most")
    anchors = written(few(anchors, n), "anchors")  # apart from the aggregation, the join can split a hot seed
    n_anchors = anchors.count()
    again = seeds(docs, least=least, only=anchors, n_only=n_anchors)
    matches = again.join(anchors, "seed").where(F.col(ID) != F.col("ref")).select(ID, "ref", F.when(F.col("place") < 0, -1 - F.col("place")).otherwise(F.col("place")).alias("x"), "y")
    found = written(few(_chained(matches), n), "chains")
    ids = found.select(ID).union(found.select("ref")).distinct()
    text = few(_word_table(docs, ids), n)
    text = written(text if unique else text.dropDuplicates([ID]), "words")

    def piece(column: str, places: str):
        low = F.greatest(F.element_at(places, 1) - BEYOND, F.lit(0))
        size = F.element_at(places, -1) + GRAM + BEYOND - low
        return low, F.substring(F.col(column), low * 4 + 1, size * 4)

    (own_low, own), (ref_low, ref) = piece("words", "xs"), piece("words", "ys")
    with_own = found.join(text, ID).select(ID, "ref", "xs", "ys", own_low.alias("own_low"), own.alias("own"))
    with_both = with_own.join(text.withColumnRenamed(ID, "ref"), "ref").select(ID, "ref", "xs", "ys", "own_low", "own", ref_low.alias("ref_low"), ref.alias("other"))
    places = ("start", "end", "ref_start", "ref_end")

    def make(batches):
        for b in batches:
            at, rows = [], []
            for k, (xs, ys, ol, o, rl, r) in enumerate(zip(b.column(2), b.column(3), *(b.column(i).to_pylist() for i in (4, 5, 6, 7)), strict=True)):
                for s, e, rs, re, _ in align(np.frombuffer(o, "<u4"), np.frombuffer(r, "<u4"), xs.values.to_numpy() - ol, ys.values.to_numpy() - rl):
                    at.append(k)
                    rows.append((s + ol, e + ol, rs + rl, re + rl))
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), *(pa.array([r[k] for r in rows], pa.int64()) for k in range(4))], [ID, "ref", *places])

    kind = kind_of(docs, ID)
    parts = map_arrow(with_both, make, f"{ID} {kind}, ref {kind}, " + ", ".join(f"{c} long" for c in places))
    gathered = parts.groupBy(ID).agg(F.collect_list(F.struct("start", "end", "ref", "ref_start", "ref_end")).alias("parts"))

    def join(batches):
        for b in batches:
            at, rows = [], []
            for k, own in enumerate(b.column(1).to_pylist()):
                merged = merge([tuple(x.values()) for x in own], least)
                at += [k] * len(merged)
                rows += merged
            refs = b.column(1).type.value_type.field("ref").type
            columns = [pa.array([r[k] for r in rows], refs if k == 2 else pa.int64()) for k in range(5)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *columns], [ID, "start", "end", "ref", "ref_start", "ref_end"])

    merged = map_arrow(gathered, join, f"{ID} {kind}, start long, end long, ref {kind}, ref_start long, ref_end long")
    return merged.select(id_of(merged, ID).alias("doc_id"), "start", "end", id_of(merged, "ref").alias("ref_doc_id"), "ref_start", "ref_end", ID)


def cut(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs without the words of the passages that ``passages`` found in them, n_chars (if there) brought up to date; documents of which no
    word is left go.

    A passage goes from its first word up to the word after it.  Other columns, documents without passages and rows without doc_id stay as they are.
    """
    n = docs.count()
    found = written(few(found.select(ID, "start", "end"), n), "passages")
    may, never = split(identified(docs), found, [ID])
    spans = found.groupBy(ID).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("__tabforge_spans"))
    # by sort-merge: an exchange keeps the two Python functions in different tasks, each with one worker
    joined = may.join(spans.hint("merge"), ID, "left").select(*docs.columns, "__tabforge_spans")
    place = docs.columns.index("text")

    def make(batches):
        for b in batches:
            texts, spans, keep = b.column(place).to_pylist(), b.column(b.num_columns - 1).to_pylist(), np.ones(b.num_rows, bool)
            for i in range(b.num_rows):
                if spans[i]:
                    data = texts[i].encode()
                    (w,) = words(pa.array([texts[i]]))
                    out, at = [], 0
                    left = len(w.hashes)
                    for s in spans[i]:
                        end = s["end"]
                        out.append(data[at : w.starts[s["start"]]])
                        at = int(w.starts[end]) if end < len(w.starts) else len(data)
                        left -= end - s["start"]
                    texts[i] = b"".join([*out, data[at:]]).decode()
                    keep[i] = left > 0
            columns = b.columns[:-1]
            columns[place] = pa.array(texts, b.schema.field(place).type)
            yield pa.RecordBatch.from_arrays(columns, b.schema.names[:-1]).filter(pa.array(keep))

    changed = map_arrow(joined, make, docs.schema)
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text")).cast(docs.schema["n_chars"].dataType))
    return few(never.select(*docs.columns), n).union(few(changed.select(*docs.columns), n))


def op2_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """All repeated passages of ``documents`` of 50 words or more: where they are, and where they are first; see ``passages``."""
    found = passages(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("start").alias("first_word"), (F.col("end") - F.col("start")).alias("n_words"), "ref_doc_id", F.col("ref_start").alias("ref_first_word"), (F.col("ref_end") - F.col("ref_start")).alias("ref_n_words"))
