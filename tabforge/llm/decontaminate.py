"""Benchmark decontamination by winnowing.

Fingerprints of a text are the least hashes of ``gram`` words in each run of ``window - gram + 1`` neighbouring grams; so any
``window`` words that a document and an item share give both the same fingerprint.  Fingerprints of documents that a bitmap of
the items' fingerprints lets through are joined with the items', and each candidate pair is extended: every occurrence of a
window of the item in the document is found.  Items of fewer words than a window are one window of their own length, whose
fingerprint is their whole gram.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabforge.llm.common import among, bitmap, few, kind_of, map_arrow, opened, table, written
from tabforge.llm.text import LOWER, UPPER, Words, grams, inside, lists, window_min, words

WINDOW, GRAM = 13, 9
NONE = hashlib.sha256(b"").hexdigest()


def _fingerprints(w: Words, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, fingerprint) for each whole window inside a document."""
    least = window_min(grams(w.hashes, gram), window - gram + 1)
    keep = inside(w.at, len(least), window)
    return np.flatnonzero(keep), least[keep]


def fingerprints_of_items(items: DataFrame, window: int, gram: int) -> DataFrame:
    """(ikey, item_id, n, words, prints) of each item with words."""

    def make(batches):
        for b in batches:
            rows = []
            for w in words(b.column("text")):
                places, prints = _fingerprints(w, window, gram)
                doc = np.searchsorted(w.at, places, "right") - 1
                for i in range(len(w.at) - 1):
                    h = w.of(i)
                    if len(h):
                        own = np.unique(prints[doc == i]) if len(h) >= window else grams(h, len(h))
                        rows.append((w.first + i, len(h), h.astype("<u8").tobytes(), own))
            at = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column("ikey").take(at), b.column("item_id").take(at), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary()), lists([r[3] for r in rows], pa.int64())],
                ["ikey", "item_id", "n", "words", "prints"],
            )

    some = items.select(F.monotonically_increasing_id().alias("ikey"), "item_id", "text")
    return map_arrow(some, make, f"ikey long, item_id {items.schema['item_id'].dataType.simpleString()}, n long, words binary, prints array<long>")


def _found(h: np.ndarray, item: np.ndarray, window: int) -> np.ndarray:
    """Places of the document's words inside any occurrence of a window of the item, in order."""
    k = min(window, len(item))
    own, there = grams(h, k), grams(item, k)
    at = np.flatnonzero(np.isin(own, there))
    if not len(at):
        return at
    by = np.argsort(there, kind="stable")
    like = by[np.searchsorted(there[by], own[at])]  # a window of the item with that hash: compare the words themselves
    at = at[(h[at[:, None] + np.arange(k)] == item[like[:, None] + np.arange(k)]).all(axis=1)]
    edge = np.zeros(len(h) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + k, -1)
    return np.flatnonzero(np.cumsum(edge[:-1]) > 0)


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM, also: Sequence[str] = ()) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_hit, item_ids (sorted as strings), n_items, contaminated, and the columns ``also``.

    ``docs`` needs doc_id and text, ``items`` item_id and text; other columns are not read.  A null or empty text has no words: it
    is never hit and, as an item, matches nothing.  Rows with the same or no doc_id are judged each on its own.  Hits of an
    item without item_id count as hit words, but the item is not listed.  Repeated items count once by item_id.  Texts of any length are
    judged as a whole.  ``also`` must not repeat names of the result.
    """
    spark = docs.sparkSession
    known = written(fingerprints_of_items(items, window, gram), "items")
    prints = known.select("ikey", F.explode("prints").alias("print"))
    short = [r.n for r in known.where(F.col("n") < window).select("n").distinct().collect()]  # fewer than `window` numbers
    packed = spark.sparkContext.broadcast(bitmap(prints, F.col("print")))

    def look(batches):
        bits = opened(packed.value)
        for b in batches:
            n_words = np.zeros(b.num_rows, np.int64)
            found: list[np.ndarray | None] = [None] * b.num_rows
            kept: list[bytes | None] = [None] * b.num_rows
            for w in words(b.column("text")):
                n_words[w.first : w.first + len(w.at) - 1] = np.diff(w.at)
                places, own = _fingerprints(w, window, gram)
                hit = among(bits, own)
                at, value = [places[hit]], [own[hit]]
                for k in short:
                    g = grams(w.hashes, k)
                    hit = np.flatnonzero(among(bits, g) & inside(w.at, len(g), k))
                    at.append(hit)
                    value.append(g[hit])
                at, value = np.concatenate(at), np.concatenate(value)
                doc = np.searchsorted(w.at, at, "right") - 1
                for i in np.unique(doc):
                    found[w.first + i] = np.unique(value[doc == i])
                    kept[w.first + i] = w.of(i).astype("<u8").tobytes()
            yield pa.RecordBatch.from_arrays(
                [b.column("row"), b.column("doc_id"), *(b.column(c) for c in also), pa.array(n_words), pa.array([None if f is None else f.view(np.int64) for f in found], pa.list_(pa.int64())), pa.array(kept, pa.binary())],
                ["row", "doc_id", *also, "n_words", "prints", "words"],
            )

    some = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", *also, "text")
    fields = "".join(f", `{c}` {kind_of(docs, c)}" for c in also)
    looked = written(map_arrow(few(some, docs.count()), look, f"row long, doc_id {kind_of(docs, 'doc_id')}{fields}, n_words long, prints array<long>, words binary"), "looked")
    hits = looked.where("prints is not null")
    pairs = hits.select("row", F.explode("prints").alias("print")).join(prints, "print").select("row", "ikey").distinct()
    # a document's words are joined once, with all items that it may hold
    of_row = pairs.join(known.select("ikey", F.col("item_id").cast("string").alias("id"), "words"), "ikey").groupBy("row").agg(F.collect_list(F.struct("id", "words")).alias("items"))

    def extend(batches):
        for b in batches:
            n_hit, ids = [], []
            for own, candidates in zip(b.column("own").to_pylist(), b.column("items").to_pylist(), strict=True):
                h = np.frombuffer(own, "<u8")
                hit, found = np.zeros(len(h), bool), set()
                for item in candidates:
                    at = _found(h, np.frombuffer(item["words"], "<u8"), window)
                    hit[at] = True
                    if len(at) and item["id"] is not None:
                        found.add(item["id"])
                n_hit.append(int(hit.sum()))
                ids.append(sorted(found, key=str.encode))
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(n_hit, pa.int64()), pa.array(ids, pa.list_(pa.string()))], ["row", "n_hit", "item_ids"])

    full = hits.select("row", F.col("words").alias("own")).join(of_row, "row").select("row", "own", "items")
    by_row = map_arrow(full, extend, "row long, n_hit long, item_ids array<string>")
    out = looked.select("row", "doc_id", *also, "n_words").join(by_row, "row", "left")
    n_hit, ids = F.coalesce("n_hit", F.lit(0).cast("long")), F.coalesce("item_ids", F.array().cast("array<string>"))
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), ids.alias("item_ids"), F.size(ids).cast("long").alias("n_items"), ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"), *also)


def op5_decontaminate(spark, sf_dir: str) -> DataFrame:
    """All ``documents`` against all of ``benchmark``; see ``decontaminate``."""
    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), "contaminated")


_SPLIT = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
SQL = f"""
WITH item AS (SELECT item_id, ws, least(len(ws), 13) AS k FROM (SELECT item_id, {_SPLIT} AS ws FROM benchmark) WHERE len(ws) > 0),
item_window AS (SELECT DISTINCT item_id, k, array_to_string(ws[p:p + k - 1], ' ') AS g FROM (SELECT item_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS p FROM item)),
doc AS (SELECT doc_id, {_SPLIT} AS ws FROM documents),
doc_window AS (SELECT doc_id, k, p, array_to_string(ws[p:p + k - 1], ' ') AS g
  FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS p FROM doc, (SELECT DISTINCT k FROM item) WHERE len(ws) >= k)),
hit AS (SELECT doc_id, item_id, p, d.k FROM doc_window d JOIN item_window USING (g)),
n AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS place FROM hit) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM doc LEFT JOIN n USING (doc_id) LEFT JOIN i USING (doc_id)
"""
