"""Quality by co-training: a text-content view and a page-metadata view teach each other.

Each view has its own linear classifier.  In each round a view labels the unlabelled documents that it is surest of, and these
join the other view's training rows, as long as the view does well on labelled rows that are kept apart: one that does not has nothing to teach.  Both views are then calibrated, and a weighing of their calibrated odds, fitted on the rows kept apart, scores all documents.

Labelled rows are a bounded sample; unlabelled ones are all other documents: those that labels lack, that are held out, whose
quality is null, or that are beyond the sample (of these the text and metadata alone are read).  Their features are written once,
and only sums over them (moments, counts of odds, gradients and Hessians) reach the driver.  If no document is left
unlabelled, no labels are exchanged: each view is fitted on its labelled rows, then calibrated and combined as always.
"""

from __future__ import annotations

import ast
import zlib
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tabforge.llm.common import kind_of, map_arrow, table, written
from tabforge.llm.text import buffers, grams, inside, words
from tabforge.llm.toxicity import held_out, labels_of

#: At most so many labelled rows train the views: those with the least hashes of doc_id.
SAMPLE_ROWS = 20_000
#: Documents are equally sure whose log odds fall into one of so many bins from 0 to LIMIT; hashes of doc_id, as many bins, order these.
BINS, LIMIT, BLOCK = 4096, 30.0, 2048
ROUNDS, SHARE = 5, 0.05
SOURCES, LANGS, WORDS = 64, 16, 64
#: A view teaches a label while its area under the curve on the rows kept apart is above one half by so many standard errors, and so many of those
#: rows that it would give the label have it, where there are so many rows to judge by.
SURE, PRECISION, JUDGED = 2.0, 0.95, 100
THRESHOLD = 0.5
TEXT_FEATURES = (*(f"share of words {k}" for k in range(WORDS)), "log words", "word length", "distinct words", "repeated trigrams", "capitals", "digits", "signs", "other bytes", "lines", "log bytes", "empty")


class View(NamedTuple):
    center: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    slope: float
    offset: float


class Model(NamedTuple):
    text: View
    meta: View
    mixture: np.ndarray


class Round(NamedTuple):
    """The views of a round, and by view and label the least (bin of odds, bin of hash) that is not sure enough."""

    views: list[View]
    cuts: dict[tuple[int, int], tuple[int, int]]


#: The cut of a view that gives no labels: no document is that sure.
NOTHING = (BINS, 0)

#: Sums an array-valued function of (text features, metadata features, hash bins) over blocks of unlabelled documents; 0 if there are none.
Fold = Callable[[Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]], np.ndarray]


def text_view(column: pa.Array) -> np.ndarray:
    """Features of whole texts: shares of words by hash, and counts; texts without words have zeros but for the last."""
    data, at = buffers(column)
    n = len(column)
    size = np.diff(at).astype(float)
    count = np.zeros(n)
    letters, distinct, repeated, trigrams, bags = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n), np.zeros((n, WORDS))
    for w in words(column):
        docs = w.first + np.arange(len(w.at) - 1)
        owner = np.repeat(np.arange(len(docs)), np.diff(w.at))
        bags[docs] += np.bincount(owner * WORDS + (w.hashes % np.uint64(WORDS)).astype(np.int64), minlength=len(docs) * WORDS).reshape(len(docs), WORDS)
        count[docs] = np.diff(w.at)
        letters[docs] += np.bincount(np.searchsorted(w.at, np.arange(len(w.starts)), "right") - 1, weights=w.ends - w.starts, minlength=len(docs))
        g = grams(w.hashes, 3)
        keep = inside(w.at, len(g), 3)
        for values, places, total in ((w.hashes, np.arange(len(w.hashes)), distinct), (g[keep], np.flatnonzero(keep), repeated)):
            owner = np.searchsorted(w.at, places, "right") - 1
            order = np.lexsort((values, owner))
            v, o = values[order], owner[order]
            new = np.ones(len(v), bool)
            new[1:] = (v[1:] != v[:-1]) | (o[1:] != o[:-1])
            total[docs] = np.bincount(o, weights=new, minlength=len(docs))
            if total is repeated:
                trigrams[docs] = np.bincount(o, minlength=len(docs))
    kinds = np.zeros((n, 5))
    for lo in range(0, n, 256):  # byte kinds, some documents at a time
        a, z = int(at[lo]), int(at[min(n, lo + 256)])
        d = data[a:z]
        edges = (at[lo : min(n, lo + 256) + 1] - a).astype(np.int64)
        for k, is_kind in enumerate(((d >= 65) & (d <= 90), (d >= 48) & (d <= 57), (d > 32) & (d < 127) & ~((d >= 48) & (d <= 57)) & ~((d >= 65) & (d <= 90)) & ~((d >= 97) & (d <= 122)), d >= 128, d == 10)):
            total = np.concatenate([[0], np.cumsum(is_kind)])
            kinds[lo : lo + 256, k] = total[edges[1:]] - total[edges[:-1]]
    safe = np.maximum(count, 1)
    return np.column_stack([np.sqrt(bags / safe[:, None]), np.log1p(count), letters / safe, distinct / safe, 1 - repeated / np.maximum(trigrams, 1), *(kinds[:, k] / np.maximum(size, 1) for k in range(5)), np.log1p(size), count == 0])


def meta_codes(source: list, lang: list, n_chars: list) -> np.ndarray:
    """What meta_view needs of a document's record: slots of source and language, whether the length is null, and its logarithm."""
    size = np.array([np.nan if x is None else float(x) for x in n_chars])
    slots = [[zlib.crc32(str(v).encode()) % k for v in values] for values, k in ((source, SOURCES), (lang, LANGS))]
    return np.column_stack([*slots, np.isnan(size), np.log1p(np.maximum(np.nan_to_num(size), 0))]).astype(float)


def expanded(codes: np.ndarray) -> np.ndarray:
    out = np.zeros((len(codes), SOURCES + LANGS + 3))
    rows = np.arange(len(codes))
    out[rows, codes[:, 0].astype(np.int64)] = 1
    out[rows, SOURCES + codes[:, 1].astype(np.int64)] = 1
    out[:, -3:-1] = codes[:, 2:]
    out[:, -1] = out[:, -2] ** 2 / 10
    return out


def meta_view(source: list, lang: list, n_chars: list) -> np.ndarray:
    """Features of a document's record: source and language by hashed indicator, length by order of magnitude; nulls have their own."""
    return expanded(meta_codes(source, lang, n_chars))


def _hash_bins(ids: np.ndarray) -> np.ndarray:
    x = ids.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return ((x ^ (x >> np.uint64(32))) % np.uint64(BINS)).astype(np.int64)


def _biased(x: np.ndarray) -> np.ndarray:
    return np.column_stack([x, np.ones(len(x))])


def _sums(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Gradient and, below it, Hessian of the logistic loss at w, of rows that have their bias."""
    p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
    return np.vstack([(p - y) @ x, (x * (p * (1 - p) + 1e-6)[:, None]).T @ x])


def _step(w: np.ndarray, sums: np.ndarray, decay: float = 1.0) -> tuple[np.ndarray, bool]:
    """A damped Newton step, and whether it was too small for another; the bias is the last weight."""
    ridge = decay * np.eye(len(w))
    ridge[-1, -1] = 1e-3
    step = np.linalg.solve(sums[1:] + ridge, sums[0] + ridge @ w)
    return w - step * min(1.0, 5.0 / max(1e-9, np.abs(step).max())), bool(np.abs(step).max() < 1e-6)


def _newton(x: np.ndarray, y: np.ndarray, rounds: int = 25) -> np.ndarray:
    """Logistic regression with a bias as last weight, by damped Newton steps."""
    x = _biased(x)
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        w, done = _step(w, _sums(x, y, w))
        if done:
            break
    return w


def _logit(view: View, x: np.ndarray) -> np.ndarray:
    z = np.clip(((x - view.center) / view.scale) @ view.weights[:-1] + view.weights[-1], -30, 30)
    return np.clip(view.slope * z + view.offset, -30, 30)


def _sureness(z: np.ndarray) -> np.ndarray:
    return np.minimum(np.abs(z) * (BINS / LIMIT), BINS - 1).astype(np.int64)


def _agreed(z: list[np.ndarray], me: int, label: int) -> np.ndarray:
    """Documents for which a view's odds, and those of both views together, are for the label: one that the other view is surer to be of the other
    class is not given to it."""
    return ((z[me] > 0) == bool(label)) & ((z[0] + z[1] > 0) == bool(label))


def _given(history: list[Round], features: tuple[np.ndarray, np.ndarray], key: np.ndarray) -> list[np.ndarray]:
    """By view, the labels that the rounds so far have given each document for it; -1 for none."""
    out = [np.full(len(key), -1), np.full(len(key), -1)]
    for r in history:
        z = [_logit(v, x) for v, x in zip(r.views, features, strict=True)]
        for me, other in ((0, 1), (1, 0)):
            sure = _sureness(z[me])
            for label in (1, 0):
                at, tie = r.cuts[me, label]
                out[other][(out[other] < 0) & _agreed(z, me, label) & ((sure > at) | ((sure == at) & (key < tie)))] = label
    return out


def _cuts(fold: Fold, history: list[Round], views: list[View], wanted: dict[int, int]) -> dict[tuple[int, int], tuple[int, int]]:
    """By view and label, where the ``wanted[label]`` surest documents end among those that the other view has not been given yet:
    counts by bins of odds, then by hashes in the bin of the cut."""
    sides = [(me, label) for me in (0, 1) for label in (1, 0)]

    def count(at: dict | None):
        def make(text, meta, key):
            out = []
            z, taken = [_logit(v, x) for v, x in zip(views, (text, meta), strict=True)], _given(history, (text, meta), key)
            for me, label in sides:
                mine = _agreed(z, me, label) & (taken[1 - me] < 0)
                sure = _sureness(z[me])
                out.append(np.bincount(sure[mine] if at is None else key[mine & (sure == at[me, label])], minlength=BINS))
            return np.array(out, float)

        return fold(make)

    at, left = {}, {}
    for side, c in zip(sides, count(None), strict=True):
        above = np.concatenate([np.cumsum(c[::-1])[::-1], [0]])  # documents in this bin or surer ones
        at[side] = int(np.searchsorted(-above, -wanted[side[1]], "left")) - 1  # the surest bin that would be too many, -1 if none is
        left[side] = wanted[side[1]] - above[at[side] + 1]
    return {side: (at[side], int(np.searchsorted(np.cumsum(c), left[side], "right"))) for side, c in zip(sides, count(at), strict=True)}


def _taught(fold: Fold, history: list[Round], own: list[tuple[np.ndarray, np.ndarray]], scales: list, start: list[np.ndarray], rounds: int = 25) -> list[np.ndarray]:
    """Weights of both views on their labelled rows and the documents given to them, by Newton steps on sums of all documents."""
    weights, done = list(start), [False, False]
    for _ in range(rounds):
        now, open_ = list(weights), [v for v in (0, 1) if not done[v]]

        def make(text, meta, key, now=now, open_=open_):
            given, parts = _given(history, (text, meta), key), []
            for v in open_:
                has = given[v] >= 0
                parts.append(_sums(_biased(((text, meta)[v][has] - scales[v][0]) / scales[v][1]), given[v][has].astype(float), now[v]).ravel())
            return np.concatenate(parts)

        total, used = fold(make), 0
        for v in open_:
            k = len(now[v])
            sums = total[used : used + (k + 1) * k].reshape(k + 1, k) + _sums(_biased((own[v][0] - scales[v][0]) / scales[v][1]), own[v][1], now[v])
            used += (k + 1) * k
            weights[v], done[v] = _step(now[v], sums)
        if all(done):
            break
    return weights


def area(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Area under the curve of scores for labels 0 and 1, and its standard error were the scores random; one half without both labels."""
    n1 = int(y.sum())
    n0 = len(y) - n1
    if not n0 or not n1:
        return 0.5, 0.0
    values, inverse, times = np.unique(z, return_inverse=True, return_counts=True)
    rank = (np.cumsum(times) - (times - 1) / 2)[inverse]
    return float((rank[y > 0].sum() - n1 * (n1 + 1) / 2) / (n0 * n1)), float(np.sqrt((n0 + n1 + 1) / (12 * n0 * n1)))


def _teaches(z: np.ndarray, y: np.ndarray, label: int, cut: int) -> bool:
    """Whether a view's labels are worth giving, by its odds for rows kept apart: it ranks them better than chance, and those that it would
    give this label have it.  A label that it gives to none of them has the precision of a guess; fewer than JUDGED rows say too little for that."""
    auc, error = area(z, y)
    sure = ((z > 0) == bool(label)) & (_sureness(z) >= cut)
    right, guess = int((y[sure] == label).sum()), float((y == label).mean())
    return auc > 0.5 + SURE * error and (len(y) < JUDGED or right + guess >= PRECISION * (int(sure.sum()) + 1))


def in_memory(text: np.ndarray, meta: np.ndarray) -> Fold:
    return lambda make: make(text, meta, _hash_bins(np.arange(len(text)))) if len(text) else np.zeros(1)


def co_train(text: np.ndarray, meta: np.ndarray, y: np.ndarray, text_pool: np.ndarray, meta_pool: np.ndarray, apart: np.ndarray, rounds: int = ROUNDS, share: float = SHARE) -> Model:
    """The model from labelled rows and an unlabelled pool; ``apart`` marks the labelled rows kept for calibration."""
    return co_train_over(text, meta, y, in_memory(text_pool, meta_pool), apart, rounds, share)


def co_train_over(text: np.ndarray, meta: np.ndarray, y: np.ndarray, fold: Fold, apart: np.ndarray, rounds: int = ROUNDS, share: float = SHARE) -> Model:
    """co_train with an unlabelled pool of any size, of which only sums are seen."""
    start = [x.mean(0) for x in (text, meta)]
    moments = fold(lambda a, b, key: np.concatenate([[len(key)], *(f(x - m) for x, m in zip((a, b), start, strict=True) for f in (lambda d: d.sum(0), lambda d: (d**2).sum(0)))]))
    n, at, scales = int(moments[0]), 1, []
    for x, m in zip((text, meta), start, strict=True):
        k, d = x.shape[1], x - m
        first, second = ((moments[at : at + k], moments[at + k : at + 2 * k]) if n else (0.0, 0.0))
        mean = (d.sum(0) + first) / (len(x) + n)
        scales.append((m + mean, np.maximum(np.sqrt(np.maximum(((d**2).sum(0) + second) / (len(x) + n) - mean**2, 0)), 1e-3)))
        at += 2 * k
    own = [(x[~apart], y[~apart]) for x in (text, meta)]
    weights = [_newton((x - c) / s, t) for (c, s), (x, t) in zip(scales, own, strict=True)]
    rate = min(0.95, max(0.05, float(y.mean())))
    history: list[Round] = []
    for _ in range(rounds if n else 0):
        views = [View(c, s, w, 1.0, 0.0) for (c, s), w in zip(scales, weights, strict=True)]
        cuts = _cuts(fold, history, views, {1: int(share * n * rate), 0: int(share * n * (1 - rate))})
        if apart.any():
            cuts = {(v, label): at if _teaches(_logit(views[v], (text, meta)[v][apart]), y[apart], label, at[0]) else NOTHING for (v, label), at in cuts.items()}
        if all(at == NOTHING for at in cuts.values()):
            break
        history = [*history, Round(views, cuts)]
        weights = _taught(fold, history, own, scales, weights)
    views = [View(c, s, w, 1.0, 0.0) for (c, s), w in zip(scales, weights, strict=True)]
    kept = apart if 0 < y[apart].sum() < apart.sum() else np.ones(len(y), bool)
    calibrated = []
    for v, x in zip(views, (text, meta), strict=True):
        slope, offset = _newton(_logit(v, x[kept])[:, None], y[kept])
        calibrated.append(v._replace(slope=float(max(slope, 0)), offset=float(offset)))
    both = np.column_stack([_logit(v, x[kept]) for v, x in zip(calibrated, (text, meta), strict=True)])
    return Model(*calibrated, _newton(both, y[kept]))


def features(docs: DataFrame, chosen: tuple[pa.Array, np.ndarray]) -> DataFrame:
    """(doc_id, label, key, x) of each doc_id, written once: its label in ``chosen`` or -1, a hash of it, and the bytes of its text features and metadata codes.

    Of several rows with one doc_id the one with the least bytes counts.
    """
    shared = docs.sparkSession.sparkContext.broadcast(chosen)

    def make(batches):
        ids, label = shared.value
        for b in batches:
            for lo in range(0, b.num_rows, BLOCK):
                p = b.slice(lo, BLOCK)
                x = np.column_stack([text_view(p.column("text")), meta_codes(*(p.column(c).to_pylist() for c in ("source", "lang", "n_chars")))])
                yield pa.RecordBatch.from_arrays([p.column("doc_id"), pa.array(labels_of(p.column("doc_id"), ids, label)), p.column("key"), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "label", "key", "x"])

    some = docs.where("doc_id is not null").select("doc_id", F.xxhash64("doc_id").alias("key"), "text", "source", "lang", "n_chars")
    every = map_arrow(some, make, f"doc_id {kind_of(docs, 'doc_id')}, label long, key long, x binary")
    return written(every.groupBy("doc_id", "label", "key").agg(F.min("x").alias("x")), "features")


def _opened(x: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Text and metadata features of the bytes of ``features``."""
    rows = np.frombuffer(b"".join(x.to_pylist())).reshape(len(x), len(TEXT_FEATURES) + 4)
    return rows[:, : len(TEXT_FEATURES)], expanded(rows[:, len(TEXT_FEATURES) :])


def over(pool: DataFrame) -> Fold:
    """Sums over the rows of ``features``: each task sends one array."""

    def fold(make):
        def each(batches):
            total = None
            for b in batches:
                for lo in range(0, b.num_rows, BLOCK):
                    p = b.slice(lo, BLOCK)
                    part = make(*_opened(p.column("x")), _hash_bins(p.column("key").to_numpy()))
                    total = part if total is None else total + part
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([repr(total.shape)]), pa.array([np.ascontiguousarray(total).tobytes()], pa.binary())], ["shape", "sums"])

        got = [np.frombuffer(r["sums"]).reshape(ast.literal_eval(r["shape"])) for r in map_arrow(pool.select("key", "x"), each, "shape string, sums binary").collect()]
        return sum(got) if got else np.zeros(1)

    return fold


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """Learns from labels (doc_id, quality) of rows that are not held out; None if they have fewer than two classes."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    kind = docs.schema["doc_id"].dataType
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows).select(F.col("doc_id").cast(kind).alias("doc_id"), F.col("quality").cast("int").alias("quality")).collect()
    if len({r["quality"] for r in picked}) < 2:
        return None
    chosen = pa.array([r["doc_id"] for r in picked], to_arrow_type(kind)), np.array([r["quality"] for r in picked], np.int64)
    every = features(docs, chosen)
    got = every.where("label >= 0").toPandas().sort_values("doc_id")
    y = got["label"].to_numpy()
    if len(set(y)) < 2:
        return None
    text, meta = _opened(pa.array(got["x"], pa.binary()))
    apart = np.array([zlib.crc32(str(i).encode()) % 4 == 1 for i in got["doc_id"]])
    if not 1 < (~apart).sum() or len(set(y[~apart])) < 2:
        apart = np.zeros(len(y), bool)
    return co_train_over(text, meta, y.astype(float), over(every.where("label < 0")), apart)


def scored(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, text_score, metadata_score, score of each row; all 0.5 without a model.  Other columns than doc_id, text, source, lang and n_chars are not read.

    Nulls and empty texts have features of their own; doc_id is no feature.  Texts of any length are read as a whole; repeated rows have equal scores.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make(batches):
        m = shared.value
        for b in batches:
            for lo in range(0, max(1, b.num_rows), 2048):
                p = b.slice(lo, 2048)
                z = [np.zeros(p.num_rows)] * 3
                if m is not None and p.num_rows:
                    z = [_logit(m.text, text_view(p.column("text"))), _logit(m.meta, meta_view(*(p.column(c).to_pylist() for c in ("source", "lang", "n_chars"))))]
                    z.append(np.column_stack(z) @ m.mixture[:-1] + m.mixture[-1])
                yield pa.RecordBatch.from_arrays([p.column("doc_id"), *(pa.array(1 / (1 + np.exp(-np.clip(s, -40, 40)))) for s in z)], ["doc_id", "text_score", "metadata_score", "score"])

    fields = [docs.schema["doc_id"], *(T.StructField(c, T.DoubleType()) for c in ("text_score", "metadata_score", "score"))]
    return map_arrow(docs.select("doc_id", "text", "source", "lang", "n_chars"), make, T.StructType(fields))


def op8_quality_cotraining(spark, sf_dir: str) -> DataFrame:
    """Scores of all ``documents`` by each view and by both: 1 is good quality, predicted from 0.5 on; see ``fit`` and ``scored``."""
    docs = table(spark, sf_dir, "documents")
    out = scored(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text_score", "metadata_score", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
