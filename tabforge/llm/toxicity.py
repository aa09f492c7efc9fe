"""Toxicity by weak supervision.

Lexicon voters (mined from labelled training rows, and one fixed word list) and pattern voters fire on whole texts.  A generative
label model estimates, from the vote patterns of all documents, how often each voter fires in both classes and how it depends on another: within a
class, votes form a tree, each conditional on its parent's.  Known labels only clamp the model's estimation.  A linear classifier over the
lexicon's entries and the votes is trained on the posterior labels that the votes of each document alone give it, of all documents, and scores every
document.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tabforge.llm.common import few, map_arrow, table, written
from tabforge.llm.text import Words, buffers, words

#: At most so many labelled rows are looked at, those with the least hashes of doc_id: the lexicon is mined from them, and they clamp the label model.
SAMPLE_ROWS = 20_000
#: The classifier's passes over all documents, after as many as it takes over so many of their feature sets.
PASSES, WARM_ROWS = 10, 20_000
#: Entries must be in so many toxic training documents, and surprise enough that by chance about so many would.
LEAST_TOXIC, BY_CHANCE = 3, 30
PREFIXES = (4, 5, 6)
THRESHOLD = 0.3
#: Common insults, as whole words.
INSULTS = (
    "idiot idiots moron morons stupid loser losers scum trash pathetic worthless disgusting clown imbecile dumb jerk bastard fool "
    "dummkopf trottel arschloch abschaum versager blöd connard imbécile abruti ordure minable idiota estúpido imbécil basura escoria inútil"
).split()
#: Entries vote by kind (whole word, prefix) and by the share of toxic documents among those that hold them: from 0.9, from 0.7, ..., below 0.3.
SHARES = (0.9, 0.7, 0.5, 0.3)
TIERS, FAMILIES = len(SHARES) + 1, 1 + len(PREFIXES)
#: Numbers of different entries that have a voter of their own.
SEVERAL = (2, 3, 5)
VOTERS = ("insults", *(f"{kind} tier {t}" for kind in ("word", "prefix") for t in range(TIERS)), *(f"{n} entries" for n in SEVERAL), "shouting", "exclamations")


class Model(NamedTuple):
    entries: np.ndarray
    """Sorted hashes of the lexicon's entries."""
    voter: np.ndarray
    weights: np.ndarray
    """Of the entries, of the voters, and the bias."""
    rates: np.ndarray
    """Label model: each voter's rate of firing on clean and on toxic documents."""
    correlations: np.ndarray


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def _hash_words(entries: list[str]) -> np.ndarray:
    return np.concatenate([w.hashes for w in words(pa.array(entries))])


def _features(w: Words) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places of words, hashes) for whole words and each prefix length."""
    return [(np.arange(len(w.hashes)), w.hashes), *(w.prefixes(n) for n in PREFIXES)]


def _patterns(column: pa.Array, piece: int = 1 << 24) -> tuple[np.ndarray, np.ndarray]:
    """Which texts are mostly capitals, and which hold a run of three exclamation marks; both of the whole text, looked at in pieces."""
    data, at = buffers(column)
    shout, bang = np.zeros(len(column), bool), np.zeros(len(column), bool)
    for i in range(len(column)):
        upper = lower = 0
        for lo in range(int(at[i]), int(at[i + 1]), piece):
            hi = min(int(at[i + 1]), lo + piece)
            d = data[lo:hi]
            upper, lower = upper + np.count_nonzero((d >= 65) & (d <= 90)), lower + np.count_nonzero((d >= 97) & (d <= 122))
            bang[i] |= b"!!!" in data[lo : min(int(at[i + 1]), hi + 2)].tobytes()
        shout[i] = upper > max(20, lower)
    return shout, bang


class _Finder:
    """Finds lexicon entries in texts."""

    def __init__(self, entries: np.ndarray, voter: np.ndarray):
        self.entries, self.voter = entries, voter
        self.low = np.zeros(1 << 20, bool)
        self.low[entries & np.uint64((1 << 20) - 1)] = True

    def found(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(document, entry) pairs, distinct; the votes of each document as bits; hits of each document, repeats included."""
        pairs, hits = [], np.zeros(len(column), np.int64)
        for w in words(column, whole=False):
            for places, hashes in _features(w):
                may = np.flatnonzero(self.low[hashes & np.uint64((1 << 20) - 1)])
                at = np.minimum(np.searchsorted(self.entries, hashes[may]), len(self.entries) - 1)
                is_in = self.entries[at] == hashes[may]
                doc = w.first + np.searchsorted(w.at, places[may[is_in]], "right") - 1
                np.add.at(hits, doc, 1)
                pairs.append(doc * (1 << 20) + at[is_in])
        both = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
        doc, entry = both >> 20, both & ((1 << 20) - 1)
        bits = np.zeros(len(column), np.int64)
        np.bitwise_or.at(bits, doc, np.int64(1) << self.voter[entry])
        shout, bang = _patterns(column)
        n = np.bincount(doc, minlength=len(column))
        fires = [*(n >= k for k in SEVERAL), shout, bang]
        for k, f in enumerate(fires):
            bits |= f.astype(np.int64) << (len(VOTERS) - len(fires) + k)
        return doc, entry, bits, hits


def _sample(labels: DataFrame, kind: T.DataType, rows: int) -> tuple[pa.Array, np.ndarray]:
    """doc_id, as the documents' type, and label of the bounded sample of training rows.  Of several labels of a doc_id the greatest counts."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    got = chosen.select(F.col("doc_id").cast(kind).alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).collect()
    return pa.array([r["doc_id"] for r in got], to_arrow_type(kind)), np.array([int(r["toxic"]) for r in got], np.int64)


def labels_of(column: pa.Array, ids: pa.Array, toxic: np.ndarray) -> np.ndarray:
    """1, 0, or -1 for documents that are not in the sample."""
    if not len(ids):
        return np.full(len(column), -1)
    at = pc.fill_null(pc.index_in(column.cast(ids.type), value_set=ids, skip_nulls=True), -1).to_numpy(zero_copy_only=False)
    return np.where(at >= 0, toxic[np.maximum(at, 0)], -1)


def _mined(docs: DataFrame, ids: pa.Array, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lexicon: entries (sorted) and the voter of each, by how much more often they are in toxic training documents.

    All significant entries are kept; they are words of at most SAMPLE_ROWS documents.
    """
    shared = docs.sparkSession.sparkContext.broadcast((ids, toxic))

    def make(batches):
        ids, toxic = shared.value
        for b in batches:
            label = labels_of(b.column("doc_id"), ids, toxic)
            chosen = np.flatnonzero(label >= 0)
            text, label = b.column("text").take(pa.array(chosen)), label[chosen]
            seen: list[list[np.ndarray]] = [[] for _ in range(FAMILIES)]
            for w in words(text, whole=False):
                for family, (places, hashes) in enumerate(_features(w)):
                    doc = w.first + np.searchsorted(w.at, places, "right") - 1
                    seen[family].append(np.rec.fromarrays([doc, hashes], names="doc,hash"))
            for family, parts in enumerate(seen):
                if parts:
                    both = np.concatenate(parts)
                    order = np.lexsort((both["hash"], both["doc"]))
                    doc, h = both["doc"][order], both["hash"][order]
                    new = np.ones(len(h), bool)
                    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
                    h, inverse = np.unique(h[new], return_inverse=True)
                    hot = np.bincount(inverse, weights=label[doc[new]], minlength=len(h))
                    cold = np.bincount(inverse, weights=1 - label[doc[new]], minlength=len(h))
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.full(len(h), family, np.int32)), pa.array(hot.astype(np.int64)), pa.array(cold.astype(np.int64))], ["entry", "family", "hot", "cold"])

    counts = map_arrow(docs.select("doc_id", "text"), make, "entry long, family int, hot long, cold long").groupBy("entry", "family").agg(F.sum("hot").alias("hot"), F.sum("cold").alias("cold"))
    counts = written(few(counts.where(F.col("hot") + F.col("cold") >= LEAST_TOXIC), len(ids)), "counts")
    least = math.sqrt(2 * math.log(max(2.0, counts.count() / BY_CHANCE)))  # of the root of the likelihood-ratio statistic
    n1 = max(1, int(toxic.sum()))
    base = n1 / max(2, len(toxic))
    n = F.col("hot") + F.col("cold")
    part = lambda k, rate: F.when(k > 0, k * F.log(k / (n * rate))).otherwise(0.0)
    root = F.sqrt(2 * F.greatest(F.lit(0.0), part(F.col("hot"), base) + part(F.col("cold"), 1 - base)))
    good = counts.where((F.col("hot") >= LEAST_TOXIC) & (F.col("hot") > n * base)).withColumn("root", root).where(F.col("root") >= least)
    top = good.orderBy(F.desc("root"), "entry").collect()
    if len(top) >= 1 << 20:
        raise ValueError("too many lexicon entries; take a smaller sample of labelled rows")
    fixed = _hash_words(INSULTS)
    voter = {int(h): 0 for h in fixed}
    for r in top:
        h = r["entry"] & ((1 << 64) - 1)
        share = (r["hot"] + base) / (r["hot"] + r["cold"] + 1)
        voter.setdefault(h, 1 + min(r["family"], 1) * TIERS + sum(share < t for t in SHARES))
    entries = np.array(sorted(voter), np.uint64)
    return entries, np.array([voter[int(h)] for h in entries], np.int64)


def _tree(votes: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Each voter's parent, -1 for none: the spanning tree of greatest mutual information within the classes, without insignificant edges."""
    n = votes.shape[1]
    gain = np.zeros((n, n))
    for w in by:
        total = w.sum() + 1e-9
        p = w @ votes / total
        both = (votes * w[:, None]).T @ votes / total
        for a, b in ((0, 0), (0, 1), (1, 0), (1, 1)):
            pa_, pb = p if a else 1 - p, p if b else 1 - p
            joint = {(1, 1): both, (1, 0): p[:, None] - both, (0, 1): p[None, :] - both, (0, 0): 1 - p[:, None] - p[None, :] + both}[a, b]
            outer = np.outer(pa_, pb)
            gain += 2 * total * np.where((joint > 1e-12) & (outer > 1e-12), joint * np.log(np.maximum(joint, 1e-12) / np.maximum(outer, 1e-12)), 0)
    np.fill_diagonal(gain, -1)
    parent, best, link, inside = np.full(n, -1), np.full(n, -1.0), np.full(n, -1), np.zeros(n, bool)
    for _ in range(n):
        at = int(np.argmax(np.where(inside, -2, best)))
        inside[at] = True
        parent[at] = link[at] if best[at] > 20 else -1  # twice the log likelihood that the edge adds
        closer = ~inside & (gain[at] > best)
        best[closer], link[closer] = gain[at][closer], at
    return parent


def label_model(bits: np.ndarray, label: np.ndarray, count: np.ndarray, voters: int, rounds: int = 60) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """EM over vote patterns (label -1: unknown).  Returns P(toxic) of each pattern by its votes, rates by class and voter, and correlations.

    Rates start from the known labels.  Within a class the votes' probability is a product over a tree of voters, each given its parent's vote;
    the tree and its conditional rates, like the rates, are estimated again as posteriors change.  So voters that repeat each other
    do not count twice.  Correlations within the classes, weighted by the posterior, are returned as a summary.
    """
    if not len(bits):
        return np.zeros(0), np.full((2, voters), 0.5), np.zeros((voters, voters))
    votes = (bits[:, None] >> np.arange(voters) & 1).astype(float)
    known = label >= 0
    post = np.where(known, label, 0.0)
    if known.any():
        seed = known & (count > 0)
    else:  # no labels: documents on which the first voter fires are the first guess
        post, seed = ((bits & 1) > 0) * 0.9, np.ones(len(bits), bool)
    # however many unlabelled documents there are, in all they count for no more than the labelled ones
    trust = min(1.0, count[known].sum() / max(1, count[~known].sum())) if known.any() else 1.0
    parent = np.full(voters, -1)
    weight = count * seed
    prior = rates = free = None
    for step in range(rounds):
        by = np.stack([weight * (1 - post), weight * post])
        prior = (by.sum(1) + 1) / (by.sum() + 2)
        rates = np.clip((by @ votes + 0.5 * votes.mean(0) + 0.05) / (by.sum(1)[:, None] + 1.1), 1e-5, 1 - 1e-5)
        if step % 10 == 1:
            parent = _tree(votes, by)
        above = np.where(parent >= 0, votes[:, parent], 0.0)  # the parent's vote
        likely = np.zeros((2, len(bits)))
        for c in (0, 1):
            fires, silent = by[c] @ above, by[c].sum() - by[c] @ above
            after, alone = by[c] @ (votes * above), by[c] @ (votes * (1 - above))
            given_1, given_0 = ((k + 2 * rates[c]) / (m + 2) for k, m in ((after, fires), (alone, silent)))
            p = np.clip(np.where(parent >= 0, above * given_1 + (1 - above) * given_0, rates[c]), 1e-5, 1 - 1e-5)
            likely[c] = (votes * np.log(p) + (1 - votes) * np.log(1 - p)).sum(1)
        free = 1 / (1 + np.exp(-np.clip(likely[1] - likely[0] + math.log(prior[1] / prior[0]), -40, 40)))
        post = np.where(known, label, free)
        weight = count * np.where(known, 1.0, trust)
    correlation = np.zeros((voters, voters))
    for c in (0, 1):
        w = np.stack([weight * (1 - post), weight * post])[c]
        d = (votes - rates[c]) * np.sqrt(w)[:, None]
        cov = d.T @ d
        scale = np.sqrt(np.maximum(np.diag(cov), 1e-9))
        correlation += prior[c] * cov / np.outer(scale, scale) * np.outer(np.diag(cov) > 1e-6, np.diag(cov) > 1e-6)
    np.fill_diagonal(correlation, 0)
    return free, rates, correlation


#: Loss and gradient, summed over feature sets, of weights.
Objective = Callable[[np.ndarray], tuple[float, np.ndarray]]


def minimised(f: Objective, w: np.ndarray, passes: int, memory: int = 10) -> np.ndarray:
    """L-BFGS with backtracking; stops at a small gradient or after so many evaluations of f."""
    (loss, g), used, past = f(w), 1, []
    while used < passes and np.abs(g).max() > 1e-5:
        d, alphas = -g, []
        for s, y in reversed(past):
            alphas.append((s @ d) / (s @ y))
            d = d - alphas[-1] * y
        if past:
            d = d * (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1])
        else:
            d = d / max(1.0, np.abs(g).sum())
        for (s, y), a in zip(past, reversed(alphas), strict=True):
            d = d + s * (a - (y @ d) / (s @ y))
        step = 1.0
        while used < passes:
            new, used = w + step * d, used + 1
            new_loss, new_g = f(new)
            if new_loss <= loss + 1e-4 * step * (g @ d):
                break
            step /= 2
        else:
            return w
        if (new - w) @ (new_g - g) > 1e-12:
            past = [*past[1 - memory :], (new - w, new_g - g)]
        w, loss, g = new, new_loss, new_g
    return w


def _loss(entries: pa.Array, bits: np.ndarray, n: np.ndarray, target: np.ndarray, w: np.ndarray, n_entries: int) -> np.ndarray:
    """Gradient of the logistic loss of feature sets (entries as bytes, votes) that n documents have, followed by the loss."""
    offsets = np.frombuffer(entries.buffers()[1], np.int32)[entries.offset : entries.offset + len(entries) + 1]
    flat = np.frombuffer(entries.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view("<i4") if offsets[-1] > offsets[0] else np.zeros(0, np.int32)
    at = np.repeat(np.arange(len(bits)), np.diff(offsets) // 4)
    votes = (bits[:, None] >> np.arange(len(VOTERS)) & 1).astype(float)
    z = np.clip(w[-1] + np.bincount(at, weights=w[flat], minlength=len(bits)) + votes @ w[n_entries:-1], -30, 30)
    p = 1 / (1 + np.exp(-z))
    error = n * (p - target)
    loss = -(n * (target * np.log(p) + (1 - target) * np.log(1 - p))).sum()
    return np.concatenate([np.bincount(flat, weights=error[at], minlength=n_entries), error @ votes, [error.sum(), loss]])


def _trained(sets: DataFrame, n_docs: int, bits: np.ndarray, free: np.ndarray, n_entries: int, decay: float = 1e-6) -> np.ndarray:
    """Logistic regression on the posteriors (by vote pattern) of all documents, whose feature sets (bits, entries, n) are given.

    The last weight is the bias.  It begins with a bounded number of sets, those with the least hashes, and then passes over all of them;
    each pass sends one sum for each weight to the driver.
    """
    by = np.argsort(bits)
    shared = sets.sparkSession.sparkContext.broadcast((bits[by], np.clip(free[by], 1e-4, 1 - 1e-4)))
    size = n_entries + len(VOTERS) + 1

    def total(batches, w):
        known, post = shared.value
        out = np.zeros(size + 1)
        for b in batches:
            own = b.column("bits").to_numpy()
            out += _loss(b.column("entries"), own, b.column("n").to_numpy().astype(float), post[np.searchsorted(known, own)], w, n_entries)
        return out

    def objective(sums: Callable[[np.ndarray], np.ndarray], n: float) -> Objective:
        def f(w):
            got = sums(w)
            ridge = np.append(decay * w[:-1], 0.0)
            return float(got[-1] / n + 0.5 * ridge @ w), got[:-1] / n + ridge

        return f

    def over_all(w: np.ndarray) -> np.ndarray:
        sent = sets.sparkSession.sparkContext.broadcast(w)

        def each(batches):
            out = total(batches, sent.value)
            at = np.flatnonzero(out)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(out[at])], ["at", "sum"])

        out = np.zeros(size + 1)
        for r in map_arrow(sets.select("bits", "entries", "n"), each, "at long, sum double").groupBy("at").agg(F.sum("sum").alias("sum")).collect():
            out[r["at"]] = r["sum"]
        return out

    warm = sets.orderBy(F.xxhash64("bits", "entries"), "bits", "entries").limit(WARM_ROWS).select("bits", "entries", "n").toArrow().combine_chunks().to_batches()
    start = np.zeros(size)
    start[-1] = -1.0
    start = minimised(objective(lambda w: total(warm, w), max(1.0, sum(pc.sum(b.column("n")).as_py() or 0 for b in warm))), start, 400)
    return minimised(objective(over_all, max(1, n_docs)), start, PASSES)


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Trains on all documents' texts and, for the lexicon and to clamp the label model, on the labels (doc_id, toxic) of at most ``sample_rows`` rows
    that are not held out; nothing else is read.

    Null and empty texts vote on nothing.  Rows without doc_id are unlabelled; rows that repeat a labelled doc_id all have its label.  Without labels of
    both classes there is nothing to learn from, and the fixed list decides.
    """
    ids, toxic = _sample(labels, docs.schema["doc_id"].dataType, sample_rows)
    entries, voter = _mined(docs, ids, toxic)
    shared = docs.sparkSession.sparkContext.broadcast((entries, voter, ids, toxic))

    def make(batches):
        entries, voter, ids, toxic = shared.value
        finder = _Finder(entries, voter)
        for b in batches:
            label = labels_of(b.column("doc_id"), ids, toxic)
            doc, entry, bits, _ = finder.found(b.column("text"))
            at = np.searchsorted(doc, np.arange(b.num_rows + 1))
            flat = entry.astype("<i4")
            sets: dict[tuple, int] = {}
            for i in range(b.num_rows):
                key = (int(bits[i]), int(label[i]), flat[at[i] : at[i + 1]].tobytes())
                sets[key] = sets.get(key, 0) + 1
            keys = list(sets)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array([k[2] for k in keys], pa.binary()), pa.array(list(sets.values()), pa.int64())], ["bits", "label", "entries", "n"])

    every = map_arrow(few(docs.select("doc_id", "text"), docs.count()), make, "bits long, label long, entries binary, n long")
    every = written(every.groupBy("bits", "label", "entries").agg(F.sum("n").alias("n")), "feature-sets")
    got = every.groupBy("bits", "label").agg(F.sum("n").alias("n")).toPandas()  # at most one row for each vote pattern (2 ** 16) and label
    bits, label, count = (got[c].to_numpy(np.int64) for c in ("bits", "label", "n"))
    free, rates, correlations = label_model(bits, label, count, len(VOTERS))
    if len(bits) and 0 < toxic.sum() < len(toxic) and (label >= 0).any():
        patterns, at = np.unique(bits, return_index=True)
        weights = _trained(every, int(count.sum()), patterns, free[at], len(entries))
    else:
        weights = np.concatenate([np.full(len(entries), 2.5), np.zeros(len(VOTERS)), [-2.0]])
    return Model(entries, voter, weights, rates, correlations)


def scored(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """docs and a column of scores from 0 to 1, in place of a column of that name; only the text is looked at, as a whole.

    A null or empty text has no features: its score is the bias's.  Equal texts have equal scores; repeated rows stay as they are.
    """
    docs = docs.drop(name)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text = docs.columns.index("text")

    def make(batches):
        m = shared.value
        finder, size = _Finder(m.entries, m.voter), len(m.entries)
        for b in batches:
            doc, entry, bits, _ = finder.found(b.column(text))
            z = m.weights[-1] + np.bincount(doc, weights=m.weights[entry], minlength=b.num_rows) + (bits[:, None] >> np.arange(len(VOTERS)) & 1) @ m.weights[size:-1]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(1 / (1 + np.exp(-np.clip(z, -40, 40))))], [*b.schema.names, name])

    return map_arrow(docs, make, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    """Scores of all ``documents``: doc_id, held_out, score, predicted (score of at least 0.3); see ``fit`` and ``scored``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return scored(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
