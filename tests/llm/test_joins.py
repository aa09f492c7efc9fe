"""Joins and dedups of documents against brute force."""

import hashlib
import itertools
import random
import re

import pytest

from tabforge.llm import common, decontaminate, jaccard, substring
from tabforge.llm.common import components, without
from tabforge.llm.text import LOWER, UPPER, WORD

from .conftest import DOCS, sentence

LOW = str.maketrans(UPPER, LOWER)


def words(t):
    return re.findall(WORD, (t or "").translate(LOW))


def shingle_set(t, n=5):
    w = words(t)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute_join(rows):
    """{doc_id: (copy_id, class_id, n_links)}"""
    own = {i: t for i, t, *_ in rows if shingle_set(t)}
    sets, up = {i: shingle_set(t) for i, t in own.items()}, {i: i for i in own}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    links = {i: set() for i in own}
    for a, b in itertools.combinations(sorted(own), 2):
        k = len(sets[a] & sets[b])
        if own[a] == own[b] or 5 * k >= 4 * (len(sets[a]) + len(sets[b]) - k):
            x, y = sorted((root(a), root(b)))
            up[y] = x
            if own[a] != own[b]:
                links[a].add(own[b])
                links[b].add(own[a])
    copies = {t: min(i for i in own if own[i] == t) for t in own.values()}
    return {i: (copies[own[i]], root(i), len(links[i])) if i in own else (i, i, 0) for i, *_ in rows}


def class_rows(df):
    return df.select("doc_id", "copy_id", "class_id", "n_links").collect()


@pytest.mark.parametrize("block", (512, 4))
def test_jaccard_join(spark, docs, corpus, monkeypatch, block):
    draw = random.Random(3)
    base = sentence(draw, 120).split()
    more = []
    for k in range(60):  # one large group of near copies
        own = list(base)
        for _ in range(draw.randint(0, 5)):
            own[draw.randrange(len(own))] = sentence(draw, 1)
        more.append((1000 + k, " ".join(own), "en", "s", 1))
    monkeypatch.setattr(jaccard, "BLOCK_DOCS", block)
    rows = corpus + more
    got = class_rows(jaccard.jaccard_join(spark.createDataFrame(rows, DOCS).repartition(4)))
    assert {r.doc_id: (r.copy_id, r.class_id, r.n_links) for r in got} == brute_join(rows)
    assert len(got) == len(rows)


def test_jaccard_join_odd_rows(spark, docs, corpus, empty, clashing):
    join = lambda df: sorted(map(tuple, class_rows(jaccard.jaccard_join(df))), key=str)
    assert join(empty) == [] and join(clashing) == join(docs)
    twice = spark.createDataFrame([(None, "a b c d e f", "en", "s", 1), (None, None, None, None, None), (5, corpus[0][1], "en", "s", 1), (5, corpus[0][1], "en", "s", 1), (9, corpus[0][1] + "!", "en", "s", 1)], DOCS)
    assert join(twice) == sorted([(None, None, None, 0), (None, None, None, 0), (5, 5, 5, 1), (5, 5, 5, 1), (9, 9, 5, 1)], key=str)
    with pytest.raises(ValueError):
        jaccard.jaccard_join(docs, threshold=0.5)


def test_jaccard_join_repeated_ids(spark):
    """Rows that share a doc_id are judged each by its own text; none is lost, none multiplied."""
    draw = random.Random(23)
    a, b = sentence(draw, 80), sentence(draw, 80)
    got = jaccard.jaccard_join(spark.createDataFrame([(1, a, "", "", 1), (5, a, "", "", 1), (5, b, "", "", 1)], DOCS)).collect()
    assert sorted((r.doc_id, r.copy_id, r.class_id, r.n_links, r.kept) for r in got) == [(1, 1, 1, 0, True), (5, 1, 1, 0, False), (5, 5, 5, 0, True)]
    near = a.split()
    near[40] = "changed"
    got = jaccard.jaccard_join(spark.createDataFrame([(5, a, "", "", 1), (5, " ".join(near), "", "", 1), (7, a.upper(), "", "", 1)], DOCS)).collect()
    assert sorted((r.doc_id, r.copy_id, r.class_id, r.n_links) for r in got) == [(5, 5, 5, 2), (5, 5, 5, 2), (7, 7, 5, 2)] and sum(r.kept for r in got) == 1


def test_jaccard_join_long_text_and_text_ids(spark):
    draw = random.Random(29)
    long = sentence(draw, 60_000).split()
    other = list(long)
    for _ in range(500):
        other[draw.randrange(len(other))] = "x"
    got = jaccard.jaccard_join(spark.createDataFrame([("a", " ".join(long)), ("b", " ".join(other)), ("c", sentence(draw, 60))], "doc_id string, text string"))
    assert sorted(map(tuple, class_rows(got))) == [("a", "a", "a", 1), ("b", "b", "a", 1), ("c", "c", "c", 0)]


def test_jaccard_join_chain_compares_few_pairs(spark, monkeypatch):
    """A component far beyond a block whose neighbours alone are alike: compared bucket by bucket, not all pairs."""
    from pyspark.sql import functions as F

    draw = random.Random(31)
    pool = sentence(draw, 15_100).split()
    rows = [(k, " ".join(pool[3 * k : 3 * k + 67]), "", "", 1) for k in range(5000)]  # neighbours share 60 of 66 shingles
    monkeypatch.setattr(jaccard, "BLOCK_DOCS", 16)
    first = jaccard._first_pass(spark.createDataFrame(rows, DOCS), 5).withColumnRenamed("row", "node")
    groups = jaccard._groups(first, first.select("node", F.lit(0).cast("long").alias("comp"))).groupBy("comp", "bucket").count().collect()
    assert all(r.bucket is not None for r in groups) and 0 < sum(r["count"] ** 2 for r in groups) < 0.05 * len(rows) ** 2
    got = class_rows(jaccard.jaccard_join(spark.createDataFrame(rows[:300], DOCS)))
    assert {r.doc_id: (r.copy_id, r.class_id, r.n_links) for r in got} == brute_join(rows[:300])


def test_pruning_keeps_what_can_reach_the_threshold():
    fewest = jaccard.least_matches(0.8, 1e-9)
    assert all(0 < m < 0.8 * n for n, m in fewest.items() if n > 16)
    assert all(m <= n for n, m in fewest.items())


@pytest.mark.parametrize("task_edges", (10**6, 0))
def test_components(spark, monkeypatch, task_edges):
    monkeypatch.setattr(common, "TASK_EDGES", task_edges)
    draw = random.Random(1)
    edges = [(draw.randrange(200), draw.randrange(200)) for _ in range(150)] + [(i, 500) for i in range(300, 340)] + [(i, i + 1) for i in range(600, 640)]
    up = {}

    def root(i):
        up.setdefault(i, i)
        while up[i] != i:
            i = up[i]
        return i

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: root(i) for e in edges if e[0] != e[1] for i in e}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_without(spark, docs, corpus):
    ids = spark.createDataFrame([(1,), (4,), (4,)], "doc_id long")
    extra = docs.union(spark.createDataFrame([(None, "x", None, None, 1)], DOCS))
    left = without(extra, ids).collect()
    assert sorted(str(r.doc_id) for r in left) == sorted([str(r[0]) for r in corpus if r[0] not in (1, 4)] + ["None"])
    assert without(docs, ids.limit(0)).count() == len(corpus)


def brute_hits(docs, items, window=13):
    out = {}
    for i, t, *_ in docs:
        w, hit, found = words(t), set(), set()
        for item, text in items:
            v = words(text)
            k = min(window, len(v))
            grams = {tuple(v[j : j + k]) for j in range(len(v) - k + 1)} if v else set()
            for j in range(len(w) - k + 1) if k else ():
                if tuple(w[j : j + k]) in grams:
                    hit.update(range(j, j + k))
                    found.add(str(item))
        out[i] = (len(w), len(hit), sorted(found), len(hit) > 0 and 20 * len(hit) >= len(w))
    return out


def test_decontaminate(spark, docs, corpus, empty, clashing):
    draw = random.Random(5)
    base = {i: t for i, t, *_ in corpus}
    items = [(k, " ".join(base[k].split()[5 : 5 + n])) for k, n in ((2, 13), (3, 14), (4, 40), (5, 12), (6, 9), (7, 30))]
    items += [(20, "one"), (21, "two words"), (22, None), (23, ""), (24, sentence(draw, 30)), (25, "É ü"), (2, " ".join(base[9].split()[:20])), (26, "x " * 40)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute_hits(corpus, items)
    for df in (docs, clashing):
        got = {r.doc_id: (r.n_words, r.n_hit, list(r.item_ids), r.contaminated) for r in decontaminate.decontaminate(df, bench).collect()}
        assert got == want
    assert sum(v[3] for v in want.values()) > 5
    assert decontaminate.decontaminate(empty, bench).count() == 0
    assert decontaminate.decontaminate(docs, bench.limit(0)).where("n_hit > 0 or contaminated").count() == 0
    odd = spark.createDataFrame([(None, "one", "", "", 1), (1, "one", "", "", 1), (1, "one", "", "", 1)], DOCS)
    assert decontaminate.decontaminate(odd, bench).where("contaminated and n_items = 1").count() == 3
    no_id = spark.createDataFrame([(None, "one")], "item_id long, text string")
    assert [tuple(r) for r in decontaminate.decontaminate(odd, no_id).select("n_hit", "n_items").distinct().collect()] == [(1, 0)]
    assert decontaminate.NONE == hashlib.sha256(b"").hexdigest()


def test_decontaminate_long_document_of_many_items(spark):
    draw = random.Random(41)
    items = [(k, sentence(draw, 15)) for k in range(300)]
    text = " ".join(f"{t} {sentence(draw, 5)}" for _, t in items) + " " + sentence(draw, 60_000)
    docs = spark.createDataFrame([("long", text, 7), ("none", sentence(draw, 50), 8)], "doc_id string, text string, mine long")
    got = {r.doc_id: r for r in decontaminate.decontaminate(docs, spark.createDataFrame(items, "item_id long, text string"), also=["mine"]).collect()}
    assert (got["long"].n_hit, got["long"].n_items, got["long"].n_words, got["long"].mine) == (4500, 300, 66_000, 7) and got["long"].contaminated
    assert list(got["long"].item_ids) == sorted(str(k) for k in range(300)) and not got["none"].contaminated


def covered(rows, found):
    """Words that lie in 50 words which a smaller doc_id has too, and words of the found passages, by document."""
    seen, want = {}, {}
    for i, t, *_ in sorted(rows, key=lambda r: r[0]):
        w = words(t)
        keys = [tuple(w[j : j + 50]) for j in range(len(w) - 49)]
        want[i] = {p for j, k in enumerate(keys) if k in seen for p in range(j, j + 50)}
        for k in keys:
            seen.setdefault(k, i)
    got = {i: set() for i in want}
    for r in found:
        got[r.doc_id].update(range(r.start, r.end))
    return want, got


def test_passages(spark, docs, corpus, empty, clashing):
    found = substring.passages(docs).collect()
    want, got = covered(corpus, found)
    for i in want:
        assert want[i] <= got[i], i
    assert all(r.end - r.start >= 50 and r.ref_doc_id < r.doc_id for r in found)
    clean = [i for i in range(30)]
    assert not any(got[i] for i in clean)
    assert {tuple(r) for r in substring.passages(clashing).collect()} == {tuple(r) for r in found}
    assert substring.passages(empty).count() == 0


def test_fuzzy_passage(spark):
    draw = random.Random(11)
    passage = sentence(draw, 80).split()
    changed = list(passage)
    changed[20], changed[41] = "changed", "again"
    del changed[60]
    a, b = f"{sentence(draw, 60)} {' '.join(passage)} {sentence(draw, 60)}", f"{sentence(draw, 30)} {' '.join(changed)} {sentence(draw, 30)}"
    (r,) = substring.passages(spark.createDataFrame([(1, a, "", "", 1), (2, b, "", "", 1)], DOCS)).collect()
    assert (r.doc_id, r.ref_doc_id, r.start, r.end, r.ref_start, r.ref_end) == (2, 1, 30, 109, 60, 140)


def test_passage_recall_by_change_rate(spark):
    """Passages of 100 words with so many words replaced at random, or evenly; the larger doc_id's copy is found at least so often."""
    draw = random.Random(5)
    rows, kinds = [], {}
    for even, rate, least in ((False, 0.0, 1.0), (False, 0.1, 1.0), (False, 0.15, 0.95), (False, 0.2, 0.9), (True, 0.1, 1.0), (True, 0.15, 0.95)):
        for _ in range(30):
            passage = sentence(draw, 100).split()
            changed, n = list(passage), round(100 * rate)
            for at in [int((k + 0.5) * 100 / n) for k in range(n)] if even else draw.sample(range(100), n):
                changed[at] = sentence(draw, 1) + "zz"
            kinds[len(rows) + 1] = (even, rate, least)
            rows.append((len(rows), f"{sentence(draw, 60)} {' '.join(passage)} {sentence(draw, 60)}", "", "", 1))
            rows.append((len(rows), f"{sentence(draw, 40)} {' '.join(changed)} {sentence(draw, 70)}", "", "", 1))
    found = substring.passages(spark.createDataFrame(rows, DOCS)).collect()
    assert {r.doc_id for r in found} <= set(kinds) and all(r.ref_doc_id == r.doc_id - 1 for r in found)
    good = {r.doc_id for r in found if min(r.end, 140) - max(r.start, 40) >= 80 and r.end - r.start <= 115}
    for kind in set(kinds.values()):
        of = [i for i, k in kinds.items() if k == kind]
        assert sum(i in good for i in of) >= kind[2] * len(of), kind


def test_passages_of_repeated_ids(spark):
    draw = random.Random(13)
    a, b, c = (sentence(draw, 60) for _ in range(3))
    rows = [(1, f"{a} {sentence(draw, 30)}"), (5, b), (5, f"{sentence(draw, 20)} {a} {sentence(draw, 20)}"), (5, b), (7, f"{c} {b}"), (None, a), (None, a)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = substring.passages(docs)
    assert sorted((r.doc_id, r.start, r.end, r.ref_doc_id) for r in found.collect()) == [(5, 20, 80, 1), (7, 60, 120, 5)]
    left = sorted((str(r.doc_id), words(r.text)) for r in substring.cut(docs, found).collect())
    want = [(i, words(t)) for i, t in rows[:2] + rows[3:4] + rows[5:]] + [(5, words(rows[2][1])[:20] + words(rows[2][1])[80:]), (7, words(c))]
    assert left == sorted((str(i), w) for i, w in want)


def test_passages_of_long_texts_and_text_ids(spark):
    draw = random.Random(17)
    long, shared = sentence(draw, 70_000).split(), sentence(draw, 80)
    long[50_000:50_000] = shared.split()
    docs = spark.createDataFrame([("a", f"{sentence(draw, 30)} {shared}"), ("b", " ".join(long)), ("c", None), ("d", "")], "doc_id string, text string")
    found = substring.passages(docs)
    assert [(r.doc_id, r.start, r.end, r.ref_doc_id, r.ref_start) for r in found.collect()] == [("b", 50_000, 50_080, "a", 30)]
    assert {r.doc_id: len(words(r.text)) for r in substring.cut(docs, found).collect()}["b"] == 70_000


def test_chain_and_align():
    import numpy as np

    x, y = np.array([0, 4, 8, 30, 34, 500, 504]), np.array([100, 104, 108, 131, 135, 20, 24])
    assert [c.tolist() for c in substring.chains(x, y)] == [[0, 1, 2, 3, 4], [5, 6]]
    assert substring.chains(x[:1], y[:1]) == []
    t = substring.PrefixMax(5)
    t.put(2, (3.0, 0))
    t.put(4, (1.0, 1))
    assert t.before(2)[1] == -1 and t.before(3) == (3.0, 0) and t.before(5) == (3.0, 0)


def test_cut(spark, docs, corpus):
    found = substring.passages(docs)
    left = {r.doc_id: r for r in substring.cut(docs, found).collect()}
    spans = {}
    for r in found.collect():
        spans.setdefault(r.doc_id, []).append((r.start, r.end))
    for i, t, lang, source, n in corpus:
        own = words(t)
        keep = [w for j, w in enumerate(own) if not any(s <= j < e for s, e in spans.get(i, ()))]
        if i in spans and not keep:
            assert i not in left
            continue
        r = left[i]
        assert words(r.text) == keep and (r.lang, r.source) == (lang, source)
        assert (r.text, r.n_chars) == ((t, n) if i not in spans else (r.text, len(r.text)))
    assert set(left) <= {c[0] for c in corpus}
    assert substring.cut(docs, found.limit(0)).count() == len(corpus)


def test_hot_passage_gives_linear_matches(spark):
    draw = random.Random(2)
    shared = sentence(draw, 60)
    rows = [(i, f"{sentence(draw, 20)} {shared} {sentence(draw, 20)}", "", "", 1) for i in range(80)]
    found = substring.passages(spark.createDataFrame(rows, DOCS)).collect()
    assert {r.doc_id for r in found} == set(range(1, 80)) and {r.ref_doc_id for r in found} == {0}
