"""Classifiers, rollups, search and licence scan."""

import os
import random
import uuid

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabforge.llm import license, mtree, quality, rollup, toxicity
from tabforge.llm.common import written

from .conftest import DOCS, sentence


@pytest.fixture(scope="module")
def labelled(spark):
    """Documents of which a fifth holds invented insults, and of which a third is junk."""
    draw = random.Random(4)
    rows, labels = [], []
    for i in range(600):
        words = sentence(draw, draw.randint(30, 120)).split()
        bad = i % 5 == 0
        for _ in range(draw.randint(1, 4) if bad else 0):
            words[draw.randrange(len(words))] = draw.choice(("zorkwald", "zorkwaldish", "quuxer", "quuxerly", "blarg"))
        junk = i % 3 == 0
        text = " ".join(f"{w}### 1234" for w in words) if junk else " ".join(words)
        rows.append((i, text, "en", f"s{i % 3}", len(text)))
        if i % 4:
            labels.append((i, int(not junk), int(bad)))
    return written(spark.createDataFrame(rows, DOCS).repartition(3), "labelled"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


ODD = [(1000, None, None, None, None), (1001, "", "en", "s", 0), (None, "fine words", None, "s", 3), (1002, "idiot " * 70_000, "en", "s", 1)]


def test_toxicity_on_held_out_rows(spark, labelled):
    docs, labels = labelled
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r for r in toxicity.scored(docs, model).select("doc_id", "score", toxicity.held_out(F.col("doc_id")).alias("h")).collect()}
    held = [i for i in got if got[i].h]
    assert 100 < len(held) < 200
    right = sum((got[i].score >= toxicity.THRESHOLD) == (i % 5 == 0) for i in held)
    assert right >= 0.97 * len(held)
    assert model.correlations.shape == (len(toxicity.VOTERS),) * 2 and (model.rates[1] >= model.rates[0]).any()


def test_toxicity_odd_rows(spark, labelled):
    docs, labels = labelled
    model = toxicity.fit(docs, labels)
    odd = spark.createDataFrame(ODD, DOCS)
    got = {r.doc_id: r.score for r in toxicity.scored(odd, model).collect()}
    assert got[1000] == got[1001] < toxicity.THRESHOLD and all(0 <= s <= 1 for s in got.values())
    # no labels: the fixed list decides
    bare = toxicity.fit(docs, labels.limit(0))
    got = {r.doc_id: r.score for r in toxicity.scored(odd, bare).collect()}
    assert got[1002] >= toxicity.THRESHOLD > got[1001]
    none = toxicity.fit(docs.limit(0), labels)
    assert toxicity.scored(docs.limit(0), none).count() == 0
    nulls = labels.selectExpr("cast(null as long) as doc_id", "quality", "toxic").union(labels.selectExpr("doc_id", "quality", "cast(null as int)"))
    assert toxicity.fit(docs, nulls).weights[-1] == bare.weights[-1]


def test_toxicity_learns_from_unlabelled_documents(spark, labelled):
    """Posterior labels of unlabelled documents, and not known ones alone, make the label model and train the classifier."""
    docs, labels = labelled
    model = toxicity.fit(docs, labels)
    alone = toxicity.fit(docs.join(labels.select("doc_id"), "doc_id").select(docs.columns), labels)
    assert not np.array_equal(model.weights, alone.weights) or not np.array_equal(model.rates, alone.rates)
    # toxic unlabelled documents in numbers: the label model finds them by their votes, and the classifier's bias follows their share
    more = spark.range(10_000, 12_000).selectExpr("id as doc_id", "'some zorkwald and a blarg with a quuxer' as text", "'en' as lang", "'s' as source", "1L as n_chars")
    many = toxicity.fit(docs.unionByName(more), labels)
    z = lambda m: m.weights[-1]
    assert z(many) > z(alone)
    # labels turned round on held-out rows, which nothing may read, change nothing
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert np.array_equal(toxicity.fit(docs, turned).weights, model.weights)


def test_toxicity_labels_of_large_and_text_ids():
    ids, toxic = pa.array([2**53, 2**53 + 1, 7]), np.array([1, 0, 1])
    assert toxicity.labels_of(pa.array([2**53 + 1, None, 2**53, 8, 7]), ids, toxic).tolist() == [0, -1, 1, -1, 1]
    assert toxicity.labels_of(pa.array(["a", None, "b"]), pa.array(["b"]), np.array([1])).tolist() == [-1, -1, 1]


def test_toxicity_patterns_of_whole_texts():
    texts = ["a" * 63 + "!!!" + "b", "A" * 60 + "b" * 59, "A" * 59 + "b" * 60, "!!", None, "x!!" + "y" * 61 + "!"]
    shout, bang = toxicity._patterns(pa.array(texts), piece=64)
    assert shout.tolist() == [False, True, False, False, False, False] and bang.tolist() == [True, False, False, False, False, False]


def test_toxicity_clashing_columns_and_text_ids(spark, labelled):
    docs, labels = labelled
    model = toxicity.fit(docs.selectExpr("concat('d', doc_id) as doc_id", "text", "'x' as bits", "'y' as label", "'z' as n"), labels.selectExpr("concat('d', doc_id) as doc_id", "toxic"))
    out = toxicity.scored(docs.selectExpr("doc_id", "text", "0.5 as score", "1 as bits").limit(5), model)
    assert out.columns == ["doc_id", "text", "bits", "score"] and out.count() == 5


def test_scores_depend_on_text_only(spark, labelled):
    docs, labels = labelled
    model = toxicity.fit(docs, labels)
    same = spark.createDataFrame([(i, "zorkwald and some words", lang, s, n) for i, lang, s, n in ((1, "en", "a", 1), (2, None, None, None), (None, "de", "b", 5))], DOCS)
    assert len({r.score for r in toxicity.scored(same, model).collect()}) == 1


def test_label_model_finds_voters():
    draw = np.random.default_rng(0)
    y = draw.random(4000) < 0.2
    rates = np.array([[0.02, 0.05, 0.3], [0.8, 0.6, 0.3]])
    votes = draw.random((4000, 3)) < rates[y.astype(int)]
    votes = np.column_stack([votes, votes[:, 0]])  # the last voter repeats the first
    bits, inverse = np.unique(votes @ (1 << np.arange(4)), return_inverse=True)
    count = np.bincount(inverse)
    seen_bits, seen_label = (votes @ (1 << np.arange(4)))[:300], y[:300].astype(int)
    post, found, correlation = toxicity.label_model(np.concatenate([bits, seen_bits]), np.concatenate([np.full(len(bits), -1), seen_label]), np.concatenate([count, np.ones(300, int)]), 4)
    assert np.abs(found[:, :3] - rates).max() < 0.08
    assert correlation[0, 3] > 0.9 and abs(correlation[0, 2]) < 0.1
    assert post[list(bits).index(0)] < 0.2 and post[list(bits).index(0b1011)] > 0.7


def test_quality_on_held_out_rows(spark, labelled):
    docs, labels = labelled
    model = quality.fit(docs, labels)
    got = [r for r in quality.scored(docs, model).select("doc_id", "score", "text_score", "metadata_score", toxicity.held_out(F.col("doc_id")).alias("h")).collect() if r.h]
    assert sum((r.score >= 0.5) == bool(r.doc_id % 3) for r in got) >= 0.97 * len(got)
    assert all(0 <= x <= 1 for r in got for x in (r.score, r.text_score, r.metadata_score))
    odd = quality.scored(spark.createDataFrame(ODD, DOCS), model).collect()
    assert len(odd) == 4 and all(0 <= r.score <= 1 for r in odd)
    assert quality.fit(docs, labels.limit(0)) is None and quality.fit(docs.limit(0), labels) is None
    assert {r.score for r in quality.scored(docs.limit(5), None).collect()} == {0.5}
    assert quality.scored(docs.limit(0), model).count() == 0


def test_co_training_uses_the_other_view():
    draw = np.random.default_rng(1)
    y = (draw.random(2000) < 0.5).astype(float)
    view = lambda noise: np.column_stack([y + draw.normal(0, noise, 2000), draw.normal(0, 1, 2000)])
    a, b = view(0.3), view(0.3)
    own = np.arange(2000) < 12
    apart = np.arange(12) % 4 == 3
    model = quality.co_train(a[own], b[own], y[own], a[~own], b[~own], apart)
    right = ((quality._logit(model.text, a) + quality._logit(model.meta, b) > 0) == y).mean()
    assert right > 0.93


def test_a_view_of_noise_teaches_nothing(monkeypatch):
    """A view that ranks no better than chance gives the other no labels: the good view is as it is when that view is left out."""
    draw = np.random.default_rng(5)
    y = (draw.random(3000) < 0.5).astype(float)
    good, noise = np.column_stack([y + draw.normal(0, 0.4, 3000), draw.normal(0, 1, 3000)]), draw.normal(0, 1, (3000, 3))
    own, apart = np.arange(3000) < 200, np.arange(200) % 4 == 3
    seen = []
    real = quality.Round
    monkeypatch.setattr(quality, "Round", lambda views, cuts: seen.append(cuts) or real(views, cuts))
    model = quality.co_train(good[own], noise[own], y[own], good[~own], noise[~own], apart)
    assert seen and all(c[1, label] == quality.NOTHING for c in seen for label in (0, 1)) and any(c[0, 1] != quality.NOTHING for c in seen)
    right = ((quality._logit(model.text, good) > 0) == y).mean()
    assert right > 0.85
    assert quality.area(np.array([1.0, 2, 2, 3]), np.array([0, 0, 1, 1]))[0] == 0.875 and quality.area(np.ones(3), np.ones(3)) == (0.5, 0.0)


def test_co_training_beats_views_alone():
    """Two fair views and few labels: exchanging labels beats fitting either view on the labelled rows alone."""
    gains = []
    for seed in range(5):
        draw = np.random.default_rng(seed)
        y = (draw.random(4000) < 0.5).astype(float)
        view = lambda: np.column_stack([y[:, None] + draw.normal(0, 0.8, (4000, 2)), draw.normal(0, 1, (4000, 20))])  # noqa: E731, B023
        a, b = view(), view()
        own, apart = np.arange(4000) < 60, np.arange(60) % 3 == 2
        right = []
        for rounds in (0, quality.ROUNDS):
            m = quality.co_train(a[own], b[own], y[own], a[~own], b[~own], apart, rounds=rounds)
            right.append([((quality._logit(v, x) > 0) == y).mean() for v, x in ((m.text._replace(slope=1, offset=0), a), (m.meta._replace(slope=1, offset=0), b))])
        gains.append(np.mean(right[1]) - np.mean(right[0]))
    assert np.mean(gains) > 0.02


def brute_top(rows, k):
    import math

    v = [(i, tuple(math.floor(64 * c) for c in x)) for i, x in rows if i is not None and x is not None and all(c is not None and math.isfinite(c) for c in x)]
    out = []
    for a, (i, q) in enumerate(v):
        if i % 20 == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, c, strict=True)), j) for b, (j, c) in enumerate(v) if a != b and len(c) == len(q))[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored)]
    return sorted(out)


@pytest.mark.parametrize(("n", "block", "leaf"), ((400, 120, 8), (30, 1000, 256), (3, 10, 4)))
def test_exact_top_k(spark, monkeypatch, n, block, leaf):
    draw = np.random.default_rng(n)
    monkeypatch.setattr(mtree, "LEAF", leaf)
    centers = draw.normal(0, 1, (5, 6))
    rows = [(i, (centers[i % 5] + draw.normal(0, 0.2, 6)).tolist()) for i in range(n)]
    if n > 100:
        rows = [(i, rows[0][1] if i % 4 == 1 else x) for i, x in rows]  # a quarter are copies
    rows += [(2000, None), (2001, []), (2002, [1.0, None]), (2003, [float("nan")]), (2004, [float("inf")]), (None, [1.0] * 6), (2020, [1.0, 2.0]), (2021, [2.0, 1.0]), (2040, [0.0] * 6), (2060, []), rows[0]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    vectors = written(mtree.whole(df), "v")
    got = mtree.top_k(vectors, vectors.where("vec_id % 20 = 0"), 20, block, 7)
    assert sorted(tuple(r) for r in got.collect()) == brute_top(rows, 20)


def test_top_k_of_nothing(spark):
    none = mtree.whole(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert mtree.top_k(none, none).count() == 0


def test_bounds_avoid_computations():
    draw = np.random.default_rng(0)
    centers = draw.normal(0, 300, (40, 8))
    v = np.round(np.repeat(centers, 100, 0) + draw.normal(0, 3, (4000, 8))).astype(np.int64)
    zero = np.zeros(4000, np.int32)
    top = np.full(4000, float((v * v).sum(1).max()))
    rows = mtree._pages(pa.table({"row": np.arange(4000), "vec_id": np.arange(4000), "v": pa.array(v.tolist()), "dim": zero + 8, "pivot": zero, "sub": zero, "top": top})).to_pylist()
    tree = mtree.Tree(rows)
    ids, scores = tree.search(5, v[5], 20)
    order = sorted((-int(v[5] @ v[j]), j) for j in range(4000) if j != 5)[:20]
    assert [(-int(s), int(i)) for i, s in zip(ids, scores, strict=True)] == order
    assert tree.computed < 2500


def test_blocks_out_of_reach_are_not_asked(spark, monkeypatch):
    """Clustered vectors: four times as many in as many more clusters ask each query's blocks hardly more often; copies of one vector
    beyond a block are dealt on."""
    asked = {}
    real = mtree.written

    def noted(df, name, *args):
        out = real(df, name, *args)
        if name == "asked":
            asked[n] = out.count()
        return out

    monkeypatch.setattr(mtree, "written", noted)
    draw = np.random.default_rng(3)
    for n in (1000, 4000):
        centers = draw.normal(0, 30, (n // 50, 8))
        rows = [(i, (centers[i % len(centers)] + draw.normal(0, 0.05, 8)).tolist()) for i in range(n)]
        vectors = real(mtree.whole(spark.createDataFrame(rows, "vec_id long, embedding array<double>")), "v")
        got = mtree.top_k(vectors, vectors.where("vec_id % 20 = 0"), 20, 50, 64)
        if n == 1000:
            assert sorted(tuple(r) for r in got.collect()) == brute_top(rows, 20)
        else:
            assert got.count() == n // 20 * 20
    blocks, queries = {1000: 20, 4000: 80}, {1000: 50, 4000: 200}
    assert asked[4000] / queries[4000] < 2 * max(1, asked[1000] / queries[1000]) and asked[4000] < 0.25 * blocks[4000] * queries[4000]
    same = real(mtree.whole(spark.range(500).selectExpr("id as vec_id", "array(1d, 2d) as embedding")), "v")
    index = mtree.build_index(same, 50)
    assert index.select("sub").distinct().count() >= 4 and mtree.top_k(same, same.where("vec_id = 0"), 20, 50).count() == 20


@pytest.fixture()
def store(spark, tmp_path):
    return rollup.RollupStore(spark, f"file://{tmp_path}/{uuid.uuid4().hex}")


CHANGE = "source string, lang string, tokenizer_version string, op string, n_tokens long, old_tokens long"


@settings(max_examples=4, deadline=None)
@given(st.data())
def test_rollup_totals(spark, tmp_path_factory, data):
    own = rollup.RollupStore(spark, f"file://{tmp_path_factory.mktemp('r')}/s")
    op = st.tuples(st.sampled_from(["a", None]), st.sampled_from(["en", "de"]), st.just("v1"), st.sampled_from(["insert", "delete", "revise"]), st.integers(0, 50), st.integers(0, 50))
    batches = data.draw(st.lists(st.lists(op, min_size=1, max_size=6), min_size=1, max_size=3))
    want: dict = {}
    for k, b in enumerate(batches):
        for _ in range(2):  # each batch arrives twice
            own.commit(f"b{k}", spark.createDataFrame(b, CHANGE))
        for s, lang, v, o, n, old in b:
            d, t = want.get((s, lang, v), (0, 0))
            want[s, lang, v] = {"insert": (d + 1, t + n), "delete": (d - 1, t - n), "revise": (d, t + n - old)}[o]
    got = {tuple(r)[:3]: tuple(r)[3:] for r in own.totals().collect()}
    assert got == {k: v for k, v in want.items() if v != (0, 0)}


def test_rollup_commits(spark, store):
    assert store.totals().count() == 0
    one = spark.createDataFrame([("a", "en", "v", "insert", 5, None), ("a", "en", "v", "insert", None, None)], CHANGE)
    assert store.commit("x", one) and not store.commit("x", one)
    assert [tuple(r) for r in store.totals().collect()] == [("a", "en", "v", 2, 5)]
    assert store.commit("empty", one.limit(0)) and store.totals().count() == 1
    other = rollup.RollupStore(spark, store.folder)
    stale = other._current()
    assert store.commit("z", one)  # another writer takes the next version
    other._current = lambda: stale
    with pytest.raises(rollup.Conflict):
        other.commit("y", one)
    assert store.commit("y", one) and store.totals().first().n_docs == 6 and all(store.applied(b) for b in ("x", "empty", "z", "y")) and not store.applied("w")
    with pytest.raises(Exception, match="no such op"):
        rollup.deltas(one.replace("insert", "upsert")).collect()


@pytest.mark.parametrize("at", range(5))
def test_rollup_survives_a_writer_that_dies(spark, store, at):
    """A commit that dies before, inside or after any of its steps is either whole or without effect, and can be sent again."""
    one = spark.createDataFrame([("a", "en", "v", "insert", 5, None)], CHANGE)
    assert store.commit("first", one)

    class Dead(Exception):
        pass

    dying = rollup.RollupStore(spark, store.folder)
    step, write, publish = iter(range(99)), dying._write, dying._publish

    def dies(f):
        def call(*args):
            if next(step) == at:
                if f is write:  # an empty file is left, as by a writer that dies between making and filling it
                    dying.fs.create(dying.path(f"{dying.folder}/pending/{uuid.uuid4().hex}"), False).close()
                raise Dead
            return f(*args)

        return call

    dying._write, dying._publish = dies(write), dies(publish)
    with pytest.raises(Dead):
        dying.commit("second", one)
        dying.commit("third", one)  # for steps after the last one
    again = rollup.RollupStore(spark, store.folder)
    assert again.totals().first().n_docs in (1, 2)
    again.commit("second", one)
    assert not again.commit("second", one) and not again.commit("first", one)
    assert [tuple(r) for r in again.totals().collect()] == [("a", "en", "v", 2, 10)]
    assert again.commit("fourth", one) and again.totals().first().n_docs == 3


def test_token_rollup_query(spark, tmp_path, docs, corpus):
    """op9 against brute force, with repeated rows, rows without doc_id and texts of many spaces."""
    import re

    from tabforge.llm.tokens import ByteTokenizer, tokenizer_files

    from .test_text import plain

    rows = corpus + [corpus[0], (None, corpus[1][1], None, None, 1), (900, "a  b \n c", "en", "s0", 1), (901, "a  b \n c", "de", "s1", 1), (902, None, None, None, None)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    slow = ByteTokenizer(tokenizer_files()[0]).slow
    ids = lambda t: len(slow.encode(t, add_special_tokens=False).ids)
    first, want = {}, {}
    for i, t, *_ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    for i, t, lang, source, _ in rows:
        t = t or ""
        if i is not None and i > first[t]:
            continue
        for version, n in (("byte_bpe_50k", ids(re.sub(r"\s+", " ", t))), ("words_1", len(plain(t)))):
            d, k = want.get((source, lang, version), (0, 0))
            want[source, lang, version] = (d + 1, k + n)
    got = rollup.op9_token_rollup(spark, str(tmp_path))
    assert got.columns == ["source", "lang", "tokenizer_version", "n_docs", "n_tokens"]
    assert {tuple(r)[:3]: tuple(r)[3:] for r in got.collect()} == want


def test_counts(spark, docs, corpus, empty, clashing):
    import re

    from tabforge.llm.tokens import ByteTokenizer, tokenizer_files

    from .test_text import plain

    slow = ByteTokenizer(tokenizer_files()[0]).slow
    ids = lambda t: len(slow.encode(t, add_special_tokens=False).ids)
    for df in (docs, clashing):
        got = {r.doc_id: (r.raw, r.clean, r.n_words) for r in rollup.counted(df).collect()}
        assert got == {i: (ids(t or ""), ids(re.sub(r"\s+", " ", t or "")), len(plain(t or ""))) for i, t, *_ in corpus}
    assert rollup.counted(empty).count() == 0


def test_license_scan(spark, docs, corpus, empty):
    mit = license.KNOWN["MIT"]
    texts = [
        ("MIT", mit), ("MIT", "Copyright (c) 2020 Someone\n\n" + mit.upper()), ("MIT", "© 2019–2021 A, B & C. \r\nAll rights reserved.\r\n\r\n" + mit.replace("\n", "\r\n  ").replace('"', "”")),
        ("MIT", mit.replace("sublicense", "sub-license")), (None, mit + " More."), (None, mit[:200]), ("BSD-3-Clause", "# Copyright 2001 X\n" + license.KNOWN["BSD-3-Clause"]), ("ISC", license.KNOWN["ISC"]),
        ("Apache-2.0-Notice", "Licenced under the Apache Licence, version 2.0"), (None, ""), (None, None), (None, "Copyright (c) 2020 Someone"),
    ]
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)] + [(0, mit)], "doc_id long, text string")
    known = license.digests(spark, license.KNOWN)
    got = license.license_scan(df, known).collect()
    assert len(got) == len(df.collect()) and {r.doc_id: r.license_id for r in got} == {i: k for i, (k, _) in enumerate(texts)}
    assert known.count() == len(license.KNOWN)
    assert license.license_scan(empty, known).count() == 0
    assert license.license_scan(docs, known).where("license_id is not null").count() == 0


def test_quality_learns_from_all_unlabelled_documents(spark):
    """More unlabelled documents than any bound that the pool once had move the feature means of both views."""
    text = F.expr("concat_ws(' ', transform(sequence(0, cast(pmod(xxhash64(id), 9) as int)), i -> concat('w', pmod(xxhash64(id, i), 50))))")
    docs = written(spark.range(0, 24_000, 1, 4).select(F.col("id").alias("doc_id"), text.alias("text"), F.lit("en").alias("lang"), F.expr("concat('s', id % 3)").alias("source"), F.length(text).cast("long").alias("n_chars")), "many")
    labels = docs.where("doc_id % 100 = 0").selectExpr("doc_id", "cast(n_chars > 15 as int) as quality")
    model = quality.fit(docs, labels)
    rows = docs.toPandas()
    assert len(rows) == 24_000
    assert np.allclose(model.text.center, quality.text_view(pa.array(rows["text"])).mean(0))
    assert np.allclose(model.meta.center, quality.meta_view(*(rows[c].tolist() for c in ("source", "lang", "n_chars"))).mean(0))


def test_quality_takes_all_but_its_sample_as_unlabelled(spark, labelled):
    """Held-out rows, null qualities and labelled rows beyond the sample are unlabelled text, even where labels cover all documents."""
    docs, labels = labelled
    every = docs.selectExpr("doc_id", "case when doc_id % 7 > 0 then cast(doc_id % 3 > 0 as int) end as quality")
    rows = docs.toPandas()
    model = quality.fit(docs, every, sample_rows=100)
    assert np.allclose(model.text.center, quality.text_view(pa.array(rows["text"])).mean(0))
    assert np.allclose(model.meta.center, quality.meta_view(*(rows[c].tolist() for c in ("source", "lang", "n_chars"))).mean(0))
    # no label of an unlabelled document is read
    hidden = every.select("doc_id", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")).alias("quality"))
    again = quality.fit(docs, hidden, sample_rows=100)
    assert np.array_equal(again.mixture, model.mixture)
    # none is left: two views that exchange nothing
    alone = quality.co_train(np.eye(4), np.eye(4), np.array([0.0, 1, 0, 1]), np.zeros((0, 4)), np.zeros((0, 4)), np.zeros(4, bool))
    assert np.isfinite(alone.mixture).all()


def test_each_round_gives_its_whole_share():
    """A view that ranks as before gives as many documents again: those given already do not take up places."""
    draw = np.random.default_rng(2)
    x = draw.normal(0, 1, (1000, 1))
    fold = quality.in_memory(x, x)
    views = [quality.View(np.zeros(1), np.ones(1), np.array([4.0, 0.0]), 1.0, 0.0)] * 2
    history, given = [], []
    for _ in range(3):
        history = [*history, quality.Round(views, quality._cuts(fold, history, views, {1: 30, 0: 20}))]
        given.append([[(g == label).sum() for label in (1, 0)] for g in quality._given(history, (x, x), quality._hash_bins(np.arange(1000)))])
    assert given == [[[30, 20]] * 2, [[60, 40]] * 2, [[90, 60]] * 2]


def test_license_scan_knows_titles_and_whole_texts(spark):
    mit, folder = license.KNOWN["MIT"], os.path.join(os.path.dirname(license.__file__), "licences")
    read = lambda name: open(os.path.join(folder, f"{name}.txt"), encoding="utf-8").read()
    apache, gpl = read("Apache-2.0"), read("GPL-2")
    texts = [
        ("MIT", "MIT License\n\nCopyright (c) 2020 X\n\n" + mit), ("MIT", "The MIT License (MIT)\r\n\r\nCopyright 2020 X\r\n\r\n" + mit), ("BSD-3-Clause", "BSD 3-Clause License\n\nCopyright (c) 2020, X\n" + license.KNOWN["BSD-3-Clause"]),
        ("BSD-2-Clause", "Copyright (c) 2020, X\n" + license.KNOWN["BSD-2-Clause"].replace("1. ", "* ").replace("2. ", "* ")), ("Apache-2.0", apache), ("Apache-2.0", apache.replace("[yyyy] [name of copyright owner]", "2020 X")),
        ("Apache-2.0", apache[: apache.index("APPENDIX")]), ("GPL-3.0", read("GPL-3")), ("GPL-2.0", gpl), ("GPL-2.0", gpl[: gpl.index("How to Apply These Terms to Your")].rstrip()), ("LGPL-2.1", read("LGPL-2.1")), ("LGPL-3.0", read("LGPL-3")), ("MPL-2.0", read("MPL-2.0")),
        (None, "MIT License"), (None, apache[:5000]), (None, apache + mit),
    ]
    got = license.license_scan(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "doc_id long, text string"), license.digests(spark, license.texts())).collect()
    assert {r.doc_id: r.license_id for r in got} == {i: k for i, (k, _) in enumerate(texts)}
    assert {*license.TITLES, *license.WHOLE.values()} <= {k for k, _ in license.texts()}
