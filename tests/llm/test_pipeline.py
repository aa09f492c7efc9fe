"""The stages one by one, each held against a brute-force version over its own input, and the registered queries."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tabforge.llm import queries, toxicity
from tabforge.llm.common import table, written

from .test_joins import brute_hits, brute_join, covered, words

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = table(spark, SF, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        after = written(stage(spark, docs, SF), name)
        out.append((docs, after))
        docs = after
    return out


def rows(df):
    return [tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()]


def test_stages_keep_the_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "repeated_passages", "contamination", "packing"]
    for before, after in stages[:-1]:
        assert after.schema == before.schema


def test_toxic_stage(spark, stages):
    before, after = stages[0]
    model = toxicity.fit(before, table(spark, SF, "labels"))
    keep = {r.doc_id for r in toxicity.scored(before, model).where(F.col("score") < toxicity.THRESHOLD).collect()}
    assert {r[0] for r in rows(after)} == keep and len(keep) < before.count()


def test_near_duplicate_stage(stages):
    before, after = stages[1]
    want = {i for i, (_, c, _) in brute_join(rows(before)).items() if i == c}
    assert {r[0] for r in rows(after)} == want < {r[0] for r in rows(before)}


def test_passage_stage(stages):
    before, after = stages[2]
    left = {r[0]: r[1] for r in rows(after)}
    want, _ = covered(rows(before), [])
    for i, t, *_ in rows(before):
        if not want[i]:
            continue
        assert i not in left or len(words(left[i])) <= len(words(t)) - len(want[i])
    again, _ = covered(rows(after), [])
    assert sum(map(len, again.values())) <= 0.02 * sum(map(len, want.values()))


def test_contamination_stage(spark, stages):
    before, after = stages[3]
    items = [tuple(r) for r in table(spark, SF, "benchmark").select("item_id", "text").collect()]
    hits = brute_hits(rows(before), items)
    assert {r[0] for r in rows(after)} == {i for i, h in hits.items() if not h[3]}


def test_packing_stage(stages):
    from .test_packing import best_fit

    before, after = stages[4]
    got = after.collect()
    assert {r.doc_id for r in got} == {r[0] for r in rows(before)}
    assert len({r.sequence_id for r in got}) == best_fit([r.length for r in got], 1024)


def test_run_gives_the_last_stage(spark, stages):
    assert corpus_pipeline.run(spark, SF).count() == stages[-1][1].count()


def test_stages_take_odd_rows(spark, docs, clashing):
    extra = clashing.withColumn("n_chars", F.col("n_chars"))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0, name
        out = stage(spark, extra, SF)
        if name != "packing":
            assert out.columns == extra.columns
        assert out.count() > 0


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_equal_their_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in "documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    want = con.execute(queries.SQL[name]).fetchall()
    order = [d[0] for d in con.description]
    assert sorted(order) == sorted(got.columns)
    assert sorted(map(str, (tuple(r) for r in got.select(*order).collect()))) == sorted(map(str, want))


def test_stages_keep_rows_of_repeated_ids_apart(spark):
    """A doc_id with several texts: no stage takes a text for another of the same id, and one of several equal rows stays."""
    import random

    from .conftest import DOCS, sentence

    draw = random.Random(3)
    item = table(spark, SF, "benchmark").where("length(text) > 100").first().text
    a, b, c = (sentence(draw, 80) for _ in range(3))
    docs = spark.createDataFrame([(1, a, "en", "s", 1), (5, a, "en", "s", 1), (5, b, "en", "s", 1), (7, c, "en", "s", 1), (7, c, "de", "t", 1), (9, item, "en", "s", 1), (9, b + " more", "en", "s", 1), (9, None, "en", "s", None), (9, None, "en", "s", None)], DOCS)
    stage = dict(corpus_pipeline.STAGES)
    left = sorted((r.doc_id, r.text or "") for r in stage["near_duplicates"](spark, docs, SF).collect())
    assert left == sorted([(1, a), (5, b), (7, c), (9, item), (9, ""), (9, "")])
    left = sorted((r.doc_id, r.text or "") for r in stage["contamination"](spark, docs, SF).collect())
    assert left == sorted([(1, a), (5, a), (5, b), (7, c), (7, c), (9, b + " more"), (9, ""), (9, "")])
