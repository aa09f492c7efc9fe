"""Streams: audits by micro-batch, event-time windows, ordered acceptance, and candidates' types."""

import datetime as dt

from pyspark.sql import functions as F

from tabforge.operators import candidates
from tabforge.operators.rules import audit
from tabforge.plans.rules import compile_rules
from tabforge.schema import ColumnSchema
from tabforge.streaming.audit import accept_stream, audited_stream, totals, windowed_violations

SCHEMA = (ColumnSchema("id", "integer"), ColumnSchema("v", "integer", nullable=True))
RULES = compile_rules([{"id": "r", "kind": "range", "column": "v", "min": 0, "max": 5, "source_action": "drop_row"}], SCHEMA)


def files(spark, path, n=3):
    df = spark.range(30).select("id", F.when(F.col("id") % 7 != 0, F.col("id") % 10).alias("v"), F.timestamp_seconds(F.col("id") * 600).alias("at"))
    for k in range(n):
        df.where(F.col("id") % n == k).coalesce(1).write.mode("append").parquet(path)
    return df, spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_audit_of_batches(spark, tmp_path):
    df, stream = files(spark, str(tmp_path / "in"))
    audited_stream(stream, RULES, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert {tuple(r) for r in totals(spark, str(tmp_path / "out")).collect()} == {tuple(r) for r in audit(df, RULES).collect()}
    # a second run finds nothing new
    audited_stream(stream, RULES, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert totals(spark, str(tmp_path / "out")).where("rule_id = '__source'").first().violations == 30


def test_windows(spark, tmp_path):
    df, stream = files(spark, str(tmp_path / "in"), 1)
    q = windowed_violations(stream, RULES, "at").writeStream.format("memory").queryName("windows").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.start: (r.n, r.dropped) for r in spark.table("windows").collect()}
    first = got[dt.datetime(1970, 1, 1)]
    assert first == (6, 0) and sum(n for n, _ in got.values()) <= 30


def test_acceptance_of_a_stream(spark, tmp_path):
    _, stream = files(spark, str(tmp_path / "in"))
    accept_stream(stream.drop("at"), RULES, "id", str(tmp_path / "out"), str(tmp_path / "state"), 8).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == 8 and got.where("v > 5").count() == 0


def test_candidate_types(spark):
    schema = [ColumnSchema("i", "integer", nullable=True), ColumnSchema("b", "boolean", nullable=True), ColumnSchema("d", "fixed_decimal", decimal_places=1, nullable=True), ColumnSchema("f", "float")]
    df = spark.createDataFrame([(1.0, "TRUE", "0.25", 1.5), (1.5, "yes", "0.35", 1.5), (None, None, None, float("inf")), (2.0**70, "false", "x", None)], "i double, b string, d string, f double").coalesce(1)
    got = [tuple(r) for r in candidates.typed_candidates(df, schema).collect()]
    assert [r[0] for r in got] == [1, None, None, None] and [r[1] for r in got] == [True, None, None, False]
    assert [None if r[2] is None else str(r[2]) for r in got] == ["0.2", "0.4", None, None]
    assert [r[4] for r in got] == [False, True, True, True]


def test_nested_split_and_plans(spark):
    df = spark.range(4000)
    share = candidates.nested_split(df, b"k" * 32, "id").where("for_fit").count() / 4000
    assert 0.88 < share < 0.92
    assert candidates.generation_plan(3, 2) == [(0, 30), (30, 60)]
    assert set(candidates.advanced_sections("release", {"pairwise": df, "empirical_privacy": df})) == {"pairwise"}
