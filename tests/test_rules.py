"""Rules: golden values of audits, views, reconstruction, acceptance and the compiler's refusals."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tabforge.operators import rules
from tabforge.operators.synth import Cyclic, shards
from tabforge.plans.pipeline import generate_exactly, run
from tabforge.plans.rules import compile_rules
from tabforge.schema import CANDIDATE_INDEX, ROW_ID, ColumnSchema, EngineError

C = ColumnSchema


def ints(*names, nullable=True):
    return [C(n, "integer", nullable=nullable) for n in names]


def table(spark, rows, schema):
    from tabforge.schema import struct

    return spark.createDataFrame(rows, struct(schema))


def counts(df, compiled):
    return {r.rule_id: r.violations for r in rules.audit(df, compiled).collect()}


def test_audit_and_drop(spark):
    schema = [C("number", "integer", nullable=True), C("code", "categorical", nullable=True)]
    df = table(spark, [(None, "bad"), (None, "ok"), (1, "bad"), (2, None), (3, "ok")], schema)
    specs = [{"id": "n", "kind": "not_null", "column": "number", "source_action": "drop_row"}, {"id": "c", "kind": "allowed_values", "column": "code", "values": ["ok"], "source_action": "drop_row"}]
    compiled = compile_rules(specs, schema)
    found = counts(df, compiled)
    assert (found["__source"], found["__retained"], found["n"], found["c"], found["__drop_union"], found["__drop_overlap"]) == (5, 2, 2, 2, 3, 1)
    assert sorted(map(tuple, rules.kept(df, compiled).collect()), key=str) == [(2, None), (3, "ok")]
    assert counts(df.limit(0), compiled)["__source"] == 0


def test_block_gate(spark):
    schema = ints("value", nullable=False)
    compiled = compile_rules([{"id": "r", "kind": "range", "column": "value", "min": 0, "max": 10}], schema)
    with pytest.raises(EngineError) as e:
        rules.audited_source(table(spark, [(1,), (11,)], schema), compiled)
    assert e.value.code == "SOURCE_RULE_VIOLATION" and e.value.details["counts"]["__block_union"] == 1


def test_overlap_counts_every_rule(spark):
    schema = ints("value")
    specs = [{"id": "a", "kind": "not_null", "column": "value"}, {"id": "b", "kind": "allowed_values", "column": "value", "values": [1]}]
    found = counts(table(spark, [(None,), (2,), (1,)], schema), compile_rules(specs, schema))
    assert (found["a"], found["b"], found["__union"], found["__overlap"]) == (1, 1, 2, 0)


def test_mask_counts_code_points(spark):
    schema = [C("t", "text", nullable=True)]
    compiled = compile_rules([{"id": "m", "kind": "mask_prefix", "column": "t", "keep_chars": 2}], schema)
    got = [r.t for r in rules.model_view(table(spark, [("A😀é",), ("e◌́x",), ("短",), (None,)], schema), compiled).collect()]
    assert got[0] == "A😀*" and got[1][:2] == "e◌" and set(got[1][2:]) == {"*"} and got[2:] == ["短", None]


def test_tuples_round_trip_with_null(spark):
    schema = [C("left", "categorical", nullable=True), C("right", "boolean")]
    compiled = compile_rules([{"id": "t", "kind": "fixed_combination", "columns": ["left", "right"], "allowed_tuples": [["a", True], [None, False]]}], schema)
    df = table(spark, [("a", True), (None, False), (None, True)], schema)
    assert counts(df, compiled)["t"] == 1
    domain = {"t": rules.domain_of(df, compiled.rules[0], compiled)}
    view = rules.model_view(df, compiled, domain)
    assert view.columns == [compiled.latent(compiled.rules[0])]
    back = rules.rebuilt(view, compiled, domain).collect()
    assert sorted(((r.left, r.right, r["__invalid"]) for r in back), key=str) == sorted([("a", True, False), (None, False, False), (None, None, True)], key=str)


def test_inferred_tuples_come_from_kept_rows(spark):
    schema = [C("a", "categorical"), C("b", "categorical"), C("keep", "integer")]
    specs = [{"id": "t", "kind": "fixed_combination", "columns": ["a", "b"], "provenance": "private_inferred"}, {"id": "k", "kind": "allowed_values", "column": "keep", "values": [1], "source_action": "drop_row"}]
    compiled = compile_rules(specs, schema)
    df = table(spark, [("x", "y", 1), ("secret", "tuple", 0)], schema)
    domain = rules.domain_of(df, compiled.rule("t"), compiled)
    assert [tuple(r)[1:] for r in domain.collect()] == [("x", "y")]
    assert [r["__violations"] for r in rules.validated(df, compiled, {"t": domain}).orderBy("a").collect()] == [2, 0]
    with pytest.raises(EngineError):
        rules.domain_of(df.withColumn("keep", F.lit(1).cast("long")), compiled.rule("t"), compiled, cap=1)


@pytest.mark.parametrize(("when", "value", "want"), (({"kind": "comparison", "column": "flag", "op": "eq", "value": 1}, "forced", ["forced", "keep", "kept"]), ({"kind": "is_null", "column": "flag"}, "n", ["wrong", "keep", "n"])))
def test_conditional_set(spark, when, value, want):
    schema = [C("flag", "integer", nullable=True), C("target", "categorical")]
    compiled = compile_rules([{"id": "s", "kind": "conditional_set", "when": when, "target": "target", "value": value}], schema)
    df = table(spark, [(1, "wrong"), (0, "keep"), (None, "kept")], schema).coalesce(1)
    assert [r.target for r in rules.rebuilt(rules.model_view(df, compiled), compiled).collect()] == want


def test_sums_round_half_to_even(spark):
    schema = [C(n, "fixed_decimal", nullable=True, decimal_places=2) for n in ("first", "second", "total")]
    compiled = compile_rules([{"id": "s", "kind": "sum_equals", "sources": ["first", "second"], "target": "total"}], schema)
    df = spark.createDataFrame([(Decimal("1.005"), Decimal("2.005")), (Decimal("1.015"), Decimal("2.005")), (None, Decimal("9.99"))], "first decimal(38,3), second decimal(38,3)").coalesce(1)
    assert [r.total for r in rules.rebuilt(df, compiled).collect()] == [Decimal("3.00"), Decimal("3.02"), None]


def test_sums_beyond_64_bits(spark):
    schema = ints("a", "b", "t", nullable=False)
    compiled = compile_rules([{"id": "s", "kind": "sum_equals", "sources": ["a", "b"], "target": "t"}], schema)
    df = table(spark, [(2**63 - 1, 1, 5)], schema)
    assert counts(df, compiled)["s"] == 1
    with pytest.raises(Exception, match="int64_overflow"):
        rules.rebuilt(df.drop("t"), compiled).collect()


@pytest.mark.parametrize(("op", "right"), (("<", 6), ("<=", 5), (">", 4), (">=", 5)))
def test_compare_steps(spark, op, right):
    schema = ints("left", "right", nullable=False)
    compiled = compile_rules([{"id": "c", "kind": "compare", "left": "left", "op": op, "right": "right"}], schema)
    df = spark.createDataFrame([(5, 0)], f"left long, `{compiled.latent(compiled.rules[0])}` long")
    assert [r.right for r in rules.rebuilt(df, compiled).collect()] == [right]


@pytest.mark.parametrize(("kind", "extra", "left", "right"), (
    ("date", {}, dt.date(2025, 1, 1), dt.date(2025, 1, 2)), ("datetime", {"timezone": "UTC"}, dt.datetime(2025, 1, 1), dt.datetime(2025, 1, 1, 0, 0, 0, 1)), ("fixed_decimal", {"decimal_places": 2}, Decimal("5.00"), Decimal("5.01")), ("float", {}, 1.0, 1.25),
))
def test_compare_units(spark, kind, extra, left, right):
    schema = [C("left", kind, **extra), C("right", kind, **extra)]
    compiled = compile_rules([{"id": "c", "kind": "compare", "left": "left", "op": "<", "right": "right"} | ({"granularity": 0.25} if kind == "float" else {})], schema)
    df = table(spark, [(left, right)], schema)
    view = rules.model_view(df, compiled)
    assert view.first()[compiled.latent(compiled.rules[0])] == 0
    assert rules.rebuilt(view, compiled).first()["right"] == right
    assert rules.model_view(table(spark, [(right, left)], schema), compiled).first()[1] is None


def test_range_takes_typed_bounds(spark):
    schema = [C("d", "date")]
    compiled = compile_rules([{"id": "r", "kind": "range", "column": "d", "min": "2025-01-01", "max": "2025-12-31"}], schema)
    assert counts(table(spark, [(dt.date(2025, 6, 1),), (dt.date(2024, 6, 1),)], schema), compiled)["r"] == 1


def test_acceptance_and_exhaustion(spark):
    schema = ints("value", nullable=False)
    compiled = compile_rules([{"id": "r", "kind": "range", "column": "value", "min": 0, "max": 5}], schema)

    class Half:
        def generate(self, start, stop):
            return spark.range(start, stop).select(F.col("id").alias(CANDIDATE_INDEX), F.when(F.col("id") < 40, 9).otherwise(1).cast("long").alias("value"))

    out, examined, rejected = generate_exactly(Half(), compiled, 4, 40)
    assert ([r.value for r in out.orderBy("accepted_id").collect()], examined, rejected) == ([1, 1, 1, 1], 80, 40)
    never = compile_rules([{"id": "r", "kind": "range", "column": "value", "min": 100, "max": 101}], schema)
    with pytest.raises(EngineError) as e:
        generate_exactly(Half(), never, 2, 20)
    assert (e.value.code, e.value.details["examined"]) == ("RULE_FEASIBILITY_EXHAUSTED", 40)
    with_id = [*schema, C("id", "identifier", role="identifier", identifier_strategy="sequential")]
    out, *_ = generate_exactly(Half(), compile_rules([{"id": "r", "kind": "range", "column": "value", "min": 0, "max": 5}], with_id), 3, 60)
    assert [r.id for r in out.orderBy("accepted_id").collect()] == ["1", "2", "3"]


def test_numbering_needs_no_single_partition(spark):
    schema = ints("v", nullable=False)
    df = spark.range(5000).select((F.col("id") * 7 % 5000).alias(CANDIDATE_INDEX), F.col("id").alias("v"), (F.col("id") % 3 == 0).cast("int").alias("__violations")).repartition(6)
    got = rules.accepted(df, CANDIDATE_INDEX, 1000).orderBy("accepted_id").collect()
    want = sorted(i * 7 % 5000 for i in range(5000) if i % 3)[:1000]
    assert [r[CANDIDATE_INDEX] for r in got] == want and [r.accepted_id for r in got] == list(range(1000)) and schema


def test_shards():
    plan = shards(10, 4, b"s")
    assert [p[0] for p in plan[1:]] == [p[1] for p in plan[:-1]] and plan[-1][1] == 200 and len({p[2] for p in plan}) == 4


def test_whole_run(spark):
    schema = [C("group", "categorical"), C("amount", "integer"), C("flag", "boolean")]
    df = spark.range(1000).select(F.col("id").alias(ROW_ID), F.element_at(F.array(*map(F.lit, "abc")), (F.col("id") % 3 + 1).cast("int")).alias("group"), (F.col("id") % 101).alias("amount"), (F.col("id") % 2 == 1).alias("flag"))
    compiled = compile_rules([{"id": "g", "kind": "allowed_values", "column": "group", "values": ["a", "b", "c"]}], schema)
    found = run(df, compiled, lambda v: Cyclic.fit(v, [ROW_ID], 7), b"k" * 32, 300)
    assert found.rows.count() == 300 and found.rejected == 0 and {r.column for r in found.distances.collect()} == {"group", "amount", "flag"}


BAD = [
    [{"id": "1x", "kind": "not_null", "column": "a"}],
    [{"id": "x", "kind": "not_null", "column": "zz"}],
    [{"id": "x", "kind": "nothing"}],
    [{"id": "x", "kind": "not_null", "column": "a"}] * 2,
    [{"id": "x", "kind": "range", "column": "a", "min": 5, "max": 4}],
    [{"id": "x", "kind": "range", "column": "t", "min": "a", "max": "b"}],
    [{"id": "x", "kind": "allowed_values", "column": "a", "values": [1, 1]}],
    [{"id": "x", "kind": "allowed_values", "column": "a", "values": [True]}],
    [{"id": "x", "kind": "allowed_values", "column": "a", "values": ["1"]}],
    [{"id": "x", "kind": "mask_prefix", "column": "a", "keep_chars": 2}],
    [{"id": "x", "kind": "mask_prefix", "column": "t", "keep_chars": 2, "source_action": "drop_row"}],
    [{"id": "x", "kind": "fixed_combination", "columns": ["a", "a"]}],
    [{"id": "x", "kind": "fixed_combination", "columns": ["a", "b"], "allowed_tuples": [[1]]}],
    [{"id": "x", "kind": "compare", "left": "a", "op": "<", "right": "f"}],
    [{"id": "x", "kind": "compare", "left": "f", "op": "<", "right": "g"}],
    [{"id": "x", "kind": "sum_equals", "sources": ["f"], "target": "a"}],
    [{"id": "x", "kind": "sum_equals", "sources": ["a"], "target": "a"}],
    [{"id": "x", "kind": "sum_equals", "sources": ["a"], "target": "b"}, {"id": "y", "kind": "compare", "left": "a", "op": "<", "right": "b"}],
    [{"id": "x", "kind": "sum_equals", "sources": ["a"], "target": "b"}, {"id": "y", "kind": "sum_equals", "sources": ["b"], "target": "a"}],
    [{"id": "x", "kind": "sum_equals", "sources": ["a"], "target": "b"}, {"id": "y", "kind": "conditional_set", "when": {"kind": "is_null", "column": "b"}, "target": "t", "value": "v"}],
    [{"id": "x", "kind": "conditional_set", "when": {"kind": "is_null", "column": "a"}, "target": "t", "value": None}],
]


@pytest.mark.parametrize("specs", BAD)
def test_compiler_refuses(specs):
    schema = [*ints("a", "b", nullable=False), C("f", "float"), C("g", "float"), C("t", "text")]
    with pytest.raises(EngineError) as e:
        compile_rules(specs, schema)
    assert e.value.code == "RULE_CONFLICT"


def test_order_of_reconstruction():
    schema = ints("a", "b", "c", "d", nullable=False)
    specs = [{"id": "a_last", "kind": "sum_equals", "sources": ["c"], "target": "d"}, {"id": "m", "kind": "compare", "left": "b", "op": "<", "right": "c"}, {"id": "z_first", "kind": "sum_equals", "sources": ["a"], "target": "b"}]
    assert compile_rules(specs, schema).rebuild == ("z_first", "m", "a_last")


def test_public_rules_only():
    schema = [C("a", "categorical", public_categories=("x", "y"))]
    ok = {"id": "r", "kind": "allowed_values", "column": "a", "values": ["x"]}
    assert compile_rules([ok], schema, public_only=True).rules
    for bad in (ok | {"values": ["q"]}, ok | {"provenance": "private_inferred"}):
        with pytest.raises(EngineError):
            compile_rules([bad], schema, public_only=True)
