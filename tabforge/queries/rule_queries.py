"""Queries of rules: audits, filters, model views, reconstruction, validation and acceptance."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabforge.operators import rules
from tabforge.plans.rules import compile_rules
from tabforge.queries import load, query
from tabforge.schema import CANDIDATE_INDEX, ColumnSchema

ORDERS = (
    ColumnSchema("o_orderkey", "integer"),
    ColumnSchema("o_orderstatus", "categorical"),
    ColumnSchema("o_totalprice", "float"),
    ColumnSchema("o_orderdate", "date"),
    ColumnSchema("prio", "categorical", nullable=True),
)
SPECS = [
    {"id": "a_prio", "kind": "not_null", "column": "prio", "source_action": "drop_row"},
    {"id": "b_status", "kind": "allowed_values", "column": "o_orderstatus", "values": ["F", "O"], "source_action": "drop_row"},
    {"id": "c_price", "kind": "range", "column": "o_totalprice", "min": 0, "max": 450000, "source_action": "drop_row"},
    {"id": "d_date", "kind": "range", "column": "o_orderdate", "min": "1995-01-01", "max": "2000-12-31", "source_action": "drop_row"},
    {"id": "e_cond", "kind": "conditional_set", "when": {"kind": "comparison", "column": "o_orderstatus", "op": "eq", "value": "P"}, "target": "prio", "value": "2-HIGH"},
]
_T = "SELECT o_orderkey, o_orderstatus, o_totalprice, CAST(o_orderdate AS DATE) AS o_orderdate, nullif(o_orderpriority, '4-NOT SPECIFIED') AS prio FROM orders"
_V = """SELECT *, prio IS NULL AS a, coalesce(o_orderstatus NOT IN ('F', 'O'), true) AS b, coalesce(NOT (o_totalprice BETWEEN 0 AND 450000), true) AS c,
coalesce(NOT (o_orderdate BETWEEN DATE '1995-01-01' AND DATE '2000-12-31'), true) AS dd, coalesce(o_orderstatus = 'P', false) AND prio IS DISTINCT FROM '2-HIGH' AS e FROM t"""
_N = "CAST(a AS INT) + CAST(b AS INT) + CAST(c AS INT) + CAST(dd AS INT)"


def orders(spark, d):
    return load(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", F.col("o_orderdate").cast("date").alias("o_orderdate"), F.nullif(F.col("o_orderpriority"), F.lit("4-NOT SPECIFIED")).alias("prio"))


def _counter(name: str, predicate: str) -> str:
    return f"SELECT '{name}' AS rule_id, count(*) FILTER (WHERE {predicate}) AS violations FROM v"


@query(f"WITH t AS ({_T}), v AS ({_V}) " + " UNION ALL ".join(_counter(n, p) for n, p in (("a_prio", "a"), ("b_status", "b"), ("c_price", "c"), ("d_date", "dd"), ("e_cond", "e"), ("__source", "true"), ("__union", f"{_N} + CAST(e AS INT) > 0"), ("__overlap", f"{_N} + CAST(e AS INT) > 1"), ("__block_union", "e"), ("__block_overlap", "false"), ("__drop_union", f"{_N} > 0"), ("__drop_overlap", f"{_N} > 1"), ("__retained", f"{_N} = 0"))))
def rule_audit_counters(spark, d):
    return rules.audit(orders(spark, d), compile_rules(SPECS, ORDERS))


def _violating(spark, d, spec, df=None, schema=ORDERS):
    c = compile_rules([spec], schema)
    return (orders(spark, d) if df is None else df).where(rules.violated(c.rules[0], c))


@query(f"SELECT o_orderkey FROM ({_T}) WHERE prio IS NULL")
def rule_not_null(spark, d):
    return _violating(spark, d, SPECS[0]).select("o_orderkey")


@query(f"SELECT o_orderkey FROM ({_T}) WHERE coalesce(o_orderstatus NOT IN ('F', 'O'), true)")
def rule_allowed_values(spark, d):
    return _violating(spark, d, SPECS[1]).select("o_orderkey")


@query(f"SELECT o_orderkey FROM ({_T}) WHERE NOT (o_totalprice > 1000 AND o_totalprice <= 450000)")
def rule_range(spark, d):
    return _violating(spark, d, {"id": "r", "kind": "range", "column": "o_totalprice", "min": 1000, "max": 450000, "inclusive_min": False}).select("o_orderkey")


@query(f"SELECT o_orderkey FROM ({_T}) WHERE NOT (o_orderdate BETWEEN DATE '1995-01-01' AND DATE '2000-12-31')")
def rule_date_bounds_typed(spark, d):
    return _violating(spark, d, SPECS[3]).select("o_orderkey")


@query(f"SELECT o_orderkey FROM ({_T}) WHERE o_orderstatus = 'P' AND prio IS DISTINCT FROM '2-HIGH'")
def rule_conditional_set(spark, d):
    return _violating(spark, d, SPECS[4]).select("o_orderkey")


LINES = (
    ColumnSchema("line", "integer"),
    ColumnSchema("quantity", "fixed_decimal", nullable=True, decimal_places=2),
    ColumnSchema("tax", "fixed_decimal", decimal_places=2),
    ColumnSchema("total", "fixed_decimal", nullable=True, decimal_places=2),
    ColumnSchema("shipped", "date"),
    ColumnSchema("ordered", "date"),
    ColumnSchema("flag", "categorical"),
    ColumnSchema("status", "categorical"),
)
_L = """SELECT l_orderkey * 100 + l_linenumber AS line, CASE WHEN l_linenumber = 7 THEN NULL ELSE CAST(l_quantity AS DECIMAL(38,2)) END AS quantity, CAST(l_tax AS DECIMAL(38,2)) AS tax,
CASE WHEN l_linenumber IN (6, 7) THEN NULL ELSE CAST(l_quantity AS DECIMAL(38,2)) + CAST(l_discount AS DECIMAL(38,2)) END AS total, CAST(l_shipdate AS DATE) AS shipped, CAST(o_orderdate AS DATE) AS ordered, l_returnflag AS flag, l_linestatus AS status
FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""


def lines(spark, d):
    li, o = load(spark, d, "lineitem"), load(spark, d, "orders").select("o_orderkey", "o_orderdate")
    dec = lambda c: F.col(c).cast("decimal(38,2)")
    total = (dec("l_quantity") + dec("l_discount")).cast("decimal(38,2)")
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
        (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("line"), F.when(F.col("l_linenumber") != 7, dec("l_quantity")).alias("quantity"), dec("l_tax").alias("tax"),
        F.when(~F.col("l_linenumber").isin(6, 7), total).alias("total"), F.col("l_shipdate").cast("date").alias("shipped"), F.col("o_orderdate").cast("date").alias("ordered"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"),
    )


_SUM = {"id": "s", "kind": "sum_equals", "sources": ["quantity", "tax"], "target": "total", "tolerance": "0.02"}
_CMP = {"id": "m", "kind": "compare", "left": "ordered", "op": "<", "right": "shipped"}
_TUP = {"id": "t", "kind": "fixed_combination", "columns": ["flag", "status"], "allowed_tuples": [["A", "F"], ["N", "O"], ["R", "F"]]}


@query(f"SELECT line FROM ({_L}) WHERE CASE WHEN quantity IS NULL THEN total IS NOT NULL ELSE NOT coalesce(abs(total - (quantity + tax)) <= 0.02, false) END")
def rule_sum_equals(spark, d):
    return _violating(spark, d, _SUM, lines(spark, d), LINES).select("line")


@query(f"SELECT line FROM ({_L}) WHERE NOT coalesce(ordered < shipped, false)")
def rule_compare(spark, d):
    return _violating(spark, d, _CMP, lines(spark, d), LINES).select("line")


@query(f"SELECT line FROM ({_L}) WHERE NOT ((flag = 'A' AND status = 'F') OR (flag = 'N' AND status = 'O') OR (flag = 'R' AND status = 'F'))")
def rule_fixed_combination(spark, d):
    return _violating(spark, d, _TUP, lines(spark, d), LINES).select("line")


@query(f"WITH t AS ({_T}), v AS ({_V}) SELECT o_orderkey, prio FROM v WHERE {_N} = 0")
def rule_drop_union_filter(spark, d):
    return rules.kept(orders(spark, d), compile_rules(SPECS, ORDERS)).select("o_orderkey", "prio")


@query(f"WITH t AS ({_T}) SELECT 'a_prio' AS rule_id, count(*) AS denominator FROM t UNION ALL SELECT 'b_status', count(o_orderstatus) FROM t UNION ALL SELECT 'c_price', count(o_totalprice) FROM t UNION ALL SELECT 'd_date', count(o_orderdate) FROM t UNION ALL SELECT 'e_cond', count(*) FILTER (WHERE o_orderstatus = 'P') FROM t")
def rule_denominators(spark, d):
    return rules.denominators(orders(spark, d), compile_rules(SPECS, ORDERS))


PARTS = (ColumnSchema("p_partkey", "integer"), ColumnSchema("p_brand", "categorical", nullable=True), ColumnSchema("p_type", "categorical"), ColumnSchema("p_size", "integer"))
_P = "SELECT p_partkey, nullif(p_brand, 'Brand#2') AS p_brand, p_type, CAST(p_size AS BIGINT) AS p_size FROM part"
_INFER = [{"id": "bt", "kind": "fixed_combination", "columns": ["p_brand", "p_type"], "provenance": "private_inferred"}, {"id": "sz", "kind": "range", "column": "p_size", "min": 1, "max": 25, "source_action": "drop_row"}]
_DOM = f"SELECT row_number() OVER (ORDER BY '[' || coalesce('\"' || p_brand || '\"', 'null') || ',\"' || p_type || '\"]') - 1 AS code, p_brand, p_type FROM (SELECT DISTINCT p_brand, p_type FROM ({_P}) WHERE p_size BETWEEN 1 AND 25)"


def parts(spark, d):
    return load(spark, d, "part").select("p_partkey", F.nullif(F.col("p_brand"), F.lit("Brand#2")).alias("p_brand"), "p_type", F.col("p_size").cast("long").alias("p_size"))


@query(_DOM)
def rule_infer_tuple_domain(spark, d):
    c = compile_rules(_INFER, PARTS)
    return rules.domain_of(parts(spark, d), c.rule("bt"), c)


@query(f"SELECT p.p_partkey, p.p_size, k.code FROM ({_P}) p LEFT JOIN ({_DOM}) k ON p.p_brand IS NOT DISTINCT FROM k.p_brand AND p.p_type = k.p_type")
def rule_encode_tuple(spark, d):
    c = compile_rules(_INFER, PARTS)
    return rules.model_view(parts(spark, d), c).withColumnRenamed(c.latent(c.rule("bt")), "code")


@query(f"SELECT p_partkey, p_brand, p_type, p_size FROM ({_P}) WHERE p_size BETWEEN 1 AND 25")
def rule_reconstruct_tuple(spark, d):
    c = compile_rules(_INFER, PARTS)
    own = rules.kept(parts(spark, d), c)
    domains = {"bt": rules.domain_of(own, c.rule("bt"), c)}
    return rules.rebuilt(rules.model_view(own, c, domains), c, domains).select("p_partkey", "p_brand", "p_type", "p_size")


@query(f"SELECT line, CASE WHEN date_diff('day', ordered, shipped) - 1 >= 0 THEN date_diff('day', ordered, shipped) - 1 END AS delta FROM ({_L})")
def rule_encode_delta(spark, d):
    c = compile_rules([_CMP], LINES)
    return lines(spark, d).select("line", rules.delta(c.rules[0], c).alias("delta"))


@query(f"SELECT line, date_diff('day', DATE '1970-01-01', shipped) AS shipped FROM ({_L}) WHERE ordered < shipped")
def rule_reconstruct_compare(spark, d):
    c = compile_rules([_CMP], LINES)
    view = rules.model_view(lines(spark, d).where("ordered < shipped"), c)
    return rules.rebuilt(view, c).select("line", F.unix_date("shipped").cast("long").alias("shipped"))


@query(f"SELECT line, CAST((quantity + tax) * 100 AS BIGINT) AS total FROM ({_L})")
def rule_reconstruct_sum(spark, d):
    c = compile_rules([_SUM], LINES)
    return rules.rebuilt(rules.model_view(lines(spark, d), c), c).select("line", (F.col("total") * 100).cast("long").alias("total"))


@query(f"SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN '2-HIGH' ELSE prio END AS prio FROM ({_T})")
def rule_reconstruct_conditional(spark, d):
    c = compile_rules([SPECS[4]], ORDERS)
    return rules.rebuilt(rules.model_view(orders(spark, d), c), c).select("o_orderkey", "prio")


@query(f"WITH t AS (SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice, o_orderdate, prio FROM ({_T})), v AS ({_V}) SELECT CAST({_N} + CAST(e AS INT) + CAST(o_totalprice IS NULL AS INT) AS BIGINT) AS n, count(*) AS n_rows FROM v GROUP BY 1")
def rule_validate_union(spark, d):
    bad = orders(spark, d).withColumn("o_totalprice", F.when(F.col("o_orderkey") % 11 != 0, F.col("o_totalprice")))
    return rules.validated(bad, compile_rules(SPECS, ORDERS)).groupBy(F.col("__violations").cast("long").alias("n")).agg(F.count(F.lit(1)).alias("n_rows"))


@query("SELECT c_custkey, CASE WHEN length(c_name) <= 10 THEN c_name ELSE substr(c_name, 1, 10) || repeat('*', length(c_name) - 10) END AS c_name FROM customer")
def rule_mask_prefix(spark, d):
    schema = (ColumnSchema("c_custkey", "integer"), ColumnSchema("c_name", "text"))
    c = compile_rules([{"id": "m", "kind": "mask_prefix", "column": "c_name", "keep_chars": 10}], schema)
    return rules.model_view(load(spark, d, "customer").select("c_custkey", "c_name"), c)


@query("SELECT o_orderkey, CAST(o_orderkey + 1 AS VARCHAR) AS ident FROM orders")
def identifiers_sequential(spark, d):
    c = ColumnSchema("ident", "identifier", role="identifier", identifier_strategy="sequential")
    return load(spark, d, "orders").select("o_orderkey", rules.identifier(c, F.col("o_orderkey")).alias("ident"))


@query("SELECT o_orderkey, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-4' || substr(h, 14, 3) || '-' || substr('89ab', CAST(('0x' || substr(h, 17, 1))::INT % 4 + 1 AS INT), 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS ident FROM (SELECT o_orderkey, sha256('tabforge:' || o_orderkey) AS h FROM orders)")
def identifiers_uuid4(spark, d):
    c = ColumnSchema("ident", "identifier", role="identifier", identifier_strategy="uuid4")
    return load(spark, d, "orders").select("o_orderkey", rules.identifier(c, F.col("o_orderkey")).alias("ident"))


_FIRST = [SPECS[1], SPECS[2]]


@query(f"SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS accepted_id FROM ({_T}) WHERE o_orderstatus IN ('F', 'O') AND o_totalprice BETWEEN 0 AND 450000 ORDER BY o_orderkey LIMIT 500")
def reject_accept_first_n(spark, d):
    schema = (*ORDERS[:4], ColumnSchema("prio", "categorical", nullable=True))
    checked = rules.validated(orders(spark, d).withColumn(CANDIDATE_INDEX, F.col("o_orderkey")), compile_rules(_FIRST, schema))
    return rules.accepted(checked, CANDIDATE_INDEX, 500).select("o_orderkey", "accepted_id")


@query("SELECT 'RULE_FEASIBILITY_EXHAUSTED' AS code, CAST(40 AS BIGINT) AS examined, CAST(0 AS BIGINT) AS accepted")
def reject_budget_exhausted(spark, d):
    from tabforge.operators.synth import Cyclic
    from tabforge.plans.pipeline import generate_exactly
    from tabforge.schema import EngineError

    schema = (ColumnSchema("n_nationkey", "integer"),)
    never = compile_rules([{"id": "r", "kind": "range", "column": "n_nationkey", "min": 1000, "max": 2000}], schema)
    model = Cyclic.fit(load(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("n_nationkey")), ["n_nationkey"], 3)
    try:
        generate_exactly(model, never, 2, 25)
    except EngineError as e:
        return spark.createDataFrame([(e.code, e.details["examined"], e.details["accepted"])], "code string, examined long, accepted long")
    raise AssertionError("rows were accepted")


_SAMPLE = """(1,1,NULL,NULL,NULL,NULL),(2,3,3,1,2,NULL),(3,9,5,2,2,4),(4,6,4,2,2,2),(5,7,4,2,2,2),(6,NULL,4,2,2,2),(7,2,2,1,1,NULL),(8,8,6,3,3,2),(9,5,NULL,1,1,3),(10,4,2,1,1,2)"""


@query(f"WITH t(id, all_total, regular, male, female, temp) AS (VALUES {_SAMPLE}), v AS (SELECT *, CASE WHEN male IS NULL OR female IS NULL THEN regular IS NOT NULL ELSE coalesce(regular <> male + female, true) END AS r, CASE WHEN regular IS NULL OR temp IS NULL THEN all_total IS NOT NULL ELSE coalesce(all_total <> regular + temp, true) END AS a FROM t) SELECT 'employee_sum' AS rule_id, count(*) FILTER (WHERE r) AS violations FROM v UNION ALL SELECT 'overall_sum', count(*) FILTER (WHERE a) FROM v UNION ALL SELECT '__drop_union', count(*) FILTER (WHERE r OR a) FROM v UNION ALL SELECT '__drop_overlap', count(*) FILTER (WHERE r AND a) FROM v UNION ALL SELECT '__retained', count(*) FILTER (WHERE NOT r AND NOT a) FROM v")
def sample_gate_audit(spark, d):
    names = ("id", "all_total", "regular", "male", "female", "temp")
    rows = [tuple(None if v == "NULL" else int(v) for v in r.split(",")) for r in _SAMPLE.strip("()").split("),(")]
    df = spark.createDataFrame(rows, ", ".join(f"{n} long" for n in names))
    schema = [ColumnSchema(n, "integer", nullable=n != "id") for n in names]
    specs = [{"id": "employee_sum", "kind": "sum_equals", "sources": ["male", "female"], "target": "regular", "source_action": "drop_row"}, {"id": "overall_sum", "kind": "sum_equals", "sources": ["regular", "temp"], "target": "all_total", "source_action": "drop_row"}]
    return rules.audit(df, compile_rules(specs, schema)).where("rule_id in ('employee_sum', 'overall_sum', '__drop_union', '__drop_overlap', '__retained')")


@query("SELECT 2500 * i AS start, 2500 * (i + 1) AS stop, CAST(('0x' || substr(sha256(encode('public seed') || unhex(lpad(to_hex(i), 16, '0')) || unhex('0000000000000000')), 1, 8)) AS BIGINT) AS seed FROM (SELECT unnest(range(8)) AS i)")
def shard_plan(spark, d):
    from tabforge.operators.synth import shards

    return spark.createDataFrame(shards(1000, 8, b"public seed"), "start long, stop long, seed long")

