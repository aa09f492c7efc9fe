"""Queries of digests, exports, reports, the generated fixture and strict CSV records."""

from __future__ import annotations


from pyspark.sql import functions as F

from tabforge.operators import export, rules
from tabforge.plans.report import release
from tabforge.plans.rules import compile_rules
from tabforge.queries import load, query
from tabforge.schema import ColumnSchema
from tabforge.sources.tables import scale_fixture, scale_rules, scale_schema, shared_folder

NATION = (ColumnSchema("n_nationkey", "integer"), ColumnSchema("n_name", "categorical"), ColumnSchema("n_regionkey", "integer"))


def nation(spark, d):
    return load(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name", F.col("n_regionkey").cast("long").alias("n_regionkey"))


def _cell(x: str) -> str:
    """Framed bytes, as hex, of a text with its tag; lengths below 256."""
    return f"(printf('%02x', 1 + strlen({x})) || '00000000000000' || '01' || lower(hex(encode({x}))))"


@query(f"SELECT n_nationkey, sha256(unhex({_cell('CAST(n_nationkey AS VARCHAR)')} || {_cell(chr(39) + 's' + chr(39) + ' || n_name')} || {_cell('CAST(n_regionkey AS VARCHAR)')})) AS digest FROM (SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, n_regionkey FROM nation)")
def canonical_row_digest(spark, d):
    return export.row_digests(nation(spark, d), NATION, "n_nationkey", normal=False)


_NATION_BYTES = f"{_cell('CAST(n_nationkey AS VARCHAR)')} || {_cell(chr(39) + 's' + chr(39) + ' || n_name')} || {_cell('CAST(n_regionkey AS VARCHAR)')}"


@query(f"SELECT sha256(unhex(string_agg({_NATION_BYTES}, '' ORDER BY n_nationkey))) AS digest FROM (SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, n_regionkey FROM nation)")
def canonical_table_digest(spark, d):
    return spark.createDataFrame([(export.content_sha256(nation(spark, d), NATION, ["n_nationkey"]),)], "digest string")


ORDERS = (ColumnSchema("o_orderkey", "integer"), ColumnSchema("o_orderstatus", "categorical"), ColumnSchema("o_totalprice", "float"), ColumnSchema("o_orderdate", "date"), ColumnSchema("prio", "text", nullable=True))


@query()
def canonical_tree_digest(spark, d):
    from tabforge.queries.rule_queries import orders

    return export.content_tree(orders(spark, d), ORDERS, "o_orderkey")


@query("SELECT count(*) AS n, count(*) AS n_csv, true AS equal FROM orders")
def csv_parquet_equivalence(spark, d):
    from tabforge.queries.rule_queries import orders

    df = orders(spark, d)
    folder = f"{shared_folder(spark)}/csv-{export.uuid.uuid4().hex}"
    return export.equivalent(df, folder, export.write_csv(df, folder, ORDERS), ORDERS)


_FIXTURE = """SELECT i AS record_id, printf('cat_%02d', ((i + 3) % 17)::INTEGER) AS category_03, CASE WHEN i % 2 = 0 THEN (i * 17) % 10000 ELSE 0 END AS integer_00, (i * 7 + 4) % 100000 AS integer_04, round(((i + 2) % 10000)::DOUBLE / 5, 6) AS float_02, (i + 1) % 2 = 0 AS boolean_01,
18262 + (i + 3) % 2191 AS date_03, (1577836800 + (i * 37 + 2) % 31536000) * 1000000 AS datetime_02, printf('txt%02d_%08d', 7, (i % 100000000)::INTEGER) AS text_07, i % 101 + (i * 3) % 97 AS employee_total, CASE WHEN i % 2 = 0 THEN 'active' ELSE 'inactive' END AS status FROM (SELECT unnest(range(10000)) AS i)"""


@query(_FIXTURE)
def scale_fixture_rows(spark, d):
    names = ["record_id", "category_03", "integer_00", "integer_04", "float_02", "boolean_01", "date_03", "datetime_02", "text_07", "employee_total", "status"]
    return scale_fixture(spark, 10_000, names).withColumns({"date_03": F.unix_date("date_03").cast("long"), "datetime_02": F.unix_micros("datetime_02")})


@query("SELECT unnest(['conditional_set', 'employee_sum', 'fixed_combination', 'integer_range', 'record_not_null', 'status_allowed']) AS rule_id, CAST(0 AS BIGINT) AS violations")
def scale_fixture_rule_counts(spark, d):
    return rules.audit(scale_fixture(spark, 10_000), compile_rules(scale_rules(), scale_schema())).where("rule_id not like '!_!_%' escape '!'")


@query("SELECT record_id, substr(text_00, 1, 3) || repeat('*', length(text_00) - 3) AS text_00 FROM (SELECT i AS record_id, printf('txt%02d_%08d', 0, (i % 100000000)::INTEGER) AS text_00 FROM (SELECT unnest(range(10000)) AS i))")
def scale_mask_projection(spark, d):
    return scale_fixture(spark, 10_000, ["record_id", "text_00"]).select("record_id", rules.masked(F.col("text_00"), 3).alias("text_00"))


@query("SELECT unnest(['actual_rows', 'epsilon']) AS field")
def release_allowlist_projection(spark, d):
    out = release({"epsilon": "3", "fit_seed": 7}, {"actual_rows": 10, "timing": 1.0})
    return spark.createDataFrame([(k,) for part in out.values() for k in part], "field string")


_CSV = 'a,b\n1,2\n3"oops,4\n5\n"x\ny",7\r\n"8"z,9\n'


@query("SELECT * FROM (VALUES (CAST(0 AS BIGINT), '1|2', NULL), (1, NULL, 'quote_in_unquoted_field'), (2, NULL, 'column_count_mismatch'), (3, 'x' || chr(10) || 'y|7', NULL), (4, NULL, 'characters_after_closing_quote')) AS t(row_id, fields, reason)")
def strict_csv_records(spark, d):
    from tabforge.sources.csv import Dialect, parse

    rows = [(i, None if f is None else "|".join(f), r) for i, f, r in parse(_CSV.encode(), Dialect(), 2)]
    return spark.createDataFrame(rows, "row_id long, fields string, reason string")


_EVENTS = "SELECT coalesce(event_type NOT IN ('click', 'view'), true) AS a, coalesce(NOT (value BETWEEN 0 AND 50), true) AS b FROM events"
_COUNTS = (("type", "a"), ("value", "b"), ("__source", "true"), ("__union", "a OR b"), ("__overlap", "a AND b"), ("__block_union", "a OR b"), ("__block_overlap", "a AND b"), ("__drop_union", "false"), ("__drop_overlap", "false"), ("__retained", "true"))


@query(" UNION ALL ".join(f"SELECT '{n}' AS rule_id, count(*) FILTER (WHERE {p}) AS violations FROM ({_EVENTS})" for n, p in _COUNTS))
def streaming_audit(spark, d):
    """An audit of events as a stream of files, summed over its micro-batches."""
    from tabforge.streaming.audit import audited_stream, totals

    schema = (ColumnSchema("event_id", "integer"), ColumnSchema("event_type", "categorical"), ColumnSchema("value", "float"))
    compiled = compile_rules([{"id": "type", "kind": "allowed_values", "column": "event_type", "values": ["click", "view"]}, {"id": "value", "kind": "range", "column": "value", "min": 0, "max": 50}], schema)
    folder = f"{shared_folder(spark)}/stream-{export.uuid.uuid4().hex}"
    events = load(spark, d, "events")
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(d)
    audited_stream(stream, compiled, f"{folder}/out", f"{folder}/state").awaitTermination()
    return totals(spark, f"{folder}/out")
