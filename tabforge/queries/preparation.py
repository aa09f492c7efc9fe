"""Queries of profiling, normalisation and keyed samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabforge.functions.keyed import hmac_hex, pads
from tabforge.operators import normalize, profile, sampling
from tabforge.queries import KEY, hmac_sql, hmac_text_sql, load, priority_sql, query, train_sql
from tabforge.schema import ROW_ID, ColumnSchema

SAMPLE_DOMAIN = b"tabforge/sample/v1\0"

_ORDER_TEXT = "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderstatus, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS o_orderdate, nullif(o_orderpriority, '4-NOT SPECIFIED') AS prio FROM orders"


def _order_text(spark, d):
    return load(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("o_orderkey"), "o_orderstatus", F.col("o_orderdate").cast("date").cast("string").alias("o_orderdate"), F.nullif(F.col("o_orderpriority"), F.lit("4-NOT SPECIFIED")).alias("prio"))


_COLUMNS = ("o_orderkey", "o_orderstatus", "o_orderdate", "prio")


@query(f"WITH t AS ({_ORDER_TEXT}) " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS n, count(*) - count({c}) AS n_null, min(length({c})) AS min_length, max(length({c})) AS max_length, min({c}) AS min_text, max({c}) AS max_text FROM t" for c in _COLUMNS))
def profile_orders_aggregates(spark, d):
    return profile.aggregates(_order_text(spark, d)).drop("n_distinct_approx")


_DATE = r"regexp_full_match(trim(v), '[0-9]{4}-[0-9]{2}-[0-9]{2}') AND try_cast(trim(v) AS DATE) IS NOT NULL"
_INT = r"regexp_full_match(trim(v), '[+-]?[0-9]+') AND try_cast(trim(v) AS BIGINT) IS NOT NULL"
_FLOAT = r"regexp_full_match(trim(v), '[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?') AND isfinite(try_cast(trim(v) AS DOUBLE))"
_BOOL = "lower(trim(v)) IN ('true', 'false')"
_TIME = r"regexp_full_match(trim(v), '[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}.*') AND try_cast(trim(v) AS TIMESTAMP) IS NOT NULL"
_COUNTS = f"""count(v) AS n_value, count(*) FILTER (WHERE {_INT}) AS "integer", count(*) FILTER (WHERE {_FLOAT}) AS "float", count(*) FILTER (WHERE {_BOOL}) AS "boolean", count(*) FILTER (WHERE {_DATE}) AS "date", count(*) FILTER (WHERE {_TIME}) AS "datetime" """


@query(f"WITH t AS ({_ORDER_TEXT}) " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {_COUNTS} FROM (SELECT {c} AS v FROM t)" for c in _COLUMNS))
def profile_parse_success(spark, d):
    return profile.parse_counts(_order_text(spark, d), _COLUMNS)


@query("""WITH l AS (SELECT 'o_orderstatus' AS "column", o_orderstatus AS value FROM orders UNION ALL SELECT 'o_orderpriority', o_orderpriority FROM orders UNION ALL SELECT 'o_custkey', CAST(o_custkey AS VARCHAR) FROM orders),
c AS (SELECT "column", value, count(*) AS n FROM l GROUP BY ALL), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS INTEGER) AS rank, count(*) OVER (PARTITION BY "column") AS k FROM c)
SELECT "column", value, n, rank FROM r WHERE k <= 256""")
def profile_low_cardinality(spark, d):
    return profile.frequencies(load(spark, d, "orders"), ["o_orderstatus", "o_orderpriority", "o_custkey"])


@query("""SELECT 'c_mktsegment' AS "column", count(DISTINCT c_mktsegment) AS n_distinct FROM customer UNION ALL SELECT 'c_nationkey', count(DISTINCT c_nationkey) FROM customer""")
def profile_exact_distinct(spark, d):
    return profile.frequencies(load(spark, d, "customer"), ["c_mktsegment", "c_nationkey"]).groupBy("column").agg(F.count(F.lit(1)).alias("n_distinct"))


@query()
def profile_approx_distinct(spark, d):
    return profile.aggregates(load(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_shipdate")).select("column", "n_distinct_approx")


_QUARTILES = ", ".join(f"round(quantile_cont(v, {p}), 6) AS q{round(p * 100):02d}" for p in (0.25, 0.5, 0.75))


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", {_QUARTILES} FROM (SELECT {c} AS v FROM lineitem)" for c in ("l_quantity", "l_extendedprice", "l_tax")))
def profile_quantiles_exact(spark, d):
    out = profile.quantiles(load(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_tax"], exact=True)
    return out.select("column", *(F.round(c, 6).alias(c) for c in out.columns[1:]))


@query()
def profile_quantiles_approx(spark, d):
    return profile.quantiles(load(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_tax"])


@query(f"""WITH t AS ({_ORDER_TEXT}), c AS ({" UNION ALL ".join(f"SELECT '{c}' AS col, count(DISTINCT v) AS k, {_COUNTS} FROM (SELECT {c} AS v FROM t)" for c in _COLUMNS)}),
p AS (SELECT *, n_value > 0 AND "integer" = n_value AS digits, CASE WHEN n_value = 0 THEN 'text' WHEN "integer" = n_value THEN 'categorical' WHEN "boolean" = n_value THEN 'boolean' WHEN "date" = n_value THEN 'date' WHEN "datetime" = n_value THEN 'datetime'
 WHEN "float" = n_value THEN 'float' WHEN n_value > 1 AND k >= 0.98 * n_value THEN 'identifier' WHEN k <= 256 THEN 'categorical' ELSE 'text' END AS kind FROM c)
SELECT col AS "column", kind, digits OR kind = 'identifier' AS needs_confirmation, CASE WHEN digits THEN 'integer,identifier' WHEN kind = 'identifier' THEN 'text' ELSE '' END AS alternatives FROM p""")
def profile_candidate_kind(spark, d):
    return profile.proposed_kinds(_order_text(spark, d), _COLUMNS)


@query("""SELECT 'c_name' AS "column", CASE WHEN min(length(c_name)) = max(length(c_name)) THEN max(length(c_name)) END AS fixed_length FROM customer UNION ALL
SELECT 'c_mktsegment', CASE WHEN min(length(c_mktsegment)) = max(length(c_mktsegment)) THEN max(length(c_mktsegment)) END FROM customer""")
def profile_fixed_length(spark, d):
    return profile.fixed_length(load(spark, d, "customer"), ["c_name", "c_mktsegment"])


def _casts(spark, d, column: ColumnSchema, text):
    df = load(spark, d, "events").select("event_id", text.alias("raw"))
    return df.select("event_id", normalize.typed(F.col("raw"), column).alias("value"))


_PROP = "regexp_extract(props, '[0-9]+')"


@query(f"SELECT event_id, CASE WHEN regexp_full_match(trim(r), '[+-]?[0-9]+') THEN try_cast(trim(r) AS BIGINT) END AS value FROM (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN props ELSE ' ' || {_PROP} || ' ' END AS r FROM events)")
def normalize_integer(spark, d):
    text = F.when(F.col("event_id") % 5 == 0, F.col("props")).otherwise(F.concat(F.lit(" "), F.regexp_extract("props", "[0-9]+", 0), F.lit(" ")))
    return _casts(spark, d, ColumnSchema("raw", "integer"), text)


@query(f"SELECT event_id, CAST(CAST({_PROP} || '.' || lpad(CAST(event_id % 1000 AS VARCHAR), 3, '0') AS DECIMAL(38,2)) * 100 AS BIGINT) AS value FROM events")
def normalize_decimal(spark, d):
    text = F.concat(F.regexp_extract("props", "[0-9]+", 0), F.lit("."), F.lpad((F.col("event_id") % 1000).cast("string"), 3, "0"))
    return _casts(spark, d, ColumnSchema("raw", "fixed_decimal", decimal_places=2), text).select("event_id", (F.col("value") * 100).cast("long").alias("value"))


@query(f"SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN CAST({_PROP} || 'e-1' AS DOUBLE) END AS value FROM events")
def normalize_float(spark, d):
    text = F.when(F.col("event_id") % 7 == 0, F.lit("inf")).otherwise(F.concat(F.regexp_extract("props", "[0-9]+", 0), F.lit("e-1")))
    return _casts(spark, d, ColumnSchema("raw", "float"), text)


@query("SELECT event_id, CASE event_type WHEN 'click' THEN true WHEN 'error' THEN false END AS value FROM events")
def normalize_boolean(spark, d):
    text = F.when(F.col("event_type") == "click", " TRUE ").when(F.col("event_type") == "error", "False").otherwise(F.col("event_type"))
    return _casts(spark, d, ColumnSchema("raw", "boolean"), text)


@query("SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) END AS value FROM events")
def normalize_date(spark, d):
    day = F.col("ts").cast("date").cast("string")
    return _casts(spark, d, ColumnSchema("raw", "date"), F.when(F.col("event_id") % 3 == 0, F.substring(day, 1, 4)).otherwise(day)).select("event_id", F.unix_date("value").cast("long").alias("value"))


@query("SELECT event_id, epoch_us(ts) - 9 * 3600000000 AS value FROM events")
def normalize_datetime(spark, d):
    text = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return _casts(spark, d, ColumnSchema("raw", "datetime", timezone="Asia/Seoul"), text).select("event_id", F.unix_micros("value").alias("value"))


@query("""SELECT 'text' AS "column", count(*) FILTER (WHERE coalesce(text, '') = '') AS n_null, count(*) FILTER (WHERE coalesce(text, '') <> '' AND NOT (regexp_full_match(trim(text), '[+-]?[0-9]+') AND try_cast(trim(text) AS BIGINT) IS NOT NULL)) AS n_invalid, count(*) FILTER (WHERE regexp_full_match(trim(text), '[+-]?[0-9]+') AND try_cast(trim(text) AS BIGINT) IS NOT NULL) AS n_valid FROM documents""")
def normalize_invalid_counts(spark, d):
    return normalize.cast_report(load(spark, d, "documents").select("text"), [ColumnSchema("text", "integer")])


@query("SELECT count(*) AS n, count(*) FILTER (WHERE toxic IS NULL OR CAST(toxic AS VARCHAR) = '') AS n_null FROM documents LEFT JOIN labels USING (doc_id)")
def normalize_semantic_null(spark, d):
    from tabforge.functions.cells import is_null_text

    both = load(spark, d, "documents").select("doc_id").join(load(spark, d, "labels"), "doc_id", "left")
    return both.agg(F.count(F.lit(1)).alias("n"), F.count_if(is_null_text(F.col("toxic").cast("string"))).cast("long").alias("n_null"))


@query("SELECT count(*) AS n, min(o_orderkey) AS least, count(DISTINCT o_orderkey) AS n_distinct, count(*) = count(DISTINCT o_orderkey) AND min(o_orderkey) >= 0 AS ok FROM orders")
def row_id_sanity(spark, d):
    return profile.row_id_check(load(spark, d, "orders"), "o_orderkey")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS place FROM orders")
def ordered_row_number(spark, d):
    return normalize.numbered(load(spark, d, "orders"), ["o_totalprice", "o_orderkey"], "place").select("o_orderkey", "place")


def _orders(spark, d):
    return load(spark, d, "orders").withColumnRenamed("o_orderkey", ROW_ID)


@query(f"SELECT count(*) FILTER (WHERE {train_sql('o_orderkey')}) AS n_train, count(*) FILTER (WHERE NOT {train_sql('o_orderkey')}) AS n_holdout FROM orders")
def keyed_train_holdout_counts(spark, d):
    return sampling.counts(_orders(spark, d), KEY)


@query(f"SELECT o_orderkey FROM orders WHERE {train_sql('o_orderkey')}")
def keyed_train_rows(spark, d):
    return sampling.train(_orders(spark, d), KEY).select(F.col(ROW_ID).alias("o_orderkey"))


@query(f"SELECT o_orderkey, {priority_sql('o_orderkey')} AS priority FROM orders WHERE {train_sql('o_orderkey')} ORDER BY priority, o_orderkey LIMIT 777")
def keyed_priority_topk(spark, d):
    return sampling.priority_sample(_orders(spark, d), KEY, 777).select(F.col(ROW_ID).alias("o_orderkey"), "priority")


_STRATA = f"""WITH t AS (SELECT o_orderkey, o_orderstatus AS s, nullif(o_orderpriority, '4-NOT SPECIFIED') AS p, {priority_sql('o_orderkey')} AS pr FROM orders WHERE {train_sql('o_orderkey')}),
n AS (SELECT s, p, count(*) AS n FROM t GROUP BY ALL), tot AS (SELECT sum(n) AS pop, least(997, sum(n)) AS k FROM n),
f AS (SELECT s, p, n, (n * k) // pop AS fl, (n * k) % pop AS rest, to_json([CASE WHEN s IS NULL THEN ['null'] ELSE ['value', s] END, CASE WHEN p IS NULL THEN ['null'] ELSE ['value', p] END]) AS tag, k FROM n, tot),
q AS (SELECT s, p, n, CAST(fl + CASE WHEN row_number() OVER (ORDER BY rest DESC, tag) <= k - sum(fl) OVER () THEN 1 ELSE 0 END AS BIGINT) AS quota FROM f)"""


@query(f"{_STRATA} SELECT s AS o_orderstatus, p AS prio, n, quota FROM q")
def keyed_hamilton_quotas(spark, d):
    own = sampling.train(_orders(spark, d), KEY).withColumn("prio", F.nullif(F.col("o_orderpriority"), F.lit("4-NOT SPECIFIED")))
    return sampling.hamilton(own.groupBy("o_orderstatus", "prio").agg(F.count(F.lit(1)).alias("n")), ["o_orderstatus", "prio"], 997)


@query(f"{_STRATA} SELECT o_orderkey FROM (SELECT t.*, quota, row_number() OVER (PARTITION BY t.s, t.p ORDER BY pr, o_orderkey) AS r FROM t JOIN q ON t.s IS NOT DISTINCT FROM q.s AND t.p IS NOT DISTINCT FROM q.p) WHERE r <= quota")
def keyed_stratified_hamilton(spark, d):
    own = _orders(spark, d).withColumn("prio", F.nullif(F.col("o_orderpriority"), F.lit("4-NOT SPECIFIED")))
    return sampling.stratified_sample(own, KEY, 997, ["o_orderstatus", "prio"]).select(F.col(ROW_ID).alias("o_orderkey"))


_CI, _CO = pads(KEY)


@query(f"""SELECT c_custkey FROM (SELECT c_custkey, '{{"c_custkey":' || c_custkey || ',"c_mktsegment":"' || c_mktsegment || '","c_name":"' || c_name || '"}}' AS j FROM customer) WHERE sha256(unhex('{_CO}') || unhex(sha256(unhex('{_CI}') || encode(j)))) < '{format((1 << 256) // 4, "064x")}'""")
def keyed_content_predicate(spark, d):
    return sampling.content_selected(load(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment"), KEY, 0.25, ["c_custkey", "c_name", "c_mktsegment"]).select("c_custkey")


@query(f"SELECT event_id FROM events ORDER BY {hmac_text_sql('event_id', SAMPLE_DOMAIN)}, event_id LIMIT 500")
def eval_sample_smallest_hmac(spark, d):
    return sampling.smallest_hmac(load(spark, d, "events"), KEY, 500, "event_id").select("event_id")


@query(f"SELECT o_orderkey, {hmac_sql('o_orderkey', b'tabforge/demo/v1' + bytes(1))} AS h FROM orders")
def keyed_hash_rows(spark, d):
    from tabforge.functions.keyed import big_endian

    return load(spark, d, "orders").select("o_orderkey", hmac_hex(big_endian(F.col("o_orderkey")), KEY, b"tabforge/demo/v1\0").alias("h"))


@query()
def hash_ordered_sample(spark, d):
    return load(spark, d, "events").select("event_id").orderBy(F.xxhash64("event_id", F.lit(761)), "event_id").limit(200)
