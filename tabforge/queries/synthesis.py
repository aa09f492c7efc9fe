"""Queries of synthesizers, codebooks, marginals and privacy accounting."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import functions as F

from tabforge.functions.keyed import pads
from tabforge.operators import candidates
from tabforge.operators.synth import Conditional, Cyclic
from tabforge.plans.estimates import disk
from tabforge.plans.pipeline import run
from tabforge.plans.rules import compile_rules
from tabforge.privacy import accounting, mst
from tabforge.privacy.codebook import Codebook, capacity
from tabforge.queries import KEY, hmac_sql, load, query
from tabforge.queries.rule_queries import orders
from tabforge.schema import CANDIDATE_INDEX, ROW_ID, ColumnSchema

SEED = 12_345


def content_sql(table: str) -> str:
    inner, outer = pads(KEY)
    text = """'c_custkey' || chr(30) || '["int","' || c_custkey || '"]' || chr(31) || 'c_mktsegment' || chr(30) || '["str","' || c_mktsegment || '"]'"""
    return f"sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode({text}))))"


def nested_sql(id_: str) -> str:
    return f"substr({hmac_sql(id_, candidates.NESTED_DOMAIN)}, 1, 16) < '{format((1 << 64) * 9 // 10, '016x')}'"


@query(f"WITH r AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (ORDER BY o_orderkey) - 1 AS place, count(*) OVER () AS n FROM orders), i AS (SELECT unnest(range(20000)) AS i) SELECT i AS candidate, o_orderkey, o_orderstatus FROM i JOIN r ON place = ({SEED} % n + i) % n")
def cyclic_generate(spark, d):
    model = Cyclic.fit(load(spark, d, "orders").select("o_orderkey", "o_orderstatus"), ["o_orderkey"], SEED)
    return model.generate(0, 20_000).select(F.col(CANDIDATE_INDEX).alias("candidate"), "o_orderkey", "o_orderstatus")


_OWN = (ColumnSchema("o_orderstatus", "categorical"), ColumnSchema("prio", "categorical", nullable=True), ColumnSchema("o_totalprice", "float"))


@query()
def conditional_generate(spark, d):
    model = Conditional.fit(orders(spark, d).select("o_orderstatus", "prio", "o_totalprice"), _OWN, SEED)
    return model.generate(0, 5_000)


@query()
def pipeline_orders(spark, d):
    """The whole run over orders: exactly 1,000 rows, then their distances."""
    schema = (ColumnSchema("o_orderstatus", "categorical"), ColumnSchema("prio", "categorical", nullable=True), ColumnSchema("o_totalprice", "float"))
    specs = [{"id": "price", "kind": "range", "column": "o_totalprice", "min": 0, "max": 450000, "source_action": "drop_row"}]
    df = orders(spark, d).withColumnRenamed("o_orderkey", ROW_ID).select(ROW_ID, "o_orderstatus", "prio", "o_totalprice")
    found = run(df, compile_rules(specs, schema), lambda view: Cyclic.fit(view, [ROW_ID], SEED), KEY, 1_000, batch=2_000)
    return found.distances


BOOK = Codebook.of([
    ColumnSchema("c_mktsegment", "categorical", nullable=True, public_categories=("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")),
    ColumnSchema("c_nationkey", "integer", public_bins=(0, 5, 10, 15, 25)),
    ColumnSchema("c_acctbal", "float", public_bins=(-2000, 0, 2500, 5000, 10000)),
])


def customers(spark, d):
    return load(spark, d, "customer").select("c_custkey", F.nullif(F.col("c_mktsegment"), F.lit("FURNITURE")).alias("c_mktsegment"), F.col("c_nationkey").cast("long").alias("c_nationkey"), "c_acctbal")


_CODES = """SELECT c_custkey, CAST(CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 0 WHEN 'BUILDING' THEN 1 WHEN 'HOUSEHOLD' THEN 3 WHEN 'MACHINERY' THEN 4 ELSE 5 END AS BIGINT) AS c_mktsegment,
CAST(CASE WHEN c_nationkey < 5 THEN 0 WHEN c_nationkey < 10 THEN 1 WHEN c_nationkey < 15 THEN 2 ELSE 3 END AS BIGINT) AS c_nationkey, CAST(CASE WHEN c_acctbal < 0 THEN 0 WHEN c_acctbal < 2500 THEN 1 WHEN c_acctbal < 5000 THEN 2 ELSE 3 END AS BIGINT) AS c_acctbal FROM customer"""


@query(_CODES)
def codebook_encode(spark, d):
    c = customers(spark, d)
    return c.select("c_custkey", *(BOOK.code(x).cast("long").alias(x.name) for x in BOOK.columns))


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c} AS state, count(*) AS n FROM ({_CODES}) GROUP BY 2" for c in ("c_mktsegment", "c_nationkey", "c_acctbal")))
def codebook_state_counts(spark, d):
    return BOOK.state_counts(customers(spark, d)).select("column", F.col("state").cast("long").alias("state"), "n")


@query("SELECT count(*) AS n, count(*) AS n_in_domain FROM customer")
def codebook_decode_in_domain(spark, d):
    """Decoded values lie in the bins and categories that they come from."""
    c = customers(spark, d)
    codes = c.select("c_custkey", *(BOOK.code(x).alias(x.name) for x in BOOK.columns))
    back = BOOK.decode(codes, "c_custkey")
    again = back.select("c_custkey", *(BOOK.code(x).alias(f"{x.name}_2") for x in BOOK.columns))
    same = F.lit(True)
    for x in BOOK.columns:
        same = same & F.col(x.name).eqNullSafe(F.col(f"{x.name}_2"))
    return codes.join(again, "c_custkey").agg(F.count(F.lit(1)).alias("n"), F.count_if(same).cast("long").alias("n_in_domain"))


@query("WITH s(c, n) AS (VALUES ('a', 6), ('b', 4), ('c', 4)), p AS (SELECT x.n * y.n AS cells FROM s x JOIN s y ON x.c < y.c ORDER BY 1 DESC) SELECT (SELECT count(*) FROM s) AS columns, CAST((SELECT max(cells) FROM p) AS BIGINT) AS largest_pair, CAST(8 * ((SELECT sum(n) FROM s) + (SELECT sum(cells) FROM (SELECT cells FROM p LIMIT 2))) * 8 AS BIGINT) AS bytes, true AS admitted")
def mst_capacity(spark, d):
    return spark.createDataFrame([capacity(BOOK.domain())], "columns long, largest_pair long, bytes long, admitted boolean")


@query(f"SELECT c_mktsegment, c_nationkey, count(*) AS n FROM ({_CODES}) GROUP BY ALL")
def dp_marginals_exact(spark, d):
    """Curator only: the two-way marginal before noise."""
    return BOOK.encode(customers(spark, d)).groupBy(F.col("c_mktsegment").cast("long").alias("c_mktsegment"), F.col("c_nationkey").cast("long").alias("c_nationkey")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CAST(0.18506984065 AS DOUBLE) AS rho, round(sqrt(3 / (2 * CAST(0.18506984065340149 AS DOUBLE))), 9) AS sigma")
def dp_accounting_vector(spark, d):
    rho = accounting.rho_of(3, 1e-6)
    return spark.createDataFrame([(round(rho, 11), round(accounting.sigma_of(rho), 9))], "rho double, sigma double")


@query()
def mst_synthesize(spark, d):
    return mst.synthesize(customers(spark, d).drop("c_custkey"), BOOK, 3.0, 1e-6, 2_000, SEED)


@query("""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN CAST(floor(value) AS BIGINT) WHEN value = floor(value) THEN CAST(value AS BIGINT) END AS n, CASE event_type WHEN 'click' THEN true WHEN 'error' THEN false END AS flag,
CAST(round_even(CAST(value AS DECIMAL(18,6)), 1) * 10 AS BIGINT) AS tenths, (event_id % 4 <> 0 AND value <> floor(value)) OR event_type NOT IN ('click', 'error') AS invalid FROM events""")
def candidate_types(spark, d):
    """Values of a generator in declared types, with rows that do not fit marked."""
    schema = (ColumnSchema("event_id", "integer"), ColumnSchema("n", "integer"), ColumnSchema("flag", "boolean"), ColumnSchema("tenths", "fixed_decimal", decimal_places=1))
    raw = load(spark, d, "events").select("event_id", F.when(F.col("event_id") % 4 == 0, F.floor("value").cast("double")).otherwise(F.col("value")).alias("n"), F.when(F.col("event_type") == "click", " TRUE").when(F.col("event_type") == "error", "false").otherwise(F.col("event_type")).alias("flag"), F.col("value").cast("decimal(18,6)").alias("tenths"))
    return candidates.typed_candidates(raw, schema).select("event_id", "n", "flag", (F.col("tenths") * 10).cast("long").alias("tenths"), F.col("__invalid").alias("invalid"))


@query("""SELECT CASE WHEN o_orderpriority = '5-LOW' THEN '["missing"]' ELSE '["str","' || o_orderpriority || '"]' END AS token, count(*) AS n FROM orders GROUP BY 1 UNION ALL SELECT '["int","' || o_custkey || '"]', count(*) FROM orders GROUP BY 1""")
def category_tokens(spark, d):
    o = load(spark, d, "orders").withColumn("p", F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")))
    token = lambda c: candidates.category_token(F.col(c), o.schema[c].dataType).alias("token")
    return o.select(token("p")).union(o.select(token("o_custkey"))).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT c_custkey FROM (SELECT c_custkey, {content_sql('customer')} AS h FROM customer) ORDER BY h LIMIT 100")
def content_priority_sample(spark, d):
    return candidates.content_priority_sample(load(spark, d, "customer").select("c_custkey", "c_mktsegment"), KEY, 100, ["c_custkey", "c_mktsegment"]).select("c_custkey")


@query(f"SELECT count(*) FILTER (WHERE {nested_sql('o_orderkey')}) AS n_fit, count(*) AS n FROM orders")
def nested_fit_split(spark, d):
    return candidates.nested_split(load(spark, d, "orders"), KEY, "o_orderkey").agg(F.count_if("for_fit").cast("long").alias("n_fit"), F.count(F.lit(1)).alias("n"))


@query("SELECT i AS process, 200 * i AS start, 200 * (i + 1) AS stop FROM (SELECT unnest(range(5)) AS i)")
def generation_plan(spark, d):
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(candidates.generation_plan(50, 5))], "process long, start long, stop long")


_RUNS = [("r1", "released", "1.25", "0.000001"), ("r2", "spent", "2.75", "0.000002"), ("r3", "aborted", "9", "0.1")]


@query("SELECT CAST(sum(e) AS DOUBLE) AS epsilon, CAST(sum(dl) AS DOUBLE) AS delta FROM (VALUES ('released', 1.25, 0.000001), ('spent', 2.75, 0.000002), ('aborted', 9, 0.1)) AS t(s, e, dl) WHERE s IN ('spent', 'released')")
def ledger_composition(spark, d):
    runs = spark.createDataFrame(_RUNS, "run string, state string, epsilon string, delta string")
    total = lambda c: F.sum(F.when(F.col("state").isin("spent", "released"), F.col(c).cast("decimal(20,6)"))).cast("double").alias(c)
    return runs.agg(total("epsilon"), total("delta"))


@query("""WITH e AS (SELECT CAST(ceil(101 * 0.5 * 1.30) AS BIGINT) AS raw_parquet, CAST(ceil(3 * 10.1 * 1.30) AS BIGINT) AS normalized_parquet, CAST(ceil(7 * 4.2 * 1.50) AS BIGINT) AS generated_parquet, CAST(ceil(7 * 8.1 * 1.50) AS BIGINT) AS csv),
z AS (SELECT *, CAST(ceil(generated_parquet * 1.01) AS BIGINT) AS parquet_zip64 FROM e)
SELECT *, raw_parquet + normalized_parquet + 17 + generated_parquet + csv + parquet_zip64 + CAST(30 AS BIGINT) * 1073741824 AS required FROM z""")
def disk_capacity_estimate(spark, d):
    found = disk(101, Decimal("0.5"), 3, Decimal("10.1"), 7, Decimal("4.2"), Decimal("8.1"), 17, 4 << 30)
    names = ("raw_parquet", "normalized_parquet", "generated_parquet", "csv", "parquet_zip64", "required")
    return spark.createDataFrame([tuple(found[n] for n in names)], ", ".join(f"{n} long" for n in names))
