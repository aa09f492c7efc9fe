"""Queries of distances, pair relations, nearest records, classifiers and attacks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabforge.functions.keyed import in_train
from tabforge.operators import attacks, classify, distances, export, gower, pairs
from tabforge.queries import KEY, load, query, train_sql
from tabforge.queries.rule_queries import orders
from tabforge.schema import ColumnSchema

# train, holdout: the keyed partition of orders; "synthetic": the training rows with other statuses, priorities and prices
_R = f"SELECT o_orderkey, o_orderstatus AS status, nullif(o_orderpriority, '4-NOT SPECIFIED') AS prio, o_totalprice AS price, CAST(o_orderdate AS DATE) AS day, {train_sql('o_orderkey')} AS t FROM orders"
_SIDES = f"""r AS ({_R}), a AS (SELECT * FROM r WHERE t), b AS (SELECT * FROM r WHERE NOT t),
c AS (SELECT o_orderkey, CASE WHEN price > 300000 THEN 'O' ELSE status END AS status, nullif(prio, '5-LOW') AS prio, round(price * 0.9, 2) AS price, day, t FROM r WHERE t)"""
SCHEMA = (ColumnSchema("status", "categorical"), ColumnSchema("prio", "categorical", nullable=True), ColumnSchema("price", "float"), ColumnSchema("day", "date"))


def sides(spark, d):
    r = orders(spark, d).select("o_orderkey", F.col("o_orderstatus").alias("status"), "prio", F.col("o_totalprice").alias("price"), F.col("o_orderdate").alias("day"), in_train(F.col("o_orderkey"), KEY).alias("t"))
    a, b = r.where("t"), r.where("not t")
    c = a.withColumns({"status": F.when(F.col("price") > 300000, "O").otherwise(F.col("status")), "prio": F.nullif(F.col("prio"), F.lit("5-LOW")), "price": F.round(F.col("price") * 0.9, 2)})
    return a, b, c


def _ks_sql(a: str, b: str, column: str, expr: str) -> str:
    return f"""(SELECT '{column}' AS "column", max(abs(fa - fb)) AS distance FROM (SELECT sum(na) OVER (ORDER BY v) / sum(na) OVER () AS fa, sum(nb) OVER (ORDER BY v) / sum(nb) OVER () AS fb
FROM (SELECT v, sum(x) AS na, sum(1 - x) AS nb FROM (SELECT {expr} AS v, 1 AS x FROM {a} UNION ALL SELECT {expr}, 0 FROM {b}) WHERE v IS NOT NULL GROUP BY v)))"""


def _tvd_sql(a: str, b: str, column: str, tops: str, top: int = 100) -> str:
    return f"""(WITH k AS (SELECT {column} AS v FROM {tops} WHERE {column} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT {top}),
g AS (SELECT CASE WHEN {column} IN (SELECT v FROM k) THEN {column} ELSE '__OTHER__' END AS v, x FROM (SELECT {column}, 1 AS x FROM {a} UNION ALL SELECT {column}, 0 FROM {b}) WHERE {column} IS NOT NULL)
SELECT '{column}' AS "column", sum(abs(na / ta - nb / tb)) / 2 AS distance FROM (SELECT v, sum(x) AS na, sum(1 - x) AS nb, sum(sum(x)) OVER () AS ta, sum(sum(1 - x)) OVER () AS tb FROM g GROUP BY v))"""


_DAY = "date_diff('day', DATE '1970-01-01', day)"
_NUM = {"price": "price", "day": _DAY}


@query(f"WITH {_SIDES} SELECT \"column\", round(distance, 6) AS distance FROM ({_ks_sql('b', 'c', 'price', 'price')} UNION ALL {_ks_sql('b', 'c', 'day', _DAY)})")
def ks_distance_all_columns(spark, d):
    _, b, c = sides(spark, d)
    return distances.ks(b, c, {"price": F.col("price"), "day": F.unix_date("day")}).select("column", F.round("distance", 6).alias("distance"))


@query(f"WITH r AS (SELECT p_name, p_brand, p_size <= 25 AS t FROM part), a AS (SELECT * FROM r WHERE t), b AS (SELECT * FROM r WHERE NOT t) SELECT \"column\", round(distance, 6) AS distance FROM ({_tvd_sql('a', 'b', 'p_name', 'a', 20)} UNION ALL {_tvd_sql('a', 'b', 'p_brand', 'a', 20)})")
def tvd_distance_topk_other(spark, d):
    p = load(spark, d, "part")
    a, b = p.where("p_size <= 25"), p.where("p_size > 25")
    columns = {"p_name": F.col("p_name"), "p_brand": F.col("p_brand")}
    return distances.tvd(a, b, columns, distances.top_values(a, columns, 20)).select("column", F.round("distance", 6).alias("distance"))


@query("WITH t AS (SELECT p_name, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, p_name) AS r FROM part GROUP BY 1) SELECT 'p_name' AS \"column\", round(sum(CASE WHEN r > 50 THEN n ELSE 0 END) / sum(n), 6) AS omitted FROM t")
def omitted_tail_mass(spark, d):
    return distances.omitted_mass(load(spark, d, "part"), {"p_name": F.col("p_name")}, 50).select("column", F.round("omitted", 6).alias("omitted"))


@query(f"WITH {_SIDES} SELECT 'prio' AS \"column\", round(abs((SELECT avg(CAST(prio IS NULL AS INT)) FROM b) - (SELECT avg(CAST(prio IS NULL AS INT)) FROM c)), 6) AS difference")
def missingness_difference(spark, d):
    _, b, c = sides(spark, d)
    return distances.missing(b, c, ["prio"]).select("column", F.round("difference", 6).alias("difference"))


_ALL = " UNION ALL ".join(f"SELECT x.\"column\", x.distance AS baseline, y.distance AS synthetic FROM {x} x, {y} y" for x, y in [(_ks_sql("a", "b", c, e), _ks_sql("b", "c", c, e)) for c, e in _NUM.items()] + [(_tvd_sql("a", "b", c, "a"), _tvd_sql("b", "c", c, "a")) for c in ("status", "prio")])


@query(f"WITH {_SIDES} SELECT \"column\", round(baseline, 6) AS baseline, round(synthetic, 6) AS synthetic, round(greatest(0.0, synthetic - baseline), 6) AS excess FROM ({_ALL})")
def baseline_excess_columns(spark, d):
    a, b, c = sides(spark, d)
    return distances.primary(a, b, c, SCHEMA).select("column", *(F.round(x, 6).alias(x) for x in ("baseline", "synthetic", "excess")))


@query(f"WITH {_SIDES}, e AS (SELECT greatest(0.0, synthetic - baseline) AS e FROM ({_ALL})) SELECT count(*) AS n_columns, round(quantile_cont(e, 0.5), 6) AS median, round(quantile_cont(e, 0.95), 6) AS p95, round(max(e), 6) AS greatest FROM e")
def baseline_excess_summary(spark, d):
    a, b, c = sides(spark, d)
    return distances.summary(distances.primary(a, b, c, SCHEMA)).select("n_columns", *(F.round(x, 6).alias(x) for x in ("median", "p95", "greatest")))


@query()
def bootstrap_ci_histogram(spark, d):
    _, b, c = sides(spark, d)
    return distances.bootstrap_ks(b, c, {"price": F.col("price"), "day": F.unix_date("day")})


_LI = ("l_quantity", "l_extendedprice", "l_discount")
_PAIRS = [("l_quantity", "l_extendedprice"), ("l_quantity", "l_discount"), ("l_extendedprice", "l_discount")]


@query(" UNION ALL ".join(f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", round(corr({a}, {b}), 6) AS r FROM lineitem" for a, b in _PAIRS))
def pair_pearson(spark, d):
    return pairs.pearson(load(spark, d, "lineitem"), _PAIRS).select("left", "right", F.round("r", 6).alias("r"))


@query("SELECT 'l_quantity' AS \"left\", 'l_extendedprice' AS \"right\", round(corr(a, b), 6) AS rho FROM (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2 AS a, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2 AS b FROM lineitem)")
def pair_spearman(spark, d):
    return pairs.spearman(load(spark, d, "lineitem"), "l_quantity", "l_extendedprice").select("left", "right", F.round("rho", 6).alias("rho"))


@query(f"WITH {_SIDES}, g AS (SELECT status AS x, coalesce(prio, '__MISSING__') AS y, 1 AS s FROM a UNION ALL SELECT status, coalesce(prio, '__MISSING__'), 0 FROM c) SELECT 'status' AS \"left\", 'prio' AS \"right\", round(sum(abs(na / ta - nb / tb)) / 2, 6) AS distance FROM (SELECT sum(s) AS na, sum(1 - s) AS nb, sum(sum(s)) OVER () AS ta, sum(sum(1 - s)) OVER () AS tb FROM g GROUP BY x, y)")
def pair_joint_tvd(spark, d):
    a, _, c = sides(spark, d)
    return pairs.joint_tvd(a, c, "status", "prio").select("left", "right", F.round("distance", 6).alias("distance"))


_EDGES = "SELECT list_sort(list_distinct(quantile_cont(l_extendedprice, [{}]))) AS e FROM lineitem".format(", ".join(f"{i / 20}" for i in range(1, 20)))


@query(f"WITH k AS ({_EDGES}) SELECT CAST(len(list_filter(e, lambda y: y <= l_extendedprice)) AS BIGINT) AS bin, count(*) AS n FROM lineitem, k GROUP BY 1")
def pair_quantile_bins(spark, d):
    li = load(spark, d, "lineitem")
    return li.select(pairs.binned(F.col("l_extendedprice"), pairs.edges(li, "l_extendedprice")).cast("long").alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


_QE = "SELECT list_sort(list_distinct(quantile_cont(price, [{}]))) AS e FROM a".format(", ".join(f"{i / 20}" for i in range(1, 20)))


@query(f"""WITH {_SIDES}, k AS ({_QE}), g AS (SELECT len(list_filter(e, lambda q: q <= price)) AS x, status AS y, s FROM (SELECT price, status, 1 AS s FROM a UNION ALL SELECT price, status, 0 FROM c), k),
h AS (SELECT x, y, sum(s) AS na, sum(1 - s) AS nb FROM g GROUP BY x, y), w AS (SELECT *, sum(na) OVER (PARTITION BY x) AS ta, sum(nb) OVER (PARTITION BY x) AS tb FROM h),
b2 AS (SELECT x, max(ta) AS ta, CASE WHEN max(tb) = 0 THEN 1.0 ELSE sum(abs(na / ta - CASE WHEN tb > 0 THEN nb / tb ELSE 0 END)) / 2 END AS dist FROM w WHERE ta > 0 GROUP BY x)
SELECT 'price' AS number, 'status' AS category, round(sum(ta * dist) / sum(ta), 6) AS distance FROM b2""")
def pair_conditional_tvd(spark, d):
    a, _, c = sides(spark, d)
    return pairs.conditional_tvd(a, c, "price", "status").select("number", "category", F.round("distance", 6).alias("distance"))


def _relation_sql(other: str, left: str, right: str, number: str | None, category: str | None) -> str:
    """The total variation of a pair between training rows and another table."""
    token = lambda c: f"coalesce({c}, '__MISSING__')"
    edges, group, value = ("[]", "0", f"{token(left)} || chr(31) || {token(right)}") if number is None else ("list_sort(list_distinct(quantile_cont({n}, [{at}])))".format(n=_NUM[number], at=", ".join(str(i / 20) for i in range(1, 20))), f"len(list_filter(e, lambda q: q <= {_NUM[number]}))", token(category))
    return f"""(WITH k AS (SELECT {edges} AS e FROM a{' LIMIT 1' if number is None else ''}), g AS (SELECT {group} AS x, {value} AS y, s FROM (SELECT *, 1 AS s FROM a UNION ALL SELECT *, 0 FROM {other}), k),
h AS (SELECT x, y, sum(s) AS na, sum(1 - s) AS nb FROM g GROUP BY x, y), w AS (SELECT *, sum(na) OVER (PARTITION BY x) AS ta, sum(nb) OVER (PARTITION BY x) AS tb FROM h),
p AS (SELECT x, max(ta) AS ta, CASE WHEN max(tb) = 0 THEN 1.0 ELSE sum(abs(na / ta - CASE WHEN tb > 0 THEN nb / tb ELSE 0 END)) / 2 END AS dist FROM w WHERE ta > 0 GROUP BY x) SELECT sum(ta * dist) / sum(ta) FROM p)"""


_RELATED = " UNION ALL ".join(
    f"SELECT '{'categorical_categorical' if r == 'prio' else 'mixed'}' AS family, '{l}' AS \"left\", '{r}' AS \"right\", round({_relation_sql('b', l, r, n, k)}, 6) AS control, round({_relation_sql('c', l, r, n, k)}, 6) AS synthetic"
    for l, r, n, k in [("status", "prio", None, None), ("status", "price", "price", "status"), ("status", "day", "day", "status"), ("prio", "price", "price", "prio"), ("prio", "day", "day", "prio")]
)


@query(f"WITH {_SIDES} {_RELATED} UNION ALL SELECT 'numeric_numeric', 'price', 'day', round(abs((SELECT corr(price, {_DAY}) FROM b) - (SELECT corr(price, {_DAY}) FROM a)), 6), round(abs((SELECT corr(price, {_DAY}) FROM c) - (SELECT corr(price, {_DAY}) FROM a)), 6)")
def pairs_compared(spark, d):
    """All pairs of modelled columns: holdout (control) and synthetic rows against training rows."""
    a, b, c = sides(spark, d)
    return pairs.compared(a, b, c, SCHEMA).select("family", "left", "right", F.round("control", 6).alias("control"), F.round("synthetic", 6).alias("synthetic"))


CUSTOMER = (ColumnSchema("c_acctbal", "float"), ColumnSchema("c_nationkey", "integer"), ColumnSchema("c_mktsegment", "categorical"))
_CU = "SELECT c_custkey, c_acctbal, c_nationkey, c_mktsegment FROM customer"
_G = f"""WITH tr AS ({_CU} WHERE {train_sql('c_custkey')}), qu AS ({_CU} WHERE NOT {train_sql('c_custkey')}), l AS (SELECT quantile_cont(c_acctbal, 0.01) AS a0, quantile_cont(c_acctbal, 0.99) AS a1, quantile_cont(c_nationkey, 0.01) AS n0, quantile_cont(c_nationkey, 0.99) AS n1 FROM tr),
p AS (SELECT q.c_custkey AS id, (abs(least(greatest(q.c_acctbal, a0), a1) - least(greatest(t.c_acctbal, a0), a1)) / (a1 - a0) + abs(least(greatest(q.c_nationkey, n0), n1) - least(greatest(t.c_nationkey, n0), n1)) / (n1 - n0) + CASE WHEN q.c_mktsegment = t.c_mktsegment THEN 0 ELSE 1 END) / 3 AS dist FROM qu q, tr t, l),
n AS (SELECT id, dist, row_number() OVER (PARTITION BY id ORDER BY dist) AS r FROM p), two AS (SELECT id, min(dist) AS f, max(dist) AS s FROM n WHERE r <= 2 GROUP BY id)"""


def _gower(spark, d):
    """All holdout customers against the training ones."""
    c, own = load(spark, d, "customer"), in_train(F.col("c_custkey"), KEY)
    return gower.nearest_two(c.where(own), c.where(~own), CUSTOMER, "c_custkey")


@query(f"{_G} SELECT id, round(f, 6) AS first, round(s, 6) AS second FROM two")
def gower_nearest_two(spark, d):
    return _gower(spark, d).select("id", F.round("first", 6).alias("first"), F.round("second", 6).alias("second"))


@query(f"{_G} SELECT count(*) AS n, round(quantile_cont(f, 0.5), 6) AS dcr_median, round(quantile_cont(f, 0.01), 6) AS dcr_p01, round(quantile_cont(f, 0.99), 6) AS dcr_p99, round(quantile_cont(CASE WHEN s = 0 THEN 0 ELSE f / s END, 0.5), 6) AS nndr_median FROM two")
def gower_dcr_nndr_summary(spark, d):
    s = gower.summary(_gower(spark, d))
    return s.select("n", *(F.round(c, 6).alias(c) for c in s.columns[1:]))


def _interpolated(values: str, at: str) -> str:
    """A quantile of a sorted list."""
    return f"({values}[CAST(floor({at} * (len({values}) - 1)) AS BIGINT) + 1] + ({at} * (len({values}) - 1) - floor({at} * (len({values}) - 1))) * ({values}[CAST(ceil({at} * (len({values}) - 1)) AS BIGINT) + 1] - {values}[CAST(floor({at} * (len({values}) - 1)) AS BIGINT) + 1]))"


_OFF = f"least(0.5, {gower.Z_HALF} / sqrt(n))"


@query(_G.replace("NOT " + train_sql("c_custkey"), "NOT " + train_sql("c_custkey") + " UNION ALL SELECT -1 - c_custkey, round(c_acctbal * 0.9, 2), c_nationkey, CASE WHEN c_custkey % 3 = 0 THEN 'BUILDING' ELSE c_mktsegment END FROM customer WHERE " + train_sql("c_custkey") + " AND c_custkey % 5 = 0") + f""", g AS (SELECT CASE WHEN id < 0 THEN 'synthetic' ELSE 'control' END AS side, count(*) AS n, list_sort(list(f)) AS f, list_sort(list(CASE WHEN s = 0 THEN 0 ELSE f / s END)) AS s FROM two GROUP BY 1)
SELECT side, n, {', '.join(f"round({_interpolated(v, at)}, 6) AS {name}_{part}" for v, name in (("f", "dcr"), ("s", "nndr")) for part, at in (("median", "0.5"), ("low", f"(0.5 - {_OFF})"), ("high", f"(0.5 + {_OFF})")))} FROM g""")
def gower_control(spark, d):
    """Changed training customers as synthetic rows, and holdout customers as control, against training customers, with intervals."""
    c, own = load(spark, d, "customer"), in_train(F.col("c_custkey"), KEY)
    made = c.where(own & (F.col("c_custkey") % 5 == 0)).select((-1 - F.col("c_custkey")).alias("c_custkey"), F.round(F.col("c_acctbal") * 0.9, 2).alias("c_acctbal"), "c_nationkey", F.when(F.col("c_custkey") % 3 == 0, "BUILDING").otherwise(F.col("c_mktsegment")).alias("c_mktsegment"))
    got = gower.compared(c.where(own), c.where(~own), made, CUSTOMER, "c_custkey")
    return got.select("side", "n", *(F.round(x, 6).alias(x) for x in got.columns[2:]))


@query("SELECT n_pos, n_neg, round(u / (n_pos * n_neg), 6) AS auc FROM (SELECT count(*) FILTER (WHERE quality = 1) AS n_pos, count(*) FILTER (WHERE quality = 0) AS n_neg, sum(r) FILTER (WHERE quality = 1) - count(*) FILTER (WHERE quality = 1) * (count(*) FILTER (WHERE quality = 1) + 1) / 2 AS u FROM (SELECT quality, rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2 AS r FROM documents JOIN labels USING (doc_id)))")
def auc_rank_sum(spark, d):
    both = load(spark, d, "documents").select("doc_id", "n_chars").join(load(spark, d, "labels"), "doc_id")
    return classify.auc_rank_sum(both, "n_chars", "quality").select("n_pos", "n_neg", F.round("auc", 6).alias("auc"))


def _c2st(spark, d, kind):
    """Synthetic against holdout rows, and training against holdout rows as control; as many rows a side in both."""
    a, b, c = sides(spark, d)
    most = min(a.count(), b.count(), c.count(), classify.MOST_ROWS)
    both = (classify.c2st(a, x, y, SCHEMA, kind, most=most).withColumn("comparison", F.lit(name)) for name, x, y in (("synthetic", b, c), ("control", a, b)))
    return reduce(DataFrame.unionByName, both).select("kind", "auc", "n", "low", "high", "comparison")


@query()
def c2st_linear_auc(spark, d):
    return _c2st(spark, d, "linear")


@query()
def c2st_gbt_auc(spark, d):
    return _c2st(spark, d, "gbt")


@query()
def downstream_classification(spark, d):
    a, b, c = sides(spark, d)
    return classify.downstream(a, c, b, SCHEMA, "status", "classification")


@query()
def downstream_regression(spark, d):
    a, b, c = sides(spark, d)
    return classify.downstream(a, c, b, SCHEMA, "price", "regression")


def _attacked(spark, d):
    c, own = load(spark, d, "customer"), in_train(F.col("c_custkey"), KEY)
    return c.where(own), c.where(~own)


@query("WITH s AS (SELECT 'c_acctbal' AS k, CAST(round(c_acctbal * 100) AS BIGINT) AS v, {h} AS h FROM customer UNION ALL SELECT 'c_nationkey', c_nationkey, {h} FROM customer), g AS (SELECT k, v FROM s WHERE h GROUP BY ALL HAVING count(*) = 1), t AS (SELECT k, v, count(*) AS n FROM s WHERE NOT h GROUP BY ALL) SELECT count(*) AS n, count(*) FILTER (WHERE t.n = 1) AS hits FROM g LEFT JOIN t USING (k, v)".format(h=train_sql("c_custkey")))
def attack_singling_out(spark, d):
    synthetic, target = (x.select(F.round(F.col("c_acctbal") * 100).cast("long").alias("c_acctbal"), F.col("c_nationkey").cast("long").alias("c_nationkey")) for x in _attacked(spark, d))
    return attacks.singling_out(synthetic, target, ["c_acctbal", "c_nationkey"], attacks=None).select("n", "hits")


@query()
def attack_singling_out_together(spark, d):
    synthetic, target = _attacked(spark, d)
    return attacks.singling_out_together(synthetic, target, CUSTOMER)


@query()
def attack_linkability(spark, d):
    synthetic, target = _attacked(spark, d)
    return attacks.linkability(synthetic, target, CUSTOMER, ["c_acctbal"], ["c_nationkey", "c_mktsegment"], "c_custkey")


@query()
def attack_inference(spark, d):
    synthetic, target = _attacked(spark, d)
    return attacks.inference(synthetic, target, CUSTOMER, "c_mktsegment", ["c_acctbal", "c_nationkey"], "c_custkey")


EXACT = (ColumnSchema("c_custkey", "integer"), ColumnSchema("c_name", "identifier", role="identifier", identifier_strategy="sequential", format=r"Customer#[0-9]{8}[0-4]"), ColumnSchema("c_mktsegment", "categorical"))


@query("""SELECT 'c_custkey' AS "column", count(*) AS n, count(*) - count(c_custkey) AS n_null, CAST(0 AS BIGINT) AS n_format FROM customer UNION ALL SELECT 'c_name', count(*), count(*) - count(c_name), count(*) FILTER (WHERE NOT regexp_full_match(c_name, 'Customer#[0-9]{8}[0-4]')) FROM customer UNION ALL SELECT 'c_mktsegment', count(*), count(*) - count(c_mktsegment), 0 FROM customer""")
def exact_scan_counts(spark, d):
    return export.exact_scan(load(spark, d, "customer"), EXACT).select("column", "n", "n_null", "n_format")


@query("SELECT count(DISTINCT o_custkey) AS n_distinct, count(o_custkey) - count(DISTINCT o_custkey) AS n_duplicate FROM orders")
def exact_duplicates(spark, d):
    c = (ColumnSchema("o_custkey", "identifier", role="identifier", identifier_strategy="sequential"),)
    return export.exact_scan(load(spark, d, "orders"), c).select("n_distinct", "n_duplicate")


@query("SELECT 'o_orderstatus' AS \"column\", o_orderstatus AS value, count(*) AS n FROM orders GROUP BY ALL UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY ALL")
def exact_category_counts(spark, d):
    return export.category_counts(load(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"])
