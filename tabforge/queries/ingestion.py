"""Queries of sources and sinks: tables are written to the shared folder in each format and read back by the engine's own readers."""

from __future__ import annotations

import io
import uuid
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import functions as F

from tabforge.functions.keyed import derive_u64, pads
from tabforge.operators import export, normalize, rules
from tabforge.operators.synth import Cyclic
from tabforge.plans.estimates import candidate_batch
from tabforge.plans.pipeline import generate_exactly
from tabforge.plans.rules import compile_rules
from tabforge.queries import KEY, load, query
from tabforge.queries.publication import _NATION_BYTES, NATION, nation
from tabforge.queries.rule_queries import _T, ORDERS, SPECS, orders
from tabforge.schema import ROW_ID, ColumnSchema, EngineError
from tabforge.sources import csv, xlsx
from tabforge.sources.tables import evaluation_input, scan_parquet, shared_folder

SEED = 54_321


def _folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _put(spark, path: str, data: bytes) -> str:
    """A small file in the shared folder."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, False)
    out.write(bytearray(data))
    out.close()
    return path


def _file(spark, lines, header: str, name: str) -> str:
    """One file of a header and lines (k, line) in the order of k."""
    folder = _folder(spark, name)
    lines.unionByName(spark.createDataFrame([(-1, header)], "k long, line string")).orderBy("k").select("line").coalesce(1).write.text(folder)
    return folder


@query("SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS row_id, CAST(c_custkey AS VARCHAR) AS k, c_name || ', \"' || c_mktsegment || '\"' || chr(10) || 'x' AS label, coalesce(nullif(c_mktsegment, 'BUILDING'), '') AS segment FROM customer")
def csv_raw_table(spark, d):
    """Quoted delimiters, doubled quotes, line ends within fields and empty fields, with the proposed dialect."""
    c = load(spark, d, "customer")
    label = F.concat(F.lit('"'), "c_name", F.lit(', ""'), "c_mktsegment", F.lit('""\nx"'))
    lines = c.select(F.col("c_custkey").cast("long").alias("k"), F.concat_ws(",", "c_custkey", label, F.coalesce(F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")), F.lit(""))).alias("line"))
    got, _ = csv.read_raw(spark, _file(spark, lines, "k,label,segment", "raw"))
    return got.withColumnRenamed(ROW_ID, "row_id")


_WAYS = ("'kept'", "'column_count_mismatch'", "'quote_in_unquoted_field'", "'characters_after_closing_quote'")


@query(f"SELECT CASE WHEN o_orderkey % 10 = 1 THEN {_WAYS[1]} WHEN o_orderkey % 10 = 2 THEN {_WAYS[2]} WHEN o_orderkey % 10 = 3 THEN {_WAYS[3]} ELSE {_WAYS[0]} END AS reason, count(*) AS n FROM orders GROUP BY 1")
def csv_malformed_reasons(spark, d):
    """Records with a column too many, a stray quote or text after a closing quote are skipped and counted."""
    k, status = F.col("o_orderkey"), F.col("o_orderstatus")
    line = F.when(k % 10 == 1, F.concat(k, F.lit(";"), status, F.lit(";more"))).when(k % 10 == 2, F.concat(k, F.lit(';a"'), status)).when(k % 10 == 3, F.concat(k, F.lit(';"a"'), status)).otherwise(F.concat(k, F.lit(';"'), status, F.lit('"')))
    path = _file(spark, load(spark, d, "orders").select(k.cast("long").alias("k"), line.alias("line")), "k;status", "malformed")
    got, reasons = csv.read_raw(spark, path, csv.Dialect("utf-8", ";"), malformed="skip")
    return spark.createDataFrame([("kept", got.count()), *reasons.items()], "reason string, n long")


@query("SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS row_id, CAST(n_nationkey AS VARCHAR) AS k, '국가 ' || n_name AS name FROM nation")
def csv_korean_encoding(spark, d):
    """The 25 nations as tab-separated CP949."""
    rows = nation(spark, d).orderBy("n_nationkey").collect()
    data = "\r\n".join(["k\tname", *(f"{r[0]}\t국가 {r[1]}" for r in rows)]).encode("cp949")
    got, _ = csv.read_raw(spark, _put(spark, f"{_folder(spark, 'korean')}.csv", data), csv.Dialect("cp949", "\t"))
    return got.withColumnRenamed(ROW_ID, "row_id")


def _workbook(sheets: dict[str, list[tuple]]) -> bytes:
    """A minimal workbook: numbers, booleans, inline texts and empty cells."""
    one = lambda v: "<c/>" if v is None else f'<c t="b"><v>{int(v)}</v></c>' if isinstance(v, bool) else f"<c><v>{v}</v></c>" if isinstance(v, int | float) else f'<c t="inlineStr"><is><t>{escape(v)}</t></is></c>'
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006"
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{package}/content-types"/>',
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets, 1)) + "</sheets></workbook>",
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{package}/relationships">' + "".join(f'<Relationship Id="r{i}" Type="{rel}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i, _ in enumerate(sheets, 1)) + "</Relationships>",
    }
    for i, rows in enumerate(sheets.values(), 1):
        parts[f"xl/worksheets/sheet{i}.xml"] = f'<worksheet xmlns="{main}"><sheetData>' + "".join("<row>" + "".join(map(one, r)) + "</row>" for r in rows) + "</sheetData></worksheet>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


@query("SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS row_id, CAST(n_nationkey AS VARCHAR) AS k, n_name AS name, CASE WHEN n_regionkey = 1 THEN NULL WHEN n_regionkey = 2 THEN 'true' ELSE CAST(n_regionkey AS VARCHAR) || '.5' END AS region FROM nation")
def xlsx_raw_table(spark, d):
    """The second of two sheets: the 25 nations with numbers, texts, booleans and empty cells."""
    rows = [("k", "name", "region"), *((r[0], r[1], None if r[2] == 1 else True if r[2] == 2 else r[2] + 0.5) for r in nation(spark, d).orderBy("n_nationkey").collect())]
    path = _put(spark, f"{_folder(spark, 'book')}.xlsx", _workbook({"other": [("a",)], "nations": rows}))
    return xlsx.read_raw(spark, path, "nations").withColumnRenamed(ROW_ID, "row_id")


@query("SELECT o_orderkey, o_totalprice FROM orders")
def parquet_shards_projected(spark, d):
    """Three shards of one table; only two columns are read."""
    folder, df = _folder(spark, "shards"), orders(spark, d)
    paths = [f"{folder}/{s}" for s in range(3)]
    for i, p in enumerate(paths):
        df.where(F.col("o_orderkey") % 3 == i).write.parquet(p)
    return scan_parquet(spark, paths, ["o_orderkey", "o_totalprice"])


@query("SELECT o_orderkey % 3 AS shard, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders GROUP BY 1")
def shards_in_order(spark, d):
    """Shards one after another, with the shard's number."""
    df = orders(spark, d).select("o_orderkey")
    every = export.ordered_union([df.where(F.col("o_orderkey") % 3 == i) for i in range(3)])
    return every.groupBy(F.col("__shard").cast("long").alias("shard")).agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"))


@query("SELECT c_custkey, c_acctbal, nullif(c_mktsegment, 'BUILDING') AS c_mktsegment FROM customer")
def evaluation_csv_input(spark, d):
    """A CSV whose types are inferred and whose empty cells are null."""
    path = f"{_folder(spark, 'input')}.csv"
    load(spark, d, "customer").select("c_custkey", "c_acctbal", F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")).alias("c_mktsegment")).write.option("header", True).csv(path)
    return evaluation_input(spark, path).withColumn("c_custkey", F.col("c_custkey").cast("long"))


def _normal(spark, d):
    """Orders as raw text, cast to their schema, written by row id and read again."""
    own = (ORDERS[1], ORDERS[2], ORDERS[4])
    raw = orders(spark, d).select(F.col("o_orderkey").cast("long").alias(ROW_ID), *(F.col(c.name).cast("string").alias(c.name) for c in own))
    path = _folder(spark, "normalized")
    normalize.write_normalized(normalize.normalize(raw, own), path)
    return spark.read.parquet(path)


@query(f"SELECT o_orderkey AS row_id, o_orderstatus, o_totalprice, prio FROM ({_T})")
def normalized_table(spark, d):
    return _normal(spark, d).withColumnRenamed(ROW_ID, "row_id")


@query("SELECT CAST(0 AS BIGINT) AS n_overlapping, count(*) AS n FROM orders")
def normalized_file_order(spark, d):
    """Files of the written table hold disjoint ranges of row ids, each in order."""
    rows = _normal(spark, d).select(F.col(ROW_ID).alias("k"), F.input_file_name().alias("f"))
    files = rows.groupBy("f").agg(F.min("k").alias("a"), F.max("k").alias("b"), F.count(F.lit(1)).alias("n"))
    other = files.select(F.col("f").alias("g"), F.col("a").alias("c"), F.col("b").alias("e"))
    overlaps = files.join(F.broadcast(other), (F.col("f") < F.col("g")) & (F.col("a") <= F.col("e")) & (F.col("c") <= F.col("b"))).agg(F.count(F.lit(1)).alias("n_overlapping"))  # one row a file
    return overlaps.crossJoin(files.agg(F.sum("n").alias("n")))  # one row each


@query("SELECT o_orderkey, o_orderstatus FROM orders")
def published_parquet(spark, d):
    """Rows of a folder that was staged, renamed and is not published twice."""
    folder, df = _folder(spark, "published"), orders(spark, d).select("o_orderkey", "o_orderstatus")
    export.publish_parquet(df, folder, "o_orderkey")
    try:
        export.publish_parquet(df.limit(1), folder)
    except EngineError as e:
        if e.code != "IMMUTABLE_PATH_EXISTS":
            raise
    return spark.read.parquet(folder)


_BYTES = f"SELECT n_nationkey, {_NATION_BYTES} AS b FROM (SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, n_regionkey FROM nation)"


@query("SELECT c.column_name, e.n, e.n_null, e.n_distinct, e.n_duplicate FROM (SELECT unnest(['c_custkey', 'c_name', 'c_mktsegment']) AS column_name) c JOIN (SELECT 'c_custkey' AS column_name, count(*) AS n, count(*) - count(c_custkey) AS n_null, CAST(NULL AS BIGINT) AS n_distinct, CAST(NULL AS BIGINT) AS n_duplicate FROM customer UNION ALL SELECT 'c_name', count(*), count(*) - count(c_name), count(DISTINCT c_name), count(c_name) - count(DISTINCT c_name) FROM customer UNION ALL SELECT 'c_mktsegment', count(*), count(*) - count(c_mktsegment), NULL, NULL FROM customer) e USING (column_name)")
def checked_output(spark, d):
    """Names, order, types, row number, nulls, identifiers and formats of an output, with what was counted."""
    schema = (ColumnSchema("c_custkey", "integer"), ColumnSchema("c_name", "identifier", role="identifier", identifier_strategy="sequential", format=r"Customer#[0-9]+"), ColumnSchema("c_mktsegment", "categorical"))
    df = load(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("c_custkey"), "c_name", "c_mktsegment")
    found = export.check_output(df, schema, df.count())
    return spark.createDataFrame([(c, r["n"], r["n_null"], r["n_distinct"], r["n_duplicate"]) for c, r in found.items()], "column_name string, n long, n_null long, n_distinct long, n_duplicate long")


@query(f"WITH r AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS place, count(*) OVER () AS n FROM orders), c AS (SELECT i, o_orderkey, o_orderstatus, o_totalprice FROM (SELECT unnest(range(20000)) AS i) JOIN r ON place = ({SEED} % n + i) % n WHERE o_totalprice BETWEEN 0 AND 200000 AND o_orderstatus IN ('F', 'O')) SELECT row_number() OVER (ORDER BY i) - 1 AS accepted_id, o_orderkey, o_orderstatus, o_totalprice FROM c ORDER BY i LIMIT 1000")
def generated_exactly(spark, d):
    """The first 1,000 valid candidates in batches of 1,500, without internal columns."""
    specs = [{"id": "price", "kind": "range", "column": "o_totalprice", "min": 0, "max": 200000}, {"id": "status", "kind": "allowed_values", "column": "o_orderstatus", "values": ["F", "O"]}]
    df = orders(spark, d).select("o_orderkey", "o_orderstatus", "o_totalprice")
    rows, _, _ = generate_exactly(Cyclic.fit(df, ["o_orderkey"], SEED), compile_rules(specs, ORDERS[:3]), 1_000, 1_500)
    return rows


_WHENS = {"eq": "o_orderstatus = 'P'", "ne": "o_orderstatus <> 'P'", "lt": "o_totalprice < 100000", "lte": "o_totalprice <= 100000", "gt": "o_totalprice > 100000", "gte": "o_totalprice >= 100000", "is_null": "prio IS NULL"}


@query(" UNION ALL ".join(f"SELECT '{op}' AS op, count(*) FILTER (WHERE {w}) AS n FROM ({_T})" for op, w in _WHENS.items()))
def rule_predicates(spark, d):
    """Each condition that rules know, counted in one pass."""
    counts = []
    for op in _WHENS:
        column = "prio" if op == "is_null" else "o_orderstatus" if op in ("eq", "ne") else "o_totalprice"
        when = {"kind": "is_null", "column": column} if op == "is_null" else {"kind": "comparison", "column": column, "op": op, "value": "P" if column == "o_orderstatus" else 100000}
        target = "o_orderstatus" if op == "is_null" else "prio"
        c = compile_rules([{"id": op, "kind": "conditional_set", "when": when, "target": target, "value": "F" if target == "o_orderstatus" else "2-HIGH"}], ORDERS)
        counts.append(F.count_if(rules.holds(c.rules[0].when, c.columns)).cast("long").alias(op))
    one = orders(spark, d).agg(*counts)
    return one.select(F.explode(F.array(*(F.struct(F.lit(op).alias("op"), F.col(op).alias("n")) for op in _WHENS))).alias("r")).select("r.*")


@query(f"SELECT 'SOURCE_RULE_VIOLATION' AS code, count(*) FILTER (WHERE prio IS NULL) AS a_prio, count(*) FILTER (WHERE o_orderstatus = 'P' AND prio IS DISTINCT FROM '2-HIGH') AS e_cond, count(*) FILTER (WHERE o_orderstatus = 'P' AND prio IS DISTINCT FROM '2-HIGH') AS n_block FROM ({_T})")
def rule_block_gate(spark, d):
    """A violated blocking rule stops a run with the counts of all rules."""
    try:
        rules.audited_source(orders(spark, d), compile_rules([SPECS[0], SPECS[4]], ORDERS))
    except EngineError as e:
        n = e.details["counts"]
        return spark.createDataFrame([(e.code, n["a_prio"], n["e_cond"], n["__block_union"])], "code string, a_prio long, e_cond long, n_block long")
    return spark.createDataFrame([], "code string, a_prio long, e_cond long, n_block long")


_INNER, _OUTER = pads(KEY)


@query(f"SELECT r_name, substr(sha256(unhex('{_OUTER}') || unhex(sha256(unhex('{_INNER}') || encode(r_name)))), 1, 16) AS seed FROM region")
def derived_seeds(spark, d):
    """The 64-bit seed of each region's name (five rows), as hex."""
    return spark.createDataFrame([(r[0], format(derive_u64(KEY, r[0]), "016x")) for r in load(spark, d, "region").select("r_name").collect()], "r_name string, seed string")


@query("SELECT DISTINCT CAST(p_size AS BIGINT) * 97 AS row_bytes, greatest(10000, least(250000, CAST(134217728 AS BIGINT) // (CAST(p_size AS BIGINT) * 97))) AS batch FROM part")
def candidate_batches(spark, d):
    """Candidates made at a time by the size of a row, for the (at most 50) sizes of parts."""
    sizes = [r[0] * 97 for r in load(spark, d, "part").select(F.col("p_size").cast("long")).distinct().collect()]
    return spark.createDataFrame([(s, candidate_batch(s)) for s in sizes], "row_bytes long, batch long")


@query(f"SELECT count(*) AS row_count, sha256(unhex(string_agg(b, '' ORDER BY n_nationkey))) AS content_sha256 FROM ({_BYTES})")
def shard_manifest(spark, d):
    """A written table's manifest: its shards are hashed, and its rows in order, and both are checked again."""
    folder = _folder(spark, "manifest")
    export.publish_parquet(nation(spark, d), folder, "n_nationkey")
    stated = export.manifest(spark, folder, NATION, ["n_nationkey"])
    export.verify_manifest(spark, folder, stated, NATION, ["n_nationkey"])
    return spark.createDataFrame([(stated["row_count"], stated["content_sha256"])], "row_count long, content_sha256 string")


@query(f"SELECT count(*) AS n, sha256(string_agg(sha256(sha256(sha256(unhex(b)))), '' ORDER BY n_nationkey)) AS digest FROM ({_BYTES})")
def content_tree_nations(spark, d):
    """The tree digest where each range holds one key."""
    return export.content_tree(nation(spark, d), NATION, "n_nationkey")
