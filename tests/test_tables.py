"""Schemas, sources, normalisation, samples, distances, privacy and sinks: golden values."""

import datetime as dt
import hashlib
import hmac
import io
import uuid
import zipfile
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabforge.functions import keyed
from tabforge.operators import attacks, classify, distances, export, gower, normalize, pairs, profile, sampling
from tabforge.operators.synth import Conditional
from tabforge.plans import estimates, report
from tabforge.privacy import accounting, mst
from tabforge.privacy.codebook import Codebook, admit, capacity
from tabforge.schema import ROW_ID, ColumnSchema, EngineError, canonical_json, struct, version_of
from tabforge.sources import csv, xlsx
from tabforge.sources.tables import scale_fixture, scale_schema

C = ColumnSchema


@pytest.mark.parametrize("bad", ({"kind": "odd"}, {"kind": "fixed_decimal"}, {"kind": "integer", "decimal_places": 2}, {"kind": "identifier"}, {"kind": "text", "role": "identifier"}, {"kind": "excluded"}, {"kind": "categorical", "public_categories": ("a", "a")}, {"kind": "integer", "public_bins": (1,)}))
def test_schema_refuses(bad):
    with pytest.raises(EngineError):
        C("c", **bad)


def test_canonical_json():
    assert canonical_json({"b": Decimal("1.500"), "a": [-0.0, "é", dt.date(2020, 1, 2), None, True]}) == '{"a":[0,"é","2020-01-02",null,true],"b":"1.5"}'
    assert len(version_of([1])) == 16
    for bad in (float("nan"), dt.datetime(2020, 1, 1), {"é": 1, "é": 2}):
        with pytest.raises(ValueError):
            canonical_json(bad)


RAW = "code,amount,ratio,when,flag,name\n001,10,1.5,2026-01-01,true,Ana\n002,20,2.5,2026-01-02,false,Bob\n003,,3.5,2026-01-03,true,Ana\n"
SCHEMA = [C("code", "categorical"), C("amount", "integer", nullable=True), C("ratio", "float"), C("when", "date"), C("flag", "boolean"), C("name", "categorical")]


def test_csv_to_typed(spark, tmp_path):
    (tmp_path / "a.csv").write_text(RAW)
    raw, reasons = csv.read_raw(spark, str(tmp_path / "a.csv"))
    assert reasons == {} and raw.columns[0] == ROW_ID
    stats = {r.column: r for r in profile.aggregates(raw).collect()}
    assert stats["amount"].n_null == 1 and stats["code"].min_length == stats["code"].max_length == 3
    assert {(r.value, r.n) for r in profile.frequencies(raw, ["name"]).collect()} == {("Ana", 2), ("Bob", 1)}
    kinds = {r.column: r for r in profile.proposed_kinds(raw, raw.columns[1:]).collect()}
    assert kinds["code"].kind == "categorical" and kinds["code"].needs_confirmation and kinds["when"].kind == "date" and kinds["flag"].kind == "boolean" and kinds["ratio"].kind == "float"
    typed = normalize.normalize(raw, SCHEMA)
    assert [f.dataType.simpleString() for f in typed.schema] == ["bigint", "string", "bigint", "double", "date", "boolean", "string"]
    normalize.write_normalized(typed, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 3
    for bad in (list(reversed(SCHEMA)), [C(c.name, "integer") for c in SCHEMA], [C(c.name, c.kind) for c in SCHEMA]):
        with pytest.raises(EngineError) as e:
            normalize.normalize(raw, bad)
        assert e.value.code == "SCHEMA_INVALID"


@pytest.mark.parametrize("encoding", csv.ENCODINGS)
def test_encodings(spark, tmp_path, encoding):
    (tmp_path / "k.csv").write_bytes("name,city\n홍길동,서울\n김영희,부산\n".encode(encoding))
    raw, _ = csv.read_raw(spark, str(tmp_path / "k.csv"), csv.Dialect(encoding))
    assert [tuple(r) for r in raw.orderBy(ROW_ID).collect()] == [(0, "홍길동", "서울"), (1, "김영희", "부산")]


def test_malformed_records(spark, tmp_path):
    (tmp_path / "m.csv").write_text('a,b\n1,2\n3"oops,4\n5\n6,7\n')
    with pytest.raises(EngineError) as e:
        csv.read_raw(spark, str(tmp_path / "m.csv"), csv.Dialect())
    assert e.value.details["row"] == 1
    raw, reasons = csv.read_raw(spark, str(tmp_path / "m.csv"), csv.Dialect(), "skip")
    assert sorted(tuple(r) for r in raw.collect()) == [(0, "1", "2"), (3, "6", "7")] and reasons == {"quote_in_unquoted_field": 1, "column_count_mismatch": 1}


def test_records_and_dialects():
    parse = lambda s, w=2: [(f, r) for _, f, r in csv.parse(s, csv.Dialect(), w)]
    assert parse(b'h,i\nfirst,"line one\nline two"\nsecond,\n') == [(["first", "line one\nline two"], None), (["second", ""], None)]
    assert parse(b'h,i\r\n"a""b",c\rd,"e') == [(['a"b', "c"], None), (None, "unterminated_quoted_field")]
    assert parse(b'h,i\n"a"b,c\n,\n') == [(None, "characters_after_closing_quote"), (["", ""], None)]
    assert parse(b"h,i\n\xff,1\n") == [(None, "invalid_encoding")]
    assert csv.propose(b"a;b\n1;2\n") == (csv.Dialect("utf-8", ";"), False)
    assert csv.propose(b"a,b;c\n1,2;3\n")[1] and csv.propose(b"one\ntwo\n")[1]
    assert csv.propose(b'"a,x";b\n"1,y";2\n\n') == (csv.Dialect("utf-8", ";"), False)  # delimiters inside quotes do not count
    assert csv.propose(b'a,b\n1,2\n3,"4\n', whole=False) == (csv.Dialect("utf-8", ","), False)  # a sample may end inside a record
    assert csv.propose(b"\xef\xbb\xbfa|b\n1|2\n")[0] == csv.Dialect("utf-8-sig", "|")
    assert csv.agreement([2, 2, 3, 3, 1]) == (True, 400, 3, 2) and csv.agreement([]) == (False, 0, 0, 0)  # of equally frequent widths the greatest
    assert csv.propose(b"a,b;c,d\n1,2;3,4\n") == (csv.Dialect("utf-8", ","), False)  # equal shares: more columns win
    with pytest.raises(EngineError):
        csv.propose(b"\xff\xff\xff")
    assert csv.propose("이름,도시\n가,나\n".encode("cp949"))[0].encoding == "cp949"
    for bad in (b"", b"a,a\n", b"a,\n", ROW_ID.encode() + b",b\n"):
        with pytest.raises(EngineError):
            csv.header(bad, csv.Dialect())


def workbook(rows: str, extra: dict | None = None, sheets=("Data",)) -> bytes:
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    names = "".join(f'<sheet name="{s}" sheetId="{i + 1}" r:id="rId{i + 1}"/>' for i, s in enumerate(sheets))
    rels = "".join(f'<Relationship Id="rId{i + 1}" Target="worksheets/sheet1.xml"/>' for i in range(len(sheets)))
    files = {"[Content_Types].xml": "<Types/>", "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>{names}</sheets></workbook>', "xl/_rels/workbook.xml.rels": f"<Relationships>{rels}</Relationships>", "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{main}"><sheetData>{rows}</sheetData></worksheet>', "xl/styles.xml": f'<styleSheet xmlns="{main}"><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>'} | (extra or {})
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for k, v in files.items():
            z.writestr(k, v)
    return out.getvalue()


def cells(*values) -> str:
    one = lambda v: "<c/>" if v is None else f'<c t="b"><v>{int(v)}</v></c>' if isinstance(v, bool) else f"<c><v>{v}</v></c>" if isinstance(v, int | float) else f'<c t="inlineStr"><is><t>{v}</t></is></c>'
    return "<row>" + "".join(map(one, values)) + "</row>"


def test_xlsx(spark, tmp_path):
    data = workbook(cells("name", "amount", "active", "missing") + cells("Alice", 10, True, None) + cells("Bob", 12.5, False, "") + cells("Carol", None, None, "value"))
    (tmp_path / "w.xlsx").write_bytes(data)
    got = [tuple(r) for r in xlsx.read_raw(spark, str(tmp_path / "w.xlsx")).orderBy(ROW_ID).collect()]
    assert got == [(0, "Alice", "10", "true", None), (1, "Bob", "12.5", "false", None), (2, "Carol", None, None, "value")]
    dated = workbook('<row><c s="1"><v>45658</v></c><c s="1"><v>45658.5</v></c></row>')
    assert list(xlsx.rows(dated, xlsx.preflight(dated)[0])) == [["2025-01-01", "2025-01-01 12:00:00"]]
    for bad in ({"xl/vbaProject.bin": "x"}, {"../x": "x"}, {"xl/externalLinks/e.xml": "<x/>"}, {"xl/x.xml": "<!DOCTYPE x><x/>"}, {"xl/y.rels": '<R TargetMode="External"/>'}):
        with pytest.raises(EngineError) as e:
            xlsx.preflight(workbook(cells("a"), bad))
        assert e.value.code == "XLSX_UNSAFE"
    with pytest.raises(EngineError):
        list(xlsx.rows(f := workbook("<row><c><f>1+1</f><v>2</v></c></row>"), xlsx.preflight(f)[0]))
    two = xlsx.preflight(workbook(cells("a"), sheets=("A", "B")))
    assert xlsx.select(two, "B").name == "B"
    with pytest.raises(EngineError):
        xlsx.select(two, None)
    with pytest.raises(EngineError):
        xlsx.preflight(b"no archive")


def test_keyed_hashes_equal_hmac(spark):
    key = b"q" * 40
    rows = spark.range(50).select("id", keyed.row_hash(F.col("id"), key, keyed.PARTITION_DOMAIN).alias("h"), keyed.uuid4_of(F.col("id")).alias("u")).collect()
    for r in rows:
        assert r.h == hmac.new(key, keyed.PARTITION_DOMAIN + r.id.to_bytes(8, "big"), hashlib.sha256).hexdigest()
        assert r.u == str(uuid.UUID(bytes=hashlib.sha256(f"tabforge:{r.id}".encode()).digest()[:16], version=4))
    with pytest.raises(ValueError):
        keyed.row_hash(F.col("id"), b"short", b"")
    # RFC 5869, test case 1
    assert keyed.hkdf(bytes([0x0B] * 22), bytes(range(0xF0, 0xFA)), 42, bytes(range(13))).hex() == "3cb25f25faacd57a90434f64d0362f2a2d2d0a90cf1a5a4c5db02d56ecc4c5bf34007208d5b887185865"


def test_samples(spark):
    df = spark.range(10_000).select(F.col("id").alias(ROW_ID), F.when(F.col("id") % 10 == 0, "rare").otherwise("common").alias("segment"), F.when(F.col("id") % 17 != 0, F.concat(F.lit("r"), F.col("id") % 3)).alias("region"))
    key = b"k" * 32
    n = sampling.counts(df, key).first()
    assert n.n_train + n.n_holdout == 10_000 and 0.78 < n.n_train / 10_000 < 0.82
    assert sampling.train(df, key).join(sampling.holdout(df, key), ROW_ID).count() == 0
    a, b = (sorted(r[0] for r in sampling.priority_sample(d, key, 777).select(ROW_ID).collect()) for d in (df, df.repartition(7)))
    assert len(a) == 777 and a == b
    got = sampling.stratified_sample(df, key, 997, ["segment", "region"]).groupBy("segment", "region").count().collect()
    assert len(got) == 8 and sum(r["count"] for r in got) == 997
    with pytest.raises(EngineError):
        sampling.stratified_sample(df, key, 5, ["segment", "region", ROW_ID])
    assert sampling.content_selected(df, key, 1, ["segment"]).count() == 10_000


EVAL = [C("number", "integer", nullable=True), C("category", "categorical"), C("constant_same", "categorical"), C("constant_different", "categorical"), C("all_null", "float", nullable=True)]


def test_primary_distances(spark):
    make = lambda n, c, d: spark.createDataFrame([(a, b, "x", e, None) for a, b, e in zip(n, c, d, strict=True)], struct(EVAL))
    train, hold, syn = make([0, 1, 2, None], "aabb", "xxxx"), make([0, 1, 2, 3], "aabb", "xxxx"), make([0, 0, 0, None], "aaab", "yyyy")
    found = distances.primary(train, hold, syn, EVAL)
    got = {r.column: r for r in found.collect()}
    n = got["number"]
    assert (n.baseline, n.synthetic, n.excess, n.missing_baseline, n.missing_synthetic) == (0.25, 0.75, 0.5, 0.25, 0.25)
    assert (got["category"].synthetic, got["constant_same"].excess, got["constant_different"].excess, got["all_null"].excess) == (0.25, 0, 1, None)
    s = distances.summary(found).first()
    assert (s.n_columns, s.median, s.greatest) == (4, 0.375, 1) and s.p95 == pytest.approx(0.925)
    ci = distances.bootstrap_ks(hold, syn, {"number": F.col("number")}, reps=50).first()
    assert ci.distance == 0.75 and ci.low <= 0.75 <= ci.high


def test_tail_of_categories(spark):
    values = [f"v{i:03d}" for i in range(102)]
    a = spark.createDataFrame([(v,) for v in values], "c string")
    b = spark.createDataFrame([(v,) for v in [*values[:100], "new1", "new2"]], "c string")
    columns = {"c": F.col("c")}
    assert distances.tvd(a, b, columns, distances.top_values(a, columns)).first().distance == 0
    assert distances.omitted_mass(a, columns).first().omitted == pytest.approx(2 / 102)


def test_gower(spark, monkeypatch):
    schema = [C("n", "float"), C("c", "categorical")]
    train = spark.createDataFrame([(1, 0.0, "a"), (2, 10.0, "b")], "k long, n double, c string")
    query = spark.createDataFrame([(1, 0.0, "a"), (2, 5.0, "a")], "k long, n double, c string")
    low, high = gower.bounds(train, schema)["n"]
    assert (low, high) == (pytest.approx(0.1), pytest.approx(9.9))
    near = gower.nearest_two(train, query, schema, "k")
    got = sorted(tuple(r) for r in near.collect())
    assert got == [(1, 0.0, 1.0), (2, pytest.approx(0.25), pytest.approx(0.75))]
    assert [r.nndr for r in gower.ratios(near).orderBy("id").collect()] == [0.0, pytest.approx(1 / 3)]
    many = spark.range(9).select(F.col("id").alias("k"), F.col("id").cast("double").alias("n"), F.lit("a").alias("c"))
    whole = sorted(map(tuple, gower.nearest_two(train, many, schema, "k").collect()))
    monkeypatch.setattr(gower, "MOST_QUERIES", 3)
    assert sorted(map(tuple, gower.nearest_two(train, many, schema, "k").collect())) == whole and len(whole) == 9
    sides = {r["side"]: r for r in gower.compared(train, many, train.withColumn("k", F.col("n").cast("long")), schema, "k").collect()}
    assert sides["control"]["n"] == 9 and sides["synthetic"]["dcr_median"] == 0.0 and sides["control"]["dcr_low"] <= sides["control"]["dcr_median"] <= sides["control"]["dcr_high"]


def test_pairs(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 4.0, 5.0), (3.0, 7.0, 5.0), (None, 9.0, 5.0)], "a double, b double, c double")
    got = {(r.left, r.right): r.r for r in pairs.pearson(df, [("a", "b"), ("a", "c")]).collect()}
    assert got["a", "b"] == pytest.approx(0.9933992677987828) and got["a", "c"] is None
    assert pairs.spearman(df, "a", "b").first().rho == pytest.approx(1.0)
    assert len(pairs.pair_families([C(f"n{i}", "integer") for i in range(70)])) == 2415
    with pytest.raises(EngineError):
        pairs.pair_families([C(f"n{i}", "integer") for i in range(71)])


BOOK = [C("sex", "categorical", nullable=True, public_categories=("F", "M")), C("age", "integer", public_bins=(0, 18, 65, 120)), C("joined", "date", public_bins=("2020-01-01", "2022-01-01", "2025-01-01"))]


def test_codebook(spark):
    book = Codebook.of(BOOK)
    assert book.domain() == {"sex": 3, "age": 3, "joined": 2}
    df = spark.createDataFrame([(None, 120, dt.date(2021, 6, 1))], struct(BOOK))
    assert tuple(book.encode(df).first()) == (2, 2, 0)
    with pytest.raises(Exception, match="outside its public domain"):
        book.encode(spark.createDataFrame([("Q", 1, dt.date(2021, 6, 1))], struct(BOOK))).collect()
    codes = spark.range(300).select("id", (F.col("id") % 3).cast("int").alias("sex"), (F.col("id") % 3).cast("int").alias("age"), (F.col("id") % 2).cast("int").alias("joined"))
    back = book.decode(codes, "id").collect()
    assert all(r.sex == (None if r.id % 3 == 2 else "FM"[r.id % 3]) and (0, 18, 65)[r.id % 3] <= r.age <= (17, 64, 120)[r.id % 3] for r in back)
    with pytest.raises(EngineError):
        Codebook.of([C("a", "text")])


def test_capacity_gates():
    ok = lambda d: capacity(d)["admitted"]
    assert ok({f"c{i}": 256 for i in range(32)}) and not ok({f"c{i}": 2 for i in range(33)}) and not ok({"a": 257}) and not ok({"a": 1001, "b": 1000})
    with pytest.raises(EngineError):
        admit({"a": 1000, "b": 32})


def test_accounting_and_ledger(tmp_path):
    rho = accounting.rho_of(3, 1e-6)
    assert (rho, accounting.sigma_of(rho)) == (pytest.approx(0.18506984065340149, abs=1e-15), pytest.approx(2.846936654408663, abs=1e-14))
    book = accounting.Ledger(str(tmp_path / "l"))
    for run, eps, delta, states in (("a", "1.25", "0.000001", ("spent", "released")), ("b", "2.75", "0.000002", ("spent", "aborted")), ("c", "9", "0.1", ("aborted",))):
        book.record(run, "reserved", eps, delta)
        for s in states:
            book.record(run, s)
    assert book.spent() == (Decimal("4.00"), Decimal("0.000003"))
    with pytest.raises(EngineError):
        book.record("a", "spent")


def test_marginal_synthesizer(spark):
    schema = [C("a", "categorical", public_categories=("x", "y")), C("b", "categorical", public_categories=("p", "q")), C("n", "integer", public_bins=(0, 10, 20))]
    df = spark.range(4000).select(F.when(F.col("id") % 4 == 0, "x").otherwise("y").alias("a"), F.when(F.col("id") % 4 == 0, "p").otherwise("q").alias("b"), (F.col("id") % 20).alias("n"))
    out = mst.synthesize(df, Codebook.of(schema), 5.0, 1e-5, 3000, 1)
    assert out.count() == 3000
    assert out.where("(a = 'x') = (b = 'p')").count() > 2800 and 600 < out.where("a = 'x'").count() < 900


def test_conditional_model_keeps_relations(spark):
    schema = [C("a", "categorical"), C("b", "categorical", nullable=True), C("n", "float")]
    df = spark.range(2000).select(F.when(F.col("id") % 2 == 0, "x").otherwise("y").alias("a"), F.when(F.col("id") % 2 == 0, "p").alias("b"), (F.col("id") % 100).cast("double").alias("n"))
    out = Conditional.fit(df, schema, 3).generate(0, 1000)
    assert out.count() == 1000 and out.where("(a = 'x') <> (b is not null)").count() == 0
    r = out.agg(F.min("n"), F.max("n"), F.avg("n")).first()
    assert r[0] >= 0 and r[1] <= 99 and 40 < r[2] < 60


def test_digests_and_csv(spark, tmp_path):
    schema = [C("count", "integer"), C("price", "fixed_decimal", decimal_places=2), C("ratio", "float"), C("day", "date"), C("at", "datetime", timezone="UTC"), C("on", "boolean"), C("cat", "categorical"), C("note", "text", nullable=True)]
    rows = [(1, Decimal("1.50"), -0.0, dt.date(1960, 1, 2), dt.datetime(1969, 12, 31, 23, 59, 59, 5), True, " a ", None), (2, Decimal("-0.01"), 1e300, dt.date(2020, 2, 29), dt.datetime(2020, 1, 1), False, 'q"u,o\nte', ""), (3, Decimal(0), 0.1, dt.date(1970, 1, 1), dt.datetime(1970, 1, 1), True, "\\", "é <b>")]
    df = spark.createDataFrame(rows, struct(schema))
    h = hashlib.sha256()
    import struct as s
    import unicodedata

    for r in rows:
        day = (r[3] - dt.date(1970, 1, 1)).days
        micros = (r[4] - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1)
        body = [str(r[0]).encode(), str(int(r[1] * 100)).encode(), s.pack("<d", r[2]), s.pack("<q", day), s.pack("<q", micros), b"\1" if r[5] else b"\0", b"s" + r[6].encode(), None if r[7] is None else b"s" + unicodedata.normalize("NFC", r[7]).encode()]
        for b in body:
            cell = b"\0" if b is None else b"\1" + b
            h.update(s.pack("<Q", len(cell)) + cell)
    assert export.content_sha256(df, schema, ["count"]) == h.hexdigest()
    marker = export.write_csv(df, str(tmp_path / "c"), schema)
    assert export.equivalent(df, str(tmp_path / "c"), marker, schema).first().equal
    assert not export.equivalent(df.limit(2), str(tmp_path / "c"), marker, schema).first().equal
    a, b = (export.content_tree(d, schema, "count").first() for d in (df, df.repartition(3)))
    assert a == b and a.n == 3
    assert export.null_marker(spark.createDataFrame([(marker,)], "note string"), [schema[7]]) != marker


def test_parquet_manifest(spark, tmp_path):
    schema = [C("n", "integer")]
    folder = str(tmp_path / "p")
    export.publish_parquet(spark.range(100).select(F.col("id").alias("n")), folder, "n")
    with pytest.raises(EngineError):
        export.publish_parquet(spark.range(1), folder)
    stated = export.manifest(spark, folder, schema, ["n"])
    export.verify_manifest(spark, folder, stated, schema, ["n"])
    with pytest.raises(EngineError):
        export.verify_manifest(spark, folder, stated | {"row_count": 99}, schema, ["n"])
    (tmp_path / "x").write_text("content")
    assert export.archive({"a": str(tmp_path / "x")}, str(tmp_path / "1.zip")) == export.archive({"a": str(tmp_path / "x")}, str(tmp_path / "2.zip"))


def test_output_check(spark):
    schema = [C("id", "identifier", role="identifier", identifier_strategy="sequential", format=r"ID-\d{3}"), C("cat", "categorical", nullable=True), C("n", "integer")]
    df = lambda rows: spark.createDataFrame(rows, struct(schema))
    good = [("ID-001", "a", 1), ("ID-002", "a", 2), ("ID-003", None, 3)]
    found = export.check_output(df(good), schema, 3)
    assert found["cat"]["n_null"] == 1 and found["id"]["n_distinct"] == 3 and found["id"]["n_duplicate"] == 0
    for bad, n in ((good, 4), ([*good[:2], ("ID-001", "a", 1)], 3), ([("ID-1", "a", 1)], 1), ([("ID-001", "a", None)], 1)):
        with pytest.raises(EngineError):
            export.check_output(df(bad), schema, n)
    with pytest.raises(EngineError):
        export.check_output(df(good).select("cat", "id", "n"), schema, 3)


def test_estimates_states_and_reports():
    d = estimates.disk(101, Decimal("0.5"), 3, Decimal("10.1"), 7, Decimal("4.2"), Decimal("8.1"), 17, 4 << 30)
    assert (d["raw_parquet"], d["normalized_parquet"], d["generated_parquet"], d["csv"], d["parquet_zip64"], d["required"]) == (66, 40, 45, 86, 46, (30 << 30) + 300)
    assert [estimates.candidate_batch(x) for x in (1, 1024, 1 << 20)] == [250_000, 131_072, 10_000]
    assert estimates.step("profiled", "schema_ready") == "schema_ready"
    with pytest.raises(EngineError):
        estimates.step("uploading", "normalized")
    assert report.release({"epsilon": 1, "fit_seed": 2}, {"actual_rows": 3})["privacy"] == {"epsilon": 1}
    with pytest.raises(EngineError):
        report.release({}, {"columns": [{"deep": {"raw_examples": []}}]})
    assert "&lt;b&gt;" in report.as_html({"a": ["<b>"]})


def test_two_sample_test_and_attacks(spark):
    schema = [C("x", "float"), C("c", "categorical")]
    make = lambda shift, salt: spark.range(400).select((F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(1000)) / 1000 + shift).alias("x"), (F.col("id") % 3).cast("string").alias("c"), F.col("id").alias("k"))
    train, same, far = make(0, 1), make(0, 2), make(0.8, 3)
    assert classify.c2st(train, train, far, schema, seeds=(0,)).first().auc > 0.9
    assert abs(classify.c2st(train, train, same, schema, seeds=(0,)).first().auc - 0.5) < 0.15
    assert classify.c2st(train, train.limit(2), same, schema).first().auc is None
    assert {r.reason for r in classify.downstream(train, same, far, schema, "zz", "classification").collect()} == {"unknown_target"}
    assert attacks.inference(train, train, schema, "c", ["x"], "k", 50).first().rate > 0.8
    assert attacks.linkability(train, train, schema, ["x"], ["x", "c"], "k", 50).first().rate > 0.8
    both = attacks.singling_out_together(train, train, schema, 20, 2, seeds=(0, 1)).first()
    assert both.hits == both.n  # what singles out a synthetic row singles out the same row of an equal target
    assert attacks.wilson(0, 0) == (0.0, 0.0, 1.0) and attacks.wilson(5, 10)[1] < 0.5 < attacks.wilson(5, 10)[2]
    auc = classify.auc_rank_sum(spark.createDataFrame([(1.0, 0), (2.0, 0), (2.0, 1), (3.0, 1)], "s double, y int"), "s", "y").first()
    assert auc.auc == 0.875


def test_numbering(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("v"), (F.col("id") % 5).alias("g"))
    got = normalize.numbered(df, ["g", "v"], "n").orderBy("n").collect()
    assert [(r.g, r.v) for r in got] == sorted((i % 5, i * 37 % 1000) for i in range(1000)) and [r.n for r in got] == list(range(1000))


def test_fixture(spark):
    df = scale_fixture(spark, 100)
    assert len(df.columns) == 70 and df.columns == [c.name for c in scale_schema()]
    r = df.where("record_id = 34").first()
    assert (r.category_00, r.integer_00, r.employee_total, r.status, r.text_03) == ("cat_00", 578, 34 + 102 % 97, "active", "txt03_00000034")


def test_two_sample_test_has_seeds_control_and_interval(spark):
    from tabforge.queries import evaluation

    rows = {r.comparison: r for r in evaluation.c2st_linear_auc(spark, "/root/testdata/sf0.001").collect()}
    assert rows["synthetic"].n == rows["control"].n > 100
    assert all(r.low < r.auc < r.high for r in rows.values())
    assert rows["control"].low < 0.5 < rows["control"].high and rows["synthetic"].low > rows["control"].high
    assert classify.TREES["maxIter"] == 200 and classify.SEEDS == (0, 1, 2, 3, 4)
    counts = np.array([3, 1, 0, 2]), np.array([1, 1, 4, 0])
    score, label = [x for v in (0, 1) for x in np.repeat(range(4), counts[1 - v])], [v for v in (0, 1) for _ in range(int(counts[1 - v].sum()))]
    pairs_ = [(a > b) + (a == b) / 2 for a, x in zip(score, label, strict=True) for b, y in zip(score, label, strict=True) if x == 1 and y == 0]
    assert abs(classify._auc(*counts) - np.mean(pairs_)) < 1e-12


def test_ranges_match_numpy(spark):
    from tabforge.operators import ranges

    rng = np.random.default_rng(3)
    for values in (rng.normal(size=5000).round(2), rng.integers(0, 3, 400).astype(float), np.array([7.0]), np.array([])):
        df = spark.createDataFrame([(float(v), None) for v in values] + [(None, None)], "x double, y double").repartition(3)
        got = ranges.quantiles_of(df, {"x": F.col("x"), "y": F.col("y")}, (0.0, 0.013, 0.5, 0.99, 1.0))
        assert got["y"] is None
        assert got["x"] == (pytest.approx(np.quantile(values, [0.0, 0.013, 0.5, 0.99, 1.0])) if len(values) else None)
    cuts = spark.range(600).select("id", ranges.place(F.col("id"), F.array(*(F.lit(2 * i) for i in range(255)))).alias("p"), ranges.place(F.col("id"), F.array(F.lit(3), F.lit(5))).alias("t")).collect()
    assert all(r.p == sum(r.id > 2 * i for i in range(255)) and r.t == (r.id > 3) + (r.id > 5) for r in cuts)
