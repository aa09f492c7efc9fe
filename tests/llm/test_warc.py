import gzip
import hashlib
import io
import base64

import pytest

from tabforge.llm import warc


def b32(b: bytes) -> str:
    return base64.b32encode(hashlib.sha1(b).digest()).decode()


def test_round_trip(spark, tmp_path):
    big = "é" * 200_000
    pages = [(1, "http://a/ b", "x"), (2, None, "x"), (3, "u", None), (4, "u", ""), (5, "u", big), (6, "u", big), (7, "u", "same"), (7, "u", "same"), (None, "u", "x"), (None, "u", "alone"), (8, "u", "same")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    folder = f"file://{tmp_path}/w"
    archives = warc.write_archives(df, folder, roll_bytes=300)
    got = warc.read_archives(archives, folder, payload=True).collect()
    assert archives.count() >= 3
    first = {}
    for i, _, h in pages:
        p = (h or "").encode()
        if i is not None:
            first[p] = min(i, first.get(p, i))
    rows = sorted((-1 if r.page_id is None else r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got)
    want = []
    for i, _, h in pages:
        p = (h or "").encode()
        to = first.get(p)
        to = None if to == i else to
        want.append((-1 if i is None else i, len(p), b32(p), "response" if to is None else "revisit", to))
    assert sorted(rows, key=str) == sorted(want, key=str)
    assert {bytes(r.payload).decode() for r in got if r.record_type == "response"} == {"x", "", big, "same", "alone"}
    small = warc.read_archives(warc.write_archives(df, f"file://{tmp_path}/v", least_bytes=1), f"file://{tmp_path}/v")
    assert small.where("payload_bytes = 0 and record_type = 'response'").count() == 2
    assert warc.write_archives(df.limit(0), folder).count() == 0


def read(b: bytes) -> list:
    return list(warc.read_records(io.BytesIO(b), True))


def test_reader_frames_and_verifies():
    good = warc.info_member() + warc.page_member(1, "u", b"abc" * 100_000, None)
    assert [r.headers["warc-type"] for r in read(good)] == ["warcinfo", "response"]
    raw = gzip.decompress(warc.page_member(1, "u", b"hello", None))
    for bad in (raw.replace(b"hello", b"jello"), raw.replace(b"Content-Length: ", b"Content-Length: 1"), raw[:-1], raw + b"x", raw.replace(b"WARC/1.1", b"WORK/1.1"), raw[:40]):
        with pytest.raises(warc.WarcError):
            read(gzip.compress(bad))
    for bad in (good[:-5], b"plain text", gzip.compress(raw + raw)):
        with pytest.raises(warc.WarcError):
            read(bad)


def test_foreign_archives_and_bad_records(spark, tmp_path):
    raw = gzip.decompress(warc.page_member(1, "u", b"hello", None))
    foreign = raw.replace(b"<urn:page:1>", b"<urn:uuid:6d3e8f3a-0000-4000-8000-000000000000>")
    no_type = raw.replace(b"WARC-Type: response\r\n", b"")
    other = raw.replace(b"sha1:" + b32(b"hello").encode(), b"md5:abc")
    (tmp_path / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, (foreign, no_type, raw.replace(b"hello", b"jello"), other))))
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(raw) + gzip.compress(raw[:-9]) + gzip.compress(raw))
    archives = spark.createDataFrame([(f"{tmp_path}/{n}.warc.gz",) for n in "ab"], "path string")
    got = sorted((r.path[-9], r.record_id or "", r.page_id or 0, r.payload_bytes or 0, r.error or "") for r in warc.read_archives(archives, f"file://{tmp_path}").collect())
    assert [g[:4] for g in got] == [("a", "<urn:page:1>", 1, 5), ("a", "<urn:page:1>", 1, 5), ("a", "<urn:uuid:6d3e8f3a-0000-4000-8000-000000000000>", 0, 5), ("b", "", 0, 0), ("b", "<urn:page:1>", 1, 5)]
    assert [bool(g[4]) for g in got] == [False, True, False, True, False] or [bool(g[4]) for g in got] == [True, False, False, True, False]


def test_hot_payloads_are_not_one_task(spark, tmp_path):
    """Nine tenths of the pages are equal; each partition writes its own share of them."""
    df = spark.range(2000, numPartitions=8).selectExpr("id as page_id", "'u' as url", "if(id % 10 = 0, concat('own ', id), repeat('same ', 50)) as html", "1 as sha", "2 as first", "3 as refers_to")
    archives = warc.write_archives(df, f"file://{tmp_path}/h").collect()
    assert sum(a.records for a in archives) >= 2000 and max(a.records for a in archives) < 800
    got = warc.read_archives(spark.createDataFrame(archives), f"file://{tmp_path}/h")
    assert got.where("record_type = 'revisit' and refers_to = 1").count() == 1799 and got.where("error is not null").count() == 0


@pytest.mark.parametrize("hot", (0, 2))
def test_payloads_beyond_the_hot_ones(spark, tmp_path, monkeypatch, hot):
    monkeypatch.setattr(warc, "HOT", hot)
    df = spark.range(60).selectExpr("id as page_id", "'u' as url", "concat('text ', id % 20) as html")
    got = warc.read_archives(warc.write_archives(df, f"file://{tmp_path}/g"), f"file://{tmp_path}/g").collect()
    assert sorted((r.page_id, r.refers_to) for r in got) == [(i, i % 20 if i >= 20 else None) for i in range(60)]
