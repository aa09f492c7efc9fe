import bisect
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tabforge.llm.packing import OpenBins, pack, pieces, plan, sequences
from tabforge.llm.tokens import ByteTokenizer, byte_tokenizer, tokenizer_files


def best_fit(lengths: list[int], capacity: int) -> int:
    """Bins that best-fit decreasing opens, one piece at a time."""
    bins: list[int] = []
    for n in sorted(lengths, reverse=True):
        i = bisect.bisect_left(bins, n)
        left = bins.pop(i) if i < len(bins) else capacity
        bisect.insort(bins, left - n)
    return len(bins)


def test_tightest_open_bin():
    t = OpenBins(20)
    assert t.tightest(1) is None
    for c in (3, 9, 17):
        t.mark(c, True)
    assert [t.tightest(n) for n in (1, 3, 4, 10, 18)] == [3, 3, 9, 17, None]
    t.mark(9, False)
    assert t.tightest(4) == 17


@pytest.mark.parametrize("seed", range(12))
def test_plan_is_best_fit_decreasing(seed):
    draw = random.Random(seed)
    capacity = draw.choice((7, 30, 100))
    lengths = [draw.randint(1, capacity) for _ in range(draw.randint(1, 400))]
    rows = plan({n: lengths.count(n) for n in set(lengths)}, capacity)
    places = []
    for n in set(lengths):
        own = rows[rows[:, 0] == n]
        own = own[np.argsort(own[:, 1])]
        for rank in range(lengths.count(n)):
            _, first, bin_, each, offset = own[np.searchsorted(own[:, 1], rank, "right") - 1]
            places.append((bin_ + (rank - first) // each, offset + (rank - first) % each * n, n))
    places.sort()
    end: dict[int, int] = {}
    for bin_, offset, n in places:
        assert end.get(bin_, 0) == offset
        end[bin_] = offset + n
    assert max(end.values()) <= capacity and len(end) == best_fit(lengths, capacity)


def test_pieces_and_sequences(spark, docs, corpus, empty, clashing):
    packed = pack(pieces(docs, capacity=64, ids=True), 64)
    rows = packed.collect()
    slow = ByteTokenizer(tokenizer_files()[0]).slow
    want = {i: [*slow.encode(t or "", add_special_tokens=False).ids, 2] for i, t, *_ in corpus}
    by_doc: dict[int, list] = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        own = want[r.doc_id][r.start : r.start + r.length]
        assert list(r.ids) == own and r.ids_crc32 == zlib.crc32(np.array(own, "<u4").tobytes())
    assert by_doc.keys() == want.keys()
    for i, own in by_doc.items():
        own.sort(key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and sum(r.length for r in own) == len(want[i])
        assert all(r.length == 64 for r in own[1:])
    for r in sequences(packed).collect():
        assert len(r.ids) <= 64
    assert len({r.sequence_id for r in rows}) == best_fit([r.length for r in rows], 64)
    assert pack(pieces(empty)).count() == 0
    assert pieces(clashing).columns == pieces(docs).columns


def test_lengths_out_of_range(spark):
    with pytest.raises(ValueError):
        pack(spark.createDataFrame([(1, 65)], "doc_id long, length long"), 64)


def test_equal_rows_spread(spark):
    """Rows equal in all columns are not ranked by one task."""
    packed = pack(spark.range(4000).selectExpr("cast(null as long) as doc_id", "cast(10 as long) as length").repartition(8), 64)
    rows = packed.collect()
    assert len(rows) == 4000 and len({(r.sequence_id, r.offset) for r in rows}) == 4000 and len({r.sequence_id for r in rows}) == -(-4000 // 6)
    from pyspark.sql import functions as F

    buckets = spark.range(4000).select(F.pmod(F.xxhash64(F.lit(None).cast("long"), F.lit(10), F.monotonically_increasing_id()), F.lit(256)).alias("b")).groupBy("b").count()
    assert buckets.agg(F.max("count")).first()[0] < 100


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(codec="utf-8"), max_size=200) | st.text("aé ßÄ\u0301\u200d1'٣Ⅷ\n\t\u3000漢😀ǅ", max_size=80))
def test_ranks_give_the_ids_of_tokenizers(text):
    fast = byte_tokenizer()
    assert fast.ids(text).tolist() == fast.slow.encode(text, add_special_tokens=False).ids
