import re
import zlib

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tabforge.llm import text as T
from tabforge.llm.tokens import ByteTokenizer, byte_tokenizer, tokenizer_files

WORD = re.compile(T.WORD)
LOW = str.maketrans(T.UPPER, T.LOWER)


def plain(t: str) -> list[str]:
    return WORD.findall(t.translate(LOW))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text()), max_size=8))
def test_words_are_those_of_the_pattern(texts):
    names: dict = {}
    got = [w for part in T.words(pa.array(texts, pa.string())) for i in range(len(part.at) - 1) for w in [part.of(i)]]
    want = [plain(t or "") for t in texts]
    assert [len(g) for g in got] == [len(w) for w in want]
    for g, w in zip(got, want, strict=True):
        for h, word in zip(g.tolist(), w, strict=True):
            assert names.setdefault(word, h) == h
    assert len(set(names.values())) == len(names)


def test_long_texts_are_cut_between_words_only(monkeypatch):
    monkeypatch.setattr(T, "SLICE", 64)
    texts = ["alpha beta " * 40, "z" * 500 + " end", "", "short"]
    for part in T.words(pa.array(texts)):
        for i in range(len(part.at) - 1):
            alone = np.concatenate([w.hashes for w in [T._words(np.frombuffer(texts[part.first + i].encode(), np.uint8), np.array([0, len(texts[part.first + i].encode())]), 0)]])
            assert (part.of(i) == alone).all()
    sliced = [w for w in T.words(pa.array(texts), whole=False) if w.first == 0]
    assert sum(len(w.hashes) for w in sliced) == 80 and len(sliced) > 1


def test_grams_windows_and_shingles():
    h = T._words(np.frombuffer(b"a b c d a b c d", np.uint8), np.array([0, 15]), 0).hashes
    g = T.grams(h, 4)
    assert g[0] == g[4] and len(set(g.tolist())) == 4
    assert T.window_min(np.array([5, 3, 4, 1, 2]), 3).tolist() == [3, 1, 1]
    assert len(T.shingles(h, 4)) == 4 and len(T.shingles(h[:2], 4)) == 1 and len(T.shingles(h[:0], 4)) == 0


def test_both_tokenizers_give_the_same_ids():
    fast, slow = byte_tokenizer(), ByteTokenizer(tokenizer_files()[0])
    for t in ("", "Hello  world\n\n it's 1234 €", "<|endoftext|> in text", "\t x" * 50, "日本語 ñandú 🙂", " " * 300, "a" * 3000):
        assert fast.ids(t).tolist() == slow.slow.encode(t, add_special_tokens=False).ids, t


def test_cut_texts_keep_their_ids(monkeypatch):
    from tabforge.llm import tokens

    whole = byte_tokenizer().ids(t := "some words  and\nlines, 12 of them " * 60)
    monkeypatch.setattr(tokens, "PIECE", 50)
    assert zlib.crc32(byte_tokenizer().ids(t).tobytes()) == zlib.crc32(whole.tobytes())
