"""Token ids of whole texts under the public byte-level vocabulary.

``tokenizers`` defines the ids; ``tiktoken`` reads the same vocabulary as ranks and gives the same ids several times
faster.  Texts that hold a special token's string, and any that ``tiktoken`` panics on, go through ``tokenizers`` itself.
"""

from __future__ import annotations

import base64
import functools
import json
import re
from collections.abc import Iterator

import numpy as np

PIECE = 1 << 20
#: Before a space that follows a letter both libraries begin a new unit, so a text may be cut there.
_CUT = re.compile("[a-z](?= )")


class ByteTokenizer:
    def __init__(self, json_path: str, ranks_path: str | None = None):
        self.json_path = json_path
        with open(json_path, encoding="utf-8") as f:
            self.special = [t["content"] for t in json.load(f)["added_tokens"]]
        self.fast = None
        if ranks_path:
            import public_tokenizers
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    @functools.cached_property
    def slow(self):
        """Made only where a text needs it: it takes several times the memory of the ranks."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.json_path)

    def _piece(self, text: str) -> list[int]:
        if self.fast is not None:
            try:
                return self.fast.encode_ordinary(text)
            except BaseException as e:  # the library panics on some inputs, such as runs of millions of one character; that alone is answered
                if type(e).__name__ != "PanicException":
                    raise
        return self.slow.encode(text, add_special_tokens=False).ids

    def ids(self, text: str) -> np.ndarray:
        """All ids of a text; a long one is taken in parts of about a megabyte, at places where no id spans the cut."""
        if any(s in text for s in self.special):
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, "<u4")
        if len(text) <= PIECE:
            return np.array(self._piece(text), "<u4")
        return np.concatenate([np.array(self._piece(p), "<u4") for p in _parts(text)])


def _parts(text: str) -> Iterator[str]:
    at = 0
    while at < len(text):
        m = _CUT.search(text, at + PIECE) if at + PIECE < len(text) else None
        end = m.end() if m else len(text)
        yield text[at:end]
        at = end


def tokenizer_files(folder: str | None = None) -> tuple[str, str]:
    """The vocabulary in ``folder``, or as the installed package names it: for ``tokenizers``, and as ranks."""
    if folder is not None:
        return f"{folder}/byte_bpe_50k.json", f"{folder}/byte_bpe_50k.tiktoken"
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


@functools.cache
def byte_tokenizer(folder: str | None = None) -> ByteTokenizer:
    return ByteTokenizer(*tokenizer_files(folder))
