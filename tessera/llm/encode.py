"""Token ids of whole texts, as the ``tokenizers`` library gives them, faster.

The file's vocabulary is byte-level, so its merges are ranks and a second
library can apply them.  The splitting pattern's look-ahead only matters where
white space follows white space; other texts take the same pattern without it,
which is twice as fast.  Texts with a special token's string, or with characters
beyond Latin letters, that the two libraries' tables might class differently, go
to ``tokenizers`` itself.
"""

from __future__ import annotations

import json
import re
import sys
from array import array

import numpy as np

_DOUBLED = re.compile(r"\s\s")
_BEYOND = re.compile("[^\0-ɏ‐-•…]")
#: The splitting pattern of the vocabulary, without and with its look-ahead.
_PARTS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|"
_PLAIN, _FULL = _PARTS + r"\s", _PARTS + r"\s+(?!\S)|\s+"
_encoders: dict = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids as ``Tokenizer.from_file(path).encode(text, add_special_tokens=False)`` gives them."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            read = json.load(f)
        added = {t["content"]: t["id"] for t in read.get("added_tokens", [])}
        self.special = list(added)
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        letters = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
        ranks = {bytes(letters[c] for c in t): i for t, i in read["model"]["vocab"].items() if t not in added}
        self.plain, self.full = (tiktoken.Encoding("own", pat_str=p, mergeable_ranks=ranks, special_tokens={}) for p in (_PLAIN, _FULL))
        #: Bytes of each id's token.
        self.byte_lengths = np.zeros(max([*ranks.values(), *added.values()]) + 1, np.int64)
        for token, i in [*ranks.items(), *((t.encode(), i) for t, i in added.items())]:
            self.byte_lengths[i] = len(token)

    def ids(self, text: str | None) -> bytes:
        """Little-endian uint32 ids of a whole text; none for null."""
        if not text:
            return b""
        if any(s in text for s in self.special) or not text.isascii() and _BEYOND.search(text):
            ids = array("I", self.whole.encode(text, add_special_tokens=False).ids)
        else:
            ids = array("I", (self.full if _DOUBLED.search(text) else self.plain).encode_ordinary(text))
        if sys.byteorder != "little":
            ids.byteswap()
        return ids.tobytes()


def encoder(path: str) -> Encoder:
    """One for each file and worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
