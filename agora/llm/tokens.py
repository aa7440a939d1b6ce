"""Byte-level BPE ids as the tokenizers library gives them, at the speed of tiktoken.

A vocabulary is given by the path of its tokenizers JSON file. The driver reads the
file and broadcasts it (about 1.5 MB); each Python worker builds its encoder once. Encoding
equals ``tokenizers.Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids`` with
truncation and padding off: strings of special tokens inside a text become their ids.
"""

from __future__ import annotations

import json


import numpy as np
from pyspark import Broadcast
from pyspark.sql import SparkSession

#: Fixed value: how byte-level BPE of this family cuts a text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters that are encoded at once; longer texts are cut where it changes nothing.
PIECE = 1 << 16

_built: dict[int, Codec] = {}


def default_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of() -> dict[str, int]:
    """The byte that each character of a vocabulary entry stands for: printable bytes stand for
    themselves, the others are numbered on from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def safe_cut(text: str, at: int, low: int) -> int:
    """The last place in (low, at] where a text can be cut without changing its ids, or low: a
    space after an ASCII letter or digit always begins a token."""
    while (at := text.rfind(" ", low + 1, at + 1)) > low:
        before = text[at - 1]
        if before.isascii() and before.isalnum():
            return at
        at -= 1
    return low


class Codec:
    """Encodes and decodes with one vocabulary."""

    def __init__(self, content: bytes):
        import tiktoken
        self.content = content
        told = json.loads(content)
        byte = _byte_of()
        self.special = {t["content"]: t["id"] for t in told["added_tokens"]}
        ranks = {bytes(byte[c] for c in token): i for token, i in told["model"]["vocab"].items()
                 if token not in self.special}
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks,
                                          special_tokens=self.special)
        #: The smallest type that holds every id: what ids are shuffled as.
        self.dtype = "<u2" if max([*ranks.values(), *self.special.values()]) < 1 << 16 else "<u4"
        self._slow = None

    def _encode(self, text: str) -> list[int]:
        try:
            if any(s in text for s in self.special):
                return self.encoding.encode(text, allowed_special="all")
            return self.encoding.encode_ordinary(text)
        except BaseException as e:  # the fast encoder gives up on some very long runs
            if type(e).__name__ != "PanicException":
                raise
            from tokenizers import Tokenizer
            self._slow = self._slow or Tokenizer.from_str(self.content.decode())
            return self._slow.encode(text, add_special_tokens=False).ids

    def encode(self, text: str) -> list[int]:
        if len(text) <= PIECE:
            return self._encode(text)
        out, low = [], 0
        while len(text) - low > PIECE:
            cut = safe_cut(text, low + PIECE, low)
            if cut == low:  # no such place: go on until there is one
                cut = next((i for i in range(low + PIECE, len(text)) if safe_cut(text, i, i - 1) == i), len(text))
            out += self._encode(text[low:cut])
            low = cut
        return out + self._encode(text[low:]) if low < len(text) else out

    def encode_array(self, text: str) -> np.ndarray:
        return np.array(self.encode(text), "<u4")

    def decode(self, ids: list[int]) -> str:
        """The text of the ids, special tokens included; bytes that form no character are replaced."""
        return self.encoding.decode(ids, errors="replace")


def share(spark: SparkSession, path: str | None = None) -> Broadcast:
    with open(path or default_path(), "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def codec(shared: Broadcast) -> Codec:
    """The worker's encoder for a shared vocabulary."""
    content = shared.value
    key = hash(content)
    if key not in _built:
        _built[key] = Codec(content)
    return _built[key]


