"""Vocabulary files: where they are and what is in them. Their place is always a parameter."""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np


def public(name: str) -> str:
    """The place of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_symbols() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies.

    Printable Latin-1 characters stand for themselves; the others follow from U+0100 on, in order.
    """
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, extra = [], 0
    for b in range(256):
        out.append(chr(b if b in plain else 0x100 + extra))
        extra += b not in plain
    return out


class Merges:
    """The merges of a BPE vocabulary as sorted arrays: pairs of ids, their ranks and what they make."""

    #: The rank of a pair that doesn't merge.
    NEVER = np.int32(2**31 - 1)

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"] if x["special"]}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.size = max([*self.vocab.values(), *self.special.values()]) + 1
        self.left = np.array([self.vocab[a] for a, _ in pairs], np.int32)
        self.right = np.array([self.vocab[b] for _, b in pairs], np.int32)
        self.made = np.array([self.vocab[a + b] for a, b in pairs], np.int32)
        keys = self.left.astype(np.int64) * self.size + self.right
        order = np.argsort(keys, kind="stable")
        self._keys, self._ranks = keys[order], order.astype(np.int32)
        symbols = byte_symbols()
        self.bytes = np.array([self.vocab[s] for s in symbols], np.int32)
        self.last = np.array([self.vocab[s + self.suffix] for s in symbols], np.int32) if self.suffix else self.bytes
        self._first_made = np.full(self.size, -1, np.int32)
        self._first_made[self.made[::-1]] = np.arange(len(pairs), dtype=np.int32)[::-1]
        # Every merge comes after those that make its parts: then ascending ranks over all words are each word's own order.
        assert (np.maximum(self._first_made[self.left], self._first_made[self.right]) < np.arange(len(pairs))).all(), "merges out of order"

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids, NEVER where there is none."""
        keys = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self._keys, keys), len(self._keys) - 1)
        return np.where(self._keys[at] == keys, self._ranks[at], self.NEVER)


@lru_cache(maxsize=4)
def merges(path: str) -> Merges:
    """Read once a Python worker."""
    return Merges(path)
