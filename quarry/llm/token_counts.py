"""Token counts by rank-synchronous array merging.

Pre-tokens are held together as ragged arrays: their byte symbols, one after the other, and where each
begins. A round finds each pre-token's lowest rank, merges that pair everywhere it stands in it, for
all pre-tokens at once, and sets aside those that have none left. What survives is counted.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import PieceCache, documents, extend, filled, pieces
from quarry.llm.tokenizer_files import Merges, merges, public

#: Fixed value: how byte-level vocabularies of this family split text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LIMIT = 512


def surviving(rules: Merges, words: list[bytes]) -> np.ndarray:
    """How many tokens each of `words` has; an empty one has none."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    counts = np.zeros(len(words), np.int64)
    ids = np.flatnonzero(lengths)
    size = lengths[ids]
    sym = rules.bytes[np.frombuffer(b"".join(words), np.uint8)]
    rank = np.full(len(sym), rules.NEVER, np.int32)
    if len(sym) > 1:
        rank[:-1] = rules.ranks(sym[:-1], sym[1:])
    if len(size):
        rank[np.cumsum(size) - 1] = rules.NEVER  # the last symbol of a word has no right neighbour
    while len(ids):
        start = np.cumsum(size) - size
        low = np.minimum.reduceat(rank, start)
        live = low < rules.NEVER
        if not live.all():
            counts[ids[~live]] = size[~live]
            on = np.repeat(live, size)
            ids, size, low, sym, rank = ids[live], size[live], low[live], sym[on], rank[on]
            if not len(ids):
                break
        hit = rank == np.repeat(low, size)
        at = np.flatnonzero(hit)
        if (touch := hit[at - 1] & (at > 0)).any():  # a run of one symbol: every second pair, from the left
            head = np.maximum.accumulate(np.where(touch, 0, np.arange(len(at))))
            at = at[(np.arange(len(at)) - head) % 2 == 0]
        sym[at] = rules.made[rank[at]]
        keep = np.ones(len(sym), bool)
        keep[at + 1] = False
        rank[at] = rank[at + 1]  # keeps the mark of a word's end
        word = np.repeat(np.arange(len(ids)), size)
        size = size - np.bincount(word[at], minlength=len(ids))
        end = np.cumsum(size) - 1
        at = (np.cumsum(keep) - 1)[at]
        sym, rank = sym[keep], rank[keep]
        stale = np.unique(np.concatenate([at, at[at > 0] - 1]))
        final = np.zeros(len(sym), bool)
        final[end] = True
        rank[stale[final[stale]]] = rules.NEVER
        stale = stale[~final[stale]]
        rank[stale] = rules.ranks(sym[stale], sym[stale + 1])
    return counts


class Counter:
    def __init__(self, path: str):
        self.rules = merges(path)
        self.split = regex.compile(PATTERN).findall
        self.special = regex.compile("(" + "|".join(map(regex.escape, self.rules.special)) + ")").split if self.rules.special else None
        self.marks = tuple(self.rules.special)
        self.tails, self.heads = PieceCache(lambda new: self.count([" " + x for x in new])), PieceCache(self.count, 20_000)

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each of `texts`, each as if alone."""
        words, owner, counts = [], [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            if any(m in text for m in self.marks):
                parts = self.special(text)
                counts[i] += len(parts) // 2
                found = [w for p in parts[::2] for w in self.split(p)]
            else:
                found = self.split(text)
            words += found
            owner += [i] * len(found)
        if words:
            counts += np.bincount(owner, surviving(self.rules, [w.encode() for w in words]), len(texts)).astype(np.int64)
        return counts.tolist()

    def __call__(self, texts: pa.Array) -> dict:
        codes, bounds, distinct = pieces(filled(texts), leading=True)
        n = len(distinct) - len(texts)
        known = np.array(self.tails.get(distinct[:n]) + [self.heads.get([h])[0] for h in distinct[n:]], np.int64)
        return {"n_tokens": np.add.reduceat(known[codes], bounds[:-1]) if len(texts) else []}


@lru_cache(maxsize=2)
def _counter(path: str) -> Counter:
    return Counter(path)


def token_counts(docs: DataFrame, *, path: str, text: str = "text") -> DataFrame:
    """`docs` with `n_tokens`: how many ids the byte-level BPE vocabulary at `path` gives each whole text.

    No begin or end tokens; the vocabulary's special strings count as one token each. Null and empty
    texts have 0. A column `n_tokens` that is there already is replaced, others pass through, rows
    that repeat stay, and an empty table stays empty. Texts of any length are counted whole: a task holds one
    text with its distinct words. Works within partitions: no shuffle, and a word is merged once while a
    worker remembers it.
    """
    return extend(docs, text, {"n_tokens": (T.LongType(), pa.int64())}, lambda: _counter(path))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts(documents(spark, sf_dir).select("doc_id", "text"), path=public("byte_bpe_50k.json"))
    return counted.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
