"""BPE encoding and decoding with a pair occurrence index.

The distinct new words of a partition lie one after the other in arrays of symbols. An index maps each
pair that can merge to all its positions. Ranks that are active are taken in ascending order; a rank's
positions are merged together, and the lists of the pairs that this makes are updated.
"""

from __future__ import annotations

import heapq
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import PieceCache, documents, extend, filled, pieces
from quarry.llm.tokenizer_files import Merges, merges, public

#: Fixed value: the words that vocabularies of this family merge; what lies between them is dropped.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Text that a task indexes at once.
INDEX_BYTES = 2 << 20


def encode_words(rules: Merges, words: list[bytes]) -> list[np.ndarray]:
    """The ids of each of `words` (none is empty)."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    stop = np.cumsum(size)
    raw = np.frombuffer(b"".join(words), np.uint8)
    sym = rules.bytes[raw]
    sym[stop - 1] = rules.last[raw[stop - 1]]
    n = len(sym)
    after = np.arange(1, n + 1, dtype=np.int64)
    before = np.arange(-1, n - 1, dtype=np.int64)
    after[stop - 1] = -1
    before[stop - size] = -1
    alive = np.ones(n, bool)
    index: dict[int, list[np.ndarray]] = {}
    active: list[int] = []

    def note(at: np.ndarray) -> None:
        """Adds the pairs that begin at `at` to the index."""
        rank = rules.ranks(sym[at], sym[after[at]])
        can = rank < rules.NEVER
        at, rank = at[can], rank[can]
        if not len(at):
            return
        order = np.argsort(rank, kind="stable")
        at, rank = at[order], rank[order]
        cut = np.flatnonzero(np.diff(rank)) + 1
        for r, places in zip(rank[np.concatenate([[0], cut])].tolist(), np.split(at, cut), strict=True):
            if (known := index.get(r)) is None:
                index[r] = [places]
                heapq.heappush(active, r)
            else:
                known.append(places)

    note(np.flatnonzero(after >= 0))
    while active:
        r = heapq.heappop(active)
        lists = index.pop(r)
        at = lists[0] if len(lists) == 1 else np.concatenate(lists)
        a, b = rules.left[r], rules.right[r]
        at = at[alive[at] & (sym[at] == a) & (after[at] >= 0)]
        at = at[sym[after[at]] == b]
        if a == b and len(at) > 1:  # a run of one symbol: every second pair, from the left
            at = np.sort(at)
            touch = np.concatenate([[False], after[at[:-1]] == at[1:]])
            place = np.arange(len(at))
            at = at[(place - np.maximum.accumulate(np.where(touch, 0, place))) % 2 == 0]
        if not len(at):
            continue
        gone = after[at]
        sym[at] = rules.made[r]
        alive[gone] = False
        follows = after[gone]
        after[at] = follows
        right = follows >= 0
        before[follows[right]] = at[right]
        left = before[at]
        note(np.unique(np.concatenate([at[right], left[left >= 0]])))
    ids = sym[alive]
    kept = np.add.reduceat(alive.astype(np.int64), stop - size) if len(size) else size
    return np.split(ids, np.cumsum(kept)[:-1]) if len(words) else []


class Codec:
    def __init__(self, path: str):
        self.rules = merges(path)
        self.find = regex.compile(PATTERN).findall
        self.marks = tuple(self.rules.special)
        self.special = regex.compile("(" + "|".join(map(regex.escape, self.marks)) + ")").split if self.marks else None
        self.names = {i: s for s, i in self.rules.vocab.items()} | {i: s for s, i in self.rules.special.items()}
        self.words = PieceCache(self.encode_new, 100_000)
        self.known = PieceCache(self.encode, 100_000)

    def encode_new(self, words: list[str]) -> list[tuple[bytes, bytes]]:
        return [(ids.astype("<u4").tobytes(), " ".join(map(self.names.__getitem__, ids.tolist())).encode()) for ids in encode_words(self.rules, [w.encode() for w in words])]

    def split(self, text: str) -> list[str]:
        text = unicodedata.normalize("NFC", text)
        return self.find(text.lower() if "Σ" not in text else "".join(c.lower() for c in text))

    def encode(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """(packed ids, decoded text) of each of `texts`, each as if alone."""
        found: list[list] = []
        for t in texts:
            if any(m in t for m in self.marks):
                found.append([w for i, p in enumerate(self.special(t)) for w in ([(p,)] if i % 2 else self.split(p))])
            else:
                found.append(self.split(t))
        new = list({w for ws in found for w in ws if isinstance(w, str)})
        table = dict(zip(new, self.words.get(new), strict=True))
        out = []
        for ws in found:
            if len(ws) == 1 and isinstance(ws[0], str):
                out.append(table[ws[0]])
                continue
            made = [table[w] if isinstance(w, str) else (np.array([self.rules.special[w[0]]], "<u4").tobytes(), w[0].encode()) for w in ws]
            out.append((b"".join([m[0] for m in made]), b" ".join([m[1] for m in made])))
        return out

    def __call__(self, texts: pa.Array) -> dict:
        codes, bounds, distinct = pieces(filled(texts), leading=False)  # a blank ends every word and is dropped
        made = self.known.get(distinct)
        out = {}
        for i, (name, kind, mark) in enumerate((("ids", pa.binary(), b""), ("decoded", pa.string(), " "))):
            full = np.fromiter((bool(m[i]) for m in made), bool, len(made))[codes]  # what has no words leaves no blank
            taken = pa.array([m[i] for m in made], pa.binary()).cast(kind).take(pa.array(codes[full]))
            ends = np.concatenate([[0], np.cumsum(full)])[bounds]
            out[name] = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), taken), mark)
        return out


@lru_cache(maxsize=2)
def _codec(path: str) -> Codec:
    return Codec(path)


def decode(path: str, ids: list[int]) -> str:
    """The text of `ids`: the vocabulary names no decoder, so it is their symbols, a blank between."""
    names = _codec(path).names
    return " ".join(names[i] for i in ids if i in names)


class Decoder:
    """Texts from packed ids, a batch at a time."""

    def __init__(self, path: str):
        names = _codec(path).names
        self.names = pa.array([names.get(i) for i in range(max(names, default=-1) + 1)], pa.string())
        self.known = self.names.is_valid().to_numpy(zero_copy_only=False)

    def __call__(self, packed: pa.Array) -> dict:
        packed = pc.fill_null(packed, b"")
        ids = np.frombuffer(b"".join(packed.to_pylist()), "<u4").astype(np.int64)
        ends = np.cumsum(pc.binary_length(packed).to_numpy(zero_copy_only=False).astype(np.int64)) // 4
        known = self.known[np.minimum(ids, len(self.known) - 1)] & (ids < len(self.known))
        upto = np.concatenate([[0], np.cumsum(known)])[np.concatenate([[0], ends]).astype(np.int64)]
        return {"decoded": pc.binary_join(pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), self.names.take(pa.array(ids[known]))), " ")}


@lru_cache(maxsize=2)
def _decoder(path: str) -> Decoder:
    return Decoder(path)


def decode_ids(encoded: DataFrame, *, path: str, ids: str = "ids") -> DataFrame:
    """`encoded` with `decoded`: the text of each row's `ids`, packed as `encode_decode` packs them.

    Ids that the vocabulary doesn't have are passed over; null and empty ids give an empty text. A column `decoded` that is
    there already is replaced, others pass through, and an empty table stays empty. No shuffle.
    """
    return extend(encoded, ids, {"decoded": (T.StringType(), pa.string())}, lambda: _decoder(path), INDEX_BYTES)


def encode_decode(docs: DataFrame, *, path: str, text: str = "text") -> DataFrame:
    """`docs` with `ids` (packed little-endian unsigned 32-bit integers) and `decoded` (the text of those ids).

    Whole texts, with the vocabulary's normalisation (composed, lower case) and without begin or end
    tokens; its special strings in a text give their ids. Null and empty texts give no ids and an empty
    text. Columns of those names are replaced, others pass through, repeated rows stay, and an empty table stays
    empty. Texts of any length are encoded whole: a task holds one text, its distinct words and the index over 2 MB of
    text or, of a longer one, over its distinct words. No shuffle.
    """
    fields = {"ids": (T.BinaryType(), pa.binary()), "decoded": (T.StringType(), pa.string())}
    return extend(docs, text, fields, lambda: _codec(path), INDEX_BYTES)


def digests(encoded: DataFrame) -> DataFrame:
    return encoded.select("doc_id", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(encode_decode(documents(spark, sf_dir).select("doc_id", "text"), path=public("word_bpe_49k.json")))
