"""Document fingerprints from improbable features.

Each window of a text's bytes has an entropy; how rare that entropy is among all windows of the corpus ranks
the window. Windows that are the rarest of their surroundings often enough are the text's features. They are
put, in order, into a chain of Bloom filters of equal size, and two chains are compared by the bits that
their filters share beyond chance.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import documents, slices
from quarry.llm.shingles import mix

WINDOW, AROUND, OFTEN = 16, 32, 8
FILTER_BYTES, FILTER_FEATURES, HASHES = 256, 160, 5
#: Entropies are told apart in so many steps; windows below the lowest share of them are no features.
BINS, LOWEST = 1000, 0.25
#: Share of the way from chance to equality below which shared bits count as chance.
CHANCE = 0.08
SLICE = 1 << 20
CHUNK = 1 << 17
#: Where one part of the table ends and the next begins is told from about so many keys a part, of two numbers each.
SAMPLE = 32

_PLOGP = np.rint(np.array([0.0] + [c * np.log2(c) for c in range(1, WINDOW + 1)]) * (1 << 20)).astype(np.int64)
_STEP = np.diff(_PLOGP)
_NONE = np.int64(1 << 20)


def _lay(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all texts with gaps between them, where each begins, how long each is)."""
    raw = [t.encode() for t in texts]
    gap = b"\0" * (WINDOW + 2 * AROUND)
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    buf = np.frombuffer(gap + gap.join(raw) + gap, np.uint8)
    return buf, len(gap) + np.cumsum(size + len(gap)) - size - len(gap), size


def _entropy_bins(buf: np.ndarray) -> np.ndarray:
    """The entropy of the window at each byte, in 0 to BINS. `buf` begins with a gap.

    From one window to the next a byte goes and a byte comes; how often each stands in between is counted
    by comparing the buffer with itself, moved.
    """
    n = len(buf)
    ahead, behind = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
    for start in range(0, n, CHUNK):  # small enough for the cache
        stop = min(n, start + CHUNK)
        for d in range(1, WINDOW):
            end = min(stop, n - d)
            if end <= start:
                break
            same = (buf[start:end] == buf[start + d : end + d]).view(np.uint8)
            ahead[start:end] += same
            behind[start + d : end + d] += same
    change = _STEP[behind[WINDOW:]] - _STEP[ahead[: n - WINDOW]]
    total = _PLOGP[WINDOW] + np.concatenate([[0], np.cumsum(change)])
    return ((_PLOGP[WINDOW] - total) * BINS // _PLOGP[WINDOW]).astype(np.int16)


def _windows(start: np.ndarray, size: np.ndarray, n: int) -> np.ndarray:
    """Where a window lies within one text."""
    edge = np.zeros(n + 1, np.int8)
    own = size >= WINDOW
    edge[start[own]] += 1
    edge[start[own] + size[own] - WINDOW + 1] -= 1
    return np.cumsum(edge[:-1], dtype=np.int8).astype(bool)


def histogram(texts: list[str]) -> np.ndarray:
    """How many windows have each entropy."""
    buf, start, size = _lay(texts)
    bins = _entropy_bins(buf)
    return np.bincount(bins[_windows(start, size, len(bins))], minlength=BINS + 1)


def ranks(counts: np.ndarray) -> np.ndarray:
    """The rank of each entropy, rarest first; _NONE for those too low to tell a text by."""
    out = np.full(BINS + 1, _NONE)
    low = int(LOWEST * BINS)
    order = low + np.lexsort((np.arange(BINS + 1 - low), counts[low:]))
    out[order] = np.arange(len(order))
    return out


class Digest:
    """A chain of Bloom filters; all but the last hold FILTER_FEATURES features."""

    __slots__ = ("bits", "features")

    def __init__(self, features: int, bits: np.ndarray):
        self.features, self.bits = features, bits

    def __str__(self) -> str:
        return f"{self.features}:{base64.b64encode(self.bits.tobytes()).decode()}"

    @classmethod
    def parse(cls, text: str) -> Digest:
        n, _, data = text.partition(":")
        return cls(int(n), np.frombuffer(base64.b64decode(data), np.uint8).reshape(-1, FILTER_BYTES))

    def held(self) -> np.ndarray:
        out = np.full(len(self.bits), FILTER_FEATURES)
        if len(out):
            out[-1] = self.features - FILTER_FEATURES * (len(out) - 1)
        return out


def likeness(a: Digest, b: Digest) -> float:
    """0 to 1. Each filter of the shorter chain is held against all of the other and keeps its best score, the
    shared bits between chance and what equal filters would share; scores are averaged by features."""
    if not a.features or not b.features:
        return float(a.features == b.features)
    if (a.features, len(a.bits)) > (b.features, len(b.bits)):
        a, b = b, a
    ones_a, ones_b = (np.bitwise_count(x.bits).sum(1, dtype=np.int64) for x in (a, b))
    scores = np.zeros(len(a.bits))
    for i, own in enumerate(a.bits):
        both = np.bitwise_count(own & b.bits).sum(1, dtype=np.int64)
        least = ones_a[i] * ones_b / (8 * FILTER_BYTES)
        most = np.minimum(ones_a[i], ones_b)
        floor = least + CHANCE * (most - least)
        scores[i] = np.clip((both - floor) / np.maximum(most - floor, 1e-9), 0, 1).max()
    return float((scores * a.held()).sum() / a.features)


def digests(texts: list[str], rank: np.ndarray) -> list[Digest]:
    """The digest of each text. One too short or too plain for a feature has itself as its only one; an empty one has none."""
    if not texts:
        return []
    buf, start, size = _lay(texts)
    bins = _entropy_bins(buf)
    n = len(bins)
    can = _windows(start, size, n)
    r = np.where(can, rank[bins], _NONE)
    lowest = r * np.int64(1 << 32) + np.arange(n)  # of equal ranks the leftmost
    width = 1
    while width < AROUND:
        lowest = np.minimum(lowest[:-width], lowest[width:])
        width *= 2
    popular = np.bincount(lowest & np.int64((1 << 32) - 1), minlength=n)
    at = np.flatnonzero((popular >= OFTEN) & can & (r < _NONE))
    h = np.zeros(len(at), np.uint64)
    for k in range(WINDOW):
        h = h * np.uint64(0x100000001B3) + buf[at + k]
    owner = np.searchsorted(start, at, "right") - 1
    found = np.bincount(owner, minlength=len(texts))
    alone = np.flatnonzero((found == 0) & (size > 0))
    if len(alone):
        whole = np.array([int.from_bytes(hashlib.blake2b(texts[i].encode(), digest_size=8).digest(), "little") for i in alone], np.uint64)
        h, owner = np.concatenate([h, whole]), np.concatenate([owner, alone])
        order = np.argsort(owner, kind="stable")
        h, owner = h[order], owner[order]
        found[alone] = 1
    h = mix(h, 9)
    place = np.arange(len(h)) - (np.cumsum(found) - found)[owner]
    chain = -(-found // FILTER_FEATURES)
    first = np.cumsum(chain) - chain
    filters = first[owner] + place // FILTER_FEATURES
    bits = np.zeros(int(chain.sum()) * FILTER_BYTES * 8, bool)
    for k in range(HASHES):
        bits[filters * (FILTER_BYTES * 8) + ((h >> np.uint64(11 * k)) & np.uint64(FILTER_BYTES * 8 - 1)).astype(np.int64)] = True
    packed = np.packbits(bits).reshape(-1, FILTER_BYTES)
    return [Digest(int(f), packed[a : a + c]) for f, a, c in zip(found, first, chain, strict=True)]


def rarity(docs: DataFrame, text: str = "text") -> np.ndarray:
    """`ranks` over all windows of all texts. A task sends a count for each entropy."""
    kinds = pa.schema([("bin", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BINS + 1, np.int64)
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                counts += histogram([t for t in part.column(0).to_pylist() if t])
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], schema=kinds)

    rows = docs.select(F.col(f"`{text}`").alias("text")).mapInArrow(run, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(BINS + 1, np.int64)
    for r in rows:
        counts[r["bin"]] = r["n"]
    return ranks(counts)


class Bounds:
    """The first keys of parts, in ascending order. A key is an id, null ids first, and a hash."""

    def __init__(self, keys: list[tuple[bool, int, int]]):
        keys = sorted(set(keys))
        self.parts = len(keys)
        self.none = sum(not k[0] for k in keys)
        self.ids = np.array([k[1] for k in keys[self.none :]], np.int64)
        self.ties = np.array([k[2] for k in keys], np.int64)

    def place(self, known: np.ndarray, ids: np.ndarray, ties: np.ndarray) -> np.ndarray:
        """Twice the part of each key, and one more where it is the part's first key."""
        upto, first = np.zeros(len(ids), np.int64), np.zeros(len(ids), bool)

        def among(own: np.ndarray, lo: int, hi: int) -> None:
            at = np.searchsorted(self.ties[lo:hi], ties[own], "right")
            upto[own] = lo + at
            first[own] = (at > 0) & (self.ties[np.maximum(lo + at - 1, 0)] == ties[own])

        own = np.flatnonzero(~known)
        among(own, 0, self.none)
        own = np.flatnonzero(known)
        lo, hi = (self.none + np.searchsorted(self.ids, ids[own], side) for side in ("left", "right"))
        upto[own] = lo
        for at in np.unique(lo[hi > lo]).tolist():  # keys of the ids that stand in a bound
            these = (lo == at) & (hi > lo)
            among(own[these], at, int(hi[these][0]))
        return 2 * np.maximum(upto - 1, 0) + first


def bounds(keys: DataFrame, parts: int) -> Bounds:
    """Of `parts` parts with about equally many of the rows of `keys` (known, id, tie), from a sample of about SAMPLE a part. The least key is the first."""
    n, least = keys.agg(F.count(F.lit(1)), F.min(F.struct("known", "id", "tie"))).first()
    if not n:
        return Bounds([(False, 0, 0)])
    rows = sorted(map(tuple, keys.where(F.rand(11) < min(1.0, SAMPLE * parts / n)).collect()))
    return Bounds([tuple(least), *[rows[i * len(rows) // parts] for i in range(1, parts) if rows]])


def with_next(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(part, look, doc_id, text), each part in ascending order of (doc_id, hash of text), null ids first.

    The next row is the next document; a part's last one, marked `look`, is the first of the next part, and
    of the first part after the last. Parts have about equally many rows, whatever the ids are; rows equal in id and
    text share one. The driver and each task know two numbers a part. The table is dealt out once.
    """
    k, t = F.col(f"`{key}`").cast("long"), F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(k.isNotNull().alias("known"), F.coalesce(k, F.lit(0).cast("long")).alias("id"), F.xxhash64(t).alias("tie"), t.alias("text"))
    edge = bounds(rows.select("known", "id", "tie"), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    @F.pandas_udf("long")
    def place(known: pd.Series, ids: pd.Series, ties: pd.Series) -> pd.Series:
        return pd.Series(edge.place(known.to_numpy(), ids.to_numpy(), ties.to_numpy()))

    rows = rows.withColumn("place", place("known", "id", "tie"))
    part = F.shiftright("place", 1).cast("int")
    at = lambda p, look: F.struct(p.alias("part"), F.lit(look).alias("look"))
    both = F.array(at(part, False), at(F.pmod(part - 1, F.lit(edge.parts)), True))
    rows = rows.select(F.explode(F.when(F.col("place") % 2 == 1, both).otherwise(F.array(at(part, False)))).alias("at"), F.when(F.col("known"), F.col("id")).alias("doc_id"), "tie", "text").select("at.part", "at.look", "doc_id", "tie", "text")
    return rows.repartitionById(edge.parts, F.col("part")).sortWithinPartitions("part", "look", "doc_id", "tie").select("part", "look", "doc_id", "text")


COLUMNS = "doc_id long, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprints(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next) for each row of `docs`.

    `edited` is the text with its last half replaced by as much of the next document's beginning, or all of it.
    The next document follows in ascending order of (id, hash of text); null ids come first, and the first
    follows the last. Null texts count as empty, and two empty texts are alike by 1. Rows that repeat follow
    each other. Ids may be any longs. Equal texts have equal fingerprints within one run. An empty table gives an empty
    result. A task works on one text as a whole, at about 100 bytes of memory for each of its own.
    """
    rank = rarity(docs, text)
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    kinds = pa.schema(list(zip(names, [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()], strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None  # (part, look, id, text) that waits for the one after it
        for batch in batches:
            for piece in slices(batch, "text", SLICE):
                rows = ([last] if last else []) + list(zip(*[c.to_pylist() for c in piece.columns], strict=True))
                last = rows[-1]
                pairs = [i for i in range(len(rows) - 1) if not rows[i][1] and rows[i][0] == rows[i + 1][0]]
                if not pairs:
                    continue
                half = [len(rows[i][3]) // 2 for i in pairs]
                edited = [rows[i][3][: len(rows[i][3]) - h] + rows[i + 1][3][:h] for i, h in zip(pairs, half, strict=True)]
                needed = sorted({*pairs, *[i + 1 for i in pairs]})
                made = digests([rows[i][3] for i in needed] + edited, rank)
                own, after = dict(zip(needed, made, strict=False)), made[len(needed) :]
                out = [
                    [rows[i][2] for i in pairs], [len(rows[i][3]) for i in pairs], edited, [str(own[i]) for i in pairs], list(map(str, after)),
                    [likeness(own[i], e) for i, e in zip(pairs, after, strict=True)], [likeness(own[i], own[i + 1]) for i in pairs],
                ]
                yield pa.RecordBatch.from_arrays([pa.array(v, kind.type) for v, kind in zip(out, kinds, strict=True)], schema=kinds)

    return with_next(docs, key, text).mapInArrow(run, COLUMNS)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fingerprints(documents(spark, sf_dir))
    return made.select("doc_id", "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")
