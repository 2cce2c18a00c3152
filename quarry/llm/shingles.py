"""Word shingles as 64-bit hashes, computed over whole buffers of text at once.

Words are runs of other than blank and the characters 9 to 13, with A-Z lower-cased. Equal sequences of
words have equal hashes; for unequal ones the chance is 2^-64 a pair.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_BASE = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_BASE, -1, 1 << 64)
_ALL = (1 << 64) - 1
_STEP = U(0xD6E8FEB86659FD93)


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """A permutation of 64-bit numbers without visible pattern; each seed gives another."""
    h = (h ^ U(seed * 0xA0761D6478BD642F & 0xFFFFFFFFFFFFFFFF)) + U(0x9E3779B97F4A7C15)
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


#: Characters, and bytes, that are worked on at once. Shorter texts are put together, a longer one is taken in parts.
CHARS = 1 << 18
_known = [np.zeros(0, np.uint64)] * 2


def _powers(n: int) -> list[np.ndarray]:
    """The first n powers of the base and of its inverse; a worker keeps the longest so far."""
    if len(_known[0]) < n:
        for i, base in enumerate((_BASE, _BACK)):
            p = np.full(n + n // 4 + 1, U(base))
            p[0] = 1
            _known[i] = np.cumprod(p)
    return [p[:n] for p in _known]


def _runs(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(where each run of other than white space begins, its length, its bytes' polynomial)."""
    buf = _LOWER[buf]
    inside = np.concatenate([[False], ~_SPACE[buf], [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    # The polynomial is a difference of prefix sums, moved back to where the run begins.
    power, back = _powers(len(buf) + 1)
    upto = np.concatenate([[U(0)], np.cumsum((buf.astype(np.uint64) + U(1)) * power[:-1])])
    return start, end - start, (upto[end] - upto[start]) * back[start]


def _long(raw: bytes) -> np.ndarray:
    """The hash of each word of one text, CHARS bytes at a time; a word may lie across the cuts."""
    out = []
    value, length = 0, 0  # of the word that reached the last cut
    view = memoryview(raw)
    for at in range(0, len(raw), CHARS):
        buf = np.frombuffer(view[at : at + CHARS], np.uint8)
        start, size, h = _runs(buf)
        if length and (not len(start) or start[0]):
            out.append(mix(np.array([value], np.uint64) + U(length)))
            value, length = 0, 0
        if not len(start):
            continue
        if length:
            h[0] = U((value + int(h[0]) * pow(_BASE, length, 1 << 64)) & _ALL)
            size[0] += length
            value, length = 0, 0
        if not _SPACE[buf[-1]]:
            value, length = int(h[-1]), int(size[-1])
            h, size = h[:-1], size[:-1]
        out.append(mix(h + size.astype(np.uint64)))
    if length:
        out.append(mix(np.array([value], np.uint64) + U(length)))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word of all texts; how many each text has)."""
    raw = [b"" if t is None else t.encode() for t in texts]
    if len(raw) == 1 and len(raw[0]) > CHARS:
        h = _long(raw[0])
        return h, np.array([len(h)])
    size = np.fromiter(map(len, raw), np.int64, len(raw)) + 1
    start, length, h = _runs(np.frombuffer(b"\n".join(raw) + b"\n", np.uint8))
    return mix(h + length.astype(np.uint64)), np.diff(np.searchsorted(start, np.concatenate([[0], np.cumsum(size)])))


def sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's shingles of `width` words; a text of fewer has all its words as one, one without has none."""
    out, start, held = [], 0, 0
    for i, t in enumerate(texts):
        size = len(t or "")
        if held and held + size > CHARS:
            out += _sets(texts[start:i], width)
            start, held = i, 0
        held += size
    return out + (_sets(texts[start:], width) if start < len(texts) else [])


def _sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    h, count = words(texts)
    n = len(h)
    grams = np.zeros(n, np.uint64)
    for k in range(width):
        m = max(0, n - k)
        grams[:m] = grams[:m] * _STEP + h[k:]
    grams = mix(grams)
    stop = np.cumsum(count)
    out = []
    for end, c in zip(stop.tolist(), count.tolist(), strict=True):
        begin = end - c
        if c >= width:
            out.append(np.unique(grams[begin : end - width + 1]))
        elif c:
            g = np.zeros(1, np.uint64)
            for x in h[begin:end]:
                g = g * _STEP + x
            out.append(mix(g, c))
        else:
            out.append(grams[:0])
    return out


def signature(own: np.ndarray) -> int:
    """A set's 64-bit identity, as a signed number."""
    total = mix(np.array([mix(own, 1).sum(dtype=np.uint64) + U(len(own))]), 2)
    return int(total.view(np.int64)[0])
