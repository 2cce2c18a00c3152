"""Simple-8b: 64-bit words whose top four bits say how many integers of how many bits the rest holds."""

from __future__ import annotations

import struct

import numpy as np

#: Fixed values of the format: by selector, how many integers a word holds and their bits.
COUNTS = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], np.int64)
BITS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60], np.int64)
WIDEST = 60


_SMALL = np.array([x.bit_length() for x in range(1 << 16)], np.uint8)


def _widths(values: np.ndarray) -> np.ndarray:
    """How many bits each value takes."""
    if len(values) and values.max() < len(_SMALL):
        return _SMALL[values]
    out = np.zeros(len(values), np.uint8)
    for bits in (32, 16, 8, 4, 2, 1):
        high = (values >> (out + np.uint8(bits - 1)).astype(np.uint64)) > 1
        out[high] += np.uint8(bits)
    return out + (values > 0)


def _wider(a: np.ndarray, b: np.ndarray, by: int) -> np.ndarray:
    """The larger of a[i] and b[i + by]; past the end nothing is wide."""
    if not by:
        return a
    out = a.copy()
    np.maximum(a[:-by], b[by:], out=out[:-by])
    return out


def _follow(step: np.ndarray) -> np.ndarray:
    """The places 0, step[0], step[step[0]] and so on, while they lie below len(step).

    Only every 64th is followed one by one; those between come from steps that were doubled.
    """
    n = len(step)
    jumps = [np.append(step, n)]
    for _ in range(6):
        jumps.append(jumps[-1][jumps[-1]])
    far, i, at = jumps.pop().tolist(), 0, []
    while i < n:
        at.append(i)
        i = far[i]
    at = np.array(at, np.int64)
    for jump in reversed(jumps):
        at = np.stack([at, jump[at]], 1).reshape(-1)
    return at[at < n]


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, escapes) of unsigned 64-bit `values`.

    Each word takes as many of the next values as fit. A value of more than 60 bits stands as 0 in the
    words and is kept in `escapes`, rows of (position, value). The last word may hold fewer values than
    its selector says; the reader knows how many there are.
    """
    values = np.ascontiguousarray(values, np.uint64)
    n = len(values)
    wide = np.flatnonzero(values >> np.uint64(WIDEST))
    escapes = np.stack([wide.astype(np.uint64), values[wide]], 1) if len(wide) else np.zeros((0, 2), np.uint64)
    if len(wide):
        values = values.copy()
        values[wide] = 0
    if not n:
        return np.zeros(0, np.uint64), escapes
    longest = {1: _widths(values)}  # over as many values from each on
    for p in (2, 4, 8, 16, 32, 64, 128):
        longest[p] = _wider(longest[p // 2], longest[p // 2], p // 2)
        if n > p and longest[p][: n - p].min() > BITS[p <= COUNTS].max():
            break  # no word takes so many or more
    selector = np.full(n, 15, np.uint8)
    for s in range(14, -1, -1):  # the last that fits has the most values
        p = 1 << int(COUNTS[s]).bit_length() - 1
        if p not in longest:
            break
        selector[_wider(longest[p], longest[p], int(COUNTS[s]) - p) <= BITS[s]] = s
    starts = _follow(np.minimum(np.arange(n) + COUNTS[selector], n))
    chosen = selector[starts].astype(np.int64)
    words = chosen.astype(np.uint64) << np.uint64(WIDEST)
    padded = np.concatenate([values, np.zeros(240, np.uint64)])
    for s in np.unique(chosen):
        if BITS[s]:
            own = np.flatnonzero(chosen == s)
            cells = padded[starts[own, None] + np.arange(COUNTS[s])]
            words[own] |= np.bitwise_or.reduce(cells << (np.arange(COUNTS[s]) * BITS[s]).astype(np.uint64), axis=1)
    return words, escapes


def unpack(words: np.ndarray, escapes: np.ndarray, n: int) -> np.ndarray:
    """The `n` values of `words`."""
    chosen = (words >> np.uint64(WIDEST)).astype(np.int64)
    counts = COUNTS[chosen]
    start = np.cumsum(counts) - counts
    total = int(counts.sum())
    if total < n:
        raise ValueError(f"words hold {total} values, {n} were written")
    out = np.zeros(total, np.uint64)
    for s in np.unique(chosen):
        if BITS[s]:
            own = np.flatnonzero(chosen == s)
            cells = (words[own, None] >> (np.arange(COUNTS[s]) * BITS[s]).astype(np.uint64)) & np.uint64((1 << int(BITS[s])) - 1)
            out[start[own, None] + np.arange(COUNTS[s])] = cells
    out = out[:n]
    if len(escapes):
        out[escapes[:, 0].astype(np.int64)] = escapes[:, 1]
    return out


HEADER = struct.Struct("<4sIQQQQ")
MAGIC, VERSION = b"QS8B", 1


def write_block(keys: np.ndarray, ends: np.ndarray, ids: np.ndarray) -> bytes:
    """A block of sequences: header; a key each; where each ends among the ids; words; escapes.

    All numbers are little-endian. Readers find a sequence by `ends` and unpack the block at once.
    """
    words, escapes = pack(ids)
    head = HEADER.pack(MAGIC, VERSION, len(keys), len(ids), len(words), len(escapes))
    return b"".join([head, keys.astype("<i8").tobytes(), ends.astype("<u8").tobytes(), words.astype("<u8").tobytes(), escapes.astype("<u8").tobytes()])


def read_block(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, ends, ids) of what `write_block` made."""
    magic, version, n, n_ids, n_words, n_escapes = HEADER.unpack_from(data)
    if magic != MAGIC or version != VERSION or len(data) != HEADER.size + 8 * (2 * n + n_words + 2 * n_escapes):
        raise ValueError("not a whole Simple-8b block")
    at, parts = HEADER.size, []
    for kind, m in (("<i8", n), ("<u8", n), ("<u8", n_words), ("<u8", 2 * n_escapes)):
        parts.append(np.frombuffer(data, kind, m, at))
        at += 8 * m
    keys, ends, words, escapes = parts
    return keys, ends, unpack(words, escapes.reshape(-1, 2), n_ids)
