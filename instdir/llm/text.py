"""Whole-batch numpy helpers over UTF-8 buffers: words, lines, shingles and their 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def seeds(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed))


#: Bytes A-Z to a-z, others as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words that hold digits, letters and everything beyond ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True
#: Bytes of words parted by ASCII white space alone.
NONSPACE = np.ones(256, dtype=bool)
NONSPACE[9:14] = NONSPACE[32] = False

_WITHIN = seeds(64, 23) | U64(1)
#: Two unrelated hash functions over the same bytes; together they name things by 128 bits.
FIRST, SECOND = 11, 13
_STEP = U64(0xD6E8FEB86659FD93)
#: The first n of eight bytes.
_HEAD = np.array([(1 << (8 * n)) - 1 for n in range(9)], dtype=U64)


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column one after another, and where each row begins and ends; null as empty."""
    if col.null_count:
        col = pc.fill_null(col, pa.scalar("").cast(col.type))
    col = col.cast(pa.large_binary())
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def pieces(col: pa.Array, limit: int = 1 << 19) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole rows of about ``limit`` bytes: first row, last row + 1, bytes, offsets."""
    buf, off = utf8(col)
    i, n = 0, len(col)
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, j, buf[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def spans(is_in: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each run of True that stays within one row."""
    if not len(is_in):
        return (np.zeros(0, np.int64),) * 3
    before, after = np.empty_like(is_in), np.empty_like(is_in)
    before[0], before[1:] = False, is_in[:-1]
    after[-1], after[:-1] = False, is_in[1:]
    edges = off[1:-1]
    before[edges[edges < len(is_in)]] = False
    after[edges[edges > 0] - 1] = False
    start = np.flatnonzero(is_in & ~before)
    end = np.flatnonzero(is_in & ~after) + 1
    return start, end, np.searchsorted(off, start, "right") - 1


def _eights(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each span as numbers of eight bytes, the last filled with zeros: the numbers, each one's place in its span, and where spans begin."""
    count = np.maximum(-(-(end - start) // 8), 1)
    first = np.cumsum(count) - count
    place = np.arange(first[-1] + count[-1]) - np.repeat(first, count)
    at = np.repeat(start, count) + 8 * place
    filled = np.concatenate([buf, np.zeros(8, np.uint8)])
    every = np.ndarray((len(buf) + 1,), "<u8", filled, strides=(1,))  # the eight bytes from each place on
    return every[at] & _HEAD[np.clip(np.repeat(end, count) - at, 0, 8)], place, first


def _blocks(start: np.ndarray, end: np.ndarray, block: int) -> Iterator[tuple[int, int]]:
    """Runs of spans over about ``block`` bytes, so that a very long text takes no more than its own size at once."""
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + block, "right")))
        yield i, j
        i = j


def hash_spans(buf: np.ndarray, start: np.ndarray, end: np.ndarray, block: int = 1 << 19, seed: int = FIRST) -> np.ndarray:
    """64-bit hash of each span of bytes (in order, apart): the sum of the scrambled eights, each with its place, and of the length.

    Scrambling comes before the sum and is no polynomial, so spans of regular patterns don't cancel out.
    """
    out, key = np.empty(len(start), dtype=U64), seeds(1, seed)[0]
    for i, j in _blocks(start, end, block):
        part, s, n = buf[start[i] : end[j - 1]], start[i:j] - start[i], end[i:j] - start[i:j]
        filled = np.concatenate([part, np.zeros(8, np.uint8)])
        every = np.ndarray((len(part) + 1,), "<u8", filled, strides=(1,))
        total = mix((every[s] & _HEAD[np.minimum(n, 8)]) ^ key)
        long = np.flatnonzero(n > 8)
        if len(long):
            eight, place, first = _eights(part, s[long] + 8, (s + n)[long])
            total[long] += np.add.reduceat(mix(mix(eight ^ key) + (place + 1).astype(U64) * _STEP), first)
        total += n.astype(U64) * key
        out[i:j] = mix(total)
    return out


def same_spans(buf: np.ndarray, start: np.ndarray, end: np.ndarray, other: np.ndarray, begin: np.ndarray, block: int = 1 << 19) -> np.ndarray:
    """Whether each span of buf has the bytes that begin at a place of ``other``, which ends in eight spare bytes."""
    out = np.empty(len(start), dtype=bool)
    for i, j in _blocks(start, end, block):
        eight, place, first = _eights(buf[start[i] : end[j - 1]], start[i:j] - start[i], end[i:j] - start[i])
        count = np.diff(np.append(first, len(place)))
        at = np.minimum(np.repeat(begin[i:j], count) + 8 * place, len(other) - 8)
        filled = np.ndarray((len(other) - 7,), "<u8", other, strides=(1,))
        left = np.clip(np.repeat(end[i:j] - start[i:j], count) - 8 * place, 0, 8)
        out[i:j] = np.logical_and.reduceat((filled[at] & _HEAD[left]) == eight, first)
    return out


def words(buf: np.ndarray, off: np.ndarray, kind: np.ndarray, seed: int = FIRST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, row and hash of each word, A-Z lower-cased."""
    start, end, row = spans(kind[buf], off)
    return start, end, row, hash_spans(LOWER[buf], start, end, seed=seed)


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k hashes from each place on; the caller drops places whose run leaves the row."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=U64)
    out = np.full(n, k, dtype=U64)
    for j in range(k):
        out += hashes[j : n + j] * _WITHIN[j]
    return mix(out)


def bounds(row: np.ndarray, n: int) -> np.ndarray:
    """Where the words of each of n rows begin in a list ordered by row (n + 1 places)."""
    return np.searchsorted(row, np.arange(n + 1))


def list_array(values: np.ndarray, off: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(values, kind))
