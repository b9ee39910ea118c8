"""Periodic runs of words by online dyadic square catching.

A run is a stretch of words with a smallest period that no neighbouring word extends. ``Catchers`` reads words as they are
appended. A text is cut into blocks of every power of two. Once a block of L words and L words more are there, its catcher
compares them with the 2L words that begin L to 2L - 1 places before: an equal one is a square of that period. Squares of one
period caught by neighbouring blocks merge; their stretch then advances by suffix comparisons, word runs of powers of two at a
time, to both sides, and goes on advancing while words are appended.

Every run of period q and length 4q or more is caught: for L <= q < 2L, of the block starts that leave q words of the run before
them and 2L after them, one is a multiple of L. What is compared are hashes of 2^k words from each place on, each made of
two of half its length: n log n steps for n words, whatever they are. Every second power's are kept, 8 bytes a word each.

Texts of a batch are one stretch of words with unlike separators between them, which no square crosses.

Defined cases: null and empty texts have no words and no run; a very long text is read in whole; repeated rows each get their own
result; a null doc_id stays null and is never rewritten; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow
from .text import NONSPACE, U64, bounds, hash_spans, mix, pieces, seeds, spans

_LEFT, _RIGHT = (x | U64(1) for x in seeds(2, 31))
_NONE = np.zeros((0, 3), np.int64)


def _pairs(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hashes of twice as many words, from those of both halves."""
    return mix(left * _LEFT + right * _RIGHT)


class Catchers:
    """Squares and the stretches that they merge into, over words (64-bit names) appended in any portions."""

    def __init__(self, longest: int | None = None):
        """longest: words of the longest stretch without a separator, if known; no period over a quarter of it is looked for."""
        self.longest, self.n = longest, 0
        self.kept: dict[int, np.ndarray] = {0: np.zeros(0, U64)}  # by even k: hashes of 2^k words from each place on
        self.seen: dict[int, int] = {}  # by k: blocks whose catchers have compared
        self.found = _NONE  # start, end, period of stretches, by period and start

    def append(self, words: np.ndarray) -> None:
        """The next words: blocks that they complete compare, stretches that end at the text's end advance."""
        old, self.n = self.n, self.n + len(words)
        self.kept[0] = np.concatenate([self.kept[0], words.astype(U64)])
        squares, k = [_NONE], 0
        half, base = self.kept[0], 0  # hashes of 2^k words from place ``base`` on
        while 4 << k <= (self.n if self.longest is None else min(self.n, self.longest)):
            size = 2 << k
            if k % 2:  # the double is kept: only new places are added
                have = self.kept.get(k + 1, np.zeros(0, U64))
                new = half[len(have) - base :]
                more = _pairs(new[: max(0, len(new) - size // 2)], new[size // 2 :])
                half, base = np.concatenate([have, more]), 0
                self.kept[k + 1] = half
            else:
                base = max(0, old - 4 * size + 1)
                part = half[base:]
                half = _pairs(part[: max(0, len(part) - size // 2)], part[size // 2 :])
            squares.append(self._caught(half, base, k))
            k += 1
        still = self.found[self.found[:, 1] == old] if old else _NONE
        ended = self.found[self.found[:, 1] != old] if old else _NONE
        self._merge(ended, np.concatenate([still, *squares]))

    def _caught(self, double: np.ndarray, base: int, k: int) -> np.ndarray:
        """Stretches of squares (start, end, period) that the new blocks of 2^k words catch; neighbours' are one."""
        size = 1 << k
        first, last = max(2, self.seen.get(k, 0)), (len(double) + base - 1) // size  # blocks that 2L words follow
        self.seen[k] = max(first, last + 1)
        if last < first:
            return _NONE
        own = double[first * size - base : last * size - base + 1 : size]
        if size <= 32:
            starts, periods = [], []
            for period in range(size, 2 * size):
                at = np.flatnonzero(own == double[first * size - period - base : last * size - period - base + 1 : size])
                starts.append((first + at) * size)
                periods.append(np.full(len(at), period))
            start, period = np.concatenate(starts), np.concatenate(periods)
        else:
            before = (first - 2) * size + 1 - base  # the windows that begin 2L - 1 to L places before a block are a row
            table = double[before : before + len(own) * size].reshape(-1, size)
            hit = np.flatnonzero(table == own[:, None])
            start, period = (first + hit // size) * size, 2 * size - 1 - hit % size
        order = np.lexsort((start, period))
        start, period = start[order], period[order]
        head = np.ones(len(start), dtype=bool)
        head[1:] = (np.diff(period) != 0) | (np.diff(start) != size)
        tail = np.append(head[1:], True)[: len(head)]
        return np.stack([start[head] - period[head], start[tail] + 2 * size, period[head]], axis=1)

    def _merge(self, ended: np.ndarray, stretches: np.ndarray) -> None:
        """Stretches taken as far as their period holds, each once."""
        if len(stretches):
            start, end, period = stretches.T
            end = end + self._equal(end, end - period, 1)
            start = start - self._equal(start + period, start, -1)
            stretches = np.stack([start, end, period], axis=1)
        both = np.concatenate([ended, stretches])
        order = np.lexsort((-both[:, 1], both[:, 0], both[:, 2]))
        both = both[order]
        once = np.ones(len(both), dtype=bool)
        once[1:] = (np.diff(both[:, 0]) != 0) | (np.diff(both[:, 2]) != 0)
        self.found = both[once]

    def _equal(self, x: np.ndarray, y: np.ndarray, step: int) -> np.ndarray:
        """How many words from x and y on (step 1), or before them (step -1), are equal; y is before x."""
        out = np.zeros(len(x), np.int64)
        for k in sorted(self.kept, reverse=True):
            size, hashes = 1 << k, self.kept[k]
            active = np.arange(len(x)) if len(hashes) else np.zeros(0, np.int64)
            while len(active):
                a, b = (v[active] + step * out[active] - (size if step < 0 else 0) for v in (x, y))
                fits = (a < len(hashes)) & (b >= 0)
                active, a, b = active[fits], a[fits], b[fits]
                active = active[hashes[a] == hashes[b]]
                out[active] += size
        return out

    def runs(self, least: int = 6, times: int = 4) -> np.ndarray:
        """start, end and smallest period of each run of at least ``least`` words and ``times`` (4 or more) periods, by start, then period."""
        start, end, period = self.found.T
        found = self.found[end - start >= np.maximum(least, times * period)]
        found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
        first = np.ones(len(found), dtype=bool)  # a multiple of a run's smallest period has the same stretch
        first[1:] = (np.diff(found[:, 0]) != 0) | (np.diff(found[:, 1]) != 0)
        found = found[first]
        return found[np.lexsort((found[:, 2], found[:, 0]))]


def runs_of(words: np.ndarray, off: np.ndarray, least: int = 6, times: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """The runs (start, end, period; words counted from each text's first) of texts whose words begin at off, and where each text's begin."""
    n = len(off) - 1
    row = np.repeat(np.arange(n), np.diff(off))
    joined = seeds(len(words) + n, 37)  # separators, each another
    joined[np.arange(len(words)) + row] = words
    catchers = Catchers(int(np.diff(off).max(initial=0)))
    catchers.append(joined)
    runs = catchers.runs(least, times)
    of = np.searchsorted(off[1:] + np.arange(1, n + 1), runs[:, 0], "right")
    runs[:, :2] -= (off[:-1] + np.arange(n))[of, None]
    return runs, bounds(of, n)


def covered(runs: np.ndarray, at: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Whether a run covers each word after its own first period."""
    of = np.repeat(off[:-1], np.diff(at))
    edge = np.zeros(off[-1] + 1, np.int64)
    np.add.at(edge, of + runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, of + runs[:, 1], -1)
    return np.cumsum(edge[:-1]) > 0


def rewritten(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """(a, p) if the words of this document from a on become repetitions of p words from a on."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def _order(ids: list, off: np.ndarray) -> np.ndarray:
    """Which word of the batch stands at each place, once documents are rewritten."""
    order = np.arange(off[-1])
    for r, doc_id in enumerate(ids):
        how = rewritten(doc_id, int(off[r + 1] - off[r]))
        if how:
            a, p = off[r] + how[0], how[1]
            order[a : off[r + 1]] = a + (order[a : off[r + 1]] - a) % p
    return order


_SCHEMA = "doc_id long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs array<struct<start:long,length:long,period:long>>, text string"


def periodic_runs(docs: DataFrame, rewrite: bool = True, least: int = 6, times: int = 4) -> DataFrame:
    """doc_id, n_words, n_runs, the run of greatest exponent, all runs, and the text without what runs repeat, of each row.

    rewrite: whether documents are rewritten first (see ``rewritten``). Words are parted by ASCII white space; words in a run after
    its first period are dropped and the others joined by one space.
    """
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def fn(batch):
        doc_id = batch.column("doc_id")
        for i, j, buf, byte_off in pieces(batch.column("text"), 1 << 20):
            start, end, row = spans(NONSPACE[buf], byte_off)
            off = bounds(row, j - i)
            ids = doc_id.slice(i, j - i).to_pylist()
            names = hash_spans(buf, start, end)
            order = _order(ids, off) if rewrite else np.arange(off[-1])
            runs, at = runs_of(names[order], off, least, times)
            keep, data, best = ~covered(runs, at, off), buf.tobytes(), []
            texts = []
            for r in range(j - i):
                mine = runs[at[r] : at[r + 1]]
                best.append(_best(mine))
                kept = order[off[r] : off[r + 1]][keep[off[r] : off[r + 1]]]
                texts.append(b" ".join([data[a:b] for a, b in zip(start[kept].tolist(), end[kept].tolist(), strict=True)]))
            size = runs[:, 1] - runs[:, 0]
            every = pa.StructArray.from_arrays([pa.array(runs[:, 0]), pa.array(size), pa.array(runs[:, 2])], ["start", "length", "period"])
            columns = [pa.array(c, pa.int64()) for c in (list(zip(*best, strict=True)) or [()] * 4)]
            listed = pa.ListArray.from_arrays(pa.array(at, pa.int32()), every)
            yield pa.Table.from_arrays(
                [doc_id.slice(i, j - i), pa.array(np.diff(off)), pa.array(np.diff(at)), *columns, listed.cast(kind), pa.array(texts, pa.binary()).cast(pa.string())],
                ["doc_id", "n_words", "n_runs", "start", "length", "period", "exponent_milli", "runs", "text"],
            )

    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), fn, _SCHEMA)


def _best(runs: np.ndarray) -> tuple:
    """start, length, period and floor(1000 * length / period) of the run with the greatest exponent; the first of equals."""
    best = (None,) * 4
    for start, end, period in runs.tolist():  # by start, then period
        if best[0] is None or (end - start) * best[2] > best[1] * period:
            best = (start, end - start, period, 1000 * (end - start) // period)
    return best
