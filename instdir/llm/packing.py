"""Best-fit packing of token pieces by linear grouping.

Texts become token ids, longer ones are cut into pieces of the sequence length. What the plan needs of the corpus is how
many pieces there are of each length: at most ``capacity`` numbers, however many documents. The plan over these counts:

1. pieces of full length fill a sequence each;
2. large lengths are cut into groups of equal cardinality and rounded up to the largest of their group;
3. for these few sizes the best mix of configurations (what may stand in one sequence together) is found by column
   generation, and taken as often as whole numbers allow;
4. the actual pieces of each group take the places of its rounded size;
5. what is left, and all small pieces, go best-fit, largest first, into the space that remains, new sequences if none.

The plan keeps runs of sequences that are alike, so it doesn't grow with the corpus. Each piece has a number among those
of its length, from windows over (length, salt) parts and the counts of the parts before; the number names its place.
No length, however common, is in one part.

Tokenising a corpus spends nearly all its time on words seen before, so each Python worker keeps the bytes and ids of
lower-cased word parts that can't influence one another. They are found by a hash and their bytes compared; texts where a
hash is shared, and those whose parts may matter to one another (special strings, final sigma), are encoded whole. The
vocabulary is sent to the tasks as text, so only the driver needs its file.

Defined cases: null and empty texts are the closing id alone; a very long text gives as many pieces as it needs, and a word
of any length is encoded as it is; repeated rows are packed once each; a null doc_id stays null; an empty table gives an
empty result; other columns are not looked at.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, map_arrow
from .text import LOWER, NONSPACE, hash_spans, pieces, same_spans, spans

_LETTER = np.zeros(256, dtype=bool)
_LETTER[97:123] = True
_MARK = NONSPACE.copy()
_MARK[97:123] = _MARK[128:] = False
#: Words whose ids a worker keeps at most, and their bytes; beyond that only those met in several batches stay.
CACHE_WORDS, CACHE_BYTES = 500_000, 32 << 20
_tokenizers: dict[str, "WordTokenizer"] = {}


def _grown(a: np.ndarray, n: int) -> np.ndarray:
    """a, or as much again and more, with room for n."""
    while len(a) < n:
        a = np.concatenate([a, np.zeros_like(a)])
    return a


class WordTokenizer:
    """Ids of whole texts, from remembered ids of their parts. ``vocabulary`` is the text of a tokenizer's file."""

    share = 1.0  # of the bounds, where a worker has several

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.model = self.tokenizer.model
        self.clear()

    def clear(self) -> None:
        self.keys, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # sorted hashes, and whose ids they have
        self.ids, self.off = np.zeros(1 << 20, np.uint32), np.zeros(1 << 18, np.int64)
        self.bytes, self.byte_off = np.zeros(1 << 20, np.uint8), np.zeros(1 << 18, np.int64)
        self.met = np.zeros(0, np.int64)  # in how many batches

    def _shrink(self) -> None:
        """Forget words until at most half of the bounds are used: first those met once."""
        size, least = np.diff(self.byte_off[: len(self.keys) + 1]), 1
        stay = np.ones(len(self.keys), dtype=bool)
        while stay.sum() > self.share * CACHE_WORDS // 2 or size[stay].sum() > self.share * CACHE_BYTES // 2:
            least += 1
            stay = self.met >= least
        kept, new = np.flatnonzero(stay), np.cumsum(stay) - 1
        keys, place, met = self.keys[stay[self.place]], new[self.place[stay[self.place]]], self.met[kept] // 2
        held = [(d, o, np.diff(o[: len(stay) + 1])[kept]) for d, o in ((self.ids, self.off), (self.bytes, self.byte_off))]
        self.clear()
        parts = [(d[np.repeat(o[kept] - np.cumsum(n) + n, n) + np.arange(n.sum())], n) for d, o, n in held]
        self.ids, self.off = self._kept(self.ids, self.off, 0, parts[0][1], parts[0][0])
        self.bytes, self.byte_off = self._kept(self.bytes, self.byte_off, 0, parts[1][1], parts[1][0])
        self.keys, self.place, self.met = keys, place, met

    def _ids(self, parts: list[bytes]) -> list[list[int]]:
        """The ids of parts that are met for the first time."""
        plain = [i for i, p in enumerate(parts) if p.isalpha()]
        other = sorted(set(range(len(parts))) - set(plain))
        got: list = [None] * len(parts)
        for i in plain:
            got[i] = [t.id for t in self.model.tokenize(parts[i].decode())]
        for i, e in zip(other, self.tokenizer.encode_batch([parts[i].decode("utf-8", "replace") for i in other], add_special_tokens=False), strict=True):
            got[i] = e.ids
        return got

    def _learn(self, hashes: np.ndarray, parts: list[bytes]) -> None:
        got = self._ids(parts)
        n, k = len(self.keys), len(got)
        self.ids, self.off = self._kept(self.ids, self.off, n, [len(x) for x in got], np.fromiter((t for x in got for t in x), np.uint32))
        self.bytes, self.byte_off = self._kept(self.bytes, self.byte_off, n, [len(p) for p in parts], np.frombuffer(b"".join(parts), np.uint8))
        at = np.searchsorted(self.keys, hashes)
        self.keys, self.place = np.insert(self.keys, at, hashes), np.insert(self.place, at, np.arange(n, n + k))
        self.met = np.append(self.met, np.zeros(k, np.int64))

    @staticmethod
    def _kept(data: np.ndarray, off: np.ndarray, n: int, lens: list[int], more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """data and off with the next values after n of them; eight places stay spare."""
        at, off = off[n], _grown(off, n + len(lens) + 1)
        data = _grown(data, at + len(more) + 8)
        data[at : at + len(more)] = more
        off[n + 1 : n + len(lens) + 1] = at + np.cumsum(lens)
        return data, off

    @staticmethod
    def _folded(buf: np.ndarray) -> np.ndarray:
        """The bytes by which parts are told apart."""
        return LOWER[buf]

    def _parts(self, low: np.ndarray, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of what lies between white space and before marks that follow a letter."""
        cut = np.flatnonzero(_LETTER[low[:-1]] & _MARK[low[1:]]) + 1 if len(low) > 1 else np.zeros(0, np.int64)
        start, end, _ = spans(NONSPACE[buf], off)
        cut = cut[~np.isin(cut, off)]
        return np.sort(np.concatenate([start, cut])), np.sort(np.concatenate([end, cut]))

    def _looked_up(self, low: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each part which remembered word it is, and whether the bytes are the same too."""
        padded, size = np.concatenate([low, np.zeros(8, np.uint8)]), end - start
        found, first, back = np.unique(hash_spans(low, start, end), return_index=True, return_inverse=True)
        same = (size == size[first][back]) & same_spans(low, start, end, padded, start[first][back])
        if len(self.keys) + len(found) > self.share * CACHE_WORDS or self.byte_off[len(self.keys)] > self.share * CACHE_BYTES:
            self._shrink()
        at = np.searchsorted(self.keys, found)
        new = np.flatnonzero(np.append(self.keys, np.uint64(0))[at] != found) if len(self.keys) else np.arange(len(found))
        if len(new):
            data = low.tobytes()
            self._learn(found[new], [data[start[first[i]] : end[first[i]]] for i in new.tolist()])
        word = self.place[np.searchsorted(self.keys, found)]
        self.met[word] += 1
        order = np.argsort(first)
        one, held = first[order], word[order]
        known = (size[one] == (self.byte_off[held + 1] - self.byte_off[held])) & same_spans(low, start[one], end[one], self.bytes, self.byte_off[held])
        sure = np.empty(len(found), dtype=bool)
        sure[order] = known
        return word[back], same & sure[back]

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def encode(self, buf: np.ndarray, off: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of each text, closed by end_id, one after another, and where each text's begin."""
        n, low = len(off) - 1, self._folded(buf)
        start, end = self._parts(low, buf, off)
        row = np.searchsorted(off, start, "right") - 1
        alone = self._entangled(buf, off)
        keep = ~np.isin(row, alone)
        start, end, row = start[keep], end[keep], row[keep]
        word = np.zeros(0, np.int64)
        if len(start):
            word, sure = self._looked_up(low, start, end)
            alone = np.union1d(alone, row[~sure])
            keep = ~np.isin(row, alone)
            row, word = row[keep], word[keep]
        whole = {int(r): self._whole(buf[off[r] : off[r + 1]].tobytes().decode("utf-8", "replace")) for r in alone}
        lens = self.off[word + 1] - self.off[word]
        size = np.bincount(row, lens, minlength=n).astype(np.int64) + 1
        for r, ids in whole.items():
            size[r] = len(ids) + 1
        begin = np.concatenate([[0], np.cumsum(size)])
        out = np.full(begin[-1], end_id, np.uint32)
        if len(word):
            source = np.repeat(self.off[word] - np.concatenate([[0], np.cumsum(lens)[:-1]]), lens) + np.arange(lens.sum())
            before = np.concatenate([[0], np.cumsum(lens)[:-1]])
            first_word = np.searchsorted(row, row)
            place = np.repeat(begin[row] + before - before[first_word] - before, lens) + np.arange(lens.sum())
            out[place] = self.ids[source]
        for r, ids in whole.items():
            out[begin[r] : begin[r + 1] - 1] = ids
        return out, begin

    @staticmethod
    def _entangled(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Rows of texts whose parts may influence one another."""
        if len(buf) < 2:
            return np.zeros(0, np.int64)
        odd = ((buf[:-1] == 0x3C) & (buf[1:] == 0x7C)) | ((buf[:-1] == 0xCE) & (buf[1:] == 0xA3))
        return np.unique(np.searchsorted(off, np.flatnonzero(odd), "right") - 1)


def token_pieces(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """doc_id, piece, start, length and ids (little-endian unsigned 32-bit) of each piece of each whole text."""
    with open(path, encoding="utf-8") as file:
        text = file.read()
    name, shared = f"{zlib.crc32(text.encode())}-{len(text)}", docs.sparkSession.sparkContext.broadcast(text)

    def fn(batch):
        if name not in _tokenizers:
            _tokenizers[name] = WordTokenizer(shared.value)
        doc_id = batch.column("doc_id")
        for i, j, buf, off in pieces(batch.column("text"), 1 << 20):
            ids, begin = _tokenizers[name].encode(buf, off, end_id)
            size = np.diff(begin)
            count = -(-size // capacity)
            row = np.repeat(np.arange(j - i), count)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            start = piece * capacity
            length = np.minimum(size[row] - start, capacity)
            ends = np.append(begin[row] + start, begin[-1]) * 4
            data = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(ids.astype("<u4"))])
            yield pa.Table.from_arrays([doc_id.take(pa.array(row + i)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), data], ["doc_id", "piece", "start", "length", "ids"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), fn, "doc_id long, piece int, start long, length long, ids binary")


def configurations(sizes: np.ndarray, counts: np.ndarray, capacity: int, rounds: int = 500) -> list[tuple[int, np.ndarray]]:
    """How often to use which configuration (items of each size in one sequence): a linear programme by column generation, rounded down."""
    k = len(sizes)
    basis, cost = np.diag(capacity // sizes).astype(float), np.ones(k)
    for _ in range(rounds):
        inverse = np.linalg.inv(basis)
        y, x = cost @ inverse, inverse @ counts
        if y.min() < -1e-9:
            column, price = -np.eye(k)[y.argmin()], 0.0
        else:
            # best[c]: the most that a sequence with c free can hold by these prices
            best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
            for c in range(int(sizes.min()), capacity + 1):
                gain = np.where(sizes <= c, best[np.maximum(c - sizes, 0)] + y, -1.0)
                i = gain.argmax()
                best[c], last[c] = (gain[i], i) if gain[i] > best[c - 1] + 1e-12 else (best[c - 1], -1)
            if best[capacity] <= 1 + 1e-6:
                break
            column, price, c = np.zeros(k), 1.0, capacity
            while c > 0:
                if last[c] < 0:
                    c -= 1
                else:
                    column[last[c]] += 1
                    c -= sizes[last[c]]
        step = inverse @ column
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        out = ratio.argmin()
        if not np.isfinite(ratio[out]):
            break
        basis[:, out], cost[out] = column, price
    x = np.linalg.solve(basis, counts)
    return [(int(n), basis[:, j].astype(np.int64)) for j, n in enumerate(np.floor(x + 1e-9)) if cost[j] and n >= 1]


class Plan:
    """Runs of places: the items numbered from ``first`` on of a length, ``each`` a sequence, from sequence and offset on."""

    def __init__(self, counts: np.ndarray, capacity: int):
        self.capacity, self.left, self.sequences = capacity, counts.astype(np.int64).copy(), 0
        self.first = np.concatenate([[0], np.cumsum(counts)])[:-1].astype(np.int64)
        self.runs: list[tuple[int, int, int, int, int]] = []
        self.free: dict[int, list[tuple[int, int]]] = {}

    def put(self, length: int, n: int, each: int, sequence: int, offset: int) -> None:
        """The next n items of this length, ``each`` to a sequence."""
        self.runs.append((int(self.first[length]), each, length, sequence, offset))
        self.first[length] += n
        self.left[length] -= n

    def open(self, n: int) -> int:
        self.sequences += n
        return self.sequences - n

    def leave(self, space: int, sequence: int, n: int) -> None:
        if n and space:
            self.free.setdefault(space, []).append((sequence, n))

    def best_fit(self, length: int) -> None:
        """All items left of this length into the least space that holds them, as many as fit there."""
        while n := int(self.left[length]):
            space = min((s for s in self.free if s >= length), default=0)
            if space:
                sequence, many = self.free[space].pop()
                if not self.free[space]:
                    del self.free[space]
            else:
                space, many = self.capacity, -(-n // (self.capacity // length))
                sequence = self.open(many)
            each = space // length
            full = min(many, n // each)
            if full:
                self.put(length, full * each, each, sequence, self.capacity - space)
                self.leave(space - each * length, sequence, full)
            rest = n - full * each if full < many else 0
            if rest:
                self.put(length, rest, rest, sequence + full, self.capacity - space)
                self.leave(space - rest * length, sequence + full, 1)
                full += 1
            self.leave(space, sequence + full, many - full)

    def table(self) -> np.ndarray:
        return np.array(sorted(self.runs), np.int64).reshape(-1, 5)


def linear_grouping(counts: np.ndarray, capacity: int, groups: int = 24, smallest: float = 0.4) -> Plan:
    """The plan for counts[length] items of each length up to capacity."""
    plan = Plan(counts, capacity)
    if plan.left[capacity]:
        n = int(plan.left[capacity])
        plan.put(capacity, n, 1, plan.open(n), 0)
    large = [x for x in range(capacity - 1, int(capacity * smallest), -1) if plan.left[x]]
    total = int(sum(plan.left[x] for x in large))
    if total:
        # groups of equal cardinality, largest first: [(length, n), ...] each
        share, grouped, room = -(-total // groups), [[]], -(-total // groups)
        for length in large:
            n = int(plan.left[length])
            while n:
                take = min(n, room)
                grouped[-1].append((length, take))
                n, room = n - take, room - take
                if not room:
                    grouped.append([])
                    room = share
        grouped = [g for g in grouped if g]
        merged: dict[int, list] = {}  # groups whose largest is the same have one rounded size
        for g in grouped:
            merged.setdefault(g[0][0], []).extend(g)
        sizes = np.array(list(merged))
        queue = [list(g) for g in merged.values()]
        for times, mix in configurations(sizes, np.array([sum(n for _, n in g) for g in queue], float), capacity):
            start = plan.open(times)
            parts = [(start, times, 0)]  # alike so far: sequence, how many, filled
            for i in np.flatnonzero(mix):
                for _ in range(mix[i]):
                    done = []
                    for sequence, many, filled in parts:
                        while many and queue[i]:
                            length, n = queue[i][0]
                            take = min(n, many)
                            plan.put(length, take, 1, sequence, filled)
                            queue[i][0] = (length, n - take)
                            if n == take:
                                queue[i].pop(0)
                            done.append((sequence, take, filled + length))
                            sequence, many = sequence + take, many - take
                        if many:
                            done.append((sequence, many, filled))
                    parts = done
            for sequence, many, filled in parts:
                plan.leave(capacity - filled, sequence, many)
    for length in range(capacity, 0, -1):
        plan.best_fit(length)
    return plan


def best_plan(counts: np.ndarray, capacity: int, shares: tuple[float, ...] = (0.4, 0.45, 0.5)) -> Plan:
    """The plan with the fewest sequences of those that take lengths over these shares of the capacity as large."""
    return min((linear_grouping(counts, capacity, smallest=s) for s in shares), key=lambda plan: plan.sequences)


def pack(items: DataFrame, row: str, capacity: int = 4096, least_part: int = 100) -> DataFrame:
    """items with sequence_id and offset: no sequence longer than capacity, its items without gaps from 0.

    ``length`` is between 1 and capacity; ``row`` names a column of unique numbers, which stay the same when a task is run
    again (a written table's). The items of a length are numbered in parts, dealt by these numbers: a part has about
    ``least_part`` items or, in a large table, a ten-thousandth of all, so there are at most capacity + 10,000 parts.
    Columns sequence_id and offset that items has already give way.
    """
    items = items.drop("sequence_id", "offset")
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in items.groupBy("length").count().collect():  # at most capacity rows
        counts[length] = n
    salts = np.maximum(1, -(-counts // max(least_part, int(counts.sum()) // 10_000)))
    of = items.sparkSession.createDataFrame([(i, int(n)) for i, n in enumerate(salts) if counts[i]], "length long, __salts long")
    salted = items.join(F.broadcast(of), "length").withColumn("__salt", F.pmod(F.xxhash64(row), F.col("__salts")))
    parts = sorted((length, salt, n) for length, salt, n in salted.groupBy("length", "__salt").count().collect())
    place = np.concatenate([[0], np.cumsum(salts)])  # of each length's first part
    number = np.zeros(place[-1], np.int64)
    for length, salt, n in parts:
        number[place[length] + salt] = n
    before = np.cumsum(number) - number
    runs = best_plan(counts, capacity).table()
    shared, names = items.sparkSession.sparkContext.broadcast((place, before, runs)), items.columns

    def fn(batch):
        place, before, runs = shared.value
        number = before[place[batch.column("length").to_numpy()] + batch.column("__salt").to_numpy()] + batch.column("__nth").to_numpy() - 1
        first, each, length, sequence, offset = runs[np.searchsorted(runs[:, 0], number, "right") - 1].T
        at = number - first
        yield pa.Table.from_arrays([*(batch.column(c) for c in names), pa.array(sequence + at // each), pa.array(offset + at % each * length)], [*names, "sequence_id", "offset"])

    numbered = salted.withColumn("__nth", F.row_number().over(Window.partitionBy("length", "__salt").orderBy(row)))
    schema = T.StructType([*items.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return map_arrow(numbered, fn, schema)


def pack_documents(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of each piece of docs(doc_id, text, ...)."""
    scratch = Scratch(docs.sparkSession, "packing")
    cut = token_pieces(docs, path, capacity, end_id).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    cut = scratch.save(cut.withColumn("row", F.monotonically_increasing_id()), "pieces")
    return pack(cut, "row", capacity).drop("row")
