"""Alignment of two tokenizers' tokens by diagonal run skipping.

Both tokenizers' tokens of one text are byte ranges whose ends ascend; where an A and a B token end together the text is cut
into groups. Texts are mostly stretches where one A token is one B token, and there both arrays of ends agree at a fixed shift
of their indexes. So ends are compared at the present shift in blocks of 4, 8, 16, ... tokens; the block that differs is halved
down to the last agreeing token. What follows is an irregular group: the side whose end is behind moves on until both ends
meet, which gives the new shift.

A first pass over the texts writes each row's tokens in figures and its links (A and B ids of tokens that end together). Links
are counted by pair of ids in the tasks, then by Spark. Texts meet the counts again by their links: the pairs counted most go to
all tasks (at most ``top`` rows, counted), links of rarer pairs join their counts by key, and are added up by row.

Defined cases: null and empty texts have no tokens; so have texts whose tokens of either kind don't give the bytes of a space and
the text (a normaliser changed them); a very long text is aligned in whole; repeated rows each count; a null doc_id stays
null; strings of special tokens in texts are plain text; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .binary_packing import byte_tokenizer
from .byte_tokens import PieceTokenizer
from .common import BROADCAST_ROWS, Scratch, lookup, map_arrow
from .text import pieces, utf8

_pairs: dict[str, "TokenPair"] = {}


def _byte_of() -> dict[str, int]:
    """Byte-level characters: visible Latin-1 ones stand for their byte, those from U+0100 on for the others in order."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


class TokenPair:
    """Tokenizers A (byte-level, a tokenizer file's text) and B (pieces, a model's bytes) and their tokens' bytes."""

    def __init__(self, name: str, vocabulary: str, model: bytes):
        self.a, self.b = byte_tokenizer(f"{name}-plain", vocabulary, special=False), PieceTokenizer(model)
        self.a.share = self.b.share = 0.5
        self.bytes_a, self.bytes_b = (np.array(x, dtype=object) for x in (bytes_of_a(self.a.tokenizer), bytes_of_b(self.b.pieces)))
        self.len_a, self.len_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (self.bytes_a, self.bytes_b))
        # each id in figures with what follows it: a comma, or at a group's end a bar (A) or a semicolon (B)
        self.shown = np.array([f"{i}{c}" for n, c2 in ((len(self.bytes_a), ",|"), (len(self.bytes_b), ",;")) for i in range(n) for c in c2], dtype=object)


def bytes_of_a(tokenizer) -> list[bytes]:
    """The bytes of each id of a byte-level tokenizer."""
    byte_of, out = _byte_of(), [b""] * tokenizer.get_vocab_size()
    for piece, i in tokenizer.get_vocab().items():
        out[i] = bytes(byte_of[c] for c in piece) if all(c in byte_of for c in piece) else piece.encode()
    return out


def bytes_of_b(model) -> list[bytes]:
    """The bytes of each id of a piece model: a byte piece's byte, otherwise the piece with U+2581 as space."""
    out = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        out.append(bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode())
    return out


def align(ends_a: list[int], ends_b: list[int]) -> tuple[bytearray, bytearray]:
    """For each token of A and of B whether a group ends with it. Both lists ascend and have the same last end."""
    n, m = len(ends_a), len(ends_b)
    last_a, last_b = bytearray(n), bytearray(m)
    i = j = 0
    while i < n:
        # along the diagonal, twice as far at each probe; once ends differ, half as far
        begin, step = i, 4
        while i < n and ends_a[i : i + step] == ends_b[j : j + step]:
            i, j, step = i + step, j + step, 2 * step
        while step > 1 and i < n:
            step >>= 1
            if ends_a[i : i + step] == ends_b[j : j + step]:
                i, j = i + step, j + step
        if i > n:  # both lists end at once
            i, j = n, m
        size = i - begin
        last_a[begin:i] = last_b[j - size : j] = b"\1" * size
        if i == n:
            break
        # an irregular group: the side behind moves on until ends meet; that is the new shift
        a, b = ends_a[i], ends_b[j]
        while a != b:
            if a < b:
                i += 1
                a = ends_a[i]
            else:
                j += 1
                b = ends_b[j]
    return last_a, last_b


def _differing(data: bytes, off: np.ndarray, tokens: list[bytes], begin: np.ndarray) -> np.ndarray:
    """Whether each text isn't what its tokens' bytes make."""
    if b"".join(tokens) == data:
        return np.zeros(len(off) - 1, dtype=bool)
    return np.array([b"".join(tokens[begin[r] : begin[r + 1]]) != data[off[r] : off[r + 1]] for r in range(len(off) - 1)], dtype=bool)


def _without_last(ids: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's ids without the one that closes them."""
    keep = np.ones(len(ids), dtype=bool)
    keep[begin[1:] - 1] = False
    return ids[keep].astype(np.int64), begin - np.arange(len(begin))


def _of_rows(ids: np.ndarray, begin: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of these rows (a mask), and how many each row has; the others have none."""
    size = np.diff(begin)
    return ids[np.repeat(rows, size)], np.where(rows, size, 0)


def aligned_texts(pair: TokenPair, buf: np.ndarray, off: np.ndarray) -> list[pa.Array | np.ndarray]:
    """n_a, n_b, n_groups, groups_sha256 and links (A id * size of B + B id, with where each row's begin) of texts after a space.

    All texts are aligned in one go: where a text ends, tokens of both kinds end.
    """
    data, n_b = buf.tobytes(), len(pair.bytes_b)
    (ids_a, begin_a), (ids_b, begin_b) = (_without_last(*x.encode(buf, off, 0)) for x in (pair.a, pair.b))
    good = np.diff(off) > 1
    good &= ~_differing(data, off, pair.bytes_a[ids_a].tolist(), begin_a)
    good &= ~_differing(data, off, pair.bytes_b[ids_b].tolist(), begin_b)
    (ids_a, n), (ids_b, m) = _of_rows(ids_a, begin_a, good), _of_rows(ids_b, begin_b, good)
    last_a, last_b = align(np.cumsum(pair.len_a[ids_a]).tolist(), np.cumsum(pair.len_b[ids_b]).tolist())
    last_a, last_b = np.frombuffer(last_a, np.uint8), np.frombuffer(last_b, np.uint8)
    # A's tokens of a group stand behind all tokens of the groups before it, B's behind A's of their own group
    until_a, until_b = np.flatnonzero(last_a) + 1, np.flatnonzero(last_b) + 1
    order = np.empty(len(ids_a) + len(ids_b), np.int64)
    order[np.arange(len(ids_a)) + np.concatenate([[0], until_b])[np.cumsum(last_a) - last_a]] = 2 * ids_a + last_a
    order[np.arange(len(ids_b)) + until_a[np.cumsum(last_b) - last_b]] = 2 * (len(pair.bytes_a) + ids_b) + last_b
    shown, ends = pair.shown[order].tolist(), np.cumsum(n + m).tolist()
    told = [hashlib.sha256("".join(shown[a:b])[:-1].encode()).hexdigest() if b > a else "" for a, b in zip([0, *ends], ends)]  # noqa: B905
    links = ids_a[until_a - 1] * n_b + ids_b[until_b - 1]
    groups = np.diff(np.concatenate([[0], np.cumsum(last_a, dtype=np.int64)])[np.concatenate([[0], np.cumsum(n)])])
    return [n, m, groups, pa.array(told, pa.string()), links]


_ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, links binary"


def aligned(docs: DataFrame, vocabulary: str, model: str) -> tuple[DataFrame, str, int]:
    """Each row's figures and links, with the type of a link and the number of B ids; both paths are the tokenizers' files."""
    with open(vocabulary, encoding="utf-8") as file, open(model, "rb") as other:
        given = file.read(), other.read()
    name = "-".join(str(zlib.crc32(x if isinstance(x, bytes) else x.encode())) for x in given)
    here = TokenPair(name, *given)
    n_a, n_b = len(here.bytes_a), len(here.bytes_b)
    shared, kind = docs.sparkSession.sparkContext.broadcast(given), "<u4" if n_a * n_b <= 1 << 32 else "<u8"

    def fn(batch):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if name not in _pairs:
            _pairs[name] = TokenPair(name, *shared.value)
        pair, doc_id = _pairs[name], batch.column("doc_id")
        empty, space = (pa.scalar(x, pa.large_string()) for x in ("", " "))
        spaced = pc.binary_join_element_wise(empty, pc.fill_null(batch.column("text").cast(pa.large_string()), ""), space)  # space, then text
        for i, j, buf, off in pieces(spaced, 1 << 19):
            n, m, groups, told, links = aligned_texts(pair, buf, off)
            ends = np.concatenate([[0], np.cumsum(groups)]) * np.dtype(kind).itemsize
            column = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(links.astype(kind))])
            yield pa.Table.from_arrays([doc_id.slice(i, j - i), pa.array(n), pa.array(m), pa.array(groups), told, column], ["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "links"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), fn, _ALIGNED), kind, n_b


def _links(batch: pa.RecordBatch, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The links of a batch's rows one after another, and where each row's begin."""
    buf, off = utf8(batch.column("links"))
    size = np.dtype(kind).itemsize
    return np.frombuffer(buf.tobytes(), kind).astype(np.int64), off // size


def pair_counts(rows: DataFrame, kind: str, n_b: int) -> DataFrame:
    """pair, n and best (no pair of its B id has more) of each linked pair of ids."""

    def fn(batch) -> Iterator[pa.Table]:
        pair, n = np.unique(_links(batch, kind)[0], return_counts=True)
        yield pa.Table.from_arrays([pa.array(pair), pa.array(n)], ["pair", "n"])

    counts = map_arrow(rows.select("links"), fn, "pair long, n long", by="links").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = Scratch(rows.sparkSession, "pairs").save(counts, "counts")
    most = counts.groupBy((F.col("pair") % n_b).alias("b")).agg(F.max("n").alias("most"))  # at most as many rows as B has ids
    return counts.join(F.broadcast(most), F.col("pair") % n_b == F.col("b")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _least(counts: DataFrame, top: int) -> int:
    """The least count, a power of two, of which no more than ``top`` pairs have as much."""
    total = 0
    for power, n in sorted(((r.power, r.n) for r in counts.groupBy(F.floor(F.log2("n")).cast("int").alias("power")).agg(F.count("*").alias("n")).collect()), reverse=True):
        total += n
        if total > top:
            return 2 << power
    return 1


def with_counts(rows: DataFrame, kind: str, n_b: int, top: int = BROADCAST_ROWS) -> DataFrame:
    """rows with n_links, n_best and count_sum, from the counts of their links' pairs over all rows; ``row`` is unique."""
    scratch = Scratch(rows.sparkSession, "counts")
    counts = scratch.save(pair_counts(rows, kind, n_b), "counts")
    least = _least(counts, top)
    common = counts.filter(F.col("n") >= least).orderBy("pair").toArrow()  # top rows at most
    shared = rows.sparkSession.sparkContext.broadcast([common.column(c).to_numpy() for c in ("pair", "n", "best")])
    names = ["row", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256"]

    def fn(batch):
        pair, n, best = shared.value
        links, off = _links(batch, kind)
        at = np.minimum(np.searchsorted(pair, links), max(len(pair) - 1, 0))
        known = pair[at] == links if len(pair) else np.zeros(len(links), dtype=bool)
        sums = [np.concatenate([[0], np.cumsum(np.where(known, x[at], 0) if len(pair) else known)])[off] for x in (best.astype(np.int64), n)]
        rest = pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(~known)])[off]), pa.array(links[~known])).cast(pa.list_(pa.int64()))
        yield pa.Table.from_arrays(
            [*(batch.column(c) for c in names), pa.array(np.diff(off)), *(pa.array(np.diff(s).astype(np.int64)) for s in sums), rest],
            [*names, "n_links", "n_best", "count_sum", "rest"],
        )

    out = map_arrow(rows, fn, "row long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, n_links long, n_best long, count_sum long, rest array<long>", by="links")
    if least == 1:
        return out.drop("rest")
    out = scratch.save(out, "summed")
    rare = scratch.save(out.filter(F.size("rest") > 0).select("row", F.explode("rest").alias("pair")).groupBy("row", "pair").agg(F.count("*").alias("times")), "rare")
    found = lookup(rare, scratch.save(counts.filter(F.col("n") < least), "rare-counts"), "pair", scratch, "rare-heavy", by=["row"])
    more = found.groupBy("row").agg(F.sum(F.col("times") * F.col("best").cast("long")).alias("__best"), F.sum(F.col("times") * F.col("n")).alias("__sum"))
    out = lookup(out.drop("rest"), scratch.save(more, "more"), "row", scratch, "more-heavy", by=["row"], how="left")
    total = {c: F.col(c) + F.coalesce(more, F.lit(0)) for c, more in (("n_best", "__best"), ("count_sum", "__sum"))}
    return out.withColumns(total).drop("__best", "__sum")


def align_documents(docs: DataFrame, vocabulary: str, model: str, top: int = BROADCAST_ROWS) -> DataFrame:
    """row (unique), doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each row of docs(doc_id, text, ...)."""
    rows, kind, n_b = aligned(docs, vocabulary, model)
    rows = Scratch(docs.sparkSession, "aligned").save(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
    return with_counts(rows, kind, n_b, top)
