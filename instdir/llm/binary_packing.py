"""Power-of-two decomposition: documents cut into pieces of binary lengths, each a sequence of its own, bucketed by length.

A document of n tokens gives n // top pieces of ``top`` tokens and, of the rest, one piece for each bit, the largest first.
Every sequence is one such piece: none crosses documents, and as each length is a power of two, none is padded. A bucket holds
the sequences of one length; within it they are numbered without gaps, so batches of equal shape are ranges of numbers.

Tokenising is a narrow step over the documents whose tasks also number their pieces of each length. What crosses tasks are
these numbers' totals, one row a task and length. The table is written sorted by length within each task, so a reader of one
bucket skips the pages of the others by their statistics, without a file for every task and bucket.

Defined cases: null and empty texts are the closing id alone, one sequence of length 1; a very long text gives as many pieces of
``top`` as it needs; repeated rows are packed once each; a null doc_id stays null; an empty table gives an empty result;
other columns are not looked at.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .byte_tokens import ByteTokenizer
from .common import Scratch, lookup, map_arrow
from .text import pieces

_tokenizers: dict[str, ByteTokenizer] = {}


def byte_tokenizer(name: str, vocabulary: str, special: bool = True) -> ByteTokenizer:
    """The worker's tokenizer of that name, with all that it remembers."""
    if name not in _tokenizers:
        _tokenizers[name] = ByteTokenizer(vocabulary, special)
    return _tokenizers[name]


def decompose(sizes: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and length of every piece of documents of these sizes, in order; top is a power of two."""
    whole, rest = sizes // top, sizes % top
    powers = top >> np.arange(1, top.bit_length())  # top / 2 to 1
    bits = (rest[:, None] & powers) > 0
    count = np.concatenate([whole[:, None], bits], axis=1).ravel()
    length = np.repeat(np.tile(np.concatenate([[top], powers]), len(sizes)), count)
    row = np.repeat(np.repeat(np.arange(len(sizes)), 1 + len(powers)), count)
    before = np.cumsum(length) - length
    return row, before - (np.cumsum(sizes) - sizes)[row], length


def _numbers(length: np.ndarray, met: dict[int, int]) -> np.ndarray:
    """Each piece's number among those of its length in this task; met has how many there were."""
    out = np.empty(len(length), np.int64)
    for size in np.unique(length).tolist():
        at = np.flatnonzero(length == size)
        out[at] = met.get(size, 0) + np.arange(len(at))
        met[size] = met.get(size, 0) + len(at)
    return out


def token_pieces(docs: DataFrame, path: str, top: int = 2048, end_id: int = 1) -> DataFrame:
    """doc_id, start, length, doc_tokens, ids (little-endian unsigned 32-bit), and task and nth, which number the pieces of a length."""
    with open(path, encoding="utf-8") as file:
        text = file.read()
    name, shared = f"{zlib.crc32(text.encode())}-{len(text)}", docs.sparkSession.sparkContext.broadcast(text)
    names = ["doc_id", "start", "length", "doc_tokens", "ids", "task", "nth"]
    met: dict[tuple[int, int], dict[int, int]] = {}

    def fn(batch):
        tokenizer, context = byte_tokenizer(name, shared.value), TaskContext.get()
        attempt = (context.taskAttemptId(), context.partitionId())
        if attempt not in met:  # a worker that runs another task begins anew
            met.clear()
            met[attempt] = {}
        doc_id = batch.column("doc_id")
        for i, _, buf, off in pieces(batch.column("text"), 1 << 20):
            ids, begin = tokenizer.encode(buf, off, end_id)
            sizes = np.diff(begin)
            row, start, length = decompose(sizes, top)
            ends = np.append(begin[row] + start, begin[-1]) * 4
            data = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(ids.astype("<u4"))])
            nth = _numbers(length, met[attempt])
            task = np.full(len(row), context.partitionId(), np.int32)
            yield pa.Table.from_arrays([doc_id.take(pa.array(row + i)), pa.array(start), pa.array(length), pa.array(sizes[row]), data, pa.array(task), pa.array(nth)], names)

    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), fn, "doc_id long, start long, length long, doc_tokens long, ids binary, task int, nth long")


def pack_binary(docs: DataFrame, path: str, top: int = 2048, end_id: int = 1) -> DataFrame:
    """doc_id, start, length, doc_tokens, ids, sequence_id, offset, bucket and number in it, of each piece of docs(doc_id, text, ...).

    Sequences are numbered through, the bucket of the shortest first; offset is always 0.
    """
    scratch = Scratch(docs.sparkSession, "binary")
    cut = scratch.save(token_pieces(docs, path, top, end_id).sortWithinPartitions("length"), "pieces")
    counts = scratch.save(cut.groupBy("length", "task").agg(F.count("*").alias("n")), "counts")  # a row for each task and length
    sizes = sorted((r.length, r.n) for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect())  # a row for each length
    bases = dict(zip([length for length, _ in sizes], np.cumsum([0, *(n for _, n in sizes)]).tolist(), strict=False))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    first = scratch.save(counts.select("length", "task", F.coalesce(before, F.lit(0)).alias("__first")), "first")
    out = lookup(cut, first, ["length", "task"], scratch, "heavy", by=["nth"], counts=counts)
    base = F.lit(0).cast("long")
    for length, at in bases.items():
        base = F.when(F.col("length") == length, at).otherwise(base)
    out = out.withColumn("number", F.col("__first") + F.col("nth")).withColumn("bucket", F.log2("length").cast("int"))
    return out.select("doc_id", "start", "length", "doc_tokens", "ids", (base + F.col("number")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), "bucket", "number")
