"""Quality by regularised quadratic discriminant analysis over document statistics.

Each whole text becomes a vector of transformed statistics. Per class the mean and the covariance come from sums over
all labelled rows outside the held-out fold, added up in Spark; the covariance is shrunk towards the pooled one and
towards its own diagonal. A score is the posterior of class 1: the sigmoid of the difference of the two log-densities,
each half the squared Mahalanobis distance from a cached Cholesky factor plus its log-determinant, and of the log-priors.

Defined cases: null text counts as empty, and an empty text is a vector like any other; a very long text is read in whole;
a row without doc_id is never learnt from, its held_out is null and it is scored like any other; repeated labels of one id
count once (the greater), repeated rows of it each; equal texts get equal scores; a class with no labelled row gives every
text the share of the other class (0.5 with no labels at all); an empty table gives an empty result; labels that are null
count as absent; other columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, fold, lookup, map_arrow
from .text import NONSPACE, hash_spans, list_array, mix, pieces, shingles, spans, words

HELD_OUT_OF, HELD_OUT = 5, 0
#: Character classes by byte; a class for each kind whose share tells something.
_KINDS = np.full(256, 9, dtype=np.int64)
for _k, _chars in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\r\n", ".,;:'\"?()-", "!", "#$%&*+<=>@^_~/\\", "|{}[]`")):
    _KINDS[[ord(c) for c in _chars]] = _k
_KINDS[128:192], _KINDS[192:] = 10, 8
NAMES = ("words", "word_length", "word_spread", "upper", "digit", "space", "point", "bang", "symbol", "bracket", "beyond_ascii", "other", "distinct_words", "top_word", "repeats", "distinct_pairs", "line_length", "distinct_lines", "lines")


def _per_row(row: np.ndarray, n: int, weight: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(row, weight, minlength=n).astype(np.float64)


def statistics(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row of transformed statistics for each text: logs of sizes, arc sines of the roots of shares."""
    n = len(off) - 1
    kinds = np.bincount(np.repeat(np.arange(n), np.diff(off)) * 11 + _KINDS[buf], minlength=11 * n).reshape(n, 11).astype(np.float64)
    chars = np.maximum(kinds[:, :10].sum(axis=1), 1)
    start, end, row, h = words(buf, off, NONSPACE)
    length, count = (end - start).astype(np.float64), _per_row(row, n)
    some = np.maximum(count, 1)
    mean = _per_row(row, n, length) / some
    spread = np.sqrt(np.maximum(_per_row(row, n, length**2) / some - mean**2, 0))
    _, first, times = np.unique(mix(h + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True, return_counts=True)
    top = np.zeros(n)
    np.maximum.at(top, row[first], times)
    same = row[1:] == row[:-1]
    repeats = _per_row(row[1:][same & (h[1:] == h[:-1])], n)
    pair_row = row[:-1][same]
    pair = shingles(h, 2)[same] if len(h) > 1 else np.zeros(0, np.uint64)
    _, pair_first = np.unique(mix(pair + pair_row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)
    l_start, l_end, l_row = spans(buf != 10, off)
    lines = _per_row(l_row, n)
    _, l_first = np.unique(mix(hash_spans(buf, l_start, l_end) + l_row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)
    share = lambda part, whole: np.arcsin(np.sqrt(np.clip(part / np.maximum(whole, 1), 0, 1)))
    return np.stack(
        [np.log1p(count), np.log1p(mean), np.log1p(spread)]
        + [share(kinds[:, k], chars) for k in (1, 2, 3, 4, 5, 6, 7, 8, 9)]
        + [share(_per_row(row[first], n), some), share(top, some), share(repeats, some), share(_per_row(pair_row[pair_first], n), np.maximum(count - 1, 1))]
        + [np.log1p(chars / np.maximum(lines, 1)), share(_per_row(l_row[l_first], n), lines), np.log1p(lines)],
        axis=1,
    )


def features(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of each whole text."""

    def fn(batch):
        out = np.concatenate([statistics(buf, off) for _, _, buf, off in pieces(batch.column("text"))])
        yield pa.Table.from_arrays([batch.column("doc_id"), list_array(out.ravel(), np.arange(len(out) + 1) * out.shape[1], pa.float64())], ["doc_id", "x"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), fn, "doc_id long, x array<double>")


@dataclass(frozen=True)
class QdaModel:
    """Per class: log-prior, mean, inverse of the Cholesky factor, log-determinant. None: no such class."""

    parts: tuple
    share: float


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1)


def fit(feats: DataFrame, labels: DataFrame, to_pooled: float = 0.1, to_diagonal: float = 0.1) -> QdaModel:
    """Means and shrunk covariances of all labelled rows outside the held-out fold."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).filter("doc_id is not null and y in (0, 1)").filter(fold(F.col("doc_id"), HELD_OUT_OF) != HELD_OUT).groupBy("doc_id").agg(F.max("y").alias("y"))
    scratch = Scratch(feats.sparkSession, "marks")
    known = lookup(feats, scratch.save(marks, "marks"), "doc_id", scratch, "heavy", by=["doc_id"]).select("y", "x")
    d = len(NAMES)

    def fn(batch):
        x, y = _matrix(batch), batch.column("y").to_numpy()
        for c in (0, 1):
            own = x[y == c]
            sums = np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
            yield pa.Table.from_arrays([pa.array(np.full(len(sums), c, np.int32)), pa.array(np.arange(len(sums), dtype=np.int32)), pa.array(sums)], ["y", "i", "v"])

    total = np.zeros((2, 1 + d + d * d))
    for y, i, v in map_arrow(known, fn, "y int, i int, v double").groupBy("y", "i").agg(F.sum("v")).collect():
        total[y, i] = v
    n = total[:, 0]
    share = float(n[1] / n.sum()) if n.sum() else 0.5
    if not n.all():
        return QdaModel((None, None), share)
    mean = total[:, 1 : 1 + d] / n[:, None]
    scatter = total[:, 1 + d :].reshape(2, d, d) - n[:, None, None] * mean[:, :, None] * mean[:, None, :]
    pooled, parts = scatter.sum(axis=0) / n.sum(), []
    for c in (0, 1):
        s = (1 - to_pooled) * scatter[c] / n[c] + to_pooled * pooled
        s = (1 - to_diagonal) * s + to_diagonal * np.diag(np.diag(s)) + 1e-6 * np.eye(d)
        factor = np.linalg.cholesky(s)
        parts.append((float(np.log(n[c] / n.sum())), mean[c], np.linalg.inv(factor), float(2 * np.log(np.diag(factor)).sum())))
    return QdaModel(tuple(parts), share)


def score(feats: DataFrame, model: QdaModel) -> DataFrame:
    """doc_id and the posterior of class 1, 0 to 1."""

    def log_density(x, part):
        prior, mean, inverse, determinant = part
        return prior - 0.5 * (((x - mean) @ inverse.T) ** 2).sum(axis=1) - 0.5 * determinant

    def fn(batch):
        if model.parts[0] is None:
            p = np.full(batch.num_rows, model.share)
        else:
            x = _matrix(batch)
            p = 1 / (1 + np.exp(np.clip(log_density(x, model.parts[0]) - log_density(x, model.parts[1]), -700, 700)))
        yield pa.Table.from_arrays([batch.column("doc_id"), pa.array(p)], ["doc_id", "score"])

    return map_arrow(feats, fn, "doc_id long, score double")
