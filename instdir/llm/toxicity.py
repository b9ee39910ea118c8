"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier over hashed words is trained in numpy from confirmed toxic texts and from unlabelled ones: documents
drawn by a hash of their id, whether labels cover them or not. Its risk is the class-prior-corrected one: with the prior p
of toxic texts, p * R(positives as 1) + max(0, R(unlabelled as 0) - p * R(positives as 0)), logistic loss; where the second
part is negative it has no slope, so the classifier can't gain by fitting it below zero. Each word counts once a text,
scaled by the log of its share among the positives over that among the unlabelled; only words whose share among the
positives is greater beyond chance are kept.

No negative label is used. Classifiers of four folds rank the texts that they have not seen. The prior, unless given, is
the least ratio of the unlabelled share to the positive share above any threshold, with its margin. The threshold with the
least cost under that prior (a flag is worth it where 0.3 of the texts are toxic) gives the share of unlabelled texts to
flag; scores are shifted so that the final classifier flags this share at 0.3.

Only the bounded training sample reaches the driver, as hashed words: so many texts of either kind, and so many words in
all. The model that tasks get has a fixed size.

Defined cases: null and wordless texts get the score of the bias alone; a very long text counts each of its words once; a
row without doc_id is never learnt from, its held_out is null and it is scored like any other; of rows that share a doc_id
one text is learnt from; equal texts get equal scores; with no confirmed example every score is 0; an empty table gives an
empty result; labels that are null count as absent; other columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, fold, lookup, map_arrow
from .text import ALNUM, bounds, list_array, mix, pieces, words

#: Log of the number of word buckets: the model's size is fixed.
LOG_BUCKETS = 20
HELD_OUT_OF, HELD_OUT = 4, 2
#: The prior that is used where it is neither given nor found.
PRIOR = 0.1


@dataclass(frozen=True)
class PuModel:
    weights: np.ndarray
    bias: float
    prior: float


def word_buckets(docs: DataFrame) -> DataFrame:
    """The columns of docs but text, and the distinct word buckets of each whole text."""
    names = [c for c in docs.columns if c != "text"]

    def fn(batch):
        out = []
        for i, j, buf, off in pieces(batch.column("text")):
            _, _, row, h = words(buf, off, ALNUM)
            at, h = bounds(row, j - i), (h >> np.uint64(64 - LOG_BUCKETS)).astype(np.int32)
            out += [np.unique(h[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
        yield pa.Table.from_arrays([*(batch.column(c) for c in names), list_array(np.concatenate(out), np.concatenate([[0], np.cumsum([len(x) for x in out])]), pa.int32())], [*names, "buckets"])

    return map_arrow(docs, fn, T.StructType([*(f for f in docs.schema if f.name != "text"), T.StructField("buckets", T.ArrayType(T.IntegerType()))]))


def _draw(seed: int) -> Column:
    """A number from 0 to 1 by the hash of the id."""
    return F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)


def sample(docs: DataFrame, labels: DataFrame, positives: int, unlabelled: int, max_words: int) -> DataFrame:
    """doc_id, confirmed, unlabelled and buckets of about so many texts, one an id, with at most max_words buckets in all.

    Labels and texts come from outside the held-out fold.
    """
    scratch, may_learn = Scratch(docs.sparkSession, "toxicity"), F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), HELD_OUT_OF) != HELD_OUT)
    toxic = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter(may_learn & (F.col("toxic") == 1)).select("doc_id").distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter(may_learn)
    n_positive, n = toxic.count(), texts.count()
    toxic = scratch.save(toxic.filter(_draw(7) < positives / max(n_positive, 1)), "confirmed").withColumn("confirmed", F.lit(True))
    texts = texts.withColumn("unlabelled", _draw(9) < unlabelled / max(n, 1))
    drawn = lookup(texts, toxic, "doc_id", scratch, "heavy", by=["doc_id"], how="left").withColumn("confirmed", F.coalesce("confirmed", F.lit(False)))
    drawn = word_buckets(drawn.filter("confirmed or unlabelled").select("doc_id", "confirmed", "unlabelled", "text"))
    one = drawn.groupBy("doc_id", "confirmed", "unlabelled").agg(F.min_by("buckets", F.xxhash64("buckets")).alias("buckets"))
    one = scratch.save(one.withColumn("draw", _draw(9)), "sample")
    sizes = one.select("draw", "confirmed", F.size("buckets").alias("size")).toPandas().sort_values("draw")  # bounded by the two counts
    held = np.full(2, np.inf)
    for part, own in sizes.groupby(sizes.confirmed.to_numpy().astype(int)):
        over = np.flatnonzero(own["size"].cumsum().to_numpy() > max_words // 2)
        if len(over):
            held[part] = own.draw.to_numpy()[over[0]]
    return one.filter(F.col("draw") < F.when(F.col("confirmed"), float(held[1])).otherwise(float(held[0]))).drop("draw")


def fit(docs: DataFrame, labels: DataFrame, positives: int = 8000, unlabelled: int = 16000, max_words: int = 8_000_000, prior: float | None = None, threshold: float = 0.3, min_z: float = 4.0, steps: int = 200) -> PuModel:
    """Learn from at most about ``positives`` confirmed texts and ``unlabelled`` others, with ``max_words`` words of four bytes in all."""
    got = sample(docs, labels, positives, unlabelled, max_words).toArrow().combine_chunks()
    is_p, is_u = (got.column(c).to_numpy().astype(bool) for c in ("confirmed", "unlabelled"))
    if not is_p.any() or not is_u.any():
        return PuModel(np.zeros(1 << LOG_BUCKETS, np.float32), -np.inf, 0.0)
    order = np.argsort(got.column("doc_id").to_numpy())  # the same sums whatever the order of rows
    lists = got.column("buckets").combine_chunks().take(pa.array(order))
    sizes = np.diff(lists.offsets.to_numpy())
    rows, cols = np.repeat(np.arange(len(sizes)), sizes), lists.flatten().to_numpy()
    is_p, is_u = is_p[order], is_u[order]
    rank, seen = _unseen_ranks(rows, cols, is_p, is_u, prior or PRIOR, min_z, steps)
    if prior is None:
        prior = least_ratio(rank[is_p & seen], rank[is_u & seen])
    share = best_share(rank[is_p & seen], rank[is_u & seen], prior, threshold)
    model = _train(rows, cols, is_p, is_u, prior, min_z, steps)
    z = model.bias + np.bincount(rows, model.weights[cols], minlength=len(is_p))[is_u]
    edge = _edge(z, share)
    return PuModel(model.weights, float(model.bias - edge + np.log(threshold / (1 - threshold))), prior)


def _unseen_ranks(rows: np.ndarray, cols: np.ndarray, is_p: np.ndarray, is_u: np.ndarray, prior: float, min_z: float, steps: int, folds: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Each text's rank among the unlabelled of its fold, by the classifier of the other folds; and which texts have one."""
    fold = (mix(np.arange(len(is_p), dtype=np.uint64)) % np.uint64(folds)).astype(int)
    rank, seen = np.zeros(len(is_p)), np.zeros(len(is_p), dtype=bool)
    for f in range(folds):
        own, rest = fold == f, fold != f
        if (is_u & own).any() and (is_u & rest).any() and (is_p & rest).any():
            model = _train(rows, cols, is_p & rest, is_u & rest, prior, min_z, steps)
            z = np.bincount(rows, model.weights[cols], minlength=len(is_p))
            rank[own] = np.searchsorted(np.sort(z[is_u & own]), z[own], "left") / (is_u & own).sum()
            seen |= own
    return rank, seen


def _edge(z: np.ndarray, share: float) -> float:
    """The least score to flag, so that the share of z from it on is as near to ``share`` as can be."""
    at = np.append(np.unique(z), z.max() + 1)
    return float(at[np.abs(1 - np.searchsorted(np.sort(z), at, "left") / len(z) - share).argmin()])


def _shares(positive: np.ndarray, unlabelled: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shares of both from each value of the positives on."""
    at = np.unique(positive)
    return tuple(1 - np.searchsorted(np.sort(x), at, "left") / len(x) for x in (positive, unlabelled))


def best_share(positive: np.ndarray, unlabelled: np.ndarray, prior: float, threshold: float = 0.3) -> float:
    """The share of the unlabelled above the score with the least cost: missed positives by 1 - threshold, flagged negatives by threshold."""
    if not len(positive) or not len(unlabelled):
        return prior
    share_p, share_u = _shares(positive, unlabelled)
    share_p, share_u = np.append(share_p, 0), np.append(share_u, 0)  # or no flag at all
    missed, flagged = prior * (1 - share_p), np.maximum(0, share_u - prior * share_p)
    return float(share_u[((1 - threshold) * missed + threshold * flagged).argmin()])


def least_ratio(positive: np.ndarray, unlabelled: np.ndarray, confidence: float = 0.1, weight: float = 0.01) -> float:
    """The prior by the best top bin: of all thresholds the one whose ratio of shares, with its margin, is least; its ratio.

    Where no threshold tells the two apart (a ratio over a half) it is PRIOR.
    """
    if not len(positive) or not len(unlabelled):
        return PRIOR
    share_p, share_u = _shares(positive, unlabelled)
    margin = sum(np.sqrt(np.log(4 / confidence) / (2 * len(x))) for x in (positive, unlabelled))
    best = (share_u / share_p + (1 + weight) / share_p * margin).argmin()
    ratio = float(share_u[best] / share_p[best])
    return max(ratio, 1e-3) if ratio <= 0.5 else PRIOR


def risk(z: np.ndarray, is_p: np.ndarray, is_u: np.ndarray, prior: float) -> tuple[float, float]:
    """The two parts of the risk of scores z: of positives as 1, and of the unlabelled as 0 without the positives' share."""
    as_0, as_1 = np.logaddexp(0, z), np.logaddexp(0, -z)
    return prior * as_1[is_p].mean(), as_0[is_u].mean() - prior * as_0[is_p].mean()


def slope(z: np.ndarray, is_p: np.ndarray, is_u: np.ndarray, prior: float) -> np.ndarray:
    """The gradient of the non-negative risk by z."""
    p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))  # the derivative of log(1 + exp(z)) is p, of log(1 + exp(-z)) is p - 1
    first = np.where(is_p, prior * (p - 1) / max(1, is_p.sum()), 0)
    if risk(z, is_p, is_u, prior)[1] < 0:
        return first
    return first + np.where(is_u, p / max(1, is_u.sum()), 0) - np.where(is_p, prior * p / max(1, is_p.sum()), 0)


def _train(rows: np.ndarray, cols: np.ndarray, is_p: np.ndarray, is_u: np.ndarray, prior: float, min_z: float, steps: int) -> PuModel:
    size = 1 << LOG_BUCKETS
    n_p, n_u = max(1, is_p.sum()), max(1, is_u.sum())
    in_p, in_u = np.bincount(cols[is_p[rows]], minlength=size), np.bincount(cols[is_u[rows]], minlength=size)
    f_p, f_u = in_p / n_p, in_u / n_u
    spread = np.sqrt((f_u + 1 / n_u) * (1 - np.minimum(f_u, 1 - 1 / n_u)) * (1 / n_p + 1 / n_u))
    ratio = np.log((in_p + 1) / (n_p + 2)) - np.log((in_u + 1) / (n_u + 2))
    scale = np.where((f_p - f_u >= min_z * spread) & (in_p >= 5), ratio, 0.0)
    keep = np.flatnonzero(scale)
    place = np.full(size, -1)
    place[keep] = np.arange(len(keep))
    at = place[cols]
    rows, at = rows[at >= 0], at[at >= 0]
    value, n = scale[keep][at], len(is_p)
    w, b = np.full(len(keep), 0.5), float(np.log(prior / max(1e-9, 1 - prior)))
    m, v = np.zeros(len(keep) + 1), np.zeros(len(keep) + 1)
    for step in range(1, steps + 1):
        d = slope(b + np.bincount(rows, value * w[at], minlength=n), is_p, is_u, prior)
        grad = np.append(np.bincount(at, d[rows] * value, minlength=len(w)) + 1e-4 * w, d.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = 0.02 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        w, b = w - move[:-1], b - move[-1]
    weights = np.zeros(size, np.float32)
    weights[keep] = w * scale[keep]
    return PuModel(weights, float(b), float(prior))


def _scores(text: pa.Array, model) -> np.ndarray:
    used, weights, bias = model
    table = np.zeros(1 << LOG_BUCKETS, np.float32)
    table[used] = weights
    out = np.full(len(text), bias, np.float64)
    for i, j, buf, off in pieces(text):
        _, _, row, h = words(buf, off, ALNUM)
        at = (h >> np.uint64(64 - LOG_BUCKETS)).astype(np.int64)
        hit = table[at] != 0
        pairs = np.unique(row[hit] << LOG_BUCKETS | at[hit])
        out[i:j] += np.bincount(pairs >> LOG_BUCKETS, table[pairs & (1 << LOG_BUCKETS) - 1], minlength=j - i)
    return np.where(np.isneginf(out), 0.0, 1 / (1 + np.exp(-np.clip(out, -700, 700))))


def _shared(docs: DataFrame, model: PuModel):
    used = np.flatnonzero(model.weights)
    return docs.sparkSession.sparkContext.broadcast((used, model.weights[used], model.bias))


def score(docs: DataFrame, model: PuModel) -> DataFrame:
    """doc_id and score of each whole text, 0 to 1."""
    shared = _shared(docs, model)

    def fn(batch):
        yield pa.Table.from_arrays([batch.column("doc_id"), pa.array(_scores(batch.column("text"), shared.value))], ["doc_id", "score"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), fn, "doc_id long, score double")


def keep_clean(docs: DataFrame, model: PuModel, threshold: float = 0.3) -> DataFrame:
    """The rows of docs, all columns, whose score stays below the threshold."""
    shared, at = _shared(docs, model), docs.columns.index("text")

    def fn(batch):
        yield batch.filter(pa.array(_scores(batch.column(at), shared.value) < threshold))

    return map_arrow(docs, fn, docs.schema)
