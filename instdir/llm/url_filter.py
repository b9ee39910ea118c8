"""URL filters: host and path rules, and a character language-model ratio for urls without a rule.

Two variable-order Markov models over the bytes of a url, one of urls that rules accept and one of those they reject, give
each byte a probability after up to five bytes before it: per context, its count plus the shorter context's probability
as many times as the context has different followers, over the sum of both (Witten-Bell). A url's score is the mean
difference of the logarithms over its bytes and its end. It is accepted from a threshold on that is calibrated on the rule-marked
urls of a fold that the counts leave out.

All six-byte windows of the corpus are counted by Spark. The probabilities are worked out once for each different window,
by a join on contexts. Tasks get the weights of the commonest windows, as many as a bound allows; what a url has of the
others is joined, and a window that many urls share is dealt out.

Defined cases: a very long url is scored over all its bytes; a null url or one without :// has an empty host and path, fits no rule, and is judged by the model (a null
one scores 0); rows are judged one by one, equal urls alike; with no url marked for one of the classes that class has
uniform probabilities, and with none left out for calibration the threshold is 0; an empty table gives an empty result;
other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, fold, join_spread, lookup, map_arrow
from .text import list_array, pieces

#: Bytes of a window: five of context, one that follows.
SPAN = 6
#: So many windows' weights, 12 bytes each, are broadcast at most.
BROADCAST_WINDOWS = 1_000_000
HELD_OUT_OF, HELD_OUT = 5, 0
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def matched(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """Of the rules (verdict, host/path) that fit, the longest one's text and verdict; null if none. Equal lengths: the first."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, text in sorted(reversed(rules), key=lambda r: len(r[1])):
        own, slash, rest = text.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, said).otherwise(verdict)
    return rule, verdict


def _windows(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The window that ends at each byte of each url and at its end, and the url's number; before it stand zeros."""
    n = len(off) - 1
    size = np.diff(off)
    row = np.repeat(np.arange(n), size)
    filled = np.zeros(len(buf) + SPAN * n + SPAN, np.int64)
    filled[np.arange(len(buf)) + SPAN * row + SPAN - 1] = buf
    count = size + 1
    row = np.repeat(np.arange(n), count)
    end = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + (off[:-1] + SPAN * np.arange(n) + SPAN - 1)[row]
    key = np.zeros(len(row), np.int64)
    for j in range(SPAN):
        key |= filled[end - j] << (8 * j)
    return key, row


def _counts(urls: DataFrame) -> DataFrame:
    """Each window of all urls, how often they have it (n), and how often the marked ones (mark 1: accepted, 2: rejected) do."""

    def fn(batch):
        mark = batch.column("mark").to_numpy()
        for i, j, buf, off in pieces(batch.column("url")):
            key, row = _windows(buf, off)
            found, back = np.unique(key, return_inverse=True)
            got = [np.bincount(back, (mark[i:j] == m)[row], minlength=len(found)).astype(np.int64) for m in (1, 2)]
            yield pa.table({"window": found, "n": np.bincount(back, minlength=len(found)).astype(np.int64), "n1": got[0], "n2": got[1]})

    every = map_arrow(urls.select("url", "mark"), fn, "window long, n long, n1 long, n2 long", by="url")
    return every.groupBy("window").agg(*[F.sum(c).alias(c) for c in ("n", "n1", "n2")])


def _weights(counts: DataFrame, scratch: Scratch) -> DataFrame:
    """window, n, and the difference of the logarithms of its last byte's probabilities in the two models."""
    orders = F.explode(F.sequence(F.lit(0), F.lit(SPAN - 1))).alias("order")
    context = F.expr("shiftright(window, 8) & (shiftleft(1L, 8 * order) - 1)").alias("context")
    byte = F.col("window").bitwiseAND(255).alias("byte")
    seen = counts.filter("n1 > 0 or n2 > 0").select("n1", "n2", "window", orders).select("order", context, byte, "n1", "n2")
    seen = seen.groupBy("order", "context", "byte").agg(F.sum("n1").alias("n1"), F.sum("n2").alias("n2"))
    of = seen.groupBy("order", "context").agg(
        F.map_from_entries(F.collect_list(F.struct("byte", F.struct("n1", "n2")))).alias("followers"),  # 256 at most
        *[F.sum(f"n{m}").alias(f"c{m}") for m in (1, 2)],
        *[F.count_if(F.col(f"n{m}") > 0).alias(f"t{m}") for m in (1, 2)],
    )
    asked = counts.select("window", "n", orders).select("window", "n", "order", context, byte)
    # contexts of one byte at most are few and on every window's way: broadcast; the others are joined
    few = asked.filter("order <= 1").join(F.broadcast(of.filter("order <= 1")), ["order", "context"], "left")
    far = of.filter("order > 1")
    many = join_spread(asked.filter("order > 1"), far, ["order", "context"], scratch, "contexts", by=["window"], how="left")
    hit = F.try_element_at("followers", "byte")
    parts = few.unionByName(many).select("window", "n", F.struct("order", *[F.coalesce(c, F.lit(0)).cast("double").alias(n) for n, c in (("n1", hit["n1"]), ("c1", F.col("c1")), ("t1", F.col("t1")), ("n2", hit["n2"]), ("c2", F.col("c2")), ("t2", F.col("t2")))]).alias("part"))

    def p(m: int) -> Column:
        step = lambda p, x: F.when(x[f"c{m}"] > 0, (x[f"n{m}"] + x[f"t{m}"] * p) / (x[f"c{m}"] + x[f"t{m}"])).otherwise(p)
        return F.aggregate("parts", F.lit(1 / 256.0), step)

    return parts.groupBy("window", "n").agg(F.array_sort(F.collect_list("part")).alias("parts")).select("window", "n", (F.ln(p(1)) - F.ln(p(2))).alias("weight"))


def _least_common(weights: DataFrame, limit: int) -> int:
    """The least power of two so that at most ``limit`` windows occur as often."""
    steps = weights.groupBy(F.floor(F.log2("n")).cast("int").alias("step")).count().orderBy(F.desc("step")).collect()  # 64 rows at most
    least, held = 1 << 62, 0
    for r in steps:
        held += r["count"]
        if held > limit:
            break
        least = 1 << r.step
    return least


def _scored(urls: DataFrame, weights: DataFrame, limit: int, scratch: Scratch) -> DataFrame:
    """urls(key, url, ...) with score, the mean weight of a url's windows; tasks get ``limit`` weights at most."""
    least = _least_common(weights, limit)
    got = weights.filter(F.col("n") >= least).select("window", "weight").toPandas().sort_values("window")
    shared = urls.sparkSession.sparkContext.broadcast((got["window"].to_numpy(), got["weight"].to_numpy()))
    names = urls.columns

    def fn(batch):
        windows, weight = shared.value
        known, count, rest, ends = np.zeros(batch.num_rows), np.ones(batch.num_rows), [], [np.zeros(1, np.int64)]
        for i, j, buf, off in pieces(batch.column("url")):
            key, row = _windows(buf, off)
            at = np.searchsorted(windows, key)
            hit = np.append(windows, -1)[at] == key
            known[i:j] = np.bincount(row[hit], weight[at[hit]], minlength=j - i)
            count[i:j] = np.diff(off) + 1
            rest.append(key[~hit])
            ends.append(ends[-1][-1] + np.cumsum(np.bincount(row[~hit], minlength=j - i)))
        known[batch.column("url").is_null().to_numpy(zero_copy_only=False)] = 0.0
        others = list_array(np.concatenate(rest), np.concatenate(ends), pa.int64())
        yield pa.Table.from_arrays([*(batch.column(c) for c in names), pa.array(known), pa.array(count), others], [*names, "known", "count", "rest"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in urls.schema) + ", known double, count double, rest array<long>"
    partly = map_arrow(urls, fn, schema, by="url")
    rare = weights.filter(F.col("n") < least)
    if rare.isEmpty():
        return partly.withColumn("score", F.col("known") / F.col("count")).select(*names, "score")
    partly = scratch.save(partly, "partly")
    asked = partly.filter("url is not null").select("key", F.explode("rest").alias("window"))
    sums = lookup(asked, scratch.save(rare, "rare").drop("n"), "window", scratch, "windows-heavy", by=["key"], rows=0, counts=rare.select("window", "n"))
    sums = sums.groupBy("key").agg(F.sum("weight").alias("more"))
    score = (F.col("known") + F.coalesce("more", F.lit(0.0))) / F.col("count")
    return partly.join(sums, "key", "left").withColumn("score", score).select(*names, "score")


def best_edge(at: np.ndarray, accepted: np.ndarray, rejected: np.ndarray) -> float:
    """The edge between two steps (or before the first, after the last) that parts both classes with the best mean rate.

    Of several best ones the one with the widest gap around it, then the lowest. at: the steps, in order.
    """
    rate = (accepted.sum() - np.concatenate([[0], np.cumsum(accepted)])) / accepted.sum() + np.concatenate([[0], np.cumsum(rejected)]) / rejected.sum()
    below, above = np.concatenate([[at[0] - 2], at]), np.concatenate([at, [at[-1] + 2]])
    best = np.flatnonzero(rate >= rate.max() - 1e-12)
    chosen = best[(above - below)[best].argmax()]
    return float(below[chosen] + above[chosen]) / 2


def _threshold(scored: DataFrame) -> float:
    """The score, to two places, that parts the held-out accepted and rejected urls with the best mean of both rates."""
    held = scored.filter("held_out and verdict is not null")
    at = F.round(F.col("score") * 100).cast("int")
    got = held.groupBy(at.alias("at")).agg(F.count_if(F.col("verdict") == "allow").alias("a"), F.count_if(F.col("verdict") == "block").alias("b")).toPandas().sort_values("at")
    a, b = got["a"].to_numpy(dtype=float), got["b"].to_numpy(dtype=float)
    if not len(got) or not a.sum() or not b.sum():
        return 0.0
    return best_edge(got["at"].to_numpy(dtype=float), a, b) / 100


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]], limit: int = BROADCAST_WINDOWS) -> DataFrame:
    """page_id, url, host, path, rule, score and verdict (allow or block) for each row of pages(page_id, url, ...)."""
    scratch = Scratch(pages.sparkSession, "urls")
    host, path = host_and_path(F.col("url"))
    urls = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")).withColumns({"host": host, "path": path})
    rule, verdict = matched(F.col("host"), F.col("path"), rules)
    held = F.coalesce(fold(F.col("page_id"), HELD_OUT_OF) == HELD_OUT, F.lit(True))
    urls = urls.withColumns({"rule": rule, "verdict": verdict, "held_out": held, "key": F.monotonically_increasing_id()})
    urls = scratch.save(urls, "urls")
    mark = F.when(F.col("held_out") | F.col("verdict").isNull(), 0).when(F.col("verdict") == "allow", 1).otherwise(2)
    counts = scratch.save(_counts(urls.withColumn("mark", mark)), "counts")
    weights = scratch.save(_weights(counts, scratch), "weights")
    scored = scratch.save(_scored(urls, weights, limit, scratch), "scored")
    threshold = _threshold(scored)
    scratch.drop("urls", "counts", "weights", "partly", "rare", "contexts", "windows-heavy")
    said = F.coalesce("verdict", F.when(F.col("score") >= threshold, "allow").otherwise("block"))
    return scored.select("page_id", "url", "host", "path", "rule", "score", said.alias("verdict"))
