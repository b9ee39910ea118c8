"""Benchmark decontamination by a prefix-filtered set join.

Every window of an item (ten consecutive words, or all words of a shorter item) is a set of word shingles with places.
A text contains the window only if it contains all of them, so one necessary prefix token is enough to find it: the
shingle that is rarest in the corpus. Counts of the items' shingles are taken over all documents first; windows with a
shingle that never occurs are out. Documents then give the places of prefix tokens, the join on the token keeps those
whose place leaves room for the whole window in the text (positional and length bounds), and the words around the place
are compared with the window's words, exactly.

Tasks skip shingles that no window has by a bitmap of fixed size; what passes is counted and joined by Spark, so the
benchmark may outgrow any task. All reading of texts is two passes of numpy over whole UTF-8 buffers.

Defined cases: null and wordless texts have no words and no hits; very long texts and items are read in whole; null and wordless items have no windows; equal windows
of several items count for each of those items; rows of one doc_id are judged one by one, repeated rows alike; a null
doc_id stays null; item_ids that are null are left out of lists and counts; empty tables on either side give no hits;
other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, lookup, map_arrow, row_key
from .text import ALNUM, LOWER, U64, bounds, pieces, shingles, words

#: log2 of the bits of the bitmap that tasks get: 2 MB, whatever the benchmark's size.
LOG_BITS = 24


def item_windows(items: DataFrame, size: int, k: int) -> DataFrame:
    """item_id, window (its words joined by a space), n words, w (words a shingle), and (h, place) of each shingle."""

    def fn(batch):
        out = {c: [] for c in ("item_id", "window", "n", "w", "h", "place")}
        for i, j, buf, off in pieces(batch.column("text")):
            low = LOWER[buf].tobytes()
            start, end, row, h = words(buf, off, ALNUM)
            at = bounds(row, j - i)
            for r in range(j - i):
                a, b = at[r], at[r + 1]
                n = min(size, b - a)
                if not n:
                    continue
                w = min(k, n)
                every = shingles(h[a:b], w).view(np.int64)
                for p in range(b - a - n + 1):
                    out["item_id"].append(batch.column("item_id")[i + r].as_py())
                    out["window"].append(b" ".join(low[start[x] : end[x]] for x in range(a + p, a + p + n)).decode())
                    out["n"].append(n)
                    out["w"].append(w)
                    out["h"].append(every[p : p + n - w + 1])
                    out["place"].append(np.arange(n - w + 1))
        yield pa.table({"item_id": pa.array(out["item_id"], pa.string()), "window": pa.array(out["window"], pa.string()), "n": pa.array(out["n"], pa.int32()), "w": pa.array(out["w"], pa.int32()), "h": pa.array([x.tolist() for x in out["h"]], pa.list_(pa.int64())), "place": pa.array([x.tolist() for x in out["place"]], pa.list_(pa.int32()))})

    texts = items.select(F.col("item_id").cast("string"), F.col("text").cast("string"))
    return map_arrow(texts, fn, "item_id string, window string, n int, w int, h array<bigint>, place array<int>")


def _bitmap(hashes: DataFrame) -> np.ndarray:
    """Bits for the top LOG_BITS bits of each hash h; gathered as at most 2 ** LOG_BITS / 64 words."""
    bit = F.shiftrightunsigned("h", 64 - LOG_BITS)
    got = hashes.groupBy(F.shiftright(bit, 6).alias("i")).agg(F.expr(f"bit_or(shiftleft(1L, cast(shiftrightunsigned(h, {64 - LOG_BITS}) & 63 as int)))").alias("v")).toPandas()
    out = np.zeros(1 << LOG_BITS - 6, np.int64)
    out[got["i"].to_numpy()] = got["v"].to_numpy()
    return np.unpackbits(out.view(np.uint8), bitorder="little").view(bool)


def _shingle_hits(h, row, at, w, bits):
    """Places in h whose w-word shingle stays in its row and has its bit set, with the shingles' hashes."""
    every = shingles(h, w)
    place = np.flatnonzero(bits[(every >> U64(64 - LOG_BITS)).astype(np.int64)])
    place = place[place + w <= at[row[place] + 1]]
    return place, every[place]


def _counts(docs: DataFrame, hashes: DataFrame, sizes: list[int]) -> DataFrame:
    """h and how often it occurs in all documents, for the items' shingles (and a few others that share a bit)."""
    bits = docs.sparkSession.sparkContext.broadcast(_bitmap(hashes))

    def fn(batch):
        found = []
        for i, j, buf, off in pieces(batch.column("text")):
            _, _, row, h = words(buf, off, ALNUM)
            at = bounds(row, j - i)
            found += [_shingle_hits(h, row, at, w, bits.value)[1] for w in sizes]
        h, n = np.unique(np.concatenate(found), return_counts=True)
        yield pa.table({"h": h.view(np.int64), "n": n.astype(np.int64)})

    return map_arrow(docs.select(F.col("text").cast("string")), fn, "h long, n long").groupBy("h").agg(F.sum("n").alias("freq"))


def _keyed(docs: DataFrame) -> DataFrame:
    """text and the parts of its row's key."""
    key = row_key(F.col("text").cast("string"), F.col("doc_id").cast("long"))
    return docs.select(key["doc_id"].alias("doc_id"), key["h"].alias("text_h"), F.col("text").cast("string"))


def _places(docs: DataFrame, hashes: DataFrame, sizes: list[int], size: int) -> DataFrame:
    """doc_id, text_h, n_words and, for each place of a prefix token, its hash, word number, and the words around with the first's number."""
    bits = docs.sparkSession.sparkContext.broadcast(_bitmap(hashes))
    hit = pa.struct([("h", pa.int64()), ("at", pa.int32()), ("first", pa.int32()), ("around", pa.string())])

    def fn(batch):
        n_words, hits, ends = [], [], [0]
        for i, j, buf, off in pieces(batch.column("text")):
            start, end, row, h = words(buf, off, ALNUM)
            at = bounds(row, j - i)
            n_words.append(np.diff(at))
            found = [_shingle_hits(h, row, at, w, bits.value) for w in sizes]
            place, hashed = np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found]).view(np.int64)
            w = np.concatenate([np.full(len(x[0]), s) for x, s in zip(found, sizes, strict=True)])
            order = np.argsort(place, kind="stable")
            low = LOWER[buf].tobytes() if len(order) else b""
            for x in order:
                p, r = place[x], row[place[x]]
                a, b = max(at[r], p - size + w[x]), min(at[r + 1], p + size)
                around = b" ".join(low[start[y] : end[y]] for y in range(a, b)).decode("utf-8", "replace")
                hits.append({"h": int(hashed[x]), "at": int(p - at[r]), "first": int(a - at[r]), "around": around})
            ends += (ends[-1] + np.cumsum(np.bincount(row[place], minlength=j - i))).tolist()
        yield pa.Table.from_arrays([batch.column("doc_id"), batch.column("text_h"), pa.array(np.concatenate(n_words), pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(hits, hit))], ["doc_id", "text_h", "n_words", "hits"])

    return map_arrow(_keyed(docs), fn, "doc_id long, text_h long, n_words long, hits array<struct<h:bigint,at:int,first:int,around:string>>")


def contamination(docs: DataFrame, items: DataFrame, size: int = 10, k: int = 5) -> DataFrame:
    """doc_id, n_words, n_hit (words in an occurrence of a window), item_ids (those with one, sorted), text_h for each row of docs.

    doc_id and text_h are the row's key (see ``row_key``).
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "windows")
    found = scratch.save(item_windows(items, size, k), "items")
    windows = found.dropDuplicates(["window"])
    tokens = windows.select("window", "n", "w", F.explode(F.arrays_zip("h", "place")).alias("t")).select("window", "n", "w", "t.h", "t.place")
    sizes = sorted(r.w for r in tokens.select("w").distinct().collect())  # at most k values
    if not sizes:
        none = map_arrow(_keyed(docs), _only_words, "doc_id long, n_words long, text_h long")
        return none.select("doc_id", "n_words", F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("item_ids"), "text_h")
    counts = scratch.save(_counts(docs, tokens.select("h").distinct(), sizes), "counts")
    ranked = lookup(tokens, counts, "h", scratch, "tokens-heavy", by=["window", "place"]).groupBy("window", "n", "w").agg(F.min(F.struct("freq", "place", "h")).alias("rarest"), F.count("*").alias("there"))
    prefix = ranked.filter(F.col("there") == F.col("n") - F.col("w") + 1).select("window", "n", "rarest.h", "rarest.place")
    prefix = scratch.save(prefix, "prefix")
    rows = _places(docs, prefix.select("h").distinct(), sizes, size).withColumn("row", F.monotonically_increasing_id())
    rows = scratch.save(rows, "places")
    at = rows.filter(F.size("hits") > 0).select("row", "n_words", F.explode("hits").alias("x")).select("row", "n_words", "x.*")
    begin = F.col("at") - F.col("place")
    room = (begin >= F.col("first")) & (begin + F.col("n") <= F.col("n_words"))
    same = F.array_join(F.slice(F.split("around", " "), begin - F.col("first") + 1, F.col("n")), " ") == F.col("window")
    met = lookup(at, prefix, "h", scratch, "places-heavy", by=["row", "at"], weight=32 + F.octet_length("window"))
    hits = met.filter(room).filter(same).select("row", begin.alias("begin"), "n", "window").distinct()
    hits = scratch.save(hits, "hits")

    before = Window.partitionBy("row").orderBy("begin", "n").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("begin") + F.col("n")
    new = end - F.greatest("begin", F.least(F.coalesce(F.max(end).over(before), F.lit(0)), end))
    covered = hits.select("row", "begin", "n").distinct().withColumn("new", new).groupBy("row").agg(F.sum("new").alias("n_hit"))
    owners = scratch.save(found.select("window", "item_id").filter("item_id is not null").distinct(), "owners")
    weight = F.octet_length("window") + F.octet_length("item_id")
    by_item = lookup(hits.select("row", "window").distinct(), owners, "window", scratch, "owners-heavy", by=["row"], weight=weight)
    listed = by_item.select("row", "item_id").distinct().groupBy("row").agg(F.array_sort(F.collect_list("item_id")).alias("item_ids"))
    marks = scratch.save(covered.join(listed, "row", "left"), "marks")
    weight = 24 + F.coalesce(F.octet_length(F.array_join("item_ids", ",")), F.lit(0))
    out = lookup(rows.select("doc_id", "n_words", "row", "text_h"), marks, "row", scratch, "marks-heavy", how="left", weight=weight)
    scratch.drop("counts", "prefix", "hits", "items", "owners")
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"), "text_h")


def _only_words(batch):
    counts = [np.bincount(words(buf, off, ALNUM)[2], minlength=j - i) for i, j, buf, off in pieces(batch.column("text"))]
    yield pa.Table.from_arrays([batch.column("doc_id"), pa.array(np.concatenate(counts).astype(np.int64)), batch.column("text_h")], ["doc_id", "n_words", "text_h"])
