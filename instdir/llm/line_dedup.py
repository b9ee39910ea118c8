"""Line dedup over overlapping three-line windows.

Every run of three consecutive lines is hashed to 128 bits; a window's first occurrence is the one with the smallest
(doc_id, line). All lines that a later occurrence covers are removed, overlapping occurrences merged; the other lines
stay in order. Only hashes, ids and line numbers are shuffled to find repeats; a window that fills a third of the corpus
is added up before the shuffle and dealt out in the join.

Defined cases: lines are split at \\n and compared as they are; windows whose three lines are all blank don't count; a
text of fewer than three lines has no window and stays, as do null and empty texts; a null doc_id sorts before any
other; rows equal in doc_id and text are one document and share their result; no row is dropped unless asked for, a text whose
lines all go becomes empty; a very long text is read in whole, one window per line, in time that grows with its lines;
an empty table gives an empty result; other columns are kept as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import KEY, Scratch, key_columns, keyed, lookup, quoted, row_key


def _windows(lines: Column, size: int) -> Column:
    """(line, h1, h2) of each window of ``size`` lines of an array column."""

    def one(i):
        run = [F.get(lines, i + j) for j in range(size)]
        blank = F.trim(F.concat(*run)) == ""
        return F.when(~blank, F.struct(i.alias("line"), F.xxhash64(*run).alias("h1"), F.xxhash64(F.lit(1), *run).alias("h2")))

    return F.when(F.size(lines) >= size, F.filter(F.transform(F.sequence(F.lit(0), F.size(lines) - size), one), lambda w: w.isNotNull()))


def repeated_lines(docs: DataFrame, size: int = 3) -> DataFrame:
    """key (see ``row_key``) and the merged (first, last) line ranges that later occurrences cover, for rows that have any."""
    scratch = Scratch(docs.sparkSession, "lines")
    text = F.col("text").cast("string")
    rows = docs.select(row_key(text, F.col("doc_id").cast("long")).alias("key"), F.split(text, "\n", -1).alias("lines"))
    rows = rows.select("key", F.explode(_windows(F.col("lines"), size)).alias("w")).select("key", "w.line", "w.h1", "w.h2")
    rows = scratch.save(rows, "windows")
    at = F.struct("key.doc_id", "line", "key.h")
    repeats = rows.groupBy("h1", "h2").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("n")).filter("first <> last")
    repeats = scratch.save(repeats.select("h1", "h2", "first", "n"), "repeats")
    later = lookup(rows, repeats.drop("n"), ["h1", "h2"], scratch, "windows-heavy", by=["key", "line"], counts=repeats)
    later = later.filter(at != F.col("first")).select("key", "line").distinct()
    in_order = Window.partitionBy("key").orderBy("line")
    begins = F.coalesce(F.col("line") > F.lag("line").over(in_order) + size, F.lit(True)).cast("int")
    runs = later.withColumn("begins", begins).withColumn("run", F.sum("begins").over(in_order))
    ranges = runs.groupBy("key", "run").agg(F.min("line").alias("first"), (F.max("line") + size - 1).alias("last"))
    covered = scratch.save(ranges.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("gone")), "covered")
    scratch.drop("windows", "repeats", "windows-heavy")
    return covered


def drop_repeated_lines(docs: DataFrame, size: int = 3, keep_emptied: bool = True) -> DataFrame:
    """docs with the covered lines taken out of text; n_chars, if there, follows the text.

    Without keep_emptied, rows of which nothing is left go too; those that were empty before stay.
    """
    scratch = Scratch(docs.sparkSession, "covered")
    covered = scratch.save(repeated_lines(docs, size).select(*key_columns(F.col("key.doc_id"), F.col("key.h")), F.col("gone").alias("__gone")), "by-key")
    out = lookup(keyed(docs), covered, KEY, scratch, "heavy", by=KEY, how="left", weight=24 + 8 * F.size("__gone"), sift=True)
    text = F.col("text").cast("string")
    out = out.withColumn("text", F.when(F.col("__gone").isNull(), text).otherwise(without(text, F.col("__gone"))))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("__gone").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(kind))
    if not keep_emptied:
        out = out.filter("__gone is null or text <> ''")
    return out.select(*quoted(docs.columns))


def without(text: Column, gone: Column) -> Column:
    """text without the lines of these ranges, which are in order and apart: the stretches between them, put together.

    Each line is moved once, however many ranges there are; the lines are split off once and held by a lambda's argument.
    """

    def between(of):
        def stretch(k):
            begin = F.coalesce(F.get(of["gone"], k - 1)["last"] + 1, F.lit(0))
            end = F.coalesce(F.get(of["gone"], k)["first"], F.size(of["lines"]))
            return F.slice(of["lines"], begin + 1, end - begin)

        return F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size(of["gone"])), stretch)), "\n")

    return F.transform(F.array(F.struct(F.split(text, "\n", -1).alias("lines"), gone.alias("gone"))), between)[0]
