"""Whether texts contain one of many terms, from a handful to tables of any size.

A few terms are one pattern in each row's expression. More, up to a counted size, go to the tasks, each of which builds an
automaton of them once and reads a text once, whatever the number of terms. Beyond that size no task gets them all: terms and
texts meet by character grams. A term lies in a text only if all its grams do, so each term is looked up by the one that the
fewest texts have, and what meets is compared in full. Equal texts are looked up once.

Defined cases: a null text gives null; null terms are none; an empty term lies in every text; no term at all gives false, for a null
text too.
"""

from __future__ import annotations

import importlib.util
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import contains_any

#: Terms in a pattern at most; terms, and their bytes, that tasks get at most; rows of a broadcast; characters of a gram.
FEW, MANY, MANY_BYTES, BROADCAST_ROWS, GRAM = 200, 200_000, 4 << 20, 200_000, 4


def _grams(text: Column, size: int) -> Column:
    """The distinct runs of so many characters."""

    def of(chars):
        run = F.transform(F.sequence(F.lit(0), F.size(chars) - size), lambda i: F.array_join(F.slice(chars, i + 1, size), ""))
        return F.when(F.size(chars) >= size, F.array_distinct(run))

    return F.transform(F.array(F.split(text, "")), of)[0]


def _met(left: DataFrame, right: DataFrame, on: str, tables, name: str, by: list[str], how: str = "inner", weight: Column | None = None, counts: DataFrame | None = None, keep: bool = False) -> DataFrame:
    """left.join(right, on, how) for a written table ``right``: broadcast if it is counted small, else a merge join whose frequent keys are dealt out.

    The hint keeps Spark from a broadcast by the size of files, which for repeated values is a small part of what rows take in
    memory. With keep, a left side that is costly to work out is written before its keys are counted.
    """
    from ..llm.common import Dealt, small

    hinted = small(right, BROADCAST_ROWS, weight)
    if hinted is not right:
        return left.join(hinted, on, how)
    if keep:
        left = tables.save(left, name)
    dealt = Dealt(left.groupBy(on).agg(F.count("*").alias("n")) if counts is None else counts, [on], tables, f"{name}-heavy")
    return dealt.left(left, by).join(dealt.right(right).hint("merge"), [on, "__part"], how).drop("__part")


class TermSet:
    """Terms given as a list or as the first column of a table; the table is counted once, and collected only if it is small."""

    def __init__(self, values: Sequence[str] | DataFrame, few: int = FEW, many: int = MANY, many_bytes: int = MANY_BYTES):
        self.table, self.listed, self.few = None, None, few
        if isinstance(values, DataFrame):
            terms = values.toDF(*[f"_{i}" for i in range(len(values.columns))]).select(F.col("_0").cast("string").alias("term")).filter("term is not null").distinct()
            n, size, blank = terms.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("term")), F.lit(0)), F.count_if(F.col("term") == "")).first()
            self.everywhere = blank > 0
            small = n <= many and size <= many_bytes and (n <= few or importlib.util.find_spec("ahocorasick") is not None)
            if small and not self.everywhere:
                self.listed = sorted(r.term for r in terms.collect())
            else:
                self.table = terms
        else:
            self.listed = sorted({v for v in values if v is not None})
            self.everywhere = "" in self.listed

    def mark(self, df: DataFrame, text: Column, name: str) -> DataFrame:
        """df with the boolean column ``name``: whether text contains one of the terms."""
        if self.everywhere:
            return df.withColumn(name, F.when(text.isNotNull(), True))
        if self.listed is None:
            return self._joined(df, text, name)
        if len(self.listed) <= self.few:
            return df.withColumn(name, contains_any(text, self.listed))
        return df.withColumn(name, self._automaton(df)(text))

    def _automaton(self, df: DataFrame):
        shared = df.sparkSession.sparkContext.broadcast(self.listed)

        def hits(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            import ahocorasick
            import pandas

            automaton = ahocorasick.Automaton()
            for term in shared.value:
                automaton.add_word(term, True)
            automaton.make_automaton()
            for batch in batches:
                found = [None if t is None else next(automaton.iter(t), None) is not None for t in batch]
                yield pandas.Series(found, dtype="object")

        return F.pandas_udf(hits, "boolean")

    def _joined(self, df: DataFrame, text: Column, name: str) -> DataFrame:
        from ..llm.common import Scratch

        tables = Scratch(df.sparkSession, "terms")
        terms, wide = self.table, lambda c: 32 + F.octet_length(c)
        sizes = [r[0] for r in terms.select(F.least(F.length("term"), F.lit(GRAM))).distinct().collect()]  # GRAM values at most
        texts = tables.save(df.select(text.alias("text")).filter("text is not null").distinct().withColumn("h", F.xxhash64("text")), "texts")
        every = F.flatten(F.array_compact(F.array(*[_grams(F.col("text"), s) for s in sizes]))) if sizes else F.array().cast("array<string>")
        grams = tables.save(texts.select("h", F.explode(every).alias("gram")), "grams")
        counts = tables.save(grams.groupBy("gram").agg(F.count("*").alias("n")), "counts")
        own = F.coalesce(*[F.when(F.least(F.length("term"), F.lit(GRAM)) == s, _grams(F.col("term"), s)) for s in sizes], F.array().cast("array<string>"))
        parts = _met(terms.select("term", F.explode(own).alias("gram")), counts, "gram", tables, "parts", ["term"], "left", keep=True)
        least = parts.groupBy("term").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("least")).filter("least.n > 0")
        rarest = tables.save(least.select("term", "least.gram"), "rarest")
        met = _met(grams, rarest, "gram", tables, "met", ["h"], weight=wide("term"), counts=counts).select("h", "term")
        found = _met(met, texts, "h", tables, "found", ["term"], weight=wide("text"), keep=True).filter(F.col("text").contains(F.col("term")))
        hits = tables.save(found.select(F.col("text").alias("__text")).distinct(), "hits").withColumn("__hit", F.lit(True))
        # No hit is empty, so rows without text have no partner as empty ones; null keys would all go to one task.
        marked = _met(df.withColumn("__text", F.coalesce(text, F.lit(""))), hits, "__text", tables, "marked", ["__text"], "left", wide("__text"))
        return marked.withColumn(name, F.when(text.isNotNull(), F.coalesce("__hit", F.lit(False)))).drop("__text", "__hit")
