"""Facets, counts, tallies and checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def facet(df: DataFrame, column: str) -> DataFrame:
    """The distinct values of a text column, or of the elements of a list column, sorted; null and empty texts are none."""
    listed = df.schema[column].dataType.typeName() == "array"
    value = F.explode(column) if listed else F.col(column)
    values = df.select(value.alias("value"))
    return (values if listed else values.filter("value <> ''")).distinct().orderBy("value")


def result_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n"))


def screen(df: DataFrame, columns: list[str], met: Column) -> DataFrame:
    """facet, value and n: every facet of these columns, over all rows, and facet ``result``: how many rows meet the condition.

    One scan and one aggregate over (facet, value) pairs. A row counts once for a value, however often its list has it; a null is no value.
    """
    pair = lambda facet, value, n: F.struct(F.lit(facet).alias("facet"), value.cast("string").alias("value"), n.cast("long").alias("n"))

    def pairs(column: str) -> Column:
        if df.schema[column].dataType.typeName() == "array":
            return F.coalesce(F.transform(F.array_compact(F.array_distinct(column)), lambda v: pair(column, v, F.lit(1))), F.array())
        return F.when(F.col(column) != "", F.array(pair(column, F.col(column), F.lit(1)))).otherwise(F.array())

    result = F.array(pair("result", F.lit(""), F.coalesce(met, F.lit(False)).cast("int")))
    every = df.select(F.explode(F.concat(*[pairs(c) for c in columns], result)).alias("p")).select("p.*")
    none = df.sparkSession.createDataFrame([("result", "", 0)], "facet string, value string, n long")
    return every.unionByName(none).groupBy("facet", "value").agg(F.sum("n").alias("n")).orderBy("facet", "value")


OUTCOMES = ("ok", "failed", "rejected", "skipped")


def observed(df: DataFrame, outcome: Column | None = None, flag: str | None = None, file: Column | None = None, required: Sequence[str] = ()) -> tuple[DataFrame, Observation]:
    """df, and what its next action (a write) finds on the way: rows, rows by outcome, rows with the flag, files, and for each
    required column whether it is never null. No second run is needed for tallies, totals and checks.

    Files are told apart by a 64-bit hash of their names.
    """
    seen = Observation()
    found = [F.count(F.lit(1)).alias("n_rows")]
    if outcome is not None:
        found += [F.count_if(outcome == o).alias(f"outcome_{o}") for o in OUTCOMES]
    if flag:
        found.append(F.count_if(F.coalesce(F.col(flag), F.lit(False))).alias("n_flagged"))
    if file is not None:
        found.append(F.size(F.collect_set(F.xxhash64(file))).cast("long").alias("n_files"))
    found += [F.coalesce(F.bool_and(F.col(c).isNotNull()), F.lit(True)).alias(f"required_{c}") for c in required]
    return df.observe(seen, *found), seen


def run_tally(outcomes: DataFrame, by: str = "outcome") -> DataFrame:
    return outcomes.groupBy(by).agg(F.count("*").alias("n"))


def totals(df: DataFrame, flag: str, file: Column | None = None) -> DataFrame:
    """Rows, input files (where the source has files), and rows with the flag."""
    return df.agg(F.count("*").alias("n_rows"), F.count_distinct(file if file is not None else F.lit(1)).alias("n_files"), F.count_if(F.coalesce(F.col(flag), F.lit(False))).alias("n_flagged"))


def relation_checks(df: DataFrame, rows: int, required: list[str]) -> DataFrame:
    """One row a check: its name and whether it holds."""
    there = [F.coalesce(F.bool_and(F.col(c).isNotNull()), F.lit(True)).alias(c) for c in required]
    one = df.agg((F.count("*") == rows).alias("rows"), *there)
    return one.unpivot([], ["rows", *required], "check", "ok")
