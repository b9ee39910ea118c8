"""A training-corpus pipeline over ``documents``: five stages, each a function of (spark, docs, sf_dir).

Each stage's result is written as Parquet in the shared folder and read again as the next one's documents. All but the
last keep the columns of documents; the last gives one row per token piece with its place in a packed sequence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from instdir.llm import toxicity
from instdir.llm.common import Scratch, without_rows
from instdir.llm.decontaminate import contamination
from instdir.llm.line_dedup import drop_repeated_lines
from instdir.llm.near_dedup import drop_near_copies
from instdir.llm.packing import pack_documents
from instdir.llm.queries import vocabulary

#: Learnt models and counts don't fit SQL.
ORACLE_SQL = None


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below 0.3.

    Rows are judged by their text alone, also those without doc_id and those that share one; null and empty texts have the
    score of the model's bias; equal rows go or stay alike; very long texts are scored in whole.
    """
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep_clean(docs, model)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that three-line windows seen before cover; those of which nothing is left go.

    Rows equal in doc_id and text are one document and share their result; null texts stay null, and texts that were empty
    before stay; n_chars follows the text; a row without doc_id comes before all others.
    """
    return drop_repeated_lines(docs, keep_emptied=False)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, the one with the smallest id (none is last).

    Rows are judged one by one: texts that share a doc_id are different documents, a row without doc_id is one too, and of
    rows equal in doc_id and text one stays. Null, empty and wordless texts are nobody's copies and all stay.
    """
    return drop_near_copies(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs.

    Rows of one doc_id, or of none, are judged one by one, equal rows alike; null and wordless texts stay; very long texts
    are read in whole; an empty benchmark drops nothing.
    """
    hits = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).filter("n_hit > 0")
    return without_rows(docs, hits.select("doc_id", F.col("text_h").alias("h")), Scratch(spark, "clean"), "gone")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece's document, length, checksum of ids, and place in a sequence of 4096 tokens.

    Null and empty texts are one token; repeated rows are packed once each; a null doc_id stays null.
    """
    return pack_documents(docs, vocabulary())


STAGES = [
    ("toxicity", without_toxic),
    ("line_dedup", without_repeated_lines),
    ("near_dedup", one_of_near_copies),
    ("decontamination", without_benchmark),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to the table of documents; a stage's table is deleted once the next one is written."""
    docs, scratch, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "pipeline"), None
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
        scratch.drop(*filter(None, [before]))
        before = name
    out = STAGES[-1][1](spark, docs, sf_dir)
    scratch.drop(before)  # packing has written its pieces
    return out
