"""Records into the directory table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.answers import FAULTS
from ..schemas import DIRECTORY

#: What names an institution.
NAMES = ["company_name", "company_type", "website"]


def surrogate_id() -> Column:
    """An id from what names an institution: the same on every run and in every partition."""
    return F.xxhash64(*NAMES)


def second_id() -> Column:
    """Another id from the same, unrelated to the first."""
    return F.xxhash64(F.lit("second"), *NAMES)


def colliding_ids(records: DataFrame, first: Callable[[], Column] = surrogate_id) -> DataFrame:
    """id and n: the ids that more than one institution has, and how many at least (2)."""
    two = records.select(first().alias("id"), second_id().alias("other"))
    ends = two.groupBy("id").agg(F.min("other").alias("least"), F.max("other").alias("most"))
    return ends.filter("least <> most").select("id")


def _unique(rows: DataFrame, first: Callable[[], Column]) -> DataFrame:
    """One row an institution. Of institutions that share an id the one with the least second id keeps it, the others get theirs."""
    rows = rows.withColumns({"id": first(), "__other": second_id()}).dropDuplicates(NAMES)
    least = F.min("__other").over(Window.partitionBy("id"))  # a row for each institution, so no id is frequent
    return rows.withColumn("id", F.when(F.col("__other") == least, F.col("id")).otherwise(F.col("__other"))).drop("__other")


def _row(load_ts: str, first: Callable[[], Column]) -> list[Column]:
    stamp = F.lit(load_ts).cast("timestamp_ntz")
    own = {"id": first(), "created_at": stamp, "last_updated": stamp}
    return [(own[f.name] if f.name in own else F.col(f.name).try_cast(f.dataType)).alias(f.name) for f in DIRECTORY]


def to_directory(records: DataFrame, load_ts: str, only_success: bool = False, unique: bool = False, first: Callable[[], Column] = surrogate_id) -> tuple[DataFrame, DataFrame]:
    """The directory rows and, apart, the records that lack a name or a type. Failed records load too unless left out.

    With unique there is one row an institution, and no two of them share an id.
    """
    if only_success:
        records = records.filter(F.col("extraction_status") == "success")
    whole = F.col("company_name").isNotNull() & F.col("company_type").isNotNull()
    rows = records.filter(whole).select(*_row(load_ts, first))
    return _unique(rows, first) if unique else rows, records.filter(~whole)


def _faults(rescued: str | None) -> Column:
    """The field, text and rule of all that keeps a record out or was, or is, made null."""

    def told(field: str, text: Column, rule: str) -> Column:
        return F.struct(F.lit(field).alias("field"), text.cast("string").alias("text"), F.lit(rule).alias("rule"))

    missing = [F.when(F.col(c).isNull(), told(c, F.lit(None), "required")) for c in NAMES[:2]]
    lost = [F.when(F.col(f.name).isNotNull() & F.col(f.name).try_cast(f.dataType).isNull(), told(f.name, F.col(f.name), f.dataType.simpleString())) for f in DIRECTORY if f.name.endswith(("crores", "size_min", "size_max"))]
    own = F.array_compact(F.array(*missing, *lost)).cast(FAULTS)
    return F.concat(own, F.coalesce(F.col(rescued), F.array().cast(FAULTS))) if rescued else own


def load_directory(records: DataFrame, path: str, load_ts: str, only_success: bool = False, rescued: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Write records as directory rows once, and return two tables that read what was written: the rows, and their faults.

    Faults have id, company_name, company_type, website, field, text, rule and left_out: one for each name or type that is
    missing (the record is left out) and for each value that didn't cast (made null). rescued names a column of faults that
    records bring along, from the file or the answer that they come from.
    """
    if only_success:
        records = records.filter(F.col("extraction_status") == "success")
    whole = F.col("company_name").isNotNull() & F.col("company_type").isNotNull()
    records.select(*_row(load_ts, surrogate_id), _faults(rescued).alias("__faults"), (~whole).alias("__left_out")).write.parquet(path)
    written = records.sparkSession.read.parquet(path)
    rows = written.filter("not __left_out").select(*DIRECTORY.names)
    return rows, written.select("id", *NAMES, F.explode("__faults").alias("fault"), F.col("__left_out").alias("left_out")).select("id", *NAMES, "fault.*", "left_out")
