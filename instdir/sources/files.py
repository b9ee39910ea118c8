"""Reading candidates and records, writing records and contacts."""

from __future__ import annotations

import re
import uuid
from functools import reduce
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.answers import from_json_array, json_array
from ..schemas import CONTACTS, DIRECTORY, RECORDS, SEEDS

#: The column of a table of contacts that names the batch of a row.
BATCH = "_batch"
CSV = {"header": True, "quote": '"', "escape": '"', "multiLine": True, "encoding": "UTF-8"}


#: Bytes that no file has: as the share of a task and the price of a file they give each file a task of its own.
_ONE_FILE = dict.fromkeys(("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"), str(1 << 40))


def escaped(path: str) -> str:
    """A path as a pattern that matches it alone."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def header_groups(spark: SparkSession, glob: str) -> dict[tuple[str, ...], list[str]]:
    """The files that match, by their header (the first record; a quoted name may hold line ends, read as \\n).

    Tasks read the heads, a file each, and stop at the record's end (where the cluster's settings give a task several files, they
    are read to their ends); the driver gets a header and a path for each file, as it does when Spark lists them. Files without a
    line have no header.
    """
    own = spark.newSession()  # its settings are for this read alone
    for key, value in _ONE_FILE.items():
        own.conf.set(key, value)
    own.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    alone = all(own.conf.get(key) == str(1 << 40) for key in _ONE_FILE) and not own.conf.get("spark.sql.files.maxPartitionNum", None)
    try:
        lines = own.read.text(glob).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("begin"), "value")
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return {}
        raise

    def heads(batches):
        import csv
        import io

        import pyarrow as pa

        def head():
            names = next(csv.reader(io.StringIO("\n".join(text).removeprefix("\ufeff"), newline="")), [])
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([names], pa.list_(pa.string()))], ["path", "names"])

        path, done, text, quotes = None, None, [], 0
        for batch in batches:
            for p, begin, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if begin or p == done:  # behind the head
                    if alone:
                        return
                    continue
                if p != path:
                    if path is not None:  # a quote that is never closed
                        yield head()
                    path, text, quotes = p, [], 0
                text.append(value)
                quotes += value.count('"')
                if quotes % 2 == 0:  # outside quotes
                    yield head()
                    path, done = None, p
                    if alone:
                        return
        if path is not None:
            yield head()

    groups: dict[tuple[str, ...], list[str]] = {}
    for row in lines.mapInArrow(heads, "path string, names array<string>").filter(F.size("names") > 0).collect():
        groups.setdefault(tuple(row.names), []).append(unquote(row.path))
    return {names: sorted(paths) for names, paths in groups.items()}


def _columns(names: tuple[str, ...]) -> list[tuple[str, str | None]]:
    """For each place of a header a column name that Spark can tell from the others, and the name it is read by (None: not read).

    Of a name that is there several times, in whatever case, the last place counts; a place without a name isn't read.
    """
    last = {name.lower(): i for i, name in enumerate(names)}
    return [(f"_{i}", name if name and last[name.lower()] == i else None) for i, name in enumerate(names)]


def read_candidates(spark: SparkSession, glob: str) -> DataFrame | None:
    """All CSV files that match, by column name, all text, empty for missing; None if there is no file with a header.

    Spark applies one file's header to all it reads, so there is one read for each header. Of a name that a header has
    several times the last column counts.
    """
    parts = []
    for names, paths in sorted(header_groups(spark, glob).items()):
        columns = _columns(names)
        schema = T.StructType([T.StructField(c, T.StringType()) for c, _ in columns])
        rows = spark.read.options(**CSV).option("enforceSchema", True).schema(schema).csv([escaped(p) for p in paths])
        parts.append(rows.select(*[F.coalesce(c, F.lit("")).alias(n) for c, n in columns if n]))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).fillna("") if parts else None


def seed_institutions(spark: SparkSession, rows: list[tuple[str, str, bool]]) -> DataFrame:
    return spark.createDataFrame(rows, SEEDS)


def write_records(records: DataFrame, path: str) -> None:
    """The whole result as CSV with header, lists as JSON text."""
    lists = {f.name: json_array(F.col(f.name)) for f in records.schema if isinstance(f.dataType, T.ArrayType)}
    records.withColumns(lists).write.mode("overwrite").options(header=True, escape='"', encoding="UTF-8").csv(path)


def read_records(spark: SparkSession, path: str, rescued: str | None = None) -> DataFrame:
    """Records from CSV, typed; text that is empty reads as empty, what doesn't cast as null (a list as empty).

    rescued names one more column: the field, text and rule of each value that was there and didn't cast.
    """
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in RECORDS])
    raw = spark.read.options(**CSV).schema(text).csv(path)

    def typed(f: T.StructField):
        c = F.col(f.name)
        if isinstance(f.dataType, T.ArrayType):
            return from_json_array(c)
        return F.coalesce(c, F.lit("")) if isinstance(f.dataType, T.StringType) else c.try_cast(f.dataType)

    def fault(f: T.StructField):
        c = F.col(f.name)
        lost = F.from_json(c, "array<string>").isNull() if isinstance(f.dataType, T.ArrayType) else c.try_cast(f.dataType).isNull()
        told = F.struct(F.lit(f.name).alias("field"), c.alias("text"), F.lit(f.dataType.simpleString()).alias("rule"))
        return F.when((F.coalesce(c, F.lit("")) != "") & lost, told)

    out = raw.select("*", F.array_compact(F.array(*[fault(f) for f in RECORDS if not isinstance(f.dataType, T.StringType)])).alias("__rescued"))
    more = [F.col("__rescued").alias(rescued)] if rescued else []
    return out.select(*[typed(f).alias(f.name) for f in RECORDS], *more)


def directory_rows(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Literal directory rows; product_types as JSON text, null staying null."""
    text = T.StructType([T.StructField(f.name, T.StringType() if f.name == "product_types" else f.dataType, f.nullable) for f in DIRECTORY])
    return spark.createDataFrame(rows, text).withColumn("product_types", F.from_json("product_types", "array<string>"))


def scan_directory(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def append_contacts(contacts: DataFrame, path: str, batch: str | None = None) -> None:
    """Add a batch of contacts; a failure is raised.

    A batch has a folder of its own. One that comes again under its name, after a failure or by mistake, replaces itself;
    one without a name is always added.
    """
    rows = contacts.select(*CONTACTS.names, F.lit(batch or uuid.uuid4().hex).alias(BATCH))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BATCH).parquet(path)


def read_contacts(spark: SparkSession, path: str) -> DataFrame:
    """The contacts of all batches."""
    return spark.read.schema(CONTACTS).parquet(path).select(*CONTACTS.names)
