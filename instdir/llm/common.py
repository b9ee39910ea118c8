"""Shared pieces: tables in the cluster's shared folder, guarded broadcasts, Arrow mapping."""

from __future__ import annotations

import io
import os
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import fresh
from .text import pieces

#: Bytes of an Arrow batch at most: what a task holds in the JVM and in Python doesn't grow with long texts.
BATCH_BYTES, _BATCH = 2 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"
#: Workers are kept for the next task; so they give what arrays took back to the system (environment of the allocators).
_MEMORY = {"MALLOC_ARENA_MAX": "2", "MALLOC_MMAP_THRESHOLD_": str(4 << 20), "MALLOC_TRIM_THRESHOLD_": str(8 << 20), "ARROW_DEFAULT_MEMORY_POOL": "system"}
#: A side is broadcast only if it was counted and holds at most so many rows of a few words each.
BROADCAST_ROWS = 200_000
#: And, where a row's size isn't fixed, at most so many bytes.
BROADCAST_BYTES = 32 << 20
#: Rows of one key that a join leaves in one part, at least; and keys that are dealt out at most, which bounds their broadcast.
PART_ROWS, DEALT_KEYS = 500, 50_000
_ready: dict[str, str] = {}


def prepare(spark: SparkSession) -> None:
    """What the operators need of a session, once for each: the only place that changes one.

    The package goes to the executors as a zip through the shared folder and Spark's own files, so they need no copy of the
    sources. Arrow's bytes a batch and the workers' allocator variables are set only where the user has not set them.
    """
    sc = spark.sparkContext
    if _ready.get("app") != sc.applicationId:
        for name, value in _MEMORY.items():
            sc.environment.setdefault(name, value)
        sc.addPyFile(_shipped(spark))
        _ready["app"] = sc.applicationId
    if not spark.conf.isModifiable(_BATCH) or spark.conf.get(_BATCH) != _default(spark, _BATCH):
        return
    spark.conf.set(_BATCH, f"{BATCH_BYTES}b")


def _default(spark: SparkSession, key: str) -> str:
    return spark._jvm.org.apache.spark.sql.internal.SQLConf().getConfString(key)


def _shipped(spark: SparkSession) -> str:
    """The path of a zip of this package's sources in the shared folder."""
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(package):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(package)))
    path = f"{fresh(spark, 'code')}/instdir.zip"
    to = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = to.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(to)
    stream.write(out.getvalue())
    stream.close()
    return path


class Scratch:
    """Tables written to the shared folder: they cut the lineage and survive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, fresh(spark, name)

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def save(self, df: DataFrame, table: str) -> DataFrame:
        """Write df once and return a plan that reads it back."""
        df.write.mode("overwrite").parquet(self.path(table))
        return self.spark.read.schema(df.schema).parquet(self.path(table))

    def drop(self, *tables: str) -> None:
        """Delete tables that no plan in use reads any more."""
        jvm = self.spark.sparkContext._jvm
        for table in tables:
            path = jvm.org.apache.hadoop.fs.Path(self.path(table))
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS, weight: Column | None = None) -> DataFrame:
    """A written table with a broadcast hint if it has at most ``rows`` rows, else as it is (shuffle join).

    weight tells the bytes of a row whose size isn't fixed; together they stay below BROADCAST_BYTES.
    """
    if weight is None:
        return F.broadcast(df) if df.count() <= rows else df
    n, size = df.agg(F.count("*"), F.coalesce(F.sum(weight), F.lit(0))).first()
    return F.broadcast(df) if n <= rows and size <= BROADCAST_BYTES else df


class Dealt:
    """A join whose frequent keys are dealt out: rows of the left side by a hash, the right side's rows of the key to each part.

    counts has the key columns and n, how many rows of the left side have them (no less). Each part has about ``per_part``
    rows of the left side; at most DEALT_KEYS keys are dealt, else parts are larger, so what is broadcast is bounded.
    """

    def __init__(self, counts: DataFrame, on: list[str], scratch: Scratch, name: str, per_part: int = PART_ROWS):
        self.on, self.heavy = on, None
        over = F.col("n") > per_part
        rows, total = counts.agg(F.count_if(over), F.sum(F.when(over, F.col("n")))).first()
        if rows:
            per_part = max(per_part, -(-total // DEALT_KEYS))
            heavy = counts.filter(F.col("n") > per_part).select(*on, F.ceil(F.col("n") / per_part).cast("int").alias("__parts"))
            self.heavy = F.broadcast(scratch.save(heavy, name))

    def left(self, df: DataFrame, by: list[str]) -> DataFrame:
        """df with the part of each row: by these columns and by where the row lies, so that equal rows part too."""
        if self.heavy is None:
            return df.withColumn("__part", F.lit(0))
        salt = F.pmod(F.xxhash64(*by, F.spark_partition_id()), F.coalesce("__parts", F.lit(1))).cast("int")
        return df.join(self.heavy, self.on, "left").withColumn("__part", salt).drop("__parts")

    def right(self, df: DataFrame) -> DataFrame:
        """df with each row once for every part of its key."""
        if self.heavy is None:
            return df.withColumn("__part", F.lit(0))
        last = F.coalesce("__parts", F.lit(1)) - 1
        return df.join(self.heavy, self.on, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), last))).drop("__parts")

    def join(self, left: DataFrame, right: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
        if self.heavy is None:
            return left.join(right, self.on, how)
        return self.left(left, by).join(self.right(right), [*self.on, "__part"], how).drop("__part")


def join_spread(left: DataFrame, right: DataFrame, on: str | list[str], scratch: Scratch, name: str, by: list[str] | None = None, how: str = "inner", per_part: int = PART_ROWS) -> DataFrame:
    """left.join(right, on, how) with the rows of a frequent key of left dealt out in parts; right's rows of it go to each.

    Key columns hold no null. ``by`` are columns of left that part a key's rows (all, if not given).
    """
    on = [on] if isinstance(on, str) else on
    counts = left.groupBy(*on).agg(F.count("*").alias("n"))
    return Dealt(counts, on, scratch, name, per_part).join(left, right, by or left.columns, how)


#: Bits of a bitmap over keys at most (32 MB), bits for each key if there is room, and bits of a row of its table.
SIFT_BITS, BITS_A_KEY, _ROW_BITS = 1 << 28, 16, 1 << 15


def sifted(left: DataFrame, right: DataFrame, on: list[str], scratch: Scratch, name: str) -> tuple[DataFrame, DataFrame]:
    """The rows of left that may have a partner in the written table right, and those that surely have none.

    They are told apart by a bitmap over right's keys, whose size is bounded: it is built by Spark, and broadcast. Where keys
    are so many that it fills up, more rows are let through; none that has a partner is missed.
    """
    bits = _ROW_BITS
    while bits < min(SIFT_BITS, BITS_A_KEY * right.count()):
        bits *= 2
    bit = F.pmod(F.xxhash64(F.lit(41), *on), F.lit(bits))
    rows = right.select(bit.alias("bit")).groupBy((F.col("bit") / _ROW_BITS).cast("int").alias("__at")).agg(F.bitmap_construct_agg(F.col("bit") % _ROW_BITS).alias("__bits"))
    rows = F.broadcast(scratch.save(rows, f"{name}-bits"))
    here = left.withColumn("__bit", bit).withColumn("__at", (F.col("__bit") / _ROW_BITS).cast("int")).join(rows, "__at", "left")
    place = F.col("__bit") % _ROW_BITS
    byte = F.conv(F.hex(F.substring("__bits", (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(byte, (place % 8).cast("int")) == 1, F.lit(False))
    marked = here.withColumn("__hit", hit).drop("__at", "__bit", "__bits")
    return marked.filter("__hit").drop("__hit"), marked.filter("not __hit").drop("__hit")


def lookup(left: DataFrame, right: DataFrame, on: str | list[str], scratch: Scratch, name: str, by: list[str] | None = None, how: str = "inner", weight: Column | None = None, rows: int | None = None, counts: DataFrame | None = None, sift: bool = False) -> DataFrame:
    """left.join(right, on, how) for a written table ``right``: broadcast if it is counted small, else with frequent keys dealt out.

    counts (the key columns and n, see ``Dealt``) spares counting left's keys. With sift, for a left side of wide rows such as
    texts, only the rows that may have a partner are shuffled; the others go round the join.
    """
    hinted = small(right, BROADCAST_ROWS if rows is None else rows, weight)
    if hinted is not right:
        return left.join(hinted, on, how)
    on, by, alone = [on] if isinstance(on, str) else on, by or left.columns, None
    if sift:
        left, alone = sifted(left, right, on, scratch, name)
    out = join_spread(left, right, on, scratch, name, by, how) if counts is None else Dealt(counts, on, scratch, name).join(left, right, by, how)
    if alone is None or how in ("inner", "left_semi"):
        return out
    return out.unionByName(alone, allowMissingColumns=True)


def _parts(batch: pa.RecordBatch, by: str, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts make about ``limit`` bytes, so that what a task holds doesn't grow with the texts of a batch."""
    at = batch.schema.get_field_index(by)
    if at < 0:
        yield batch
        return
    for i, j, _, _ in pieces(batch.column(at), limit):
        yield batch.slice(i, j - i)


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.Table | pa.RecordBatch]], schema: str, by: str = "text") -> DataFrame:
    """Arrow batches through fn, at most about BATCH_BYTES each; one with larger texts in column ``by`` is cut by their size."""
    prepare(df.sparkSession)
    names = df.columns
    df = df.toDF(*[f"_{i}" for i in range(len(names))])  # a name may hold dots or backticks

    def run(batches):
        for batch in batches:
            batch = batch.rename_columns(names)
            for part in _parts(batch, by) if batch.num_rows else ():
                for out in fn(part):
                    yield from out.to_batches() if isinstance(out, pa.Table) else [out]

    return df.mapInArrow(run, schema)


def quoted(names: list[str]) -> list[str]:
    """Column names as Spark reads them: with dots and backticks in them, too."""
    return ["`" + n.replace("`", "``") + "`" for n in names]


def row_key(text: Column, doc_id: Column) -> Column:
    """Names a row by what it holds, so that it is the same after a lost task; equal rows share it."""
    return F.struct(doc_id.alias("doc_id"), F.xxhash64(text).alias("h"))


#: Columns of a row's key that hold no null, for joins.
KEY = ["__row_no_id", "__row_id", "__row_hash"]


def key_columns(doc_id: Column, h: Column) -> list[Column]:
    """The parts of a row's key as KEY."""
    doc_id = doc_id.cast("long")
    return [doc_id.isNull().alias(KEY[0]), F.coalesce(doc_id, F.lit(0)).alias(KEY[1]), h.alias(KEY[2])]


def keyed(docs: DataFrame) -> DataFrame:
    """docs with KEY of each row."""
    return docs.select(*quoted(docs.columns), *key_columns(F.col("doc_id"), F.xxhash64(F.col("text").cast("string"))))


def without_rows(docs: DataFrame, gone: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """docs without the rows whose key is in the written table gone(doc_id, h)."""
    gone = scratch.save(gone.select(*key_columns(F.col("doc_id"), F.col("h"))).distinct(), f"{name}-keys")
    return lookup(keyed(docs), gone, KEY, scratch, f"{name}-heavy", by=KEY, how="left_anti", sift=True).select(*quoted(docs.columns))


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text, mod n; null stays null."""
    return (F.crc32(doc_id.cast("string").cast("binary")) % n).cast("int")
