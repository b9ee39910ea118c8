"""Incremental ingest in bounded micro-batches: a run takes the files that no run has taken, and keeps what it has done.

Each micro-batch takes so many files, or bytes, and is written to a folder of its own before its offsets are committed. A
run that dies leaves the committed batches; the next one with the same checkpoint begins with the batch that wasn't, whose
files are in the checkpoint, and overwrites its folder. So no row is missing and none is there twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Columns of the sink that name a batch: the stream (one a checkpoint) and its number there.
STREAM, BATCH = "_stream", "_batch"


def ingest_incremental(
    spark: SparkSession,
    source: str,
    schema: T.StructType,
    sink: str,
    checkpoint: str,
    transform: Callable[[DataFrame], DataFrame] = lambda df: df,
    fmt: str = "parquet",
    files_per_batch: int | None = 1000,
    bytes_per_batch: int | str | None = None,
) -> list[dict]:
    """Read what is new under source (a folder or pattern), transform it row by row, add it to the Parquet sink, and end.

    A micro-batch has at most files_per_batch files or, if bytes_per_batch is given (as a number or like "10g"), about so many
    bytes. Filters and projections of transform reach the scan. The batches that this run committed are returned: their
    number and their rows read. A sink may be fed by several checkpoints; each has its own folders there.
    """
    bound = {"maxBytesPerTrigger": str(bytes_per_batch)} if bytes_per_batch else {"maxFilesPerTrigger": str(files_per_batch)} if files_per_batch else {}
    stream = transform(spark.readStream.schema(schema).format(fmt).options(**bound).load(source))
    done: list[dict] = []

    def write(batch: DataFrame, number: int) -> None:
        name = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        batch.write.mode("overwrite").parquet(f"{sink}/{STREAM}={name}/{BATCH}={number}")

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        done = [{"batch": p["batchId"], "rows": p["numInputRows"]} for p in query.recentProgress if p["numInputRows"]]
    return done


def read_ingested(spark: SparkSession, sink: str, schema: T.StructType) -> DataFrame:
    """The rows of a sink, without the columns that name their batch; none where nothing was ingested yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(sink)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(sink).select(*[f"`{n.replace('`', '``')}`" for n in schema.names])
