import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from instdir.llm import common
from instdir.llm.common import Dealt, Scratch, fold, join_spread, lookup, map_arrow, small, without_rows
from instdir.llm.text import pieces


def test_frequent_keys_are_dealt_out(spark):
    left = spark.range(3000).select((F.when(F.col("id") < 2500, 7).otherwise(F.col("id"))).cast("long").alias("k"), "id")
    right = spark.range(2900).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    got = join_spread(left, right, "k", Scratch(spark, "spread"), "heavy", per_part=100)
    assert got.count() == left.join(right, "k").count() == 2900 and got.select("id").distinct().count() == 2900
    assert got.filter("k = 7").agg(F.count_distinct("v")).first()[0] == 1 and set(got.columns) == {"k", "id", "v"}


def test_equal_rows_of_a_frequent_key_part(spark):
    """Equal rows differ by where they lie, so they don't all go to one part."""
    left = spark.range(4000).select(F.lit(7).alias("k"), F.lit("same").alias("v")).repartition(8)
    counts = left.groupBy("k").agg(F.count("*").alias("n"))
    dealt = Dealt(counts, ["k"], Scratch(spark, "equal"), "heavy", per_part=500)
    sizes = [r["count"] for r in dealt.left(left, ["k", "v"]).groupBy("__part").count().collect()]
    assert len(sizes) > 2 and sum(sizes) == 4000
    got = dealt.join(left, spark.createDataFrame([(7, "x"), (8, "y")], "k int, w string"), ["v"])
    assert got.count() == 4000 and got.columns == ["k", "v", "w"]


def test_number_of_dealt_keys_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(common, "DEALT_KEYS", 3)
    left = spark.range(1000).select((F.col("id") % 10).alias("k"), "id")
    dealt = Dealt(left.groupBy("k").agg(F.count("*").alias("n")), ["k"], Scratch(spark, "many"), "heavy", per_part=10)
    assert dealt.heavy is None or dealt.heavy.count() <= 3
    assert dealt.join(left, spark.range(10).withColumnRenamed("id", "k"), ["id"]).count() == 1000


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_lookup_is_the_same_both_ways(spark, how):
    left = spark.range(3000).select((F.when(F.col("id") < 2000, 7).otherwise(F.col("id") % 50)).alias("k"), "id")
    scratch = Scratch(spark, "lookup")
    right = scratch.save(spark.range(5, 20).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v")), "right")
    near, far = (sorted(map(str, lookup(left, right, "k", scratch, f"heavy-{n}", by=["id"], how=how, rows=n).collect())) for n in (100, 0))
    assert near == far == sorted(map(str, left.join(right, "k", how).collect()))


def test_rows_are_dropped_by_their_key(spark):
    docs = spark.createDataFrame([(None, "a", 1), (None, "b", 1), (0, "a", 1), (1, None, 1), (1, "a", 1), (1, "a", 2)], "doc_id long, text string, __id long")
    docs = docs.withColumnRenamed("__id", "other")
    gone = docs.filter("doc_id is null and text = 'a' or doc_id = 1 and text is null").select("doc_id", F.xxhash64("text").alias("h"))
    left = without_rows(docs, gone, Scratch(spark, "rows"), "gone")
    assert left.columns == docs.columns and sorted((r.doc_id, r.text) for r in left.collect() if r.doc_id is not None) == [(0, "a"), (1, "a"), (1, "a")] and left.filter("doc_id is null").count() == 1


def test_session_settings(spark):
    """Arrow's bytes a batch are set once, and a user's own value is left alone."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(key, "1m")
    common.prepare(spark)
    assert spark.conf.get(key) == "1m"
    spark.conf.unset(key)
    common.prepare(spark)
    assert spark.conf.get(key) == f"{common.BATCH_BYTES}b"
    assert any("instdir.zip" in f for f in spark.sparkContext._python_includes)


def test_broadcasts_have_a_checked_size(spark):
    df = spark.range(10)
    hinted = lambda d: "broadcast" in d._jdf.queryExecution().logical().toString().lower()
    assert hinted(small(df, rows=10)) and not hinted(small(df, rows=9))
    assert hinted(small(df, weight=F.lit(8))) and not hinted(small(df, weight=F.lit(1 << 30)))


def test_batches_are_cut_by_their_texts(spark):
    def size(batch):
        yield pa.table({"n": [sum(len(b) for _, _, b, _ in pieces(batch.column("text")))], "rows": [batch.num_rows]})

    seen = map_arrow(spark.range(40).select(F.repeat(F.lit("x"), 1 << 20).alias("text")).coalesce(1), size, "n long, rows long").collect()
    assert sum(r.rows for r in seen) == 40 and max(r.n for r in seen) <= 3 << 20


def test_fold(spark):
    got = spark.range(50).select("id", fold(F.col("id"), 4).alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 4 for r in got)
    assert spark.sql("SELECT CAST(NULL AS BIGINT) AS id").select(fold(F.col("id"), 4)).first()[0] is None


def test_scratch_tables_are_dropped(spark):
    scratch = Scratch(spark, "drop")
    df = scratch.save(spark.range(3), "t")
    assert df.count() == 3
    scratch.drop("t", "never there")
    assert not spark.sparkContext._jvm.java.io.File(scratch.path("t").removeprefix("file://")).exists()


@pytest.mark.parametrize("bits", [1 << 28, 1 << 15])
def test_sifted_joins_shuffle_hits_alone(spark, monkeypatch, bits):
    """Every kind of join gives what it gives unsifted, also when the bitmap is full; no row with a partner is missed."""
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(common, "SIFT_BITS", bits)
    scratch = common.Scratch(spark, "sift")
    left = spark.range(30_000).select((F.col("id") % 9_000).alias("k"), F.concat(F.lit("text "), "id").alias("a.b"))
    right = scratch.save(spark.range(0, 9_000, 7).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v")), "right")
    maybe, sure = common.sifted(left, right, ["k"], scratch, "bits")
    assert sure.join(right, "k", "left_semi").isEmpty() and maybe.count() + sure.count() == 30_000
    if bits > 1 << 15:
        assert maybe.count() < 30_000 / 7 * 1.6  # a seventh, and a sixteenth of the others
    for how in ("inner", "left", "left_anti", "left_semi"):
        got = common.lookup(left, right, "k", scratch, f"heavy-{how}", by=["k"], how=how, sift=True)
        want = left.join(right, "k", how)
        assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    empty = scratch.save(right.filter("false"), "empty")
    assert common.lookup(left, empty, "k", scratch, "none", by=["k"], how="left_anti", sift=True).count() == 30_000
