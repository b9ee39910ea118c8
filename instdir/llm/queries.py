"""The thin queries over the operators of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import media, quality, secret_scan, toxicity, warc
from .alignment import align_documents
from .binary_packing import pack_binary
from .common import Scratch, fold
from .decontaminate import contamination
from .line_dedup import drop_repeated_lines
from .near_dedup import near_duplicates
from .packing import pack_documents
from .runs import periodic_runs
from .url_filter import judge_urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Scratch(spark, "warc").path("archives")
    warc.write_warc(_table(spark, sf_dir, "pages"), path)
    c = warc.assemble(warc.read_warc(spark, path, payloads=False))
    return c.select(
        warc.page_of(F.col("record_id")).alias("page_id"),
        F.col("capture.payload_bytes").alias("payload_bytes"),
        F.col("capture.payload_digest").alias("payload_digest"),
        F.col("capture.warc_type").alias("record_type"),
        warc.page_of(F.col("capture.refers_to")).alias("refers_to"),
        F.size("requests").alias("n_requests"),
        F.size("metadata").alias("n_metadata"),
    )


def op2_linear_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"), vocabulary())


def op3_prefix_filtered_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    ids = F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256")
    return out.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), ids, (F.col("n_hit") > 0).alias("contaminated"))


def op4_minhash_odd_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents")).drop("text_h")


def _judged(scores: DataFrame, of: int, held_out: int) -> DataFrame:
    return scores.select("doc_id", (fold(F.col("doc_id"), of) == held_out).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op5_png_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = Scratch(spark, "media").save(media.texts_as_png(_table(spark, sf_dir, "documents")), "images")
    return media.decoded(stored).select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -32, 32)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.lower(F.hex("hash")).alias("feature"),
    )


#: The rules of the query.
URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def op6_markov_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(_table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict", "score")


def op7_positive_unlabelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    return _judged(toxicity.score(docs, model), toxicity.HELD_OUT_OF, toxicity.HELD_OUT)


def op8_blob_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base rules first; then, over the same ledger, the wider ones, for which the base pairs are seen already."""
    docs, ledger = _table(spark, sf_dir, "documents"), Scratch(spark, "secrets").path("ledger")
    secret_scan.scan(docs, ledger, ("base-1",))
    out = secret_scan.scan(docs, ledger, ("base-1", "wide-1"))

    def count(kind: str):
        return F.size(F.filter("findings", lambda f: f["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def joined(findings):
        return F.array_join(F.transform(findings, lambda f: F.concat_ws(":", f["kind"], f["start"], f["end"])), ",")

    base = joined(F.filter("findings", lambda f: f["kind"].isin(*[r[0] for r in secret_scan.RULES])))
    return out.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(base.cast("binary"), 256).alias("base_sha256"), joined("findings").alias("spans"))


def op9_three_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    out = drop_repeated_lines(docs.select("doc_id", "text", "n_chars").withColumn("before", F.length("text")))
    return out.select("doc_id", "text", "n_chars", (F.col("before") - F.length("text")).cast("long").alias("chars_removed"))


def op10_regularised_qda(spark: SparkSession, sf_dir: str) -> DataFrame:
    feats = Scratch(spark, "quality").save(quality.features(_table(spark, sf_dir, "documents")), "features")
    model = quality.fit(feats, _table(spark, sf_dir, "labels"))
    return _judged(quality.score(feats, model), quality.HELD_OUT_OF, quality.HELD_OUT)


def op11_power_of_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pack_binary(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket", "number")


def op12_square_catching(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = periodic_runs(_table(spark, sf_dir, "documents"))
    told = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    hashes = [F.sha2(c.cast("binary"), 256).alias(name) for c, name in ((told, "runs_sha256"), (F.col("text"), "collapsed_sha256"))]
    return out.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", *hashes)


def op13_diagonal_skipping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_documents(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")).drop("row")


QUERIES = {f.__name__: f for f in (op1_warc_transactions, op2_linear_grouping, op3_prefix_filtered_windows, op4_minhash_odd_sketches, op5_png_cosine, op6_markov_ratio, op7_positive_unlabelled, op8_blob_ledger, op9_three_line_windows, op10_regularised_qda, op11_power_of_two, op12_square_catching, op13_diagonal_skipping)}
ORACLE_SQL: dict[str, str] = {
    "op1_warc_transactions": """
WITH h AS (SELECT page_id, coalesce(html, '') AS p, sha1(coalesce(html, '')) AS s FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY p) AS first FROM h)
SELECT page_id, CAST(strlen(p) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           ((CAST('0x' || substr(s, CAST(5 * (j // 4) + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (j % 4) AS BIGINT)) & 31) + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to, CAST(1 AS INTEGER) AS n_requests, CAST(1 AS INTEGER) AS n_metadata
FROM f
""",
    "op4_minhash_odd_sketches": r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(len(w) - 4), lambda i: array_to_string(list_slice(w, i + 1, i + 5), ' '))
      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE CAST([] AS VARCHAR[]) END) AS x FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
g AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id, doc_id AS other FROM d UNION SELECT r.doc_id, g.b FROM r JOIN g ON g.a = r.other),
m AS (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM d JOIN m ON m.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
""",
    "op3_prefix_filtered_windows": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
i AS (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(len(w) - least(10, len(w)) + 1)) AS p FROM b WHERE len(w) > 0),
x AS (SELECT DISTINCT item_id, n, list_slice(w, p + 1, p + n) AS run FROM i),
s AS (SELECT DISTINCT n FROM x),
o AS (SELECT doc_id, w, n, unnest(range(len(w) - n + 1)) AS p FROM d, s WHERE len(w) >= n),
h AS (SELECT o.doc_id, o.p, o.n, x.item_id FROM (SELECT doc_id, p, n, list_slice(w, p + 1, p + n) AS run FROM o) o JOIN x ON x.run = o.run),
c AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(p, p + n)) AS q FROM h) GROUP BY doc_id),
l AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(c.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(l.n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(l.ids, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN l ON l.doc_id = d.doc_id
""",
    "op9_three_line_windows": """
WITH l AS (SELECT doc_id, text, n_chars, string_split(text, chr(10)) AS lines FROM documents),
w AS (SELECT doc_id, unnest(range(len(lines) - 2)) AS line, lines FROM l WHERE len(lines) >= 3),
k AS (SELECT doc_id, line, list_slice(lines, line + 1, line + 3) AS run FROM w),
o AS (SELECT doc_id, line, row_number() OVER (PARTITION BY run ORDER BY doc_id, line) AS nth FROM k
      WHERE trim(run[1] || run[2] || run[3], ' ') <> ''),
c AS (SELECT DISTINCT doc_id, line + j AS line FROM o, (SELECT unnest([0, 1, 2]) AS j) WHERE nth > 1),
p AS (SELECT l.doc_id, u.line, u.s FROM l, LATERAL (SELECT unnest(range(len(l.lines))) AS line, unnest(l.lines) AS s) u),
t AS (SELECT p.doc_id, string_agg(p.s, chr(10) ORDER BY p.line) AS kept
      FROM p LEFT JOIN c ON c.doc_id = p.doc_id AND c.line = p.line WHERE c.line IS NULL GROUP BY p.doc_id),
h AS (SELECT DISTINCT doc_id FROM c)
SELECT l.doc_id, CASE WHEN h.doc_id IS NULL THEN l.text ELSE coalesce(t.kept, '') END AS text,
       CASE WHEN h.doc_id IS NULL THEN l.n_chars ELSE CAST(length(coalesce(t.kept, '')) AS BIGINT) END AS n_chars,
       CAST(length(l.text) - CASE WHEN h.doc_id IS NULL THEN length(l.text) ELSE length(coalesce(t.kept, '')) END AS BIGINT) AS chars_removed
FROM l LEFT JOIN h ON h.doc_id = l.doc_id LEFT JOIN t ON t.doc_id = l.doc_id
""",
}
