"""Secret scans over an incremental ledger of blobs.

Every version of every path is addressed by its content. The ledger holds, for each pair of a blob and a version of the
rules, what the scan found (also when it found nothing). A run first finds out, from addresses alone, which pairs the
ledger lacks; only their texts are read by the scanner, each blob once, for the versions it lacks. The findings are
appended and joined back to all paths.

Most blobs of a run lack the same versions (all of them, the newest, or none). Only the others and repeated blobs are
named to the scan of texts, by a broadcast where they are few, so texts are shuffled only if both kinds are many.

Defined cases: null text is an empty blob; a very long text is scanned in whole, in time that grows with it; repeated rows and equal texts share a blob,
are scanned once and each get its findings; a null doc_id stays null; an empty table leaves the ledger as it is; other
columns are not looked at.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, lookup, map_arrow

#: The kinds in their order, the pattern of each, the group whose length counts, and the least length.
RULES = (
    ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE, 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 0, 20),
    ("hex", r"[0-9a-f]+", 0, 0, 24),
)
#: Further kinds, after the base ones: heads of private keys, access tokens, web tokens, passwords in urls. A run of a kind's
#: characters is tried from its beginning alone, so a long one takes time in proportion: what is tried later in it would fail too.
#: A finding begins at the group ``begin``: the first letter of a scheme, the first mark of a web token in the run.
WIDE_RULES = (
    ("key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0, 0),
    ("token", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 0, 0),
    ("web", r"(?<![A-Za-z0-9_-])(?>[A-Za-z0-9_-]*?(?=eyJ))(?P<begin>eyJ[A-Za-z0-9_-]{8,})\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 0, 0),
    ("login", r"(?<![a-z0-9+.-])[0-9+.-]*(?P<begin>[a-z][a-z0-9+.-]*)://[A-Za-z0-9._~%-]+:[A-Za-z0-9._~%-]+@", 0, 0, 0),
)
#: Versions of the rules by name, in the order of their kinds.
VERSIONS = {"base-1": RULES, "wide-1": WIDE_RULES}
KINDS = [r[0] for rules in VERSIONS.values() for r in rules]
_FOUND = "array<struct<start:int,rank:int,end:int,kind:string>>"


def _compiled(version: str) -> list:
    """(kind, what any match must contain, pattern, group, least length).

    A run of hex digits is maximal, so asking for the least length at once finds the same runs.
    """
    out = []
    for kind, pattern, flags, group, least in VERSIONS[version]:
        if kind == "hex":
            pattern = pattern.removesuffix("+") + "{%d,}" % least
        need = {"assign": (":", "="), "access": ("AKIA",), "key": ("PRIVATE KEY-----",), "token": ("gh",), "web": ("eyJ",), "login": ("://",)}.get(kind, ("",))
        out.append((kind, need, re.compile(pattern, re.ASCII | flags), group, least))
    return out


def find(text: str, rules) -> list[tuple[int, int, int, str]]:
    """(start, rank, end, kind) of every finding, in code points, by start and rank."""
    out = []
    for kind, need, pattern, group, least in rules:
        if any(n in text for n in need):
            begin = "begin" if "begin" in pattern.groupindex else 0
            out += [(m.start(begin), KINDS.index(kind), m.end(), kind) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return sorted(out)


def scan_blobs(blobs: DataFrame) -> DataFrame:
    """blob, findings, n_found and version of each row of blobs(blob, text, missing) and each version in missing."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("rank", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))

    def fn(batch):
        rules, out = {v: _compiled(v) for v in VERSIONS}, []
        for blob, text, missing in zip(batch.column("blob"), batch.column("text"), batch.column("missing").to_pylist(), strict=True):
            for version in missing:
                found = [dict(zip(("start", "rank", "end", "kind"), x, strict=True)) for x in find(text.as_py(), rules[version])]
                out.append((blob.as_py(), found, len(found), version))
        columns = list(zip(*out, strict=True)) or [()] * 4
        yield pa.Table.from_arrays([pa.array(columns[0], pa.binary()), pa.array(columns[1], kind), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.string())], ["blob", "findings", "n_found", "version"])

    return map_arrow(blobs.select("blob", "text", "missing"), fn, _SCHEMA)


_SCHEMA = f"blob binary, findings {_FOUND}, n_found int, version string"


def _ledger(docs: DataFrame, path: str, versions: list[str]) -> DataFrame:
    """The ledger's rows of these versions; an empty one is made where there is none."""
    spark = docs.sparkSession
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        spark.createDataFrame([], _SCHEMA).write.partitionBy("version").parquet(path)
    return spark.read.schema(_SCHEMA).parquet(path).filter(F.col("version").isin(versions))


def scan(docs: DataFrame, ledger: str, versions: tuple[str, ...] = ("base-1",)) -> DataFrame:
    """doc_id, blob and findings for each row of docs(doc_id, text, ...); the ledger at that path grows by what was new."""
    scratch, versions = Scratch(docs.sparkSession, "blobs"), list(versions)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("blob", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))

    # which pairs are unseen, from addresses alone
    blobs = scratch.save(rows.groupBy("blob").agg(F.count("*").alias("n")), "present")
    known = _ledger(docs, ledger, versions).join(blobs.select("blob"), "blob", "left_semi").groupBy("blob").agg(F.collect_set("version").alias("seen"))  # as many as versions at most
    none = F.array().cast("array<string>")
    missing = F.array_sort(F.array_except(F.array(*[F.lit(v) for v in versions]), F.coalesce("seen", none)))
    blobs = scratch.save(blobs.join(known, "blob", "left").select("blob", "n", missing.alias("missing")), "blobs")
    kinds = blobs.groupBy((F.col("n") == 1).alias("once"), "missing").count().orderBy(F.desc("count"), "missing").collect()  # by sets of versions
    usual = next((r.missing for r in kinds if r.once), [])
    special = scratch.save(blobs.filter((F.col("n") > 1) | (F.col("missing") != F.coalesce(F.array(*[F.lit(v) for v in usual]).cast("array<string>"), none))), "special")

    # their texts, each blob's once
    if any(r.missing for r in kinds):
        picked = lookup(rows, special, "blob", scratch, "heavy-1", by=["doc_id"], how="left" if usual else "inner", counts=special, sift=True)
        picked = picked.withColumns({"n": F.coalesce("n", F.lit(1)), "missing": F.coalesce("missing", F.array(*[F.lit(v) for v in usual]).cast("array<string>"))}).filter(F.size("missing") > 0)
        once = picked.filter("n = 1").select("blob", "text", "missing")
        again = picked.filter("n > 1").groupBy("blob").agg(F.first("text").alias("text"), F.first("missing").alias("missing"))
        scan_blobs(once.unionByName(again)).write.mode("append").partitionBy("version").parquet(ledger)

    # findings back to all paths; blobs with nothing found need no join
    found = _ledger(docs, ledger, versions).filter("n_found > 0").join(blobs.select("blob"), "blob", "left_semi")
    found = found.groupBy("blob", "version").agg(F.first("findings").alias("findings")).groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("findings"))).alias("findings"))
    found = scratch.save(found, "found")
    paths = rows.select("doc_id", "blob")
    out = lookup(paths, found, "blob", scratch, "heavy-2", by=["doc_id"], how="left", weight=32 + 40 * F.size("findings"), counts=blobs.select("blob", "n"))
    scratch.drop("present", "special")
    return out.select("doc_id", "blob", F.coalesce("findings", F.array().cast(_FOUND)).alias("findings"))
