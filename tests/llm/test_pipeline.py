"""The pipeline against brute force: each stage's rows by plain Python, on the smallest tables and on odd rows."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from instdir.llm import queries as Q

UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower(text):
    return (text or "").translate(str.maketrans(UP, LOW))


def by_id(row):
    """Rows in the order in which the first one of a kind is kept: without an id last."""
    return row[0] is None, row[0] or 0


def plain_lines(rows):
    """Texts without the lines of three-line windows that an earlier row has; rows equal in id and text are one; rows emptied go."""
    seen, gone = {}, defaultdict(set)
    different = sorted({r for r in rows if r[1] is not None}, key=lambda r: (r[0] is not None, r[0] or 0))
    places = []
    for i, text in different:
        lines = text.split("\n")
        places += [((i is not None, i or 0), at, (i, text), tuple(lines[at : at + 3])) for at in range(len(lines) - 2) if "".join(lines[at : at + 3]).strip(" ")]
    for _, at, row, window in sorted(places, key=lambda p: (p[0], p[1])):
        if window in seen:
            gone[row] |= {at, at + 1, at + 2}
        seen.setdefault(window, row)
    left = [(i, t, t if (i, t) not in gone else "\n".join(line for n, line in enumerate(t.split("\n")) if n not in gone[i, t])) for i, t in rows]
    return [(i, new) for i, t, new in left if new != "" or t == ""]


def plain_copies(rows):
    """One row of each component of rows whose five-word shingles are at least 0.75 alike."""
    rows = sorted(rows, key=by_id)
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
        sets.append({tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    where, common, root = defaultdict(list), Counter(), list(range(len(rows)))
    for i, s in enumerate(sets):
        for x in s:
            where[x].append(i)
    for ids in where.values():
        common.update((a, b) for k, a in enumerate(ids) for b in ids[k + 1 :])

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), n in common.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return [r for i, r in enumerate(rows) if find(i) == i]


def plain_benchmark(rows, items):
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    windows = set()
    for text in items:
        w = re.findall(pattern, lower(text))
        n = min(10, len(w))
        windows |= {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if n else set()
    sizes = {len(w) for w in windows}

    def hit(text):
        w = re.findall(pattern, lower(text))
        return any(tuple(w[j : j + n]) in windows for n in sizes for j in range(len(w) - n + 1))

    return [r for r in rows if not hit(r[1])]


def plain_pieces(rows):
    from tokenizers import Tokenizer

    tok, out = Tokenizer.from_file(Q.vocabulary()), []
    for i, text in rows:
        ids = tok.encode(text or "", add_special_tokens=False).ids + [1]
        out += [(i, k // 4096, k, len(ids[k : k + 4096]), zlib.crc32(np.array(ids[k : k + 4096], "<u4").tobytes())) for k in range(0, len(ids), 4096)]
    return out


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def same(a, b):
    assert sorted(a, key=str) == sorted(b, key=str)


def check(spark, docs, folder, items):
    """Every stage after the first on its predecessor's rows; the last one's places too."""
    import corpus_pipeline as pipeline

    stages = dict(pipeline.STAGES)
    now = docs
    for name, plain in (("line_dedup", plain_lines), ("near_dedup", plain_copies), ("decontamination", lambda rows: plain_benchmark(rows, items))):
        before, out = rows_of(now), stages[name](spark, now, folder)
        assert out.columns == docs.columns
        now = spark.createDataFrame(out.collect(), docs.schema)
        same(rows_of(now), plain(before))
    out = stages["packing"](spark, now, folder).toPandas()
    ids = out.doc_id.astype(object).where(out.doc_id.notna(), None)
    same([(None if i is None else int(i), *r) for i, r in zip(ids, out[["piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None))], plain_pieces(rows_of(now)))
    out = out.sort_values(["sequence_id", "offset"])
    assert (out.groupby("sequence_id").length.cumsum() - out.length == out.offset).all() and (out.offset + out.length).max() <= 4096
    return out


def test_smallest_tables(spark, sf_dir):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    clean = pipeline.without_toxic(spark, docs, sf_dir)
    kept = {r.doc_id for r in clean.select("doc_id").collect()}
    scores = {r.doc_id: r.score for r in Q.op7_positive_unlabelled(spark, sf_dir).collect()}
    assert kept == {i for i, s in scores.items() if s < 0.3} and clean.columns == docs.columns and len(kept) > 0.7 * len(scores)
    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    out = check(spark, spark.createDataFrame(clean.collect(), docs.schema), sf_dir, items)
    whole = pipeline.run(spark, sf_dir).toPandas()
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(whole[columns].itertuples(index=False, name=None)) == sorted(out[columns].itertuples(index=False, name=None))


ITEM = "one two three four five six seven eight nine ten eleven twelve"
OTHER = "red green blue white black brown pink grey gold silver"
LINES = "first line\nsecond line\nthird line"


def test_odd_rows(spark, tmp_path):
    rows = [
        (None, "so " + ITEM), (1, "and " + ITEM), (1, "a clean text of the same id as a bad one"), (2, "nothing bad"), (3, OTHER), (4, OTHER), (4, "no copy but it shares an id with one"), (None, OTHER + " more"),
        (5, None), (None, None), (6, ""), (6, ""), (7, LINES + "\nown"), (8, "x\n" + LINES), (8, "x\n" + LINES), (None, "y\n" + LINES + "\nz"), (9, "\n\n\n\n"), (10, "twice twice twice"), (10, "twice twice twice"), (11, "w" * 5000), (12, " ".join(f"v{i}" for i in range(6000))),
    ]
    docs = spark.createDataFrame([(i, t, None, "s", None if t is None else len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit("clash") for c in ("h", "n", "row", "kept", "text_h", "cid", "__part", "gone")})
    spark.createDataFrame([("i", ITEM), ("j", None)], "item_id string, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    check(spark, docs.repartition(3), f"file://{tmp_path}", [ITEM])


@pytest.mark.parametrize("missing", ["labels", "benchmark"])
def test_empty_side_tables_drop_nothing(spark, tmp_path, missing):
    import corpus_pipeline as pipeline

    schemas = {"labels": "doc_id long, quality int, toxic int", "benchmark": "item_id string, text string"}
    spark.createDataFrame([], schemas[missing]).write.parquet(f"file://{tmp_path}/{missing}.parquet")
    docs = spark.createDataFrame([(1, "a b"), (None, None)], "doc_id long, text string")
    stage = pipeline.without_toxic if missing == "labels" else pipeline.without_benchmark
    same(rows_of(stage(spark, docs, f"file://{tmp_path}")), rows_of(docs))
