"""Every operator and stage over odd tables: nulls, empty and very long texts, ties, repeated rows, no rows, clashing columns."""

import random
import re
import struct
import time
import zlib

import pytest
from pyspark.sql import functions as F

from instdir.llm import media, near_dedup, quality, secret_scan, toxicity, url_filter, warc
from instdir.llm import queries as Q
from instdir.llm.common import Scratch, without_rows
from instdir.llm.decontaminate import contamination
from instdir.llm.line_dedup import drop_repeated_lines
from instdir.llm.packing import pack_documents

A = "one two three four five six seven eight nine ten eleven twelve"
LONG = " ".join(f"word{i % 977}x{i % 31}" for i in range(60_000))
LINES = "first line\nsecond line\nthird line"
DOCS = [
    (1, A), (2, A), (2, A), (3, None), (4, ""), (5, "   \n\t "), (6, LONG), (7, LONG + " more"), (8, "two words"), (9, "two words"),
    (None, A), (None, None), (10, LINES + "\nown"), (11, "before\n" + LINES), (12, "\n\n\n\n\n\n"), (13, "\n\n\n\n\n"), (14, A.upper()), (15, "x\n" * 9), (1, "another text of the same id"),
]
EXTRA = ["key", "h", "row", "gone", "text_h", "draw", "confirmed", "unlabelled", "first", "n", "window", "score", "value", "payload", "media", "sequence_id", "offset", "label", "toxic", "_gone", "_id", "blob", "cid", "root"]


def docs_of(spark, rows=DOCS):
    df = spark.createDataFrame([(i, t, None, "s", None if t is None else len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit("extra") for c in EXTRA}).repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    return docs_of(spark).cache()


@pytest.fixture(scope="module")
def none(spark):
    return docs_of(spark, []).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, int(i in (1, 8))) for i in range(1, 16)] + [(None, 1, 1), (3, None, None), (4, 1, 0)], "doc_id long, quality int, toxic int")


def test_near_duplicates(docs):
    got = near_dedup.near_duplicates(docs).collect()
    assert len(got) == len(DOCS)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add((r.n_shingles, r.component_id, r.kept))
    assert by[2] == {(8, 1, False)} and by[14] == {(8, 1, False)} and by[1] == {(8, 1, True), (2, 1, True)}
    assert by[3] == {(0, 3, True)} and by[4] == {(0, 4, True)} and by[5] == {(0, 5, True)} and by[9] == {(1, 8, False)}
    assert {c for _, c, _ in by[7]} == {6} and by[None] == {(8, None, True), (0, None, True)}


def test_near_duplicates_in_round_two(spark):
    """A link between two classes that their buckets' center has no link with."""
    words = [f"w{i}" for i in range(400)]
    near = lambda step, n: " ".join(f"{w}_{i}" if i % step == 0 and i < n else w for i, w in enumerate(words))
    rows = [(i, near(20, 20 * i)) for i in range(12)]
    sets = {}
    for i, t in rows:
        w = t.split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs_of(spark, rows)).collect()}
    assert got == {i: find(i) for i in sets}


def test_near_duplicates_of_one_id_with_several_texts(spark):
    """Rows of one doc_id are one document: its texts' classes are one component, and unlike texts hide no link."""
    b, c = "red green blue white black brown pink grey", "far away over the hills and seas it lies"
    rows = [(5, A), (5, b), (3, b), (9, A), (7, c), (8, c), (8, "x " + b + " y z " + c), (20, A + " q"), (20, ""), (21, "t " + A), (21, "")]
    got = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in near_dedup.near_duplicates(docs_of(spark, rows)).collect()}
    assert got[5, 8] == got[5, 4] == (3, False) and got[3, 4] == (3, True) and got[9, 8] == (3, False)
    assert {v for (i, _), v in got.items() if i == 8} == {(7, False)} and got[7, 5] == (7, True)
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(f"{w}_{i}" if j % 20 == 0 and j < 20 * i else w for j, w in enumerate(words))) for i in range(12)]
    want = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs_of(spark, rows), sigmas=None).collect()}
    more = rows + [(i, " ".join(f"u{i}x{j}" for j in range(400))) for i in range(12)]
    got = near_dedup.near_duplicates(docs_of(spark, more)).collect()
    assert len(got) == 24 and {(r.doc_id, r.component_id) for r in got} == set(want.items())


def test_regular_words_are_no_copies(spark):
    """Texts whose words collide under polynomial hashes stay two documents; so do texts that share one hash of two."""
    from test_parts import thue_morse

    rows = []
    for n in (1 << 11, 1 << 12):
        x, y = thue_morse(n), thue_morse(n, "b", "a")
        rows += [x, y, x + " b c", y + " b c"]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs_of(spark, list(enumerate(rows)))).collect()}
    assert got == {i: (1, i, True) for i in range(8)}


def test_links_need_both_hashes(spark):
    from instdir.llm.common import Scratch

    scratch = Scratch(spark, "test")
    sets = scratch.save(spark.createDataFrame([(1, [5, 6], [7, 8]), (2, [5, 6], [7, 8]), (3, [5, 6], [1, 2])], "cid long, items array<long>, others array<long>"), "sets")
    pairs = spark.createDataFrame([(2, 1), (3, 1), (3, 2)], "a long, b long")
    assert [tuple(r) for r in near_dedup._confirmed(pairs, sets, scratch, "links", 75).collect()] == [(2, 1)]


@pytest.mark.parametrize("least", [None, 2])
def test_near_copies_go_row_by_row(spark, monkeypatch, least):
    """Each different (doc_id, text) is judged on its own; with ``least`` no side is broadcast and every key is dealt out."""
    if least:
        from instdir.llm import common

        monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
        monkeypatch.setattr(near_dedup, "Dealt", lambda counts, on, scratch, name: common.Dealt(counts, on, scratch, name, least))
        monkeypatch.setattr(near_dedup, "FEW_EDGES", 0)
    near = A + " thirteen"
    rows = [(1, A), (2, A), (2, "another text by far and wide it is"), (2, near), (None, A), (None, "nobody has this text but me alone"), (3, None), (None, None), (4, ""), (4, "")]
    rows += [(5, "five five five"), (5, "five five five"), (6, "five five FIVE"), (7, near + " x"), (8, LONG), (9, LONG + " more")]
    got = sorted(((r.doc_id, r.text) for r in near_dedup.drop_near_copies(docs_of(spark, rows)).collect()), key=str)
    want = [(1, A), (2, rows[2][1]), (None, rows[5][1]), (3, None), (None, None), (4, ""), (4, ""), (5, "five five five"), (8, LONG)]
    assert got == sorted(want, key=str)


def test_line_dedup(docs, none):
    out = drop_repeated_lines(docs)
    assert out.columns == docs.columns and out.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
    by = {(r.doc_id, r.n_chars): r.text for r in out.collect()}
    assert out.count() == len(DOCS) and drop_repeated_lines(none).count() == 0
    assert by[10, len(LINES + "\nown")] == LINES + "\nown" and by[11, 6] == "before"
    assert by[12, 6] == "\n" * 6 and by[3, None] is None and by[6, len(LONG)] == LONG
    assert [t for (i, _), t in by.items() if i == 15] == ["x\n"]


def test_contamination(spark, docs, none):
    items = spark.createDataFrame([("b", A), ("a", "TWO words"), (None, "two words"), ("c", None), ("d", ""), ("e", "never there at all")], "item_id string, text string")
    got = {}
    for r in contamination(docs, items).collect():
        got.setdefault(r.doc_id, []).append((r.n_words, r.n_hit, r.item_ids))
    assert sorted(got[1]) == [(6, 0, []), (12, 12, ["b"])] and got[2] == [(12, 12, ["b"])] * 2 and got[8] == [(2, 2, ["a"])]
    assert got[3] == [(0, 0, [])] and got[14] == [(12, 12, ["b"])] and len(got[None]) == 2
    assert contamination(none, items).count() == 0
    assert contamination(docs, items.limit(0)).filter("n_hit > 0").count() == 0
    assert contamination(docs, items.filter("item_id = 'e'")).agg(F.sum("n_hit")).first()[0] == 0


def test_windows_overlap_and_repeat(spark):
    body = "a b c d e f g h i j k"
    df = spark.createDataFrame([(1, f"z {body} y {body} a b c d e f g h i z"), (2, "a b c d e f g h i"), (3, "É" + body)], "doc_id long, text string")
    items = spark.createDataFrame([(7, body), (30, "b c d e f g h i j k q"), (4, "y a")], "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.item_ids) for r in contamination(df, items).collect()}
    assert got == {1: (34, 23, ["30", "4", "7"]), 2: (9, 0, []), 3: (11, 10, ["30", "7"])}


def test_packing(docs, none):
    out = pack_documents(docs, Q.vocabulary()).collect()
    assert len({(r.sequence_id, r.offset) for r in out}) == len(out) and pack_documents(none, Q.vocabulary()).count() == 0
    ends = {}
    for r in out:
        ends[r.sequence_id] = max(ends.get(r.sequence_id, 0), r.offset + r.length)
    assert sum(ends.values()) == sum(r.length for r in out) and max(ends.values()) <= 4096
    assert [(r.piece, r.length) for r in out if r.doc_id in (3, 4, 5)] == [(0, 1)] * 3 and sum(r.doc_id == 2 for r in out) == 2
    assert [r.piece for r in sorted(out, key=lambda r: r.piece) if r.doc_id == 6] == list(range(sum(r.doc_id == 6 for r in out)))


def test_media(spark, docs, none):
    images = media.texts_as_png(docs)
    out = media.decoded(images).collect()
    assert len(out) == len(DOCS) and media.decoded(media.texts_as_png(none)).count() == 0
    by = {r.doc_id: r for r in out}
    assert bytes(by[3].payload) == bytes(by[4].payload) == b"\xff" * 576 and by[3].n_bytes == 0 and by[8].hash == by[9].hash
    assert bytes(by[6].payload).rstrip(b"\xff") == LONG.encode()
    assert media.decoded(spark.createDataFrame([(None, "x")], "media binary, payload string")).first().payload is None


def test_toxicity(docs, none, labels):
    model = toxicity.fit(docs, labels)
    out = toxicity.score(docs, model).collect()
    assert len(out) == len(DOCS) and all(0 <= r.score <= 1 for r in out)
    assert len({r.score for r in out if r.doc_id in (3, 4, 5)}) == 1 and len({r.score for r in out if r.doc_id in (2, None)}) <= 2
    assert toxicity.score(none, model).count() == 0
    assert all(r.score == 0 for r in toxicity.score(docs, toxicity.fit(docs, labels.limit(0))).collect())
    assert toxicity.fit(none, labels).weights.any() == False  # noqa: E712
    kept = toxicity.keep_clean(docs, model)
    assert kept.dtypes == docs.dtypes and kept.count() == sum(r.score < 0.3 for r in out) and toxicity.keep_clean(none, model).count() == 0


def test_quality(docs, none, labels):
    feats = quality.features(docs)
    for marks, share in ((labels, None), (labels.filter("quality = 1"), 1.0), (labels.limit(0), 0.5)):
        out = quality.score(feats, quality.fit(feats, marks)).collect()
        assert len(out) == len(DOCS) and all(0 <= r.score <= 1 for r in out)
        assert share is None or {r.score for r in out} == {share}
        assert len({r.score for r in out if r.doc_id in (3, 4)}) == 1
    assert quality.score(quality.features(none), quality.fit(quality.features(none), labels)).count() == 0


def test_secret_scan(docs, none, tmp_path):
    assert secret_scan.scan(none, f"file://{tmp_path}/a").count() == 0
    out = secret_scan.scan(docs, f"file://{tmp_path}/a").collect()
    assert len(out) == len(DOCS) and not any(r.findings for r in out)


def test_urls(spark):
    df = spark.createDataFrame([(1, None), (None, "x://a.net/b"), (2, ""), (2, ""), (3, "x" * 50_000), (4, "http://é.example.org/fr/")], "page_id long, url string").withColumns({c: F.lit(1) for c in ("host", "path", "rule", "key", "score")})
    out = url_filter.judge_urls(df, Q.URL_RULES).collect()
    assert len(out) == 6 and {r.verdict for r in out} <= {"allow", "block"} and url_filter.judge_urls(df.limit(0), Q.URL_RULES).count() == 0
    assert next(r for r in out if r.page_id == 1).score == 0 and next(r for r in out if r.page_id == 4)["rule"] == "org/fr/"


def test_warc_of_no_pages(spark, tmp_path):
    df = spark.createDataFrame([], "page_id long, url string, html string, digest string")
    warc.write_warc(df, f"file://{tmp_path}/w")
    assert warc.assemble(warc.read_warc(spark, f"file://{tmp_path}/w")).count() == 0


def test_stages_over_no_rows(spark, none, labels, tmp_path):
    import corpus_pipeline as pipeline

    folder = f"file://{tmp_path}"
    labels.write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, A)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    for name, stage in pipeline.STAGES:
        out = stage(spark, none, folder)
        assert out.count() == 0 and (name == "packing" or out.columns == none.columns)


def test_shuffled_sides_give_the_same(spark, docs, labels, monkeypatch):
    """No side is broadcast and every frequent key is dealt out: results are those of broadcasts."""
    from instdir.llm import common

    items = spark.createDataFrame([("b", A), ("a", "TWO words"), ("c", "two words")], "item_id string, text string")

    def results():
        lines = sorted((str(r.doc_id), str(r.text)[:50], str(r.n_chars)) for r in drop_repeated_lines(docs).collect())
        hits = sorted((str(r.doc_id), r.n_words, r.n_hit, tuple(r.item_ids)) for r in contamination(docs, items).collect())
        feats = quality.features(docs)
        scores = sorted((str(r.doc_id), round(r.score, 9)) for r in quality.score(feats, quality.fit(feats, labels)).collect())
        toxic = sorted((str(r.doc_id), round(r.score, 6)) for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect())
        copies = sorted((str(r.doc_id), str(r.text)[:50]) for r in near_dedup.drop_near_copies(docs).collect())
        return lines, hits, scores, toxic, copies

    broadcast = results()
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(common.Dealt.__init__, "__defaults__", (2,))
    assert results() == broadcast


ODD_NAMES = ["meta.lang", "a`b", "a.b.c", " spaced, name"]


def test_columns_with_dots_and_backticks(spark, docs, labels):
    """Every stage keeps them, and every operator takes tables that have them."""
    odd = docs.select("*", *[F.struct(F.lit(n).alias("in.ner")).alias(n) for n in ODD_NAMES])
    items = spark.createDataFrame([("b", A)], "item_id string, text string").withColumn("x.y", F.lit(1))
    labels = labels.withColumn("x.y", F.lit(1))
    hits = contamination(odd, items).filter("n_hit > 0").select("doc_id", F.col("text_h").alias("h"))
    kept = [
        (drop_repeated_lines(odd), drop_repeated_lines(docs)),
        (near_dedup.drop_near_copies(odd), near_dedup.drop_near_copies(docs)),
        (toxicity.keep_clean(odd, toxicity.fit(odd, labels)), toxicity.keep_clean(docs, toxicity.fit(docs, labels))),
        (without_rows(odd, hits, Scratch(spark, "odd"), "gone"), without_rows(docs, hits, Scratch(spark, "odd"), "gone")),
    ]
    told = lambda df: sorted((str(r.doc_id), str(r.text)[:60]) for r in df.select("doc_id", "text").collect())
    for with_names, plain in kept:
        assert with_names.columns == odd.columns and told(with_names) == told(plain)
        assert {r[n]["in.ner"] for r in with_names.collect() for n in ODD_NAMES} == set(ODD_NAMES)
    assert pack_documents(odd, Q.vocabulary()).count() == pack_documents(docs, Q.vocabulary()).count()
    feats = quality.features(odd)
    assert quality.score(feats, quality.fit(feats, labels)).count() == len(DOCS)


def test_five_megabytes_of_alternating_lines(spark):
    """Every second line is in a repeated window: ranges are half as many as lines, and time grows with the lines."""
    n = 40_000
    shared = [f"shared {i} {'x' * 50}" for i in range(3 * n // 4)]
    text = "\n".join(line for i in range(n // 4) for line in (*shared[3 * i : 3 * i + 3], f"own {i} {'y' * 50}"))
    assert len(text) > 2_000_000
    rows = [(1, "\n".join(shared)), (2, text), (3, text.replace("own", "other"))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    began = time.time()
    got = {r.doc_id: r.text for r in drop_repeated_lines(df).collect()}
    assert time.time() - began < 60
    assert got[1] == rows[0][1] and got[2] == "\n".join(f"own {i} {'y' * 50}" for i in range(n // 4)) and got[3] == got[2].replace("own", "other")


@pytest.mark.parametrize("text", ["x://" + "a.b1" * 1_250_000, "eyJ" * 1_700_000, "eyJ" + "a" * 5_000_000 + ".b", "ghp_" * 1_250_000, "-----BEGIN " * 450_000, "password" * 600_000, "a:" * 2_500_000, "x://u:" + "p" * 5_000_000, "9" * 5_000_000 + "://"])
def test_five_megabytes_of_one_run_are_scanned_in_seconds(text):
    rules = [r for v in secret_scan.VERSIONS for r in secret_scan._compiled(v)]
    began = time.time()
    secret_scan.find(text, rules)
    assert time.time() - began < 15


def test_runs_tried_from_their_beginning_give_the_same_findings():
    plain = {"web": r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", "login": r"[a-z][a-z0-9+.-]*://[A-Za-z0-9._~%-]+:[A-Za-z0-9._~%-]+@"}
    rules, rng = secret_scan._compiled("wide-1"), random.Random(9)
    parts, met = ["eyJ", "eyJabcdefgh", ".", "abcdefgh", "-", "1", "http", "://", "u", ":", "p", "@", " ", "H", "a.b", "%"], 0
    for _ in range(20_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(25)))
        want = sorted((m.start(), m.end(), kind) for kind, p in plain.items() for m in re.finditer(p, text, re.A))
        got = sorted((a, b, kind) for a, _, b, kind in secret_scan.find(text, rules) if kind in plain)
        met += len(want)
        assert got == want, text
    assert met > 50


def test_broken_images(spark):
    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))

    def image(width=4, height=2, depth=8, colour=0, raw=None, head=None, end=b""):
        raw = b"\0" * (5 * height) if raw is None else raw
        head = struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, 0) if head is None else head
        return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", raw if raw[:1] == b"x" else zlib.compress(raw)) + chunk(b"IEND", b"") + end

    good = image()
    cases = {
        good: None,
        image(colour=5): "colour type 5", image(head=b"short"): "header", image(end=b"more"): "after the end", image(raw=b"\0" * 7): "fill",
        image(raw=b"\0" * 30): "fill", image(raw=b"\0" * 10 + b"\0"): "fill", image(raw=b"x broken"): "compressed", image(raw=b"\7" + b"\0" * 9): "filter",
        image(width=0, raw=b"\0\0"): "no rows", image(depth=16): "8 bits", good[:-6]: "cut short", good[:20]: "checksum", good[:34]: "cut short", b"GIF": "signature", b"": "signature",
        good.replace(b"IDAT", b"IDAX"): "checksum",
    }
    for data, fault in cases.items():
        if fault:
            with pytest.raises(ValueError, match=fault):
                media.decode_png(data)
    df = spark.createDataFrame([(i, bytearray(d)) for i, d in enumerate(cases)] + [(99, None)], "i long, media binary").withColumn("x.y", F.lit(1))
    got = {r.i: r for r in media.decoded(df, broken="null").collect()}
    for i, fault in enumerate(cases.values()):
        assert (got[i].payload is None) == (got[i].hash is None) == bool(fault) and (fault or "") in (got[i].fault or "") and (got[i].fault is None) == (fault is None)
    assert got[99].payload is None and got[99].fault is None and media.decoded(df.filter("i = 0")).columns == ["i", "media", "x.y", "payload", "hash"]
