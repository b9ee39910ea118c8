"""Power-of-two packing, periodic runs and alignment: against brute force, over odd tables too."""

import hashlib
import random
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from instdir.llm import alignment, binary_packing, common, runs
from instdir.llm import queries as Q
from instdir.llm.byte_tokens import ByteTokenizer, PieceTokenizer
from instdir.llm.text import pieces

SQUARES = "tra la " * 40 + "end"
ODD = [(1, "one two three"), (1, "one two three"), (2, None), (3, ""), (4, " \n\t "), (5, SQUARES), (6, "a b　c ▁d"), (7, "<|endoftext|> x <|endoftext|>"), (None, SQUARES), (None, None), (8, "word " * 30_000), (9, "x" * 100_000)]
CLASH = ["ids", "start", "length", "row", "task", "nth", "number", "links", "pair", "n", "best", "rest", "runs", "period", "sequence_id", "meta.lang", "a`b"]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string").select("*", *[F.lit("extra").alias(c) for c in CLASH]).repartition(3)


@pytest.fixture(scope="module")
def none(odd):
    return odd.filter("false")


def _documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").toPandas()


def _tokenizer(special=True):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(Q.vocabulary("byte_bpe_50k.json"))
    t.encode_special_tokens = not special
    return t


# Tokens from remembered parts


def _texts(parts, n):
    rng = random.Random(5)
    return ["", " ", "  a", "a  b ", "it's  we'll", "x　 y", *("".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(n))]


def test_parts_of_bytes_give_the_ids_of_whole_texts():
    with open(Q.vocabulary("byte_bpe_50k.json"), encoding="utf-8") as file:
        own = ByteTokenizer(file.read())
    texts = _texts([" ", "  ", "a", "Word", "é", " ", "\n", "'s", "'", "1", ",", "日", " ", "<|endoftext|>", "\x1c", "​", "\x85"], 1500)
    for i, j, buf, off in pieces(pa.array(texts), 300):
        ids, at = own.encode(buf, off, 1)
        for r in range(j - i):
            assert ids[at[r] : at[r + 1]].tolist() == [*_tokenizer_ids(texts[i + r]), 1]


def _tokenizer_ids(text, held=[]):  # noqa: B006
    held or held.append(_tokenizer())
    return held[0].encode(text, add_special_tokens=False).ids


def test_parts_of_pieces_give_the_ids_of_whole_texts():
    with open(Q.vocabulary("piece_bpe_32k.model"), "rb") as file:
        own = PieceTokenizer(file.read())
    texts = _texts([" ", "  ", "   ", "a", "ing", "é", " ", "\n", "\t", "the", "1", ",", "日"], 1500)
    for i, j, buf, off in pieces(pa.array([" " + t for t in texts]), 300):
        ids, at = own.encode(buf, off, 0)
        for r in range(j - i):
            if texts[i + r]:
                assert ids[at[r] : at[r + 1] - 1].tolist() == own.pieces.encode(texts[i + r])


# Power-of-two decomposition


def test_decompose():
    sizes = np.array([1, 2047, 2048, 2049, 10_000, 3])
    row, start, length = binary_packing.decompose(sizes, 2048)
    for r, n in enumerate(sizes):
        mine, begin = length[row == r], start[row == r]
        assert mine.sum() == n and (begin == np.cumsum(mine) - mine).all() and (np.diff(mine) <= 0).all()
        assert all(x & (x - 1) == 0 for x in mine.tolist()) and len(mine) == n // 2048 + bin(n % 2048).count("1")


def _check_packed(rows, texts):
    """rows of one text's copies alike: whole, in order, right checksums; sequences of one piece, buckets without gaps."""
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    for i, copies in texts.items():
        want = Counter()
        for text in copies:
            ids, at = [*_tokenizer_ids(text or ""), 1], 0
            while at < len(ids):
                size = min(2048, 1 << (len(ids) - at).bit_length() - 1)
                want[at, size, zlib.crc32(np.array(ids[at : at + size], "<u4").tobytes()), len(ids)] += 1
                at += size
        assert Counter((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in by[i]) == want
    assert sorted(r.sequence_id for r in rows) == list(range(len(rows))) and {r.offset for r in rows} <= {0}
    for bucket in {r.bucket for r in rows}:
        mine = [r for r in rows if r.bucket == bucket]
        assert {r.length for r in mine} == {1 << bucket} and sorted(r.number for r in mine) == list(range(len(mine)))


def test_op11(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    _check_packed(Q.op11_power_of_two(spark, sf_dir).collect(), {i: [t] for i, t in zip(docs.doc_id, docs.text)})


@pytest.mark.parametrize("least", [200_000, 0])
def test_power_of_two_over_odd_rows(odd, none, monkeypatch, least):
    monkeypatch.setattr(common, "BROADCAST_ROWS", least)
    path = Q.vocabulary("byte_bpe_50k.json")
    out = binary_packing.pack_binary(odd, path)
    texts = {}
    for i, t in ODD:
        texts.setdefault(i, []).append(t)
    _check_packed(out.withColumn("ids_crc32", F.crc32("ids")).collect(), texts)
    assert all(len(r.ids) == 4 * r.length for r in out.collect())
    assert binary_packing.pack_binary(none, path).count() == 0


# Periodic runs


def _runs(w, least=6, times=4):
    out, n = [], len(w)
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            a, b = i, j + q
            if b - a >= max(least, times * q) and not any(w[a + p : b] == w[a : b - p] for p in range(1, q)):
                out.append((a, b, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def _told(w):
    found, drop = _runs(w), set()
    for a, b, q in found:
        drop.update(range(a + q, b))
    best = max(found, key=lambda r: ((r[1] - r[0]) / r[2], -r[0], -r[2]), default=None)
    hashed = "".join(f"{a},{b - a},{q}\n" for a, b, q in found)
    kept = " ".join(x for i, x in enumerate(w) if i not in drop)
    four = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
    return (len(found), *four, *(hashlib.sha256(x.encode()).hexdigest() for x in (hashed, kept)))


def _words(doc_id, text):
    w = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    return [x.decode() for x in w]


def test_catchers_find_every_run_however_words_are_appended():
    rng, met = random.Random(3), 0
    for _ in range(1500):
        n, k, w = rng.choice([0, 1, 5, 6, 7, 20, 60, 200]), rng.choice([1, 2, 3]), []
        while len(w) < n:
            u = [rng.randrange(k + 1) for _ in range(rng.randint(1, 12))]
            w += u * rng.randint(1, 9) + u[: rng.randrange(len(u))]
        if rng.random() < 0.5:
            w = [rng.randrange(k) for _ in range(n)]
        want, whole, single, i = _runs(w), runs.Catchers(), runs.Catchers(), 0
        whole.append(np.array(w, np.uint64))
        while i < len(w):
            size = rng.choice([1, 1, 2, 7, 50])
            single.append(np.array(w[i : i + size], np.uint64))
            i += size
        met += len(want)
        assert list(map(tuple, whole.runs().tolist())) == want == list(map(tuple, single.runs().tolist()))
    assert met > 1000


def test_runs_of_a_million_words():
    began, n = time.time(), 1_000_000
    for period in (1, 2, 77_777):
        c = runs.Catchers()
        c.append((np.arange(n) % period).astype(np.uint64))
        assert c.runs().tolist() == [[0, n, period]]
    assert time.time() - began < 60


def test_op12(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    got = {r.doc_id: tuple(r)[1:] for r in Q.op12_square_catching(spark, sf_dir).collect()}
    small = {i: t for i, t in zip(docs.doc_id, docs.text) if len((t or "").split()) <= 1500}
    assert len(got) == len(docs) and len(small) > 150
    for i, t in small.items():
        assert got[i] == _told(_words(i, t))
    assert sum(r[0] > 0 for r in got.values()) >= 5


def test_runs_over_odd_rows(odd, none):
    rows = runs.periodic_runs(odd, rewrite=False).collect()
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, []).append(r)
    assert len(rows) == len(ODD) and [r.n_runs for r in got[1]] == [0, 0]
    for i in (2, 3, 4):
        assert (got[i][0].n_words, got[i][0].n_runs, got[i][0].start, got[i][0].text) == (0, 0, None, "")
    assert (got[5][0].start, got[5][0].length, got[5][0].period, got[5][0].exponent_milli, got[5][0].text) == (0, 80, 2, 40_000, "tra la end")
    assert (got[8][0].length, got[8][0].period, got[8][0].text) == (30_000, 1, "word") and got[9][0].n_words == 1
    assert {r.n_runs for r in got[None]} == {0, 1} and runs.periodic_runs(none).count() == 0


# Alignment


def _plain_alignment(rows):
    """For each (id, text) what op13 is to tell, by sets of ends."""
    from sentencepiece import SentencePieceProcessor

    a_tok, b_tok = _tokenizer(special=False), SentencePieceProcessor(model_file=Q.vocabulary("piece_bpe_32k.model"))
    bytes_a, out, counts = alignment.bytes_of_a(a_tok), [], Counter()
    for i, text in rows:
        a, b = (a_tok.encode(" " + text, add_special_tokens=False).ids, b_tok.encode(text)) if text else ([], [])
        x, y = [bytes_a[t] for t in a], [bytes([int(p[3:5], 16)]) if b_tok.is_byte(t) else p.replace("▁", " ").encode() for t, p in ((t, b_tok.id_to_piece(t)) for t in b)]
        if not text or b"".join(x) != (" " + text).encode() or b"".join(y) != (" " + text).encode():
            out.append((i, 0, 0, [], []))
            continue
        ends_a, ends_b = (np.cumsum(list(map(len, z))).tolist() for z in (x, y))
        groups, links, p, q = [], [], 0, 0
        for end in sorted(set(ends_a) & set(ends_b)):
            u, v = ends_a.index(end, p) + 1, ends_b.index(end, q) + 1
            groups.append(",".join(map(str, a[p:u])) + "|" + ",".join(map(str, b[q:v])))
            links.append((a[u - 1], b[v - 1]))
            p, q = u, v
        counts.update(links)
        out.append((i, len(a), len(b), groups, links))
    most = {}
    for (_, y), n in counts.items():
        most[y] = max(most.get(y, 0), n)
    return Counter(
        (i, n, m, len(g), len(k), sum(counts[x] == most[x[1]] for x in k), sum(counts[x] for x in k), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for i, n, m, g, k in out
    )


_TOLD = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_align_skips_along_any_shift():
    rng = random.Random(7)
    for _ in range(500):
        n = rng.randint(1, 300)
        both = sorted({*rng.sample(range(1, 2000), min(n, 1500)), 2000})
        a, b = sorted({*both, *rng.sample(range(1, 2000), rng.randint(0, 40))}), sorted({*both, *rng.sample(range(1, 2000), rng.randint(0, 40))})
        common_ends = set(a) & set(b)
        last_a, last_b = alignment.align(a, b)
        assert [x for x, e in zip(a, last_a) if e] == [x for x, e in zip(b, last_b) if e] == sorted(common_ends)


def test_op13(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    got = Counter(tuple(r[c] for c in _TOLD) for r in Q.op13_diagonal_skipping(spark, sf_dir).collect())
    assert got == _plain_alignment(zip(docs.doc_id, docs.text))


@pytest.mark.parametrize("top", [200_000, 3, 0])
def test_alignment_over_odd_rows(odd, none, monkeypatch, top):
    """Also where only the commonest pairs, or none, go to the tasks."""
    monkeypatch.setattr(common, "BROADCAST_ROWS", top)
    paths = Q.vocabulary("byte_bpe_50k.json"), Q.vocabulary("piece_bpe_32k.model")
    got = Counter(tuple(r[c] for c in _TOLD) for r in alignment.align_documents(odd, *paths, top=top).collect())
    assert got == _plain_alignment(ODD) and alignment.align_documents(none, *paths, top=top).count() == 0
