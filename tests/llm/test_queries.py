"""The registered queries over the smallest tables: against SQL where it can express them, else against brute force."""

import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import oracle
import pytest

from instdir.llm import queries as Q


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").toPandas()


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_same_as_sql(spark, sf_dir, name):
    oracle.same(spark, sf_dir, Q.QUERIES[name], Q.ORACLE_SQL[name])


def test_op1(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    got = Q.op1_warc_transactions(spark, sf_dir).toPandas().set_index("page_id")
    first = {}
    for i, h in sorted(zip(pages.page_id, pages.html)):
        first.setdefault(h, i)
    assert len(got) == len(pages) and set(got.n_requests) == set(got.n_metadata) == {1}
    for i, h in zip(pages.page_id, pages.html):
        data, r = (h or "").encode(), got.loc[i]
        assert (r.payload_bytes, r.payload_digest) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
        assert r.record_type == ("response" if first[h] == i else "revisit")


def test_op2(spark, sf_dir):
    from tokenizers import Tokenizer

    docs, got = table(spark, sf_dir, "documents"), Q.op2_linear_grouping(spark, sf_dir).toPandas()
    tok, want = Tokenizer.from_file(Q.vocabulary()), {}
    for i, text in zip(docs.doc_id, docs.text):
        ids = tok.encode(text or "", add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), 4096):
            part = np.array(ids[k : k + 4096], "<u4")
            want[i, k // 4096] = (k, len(part), zlib.crc32(part.tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got.itertuples()} == want and len(got) == len(want)
    got = got.sort_values(["sequence_id", "offset"])
    sums = got.groupby("sequence_id").length.cumsum()
    assert (sums - got.length == got.offset).all() and sums.max() <= 4096
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 4096) * 1.02 + 1


def test_op4(spark, sf_dir):
    docs, sets = table(spark, sf_dir, "documents"), {}
    up, low = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    for i, text in zip(docs.doc_id, docs.text):
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans(up, low)))
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    where, common, root = defaultdict(list), Counter(), {i: i for i in sets}
    for i, s in sets.items():
        for x in s:
            where[x].append(i)
    for ids in where.values():
        common.update((a, b) for k, a in enumerate(sorted(ids)) for b in sorted(ids)[k + 1 :])

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), n in common.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            a, b = sorted((find(a), find(b)))
            root[b] = a
    got = Q.op4_minhash_odd_sketches(spark, sf_dir).toPandas()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got.itertuples()} == {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}
    assert (~got.kept).any()


def test_op5(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").set_index("doc_id").text
    got = Q.op5_png_cosine(spark, sf_dir).toPandas()
    assert len(got) == len(docs)
    for r in got.itertuples():
        data = docs[r.doc_id].encode()
        full = data + b"\xff" * (max(1, -(-len(data) // 576)) * 576 - len(data))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-32:]))
    same = got.merge(docs.rename("text"), left_on="doc_id", right_index=True).groupby("text")
    assert (same.feature.nunique() == 1).all() and (same.media_sha256.nunique() == 1).all()


def _host_path(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    up, low = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return host.translate(str.maketrans(up, low)), re.match(r"[^?#]*", rest[len(host) :])[0]


def test_op6(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").set_index("page_id").url
    got = Q.op6_markov_ratio(spark, sf_dir).toPandas().set_index("page_id")
    right = n = 0
    for i, url in pages.items():
        host, path = _host_path(url)
        fit = []
        for verdict, rule in Q.URL_RULES:
            h, _, p = rule.partition("/")
            if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
                fit.append((len(rule), rule, verdict))
        r = got.loc[i]
        assert (r.host, r.path, r["rule"]) == (host, path, max(fit)[1] if fit else None)
        if fit:
            assert r.verdict == max(fit)[2]
            n, right = n + 1, right + ((r.score >= got[got["rule"].notna() & (got.verdict == "block")].score.mean()) == (r.verdict == "allow"))
    assert set(got.verdict) <= {"allow", "block"}
    ruled = got[got["rule"].notna()]
    assert ruled[ruled.verdict == "allow"].score.mean() > ruled[ruled.verdict == "block"].score.mean()


@pytest.mark.parametrize("name, label, of, least", [("op7_positive_unlabelled", "toxic", 4, 0.9), ("op10_regularised_qda", "quality", 5, 0.9)])
def test_held_out_accuracy(spark, name, label, of, least):
    sf_dir = "/root/testdata/sf0.01"
    got, labels = Q.QUERIES[name](spark, sf_dir).toPandas(), table(spark, sf_dir, "labels")
    left_out = {4: 2, 5: 0}[of]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % of == left_out) for r in got.itertuples())
    assert got.score.between(0, 1).all() and ((got.score >= 0.3) == (got.predicted == 1)).all()
    held = got[got.held_out].merge(labels, on="doc_id")
    assert (held.predicted == held[label]).mean() >= least


def test_op8(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    got = Q.op8_blob_ledger(spark, sf_dir).toPandas().set_index("doc_id")
    wide = [r"-----BEGIN [A-Z ]*PRIVATE KEY-----", r"gh[pousr]_[A-Za-z0-9]{36,}", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", r"[a-z][a-z0-9+.-]*://[A-Za-z0-9._~%-]+:[A-Za-z0-9._~%-]+@"]
    for i, text in zip(docs.doc_id, docs.text):
        found = [(m.start(), 0, m.end(), "assign") for m in re.finditer(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.A) if len(m[2]) >= 6]
        found += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        found += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
        base = ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found))
        for rank, (kind, pattern) in enumerate(zip(("key", "token", "web", "login"), wide)):
            found += [(m.start(), 3 + rank, m.end(), kind) for m in re.finditer(pattern, text, re.A)]
        spans = ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found))
        r = got.loc[i]
        assert (r.spans, r.base_sha256) == (spans, hashlib.sha256(base.encode()).hexdigest())
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(f[3] == k for f in found) for k in ("assign", "access", "hex")]
