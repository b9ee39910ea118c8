"""What no SQL holds: op7's scores recomputed word by word, op4's links of planted pairs near the limit counted."""

import math
import random
import re

import numpy as np

from pyspark.sql import functions as F

from instdir.llm import near_dedup, toxicity
from instdir.llm import queries as Q
from instdir.llm.text import hash_spans

SF_DIR = "/root/testdata/sf0.01"


def test_toxicity_scores_are_sums_over_distinct_words(spark):
    docs, labels = (spark.read.parquet(f"{SF_DIR}/{t}.parquet") for t in ("documents", "labels"))
    model, bucket = toxicity.fit(docs, labels), {}
    assert np.count_nonzero(model.weights) > 10

    def score(text):
        low = re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())
        found = set()
        for word in re.findall(rb"[0-9a-z\x80-\xff]+", low):
            if word not in bucket:
                bucket[word] = int(hash_spans(np.frombuffer(word, np.uint8), np.array([0]), np.array([len(word)]))[0]) >> (64 - toxicity.LOG_BUCKETS)
            found.add(bucket[word])
        return 1 / (1 + math.exp(-(model.bias + sum(float(model.weights[b]) for b in found))))

    want = {r.doc_id: score(r.text) for r in docs.collect()}
    got = {r.doc_id: r.score for r in Q.op7_positive_unlabelled(spark, SF_DIR).collect()}
    assert got.keys() == want.keys() and max(abs(got[i] - want[i]) for i in want) < 1e-6
    assert len({round(x, 6) for x in got.values()}) > 20


def test_pairs_just_over_the_limit_are_linked(spark):
    """2,000 pairs of similarity 0.75 to 0.80, and as many just below it; the chance to lose one is told as 5e-6."""
    rng, rows, linked = random.Random(11), [], 0
    for pair in range(4000):
        n, over = rng.randint(120, 400), pair % 2 == 0
        words = [f"w{pair}x{i}" for i in range(n)]
        other, shingles = list(words), n - 4
        # a changed word takes five shingles: the most that leave 0.75, or one more
        most = shingles // 7 // 5
        for i in range(most if over else most + 1):
            other[4 + 5 * i + 1] = f"changed{pair}x{i}"
        a, b = ({tuple(w[j : j + 5]) for j in range(n - 4)} for w in (words, other))
        similar = len(a & b) / len(a | b)
        assert (similar >= 0.75) == over and 0.65 < similar < 0.86
        linked += over
        rows += [(2 * pair, " ".join(words)), (2 * pair + 1, " ".join(other))]
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()}
    assert linked == 2000 and all(got[2 * p + 1] == (2 * p if p % 2 == 0 else 2 * p + 1) and got[2 * p] == 2 * p for p in range(4000))


def _template_rows(n, seed):
    """Texts of one template and two of many blocks: none is similar enough to another, but each block is in several."""
    rng = random.Random(seed)
    template = [f"t{i}" for i in range(150)]
    blocks = [[f"b{k}x{i}" for i in range(50)] for k in range(n)]
    return [(i, " ".join([*template, *blocks[rng.randrange(n)], *blocks[rng.randrange(n)]])) for i in range(n)]


def test_pairs_tried_in_a_mixed_bucket_grow_about_linearly(spark, monkeypatch):
    """Without rare shingles they grow with the square; the links are those of all pairs either way."""
    tried, split = {}, near_dedup.met_by_rare_shingles
    for n in (500, 1000, 2000):

        def counted(rest, sets, percent, scratch, n=n):
            out = scratch.save(split(rest, sets, percent, scratch), "counted")
            pairs = lambda df: df.groupBy("h").agg(F.expr("count_if(comp <> largest) * count(*)").alias("p")).agg(F.sum("p")).first()[0] or 0
            tried[n] = pairs(rest), pairs(out)
            return out

        monkeypatch.setattr(near_dedup, "met_by_rare_shingles", counted)
        rows = _template_rows(n, n)
        rows += [(100_000 + i, text + " more") for i, text in rows[:50]]  # and near copies, which are linked
        got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
        assert all(got[100_000 + i] == got[i] for i in range(50))
        if n == 500:
            assert got == _components(rows)
    assert tried[2000][0] > 10 * tried[500][0] and tried[2000][1] < 4 * tried[500][1] and 10 * tried[2000][1] < tried[2000][0]


def _components(rows):
    sets = [{tuple(w[j : j + 5]) for j in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if 4 * len(sets[a] & sets[b]) >= 3 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    groups = {}
    for i, (doc_id, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(doc_id)
    return {d: min(g) for g in groups.values() for d in g}
