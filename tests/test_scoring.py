import pytest
from pyspark.sql import functions as F

from instdir.operators.clean import classify
from instdir.operators.facets import relation_checks, totals
from instdir.operators.scoring import score_candidates
from instdir.rules import BANK_RULES, BANK_TYPES, DEFAULT_BANK_TYPE, ScoringRules, as_list
from instdir.sources.seeds import bank_seeds

# Names, sites and their known results.
CASES = [
    ("HDFC Bank", "https://www.hdfcbank.com", True, 95),
    ("ICICI Bank", "https://www.icicibank.com", True, 150),
    ("AU Small Finance Bank", "https://www.aubank.in", True, 95),
    ("State Bank of India", "https://www.onlinesbi.sbi", True, 95),
    ("HSBC India", "https://www.hsbc.co.in", True, 60),
    ("Fake Bank", "https://www.hotelparadise.com", False, 0),
    ("XYZ Bank", "https://www.steelworks.co.in", False, 0),
    ("City Union Bank", "https://www.cityunionbank.com", True, 120),
    ("Karur Vysya Bank", "https://www.kvb.co.in", True, 105),
    ("CSB Bank", "https://www.csb.co.in", True, 75),
    ("JP Morgan India", "https://www.jpmorgan.com/IN/en/about-us", True, 85),
    ("Barclays India", "https://home.barclays/india", False, 25),
]


def test_known_scores(spark):
    df = spark.createDataFrame([c[:2] for c in CASES], "name string, url string")
    got = {r.name: (r.is_valid, r.score) for r in score_candidates(df, BANK_RULES).collect()}
    assert got == {n: (v, s) for n, _, v, s in CASES}


def test_reasons_and_no_signal(spark):
    df = spark.createDataFrame([("HSBC India", "https://www.hsbc.co.in"), ("q", "x://y"), ("Fake", "http://shop.x"), ("", "")], "name string, url string")
    got = [r.reason for r in score_candidates(df, BANK_RULES).collect()]
    assert got == ["known bank domain", "no banking signals found", "non-banking domain detected", "no banking signals found"]


def test_initials_match_the_scheme(spark):
    df = spark.createDataFrame([("The Place", "http://zz")], "name string, url string")
    assert score_candidates(df, ScoringRules()).first().s_initials


def test_seeds(spark):
    seeds = classify(bank_seeds(spark), BANK_TYPES, DEFAULT_BANK_TYPE, "company_name")
    scored = score_candidates(seeds, BANK_RULES, "company_name", "website")
    assert {r.company_type: r["count"] for r in seeds.groupBy("company_type").count().collect()} == {"Private Bank": 24, "Small Finance Bank": 10, "Foreign Bank": 10, "PSU Bank": 6}
    assert [r.company_name for r in scored.filter("not is_valid").collect()] == ["Barclays India"]
    assert totals(seeds, "pan_india").first().asDict() == {"n_rows": 50, "n_files": 1, "n_flagged": 34}
    assert all(r.ok for r in relation_checks(seeds, 50, ["company_name", "website", "pan_india"]).collect())
    assert not relation_checks(seeds, 49, ["company_name"]).filter("check = 'rows'").first().ok


def test_rule_sets_from_tables(spark):
    assert as_list(spark.createDataFrame([("b",), ("a",), ("b",), (None,)], "v string")) == ["a", "b"]
    with pytest.raises(ValueError):
        as_list(spark.range(10_001).select(F.col("id").cast("string")))


def test_terms_of_every_number_mark_what_contains_one(spark):
    """100,000 terms by automaton and by grams, as by plain contains; short, empty and odd terms, repeated and null texts."""
    from instdir.operators.terms import TermSet

    many = [f"{(i * 2654435761) % 10**9:09d}"[: 5 + i % 5] for i in range(100_000)]
    texts = [f"http://{'ab' * (i % 7)}{(i * 97) % 10**6:06d}é日{i}/" for i in range(400)] + ["", "a", None, "日本", "x.y*z"] + ["same 12345"] * 50
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(3)
    for terms in (many, ["é日3", "x.y*", "本", "ab00", "", None], ["é日3", "x.y*", "本", "ab00", "nowhere", None], ["z"], [], [None], many[:5]):
        table = spark.createDataFrame([(t,) for t in terms], "`a.b` string")
        held = [t for t in terms if t is not None]
        want = {i: None if t is None and held else any(x in (t or "") for x in held) for i, t in enumerate(texts)}
        for way in (TermSet(table), TermSet(table, many=0), TermSet(table, few=0), TermSet(terms, few=0)):
            got = {r.i: r.hit for r in way.mark(df, F.col("t"), "hit").collect()}
            assert got == want, (terms[:5], way.few)
    assert TermSet(table).mark(df.filter("false"), F.col("t"), "hit").count() == 0 == TermSet(table, many=0).mark(df.filter("false"), F.col("t"), "hit").count()


def _plans(spark, since=0):
    """The plans of the session's actions after so many of them, as they ran at last."""
    done = spark._jsparkSession.sharedState().statusStore().executionsList()
    return [done.apply(i).physicalPlanDescription() for i in range(since, done.size())]


def test_terms_meet_without_broadcasts_by_file_size(spark, monkeypatch):
    """Rows of grams are a small part in files of what they are in memory: no side is broadcast that isn't counted small."""
    from instdir.llm import common
    from instdir.operators import terms

    # 600 rows have one text, 1,200 terms one gram, and a text meets 700 terms: keys that are dealt out.
    texts = ["http://a.example/same"] * 600 + [f"http://b{i % 40}.example/{i}" for i in range(900)] + [None] * 20 + [""] * 20 + ["xyzw" + "".join(f"-xyzw{i}" for i in range(700))]
    given = [f"xyzw{i}" for i in range(1200)] + ["/same", "b7.", "/42", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(5)
    want = {i: None if t is None else any(x in t for x in given if x) for i, t in enumerate(texts)}
    table = spark.createDataFrame([(t,) for t in given], "term string")
    monkeypatch.setattr(terms, "BROADCAST_ROWS", 0)
    for per_part in (10**9, common.PART_ROWS):
        monkeypatch.setattr(common.Dealt.__init__, "__defaults__", (per_part,))
        since = spark._jsparkSession.sharedState().statusStore().executionsList().size()
        out = terms.TermSet(table, many=0).mark(df, F.col("t"), "hit")
        assert {r.i: r.hit for r in out.collect()} == want
        plans = _plans(spark, since)
        assert any("SortMergeJoin" in p for p in plans)
        if per_part > common.PART_ROWS:  # then no key is dealt out, which would broadcast the dealt ones
            assert not any("BroadcastHashJoin" in p for p in plans)
        else:
            assert any("BroadcastHashJoin" in p for p in plans)
