import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from instdir.operators.enrich import build_records, enrich, outcome, with_gate, without_gate
from instdir.schemas import RECORDS
from instdir.sources import files
from instdir.streaming.ingest import ingest_incremental, read_ingested


def test_files_with_other_columns_unite_by_name(spark, tmp_path):
    (tmp_path / "1.csv").write_bytes(b"company_name,website\r\nA,http://a\r\n")
    (tmp_path / "2.csv").write_text('website,company_name,extra\nhttp://b,B,x\nhttp://c,"C, ""quoted""\nand two lines",\n')
    (tmp_path / "3.csv").write_text("company_name,website\nD,\n")
    got = sorted(tuple(r) for r in files.read_candidates(spark, f"{tmp_path}/*.csv").select("company_name", "website", "extra").collect())
    assert got == [("A", "http://a", ""), ("B", "http://b", "x"), ('C, "quoted"\nand two lines', "http://c", ""), ("D", "", "")]
    assert files.read_candidates(spark, f"{tmp_path}/*.tsv") is None


def test_header_with_line_ends_and_a_long_one(spark, tmp_path):
    (tmp_path / "1.csv").write_text('"company_name","web\nsite"\nA,http://a\n')
    names = [f"column {i} {'x' * 40}" for i in range(3000)]
    (tmp_path / "2.csv").write_text(",".join(["company_name", *(f'"{n}"' for n in names)]) + "\n" + ",".join(["B"] * 3001) + "\n")
    (tmp_path / "3.csv").write_text("")
    (tmp_path / "4.csv").write_bytes("\ufeffcompany_name\r\nC\r\n".encode())
    groups = files.header_groups(spark, f"{tmp_path}/*.csv")
    assert sorted(map(len, groups)) == [1, 2, 3001]
    out = files.read_candidates(spark, f"{tmp_path}/*.csv")
    assert sorted((r.company_name, r["web\nsite"]) for r in out.select("company_name", "web\nsite").collect()) == [("A", "http://a"), ("B", ""), ("C", "")]


@pytest.mark.parametrize("share", [None, {"spark.sql.files.maxPartitionBytes": "200000", "spark.sql.files.openCostInBytes": "100"}])
def test_odd_file_names_and_headers(spark, tmp_path, monkeypatch, share):
    """Brackets, spaces, percent and braces in names; a repeated name (the last counts), one in another case, one that is missing; a long file. Also with several files a task."""
    if share:
        monkeypatch.setattr(files, "_ONE_FILE", share)
    (tmp_path / "a[1].csv").write_text("company_name,website\nA,http://a\n")
    (tmp_path / "b {x,y} 100%25.csv").write_text('"company_name","note","note",""\nB,first,last,none\n')
    (tmp_path / "c?*.csv").write_bytes(b'"company_name","two\r\nlines","Website"\r\nC,t,http://c\r\n')
    (tmp_path / "d.csv").write_text("Note,company_name,note\nupper,D,lower\n")
    (tmp_path / "e.csv").write_text("company_name,dot.ted,tick`ed\n" + "E,x,y\n" * 300_000)
    (tmp_path / "f.csv").write_text('"never closed,\nF\n')
    out = files.read_candidates(spark, f"{tmp_path}/[a-e]*.csv")
    assert sorted(c.lower() for c in out.columns) == sorted(["company_name", "website", "note", "two\nlines", "dot.ted", "tick`ed"])
    rows = out.select("company_name", "website", "note", F.col("`two\nlines`").alias("two"), F.col("`dot.ted`").alias("dot"), F.col("`tick``ed`").alias("tick")).distinct().collect()
    got = {r.company_name: tuple(r)[1:] for r in rows}
    assert got == {"A": ("http://a", "", "", "", ""), "B": ("", "last", "", "", ""), "C": ("http://c", "", "t", "", ""), "D": ("", "lower", "", "", ""), "E": ("", "", "", "x", "y")}
    assert out.count() == 300_004 and len(files.header_groups(spark, f"{tmp_path}/*.csv")) == 6
    assert files.read_candidates(spark, f"{tmp_path}/{files.escaped('a[1].csv')}").count() == 1


def test_records_round_trip(spark, tmp_path):
    row = ("a", "t", "w", 1.5, ["x", 'y "z", q'], "", "l", "s", [], True, 1999, None, None, 2.0, False, "", "e", "m", "success", "")
    df = spark.createDataFrame([row, ("b", *[None] * 19)], RECORDS)
    files.write_records(df, str(tmp_path / "out"))
    got = {r.company_name: tuple(r) for r in files.read_records(spark, str(tmp_path / "out")).collect()}
    assert got["a"] == row
    assert got["b"][1] == "" and got["b"][3] is None and got["b"][4] == [] and got["b"][14] is None


def test_contacts_are_appended(spark, tmp_path):
    df = spark.createDataFrame([("1", "e", "p")], "user_id string, email string, phone string")
    for _ in range(2):
        files.append_contacts(df, str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "c")).count() == 2


def test_a_batch_that_comes_again_replaces_itself(spark, tmp_path):
    df = spark.createDataFrame([("1", "e", "p"), ("2", None, "q")], "user_id string, email string, phone string")
    for batch, rows in (("a", df), ("b", df.limit(1)), ("a", df), ("b/c d=e", df), ("b", df.limit(1))):
        files.append_contacts(rows, str(tmp_path / "c"), batch)
    assert files.read_contacts(spark, str(tmp_path / "c")).count() == 5
    assert sorted(files.read_contacts(spark, str(tmp_path / "c")).columns) == ["email", "phone", "user_id"]


def test_what_does_not_cast_is_rescued(spark, tmp_path):
    (tmp_path / "r.csv").write_text(",".join(f.name for f in RECORDS) + "\n" + 'A,t,w,much,not a list,,l,s,"[""x""]",perhaps,1999,,1e400x,,true,,,m,success,\nB,t,w,1.5,[],,l,s,[],true,12,3,,,false,,,m,success,\n')
    got = {r.company_name: r for r in files.read_records(spark, str(tmp_path / "r.csv"), rescued="lost").collect()}
    assert [(f.field, f.text, f.rule) for f in got["A"].lost] == [("aum_crores", "much", "double"), ("product_types", "not a list", "array<string>"), ("pan_india", "perhaps", "boolean"), ("ticket_size_min", "1e400x", "double")]
    assert got["A"].aum_crores is None and got["A"].operating_states == ["x"] and got["B"].lost == []


def test_a_run_observed_scans_each_table_once(spark, sf_dir):
    from instdir.plans import proofs

    told, seen = proofs.observed_run(spark, sf_dir)
    plan = told._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 2
    told.write.format("noop").mode("overwrite").save()
    found = seen.get
    assert sum(v for k, v in found.items() if k.startswith("outcome_")) == found["n_rows"] == told.count() and found["n_files"] == 1
    tally = {r.outcome: r.n for r in proofs.QUERIES["run_tally"](spark, sf_dir).collect()}
    assert {k: v for k, v in ((o, found[f"outcome_{o}"]) for o in ("ok", "failed", "rejected", "skipped")) if v} == tally


def test_one_pass_over_the_screen(spark):
    from instdir.operators import facets, search

    df = spark.createDataFrame([(["b", "a", "b"], "x", None), (None, "", "t"), ([], None, "t"), (["b", None], "y", "u")], "product_types array<string>, hq_state string, company_type string")
    got = {(r.facet, r.value): r.n for r in facets.screen(df, ["product_types", "hq_state", "company_type"], search.matches(product="b")).collect()}
    assert got == {("product_types", "a"): 1, ("product_types", "b"): 2, ("hq_state", "x"): 1, ("hq_state", "y"): 1, ("company_type", "t"): 2, ("company_type", "u"): 1, ("result", ""): 2}
    empty = facets.screen(df.filter("false"), ["product_types"], search.matches(region="z")).collect()
    assert [(r.facet, r.value, r.n) for r in empty] == [("result", "", 0)]


def test_second_run_takes_new_files_alone(spark, tmp_path):
    src, sink, log = (str(tmp_path / x) for x in ("src", "sink", "log"))
    df = spark.range(3)
    df.write.mode("append").parquet(src)
    run = lambda: ingest_incremental(spark, src, df.schema, sink, log, lambda d: d.filter("id > 0"))
    run()
    run()
    assert spark.read.parquet(sink).count() == 2
    spark.range(10, 12).write.mode("append").parquet(src)
    run()
    assert spark.read.parquet(sink).count() == 4


def test_a_run_that_dies_keeps_its_batches(spark, tmp_path):
    """Ten files, two a batch, a failure in the middle: the second run reads only what wasn't committed, and no row is there twice."""
    src, sink, log = (str(tmp_path / x) for x in ("src", "sink", "log"))
    for i in range(10):
        spark.range(100 * i, 100 * i + 7).coalesce(1).write.mode("append").parquet(src)
    schema = spark.range(1).schema
    run = lambda t: ingest_incremental(spark, src, schema, sink, log, t, files_per_batch=2)
    assert read_ingested(spark, sink, schema).count() == 0
    with pytest.raises(StreamingQueryException):
        run(lambda d: d.select(F.when(F.col("id") == 503, F.raise_error(F.lit("broken")).cast("long")).otherwise(F.col("id")).alias("id")))
    kept = {r.id for r in read_ingested(spark, sink, schema).collect()}
    before = len(kept) // 14
    assert 0 < before < 5 and len(kept) == 14 * before
    done = run(lambda d: d)
    assert [b["rows"] for b in done] == [14] * (5 - before) and done[0]["batch"] == before
    ids = [r.id for r in read_ingested(spark, sink, schema).collect()]
    assert sorted(ids) == [100 * i + j for i in range(10) for j in range(7)]
    assert run(lambda d: d) == [] and ingest_incremental(spark, src, schema, sink, log + "2", bytes_per_batch=1)
    assert read_ingested(spark, sink, schema).count() == 140  # another checkpoint has its own folders


def _answer(body):
    return '{"candidates":[{"content":{"parts":[{"text":"%s"}]}}]}' % body.replace('"', '\\"')


def test_records_of_requests_and_answers(spark):
    requests = spark.createDataFrame(
        [("1", "A", "http://a", "t", True), ("2", "", "http://b", "t", False), ("3", "C", "", "t", True), ("4", "D", "http://d", "t", True), ("5", "", "", "t", False)],
        "request_id string, name string, url string, company_type string, pan_india boolean",
    )
    responses = spark.createDataFrame(
        [("1", 200, _answer('{"hq_city":"Pune","hq_state":"Goa","operating_states":["Goa"]}')), ("1", 500, ""), ("2", 200, _answer('{"company_name":"B","website":"http://bb"}')), ("3", 200, _answer("[1]"))],
        "request_id string, http_status int, envelope string",
    )
    out = build_records(without_gate(requests), responses).cache()
    got = {r.request_id: r.record for r in out.collect()}
    assert (got["1"].company_name, got["1"].hq_location, len(got["1"].operating_states), got["1"].pan_india) == ("A", "Pune, Goa", 36, True)
    assert (got["2"].company_name, got["2"].website, got["2"].extraction_status) == ("B", "http://bb", "success")
    assert (got["3"].extraction_status, got["3"].error, got["3"].operating_states, got["3"].pan_india) == ("failed", "no data returned", [], True)
    assert got["5"].company_name == "Unknown" and out.count() == 5
    assert {r.request_id: r.o for r in out.withColumn("o", outcome(out)).collect()} == {"1": "ok", "2": "ok", "3": "failed", "4": "failed", "5": "skipped"}
    scored = requests.withColumns({"is_valid": F.col("request_id") != "1", "score": F.lit(25), "reason": F.lit("why")})
    gated = {r.request_id: r.record for r in build_records(with_gate(scored), responses).collect()}
    assert gated["1"].error == "Bank validation failed (25/100): why" and gated["1"].pan_india and gated["1"].operating_states == []
    assert gated["2"].extraction_status == "success" and enrich(requests, responses).count() == 5


def test_the_good_answer_counts_in_every_order(spark):
    from itertools import permutations

    good, other = _answer('{"hq_city":"Pune"}'), _answer('{"hq_city":"Goa"}')
    fenced = '{"candidates":[{"content":{"parts":[{"text":"```json\\n{\\"hq_city\\":\\"Pune\\"}\\n```"}]}}]}'
    bad = [(100, "x"), (500, good), (200, "x"), (200, _answer("{}")), (200, _answer("[1]")), (200, ""), (200, None), (None, None)]
    rows, n = [], 0
    for a in bad:
        for b in bad:
            for answers in permutations([a, b, (200, fenced if n % 2 else good)]):
                rows += [(str(n), k, *x) for k, x in enumerate(answers)]
                n += 1
    rows += [("both", 1, 200, other), ("both", 2, 200, good), ("both", None, 200, other), ("none", 1, 100, "x"), ("none", 2, 500, good)]
    responses = spark.createDataFrame(rows, "request_id string, attempt int, http_status int, envelope string")
    requests = responses.select("request_id").distinct().unionByName(spark.createDataFrame([("unasked",)], "request_id string"))
    got = {r.request_id: r.answer and r.answer.hq_city for r in enrich(requests, responses).collect()}
    assert len(got) == n + 3 and {v for k, v in got.items() if k not in ("none", "unasked")} == {"Pune"}
    assert got["none"] is None and got["unasked"] is None
    twice = {r.request_id: r.text for r in enrich(requests, responses.unionByName(responses).drop("attempt")).collect()}
    assert twice["both"] == '{"hq_city":"Pune"}' and enrich(requests, responses.filter("false")).filter("answer is not null").count() == 0


def test_batch_of_seeds_and_candidates(spark):
    from instdir.plans import batch
    from instdir.sources.seeds import bank_seeds

    banks = batch.bank_requests(bank_seeds(spark))
    others = batch.candidate_requests(spark.createDataFrame([("N", "http://n"), ("", "")], "company_name string, website string"))
    ids = banks.unionByName(others, allowMissingColumns=True).filter("name in ('HDFC Bank', 'Barclays India', 'N')").select("request_id")
    answers = ids.withColumns({"http_status": F.lit(200), "envelope": F.lit(_answer('{"hq_city":"X"}'))})
    out = batch.all_records(banks, others, answers).cache()
    assert {r.origin: r["count"] for r in out.groupBy("origin").count().collect()} == {"bank": 50, "nbfc": 1}
    assert {r.company_name for r in out.filter("extraction_status = 'success'").collect()} == {"HDFC Bank", "N"}
    assert out.filter("company_name = 'Barclays India'").first().error.startswith("Bank validation failed (25/100)")
