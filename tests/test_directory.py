import json

import pytest
from pyspark.sql import functions as F

from instdir.operators import facets, search
from instdir.operators.cards import card
from instdir.operators.load import to_directory
from instdir.schemas import DIRECTORY, RECORDS
from instdir.sources.files import directory_rows

# Name, type, size, products, state, least and largest ticket.
ROWS = [
    ("121 Finance", "NBFC", 250, "MSME Loan,Working Capital,Invoice Discounting", "Rajasthan", 5, 200),
    ("4Fin Finance", "NBFC", 180, "MSME Loan,Working Capital,Business Loan", "Maharashtra", 10, 500),
    ("Bajaj Finance", "NBFC", 250000, "Personal Loan,Home Loan,Business Loan,Consumer Durable Loan", "Maharashtra", 1, 2500),
    ("Muthoot Finance", "NBFC", 60000, "Gold Loan,Personal Loan", "Kerala", 0.1, 50),
    ("Shriram Finance", "NBFC", 185000, "Vehicle Loan,MSME Loan,Personal Loan,Gold Loan", "Tamil Nadu", 1, 2000),
    ("State Bank of India", "PSU Bank", 4700000, "Home Loan,Personal Loan,Business Loan,Vehicle Loan,Education Loan", "Maharashtra", 1, 50000),
    ("Punjab National Bank", "PSU Bank", 1100000, "Home Loan,Personal Loan,Business Loan,Agriculture Loan", "Delhi", 1, 20000),
    ("Bank of Baroda", "PSU Bank", 1300000, "Home Loan,Personal Loan,Business Loan,MSME Loan", "Gujarat", 1, 25000),
    ("HDFC Bank", "Private Bank", 2100000, "Home Loan,Personal Loan,Business Loan,Vehicle Loan,Credit Card", "Maharashtra", 1, 100000),
    ("ICICI Bank", "Private Bank", 1900000, "Home Loan,Personal Loan,Business Loan,Vehicle Loan", "Maharashtra", 1, 75000),
    ("Axis Bank", "Private Bank", 1000000, "Home Loan,Personal Loan,Business Loan,MSME Loan", "Maharashtra", 1, 50000),
    ("Kotak Mahindra Bank", "Private Bank", 550000, "Home Loan,Personal Loan,Business Loan,Vehicle Loan", "Maharashtra", 1, 30000),
    ("Saraswat Co-operative Bank", "Cooperative Bank", 6500, "Home Loan,Personal Loan,Business Loan", "Maharashtra", 0.5, 500),
    ("TJSB Sahakari Bank", "Cooperative Bank", 4200, "Home Loan,Personal Loan,MSME Loan", "Maharashtra", 0.5, 200),
    ("LIC Housing Finance", "NBFC", 275000, "Home Loan,Loan Against Property", "Maharashtra", 5, 10000),
]


def directory(spark, rows):
    from decimal import Decimal

    def full(i, name, kind, size, products, state, low, high):
        money = lambda x: None if x is None else Decimal(str(x))
        listed = None if products is None else json.dumps(products.split(","))
        return (i, None, None, name, kind, money(size), listed, None, None, None, None, money(low), money(high), None, state, None, None, None)

    return directory_rows(spark, [full(i, *r) for i, r in enumerate(rows)])


@pytest.fixture(scope="module")
def dir15(spark):
    return directory(spark, ROWS).cache()


def names(df):
    return [r.company_name for r in df.collect()]


def test_facets(dir15):
    assert [r.value for r in facets.facet(dir15, "company_type").collect()] == ["Cooperative Bank", "NBFC", "PSU Bank", "Private Bank"]
    assert [r.value for r in facets.facet(dir15, "hq_state").collect()] == ["Delhi", "Gujarat", "Kerala", "Maharashtra", "Rajasthan", "Tamil Nadu"]
    assert facets.facet(dir15, "product_types").count() == 13


def test_bands_are_closed_at_both_ends(dir15):
    got = {r.band: r.n for r in search.ticket_bands(dir15).collect()}
    assert got == {"micro": 14, "small": 15, "medium": 15, "large": 12}
    assert "4Fin Finance" not in names(search.by_band(dir15, "micro"))
    assert search.by_band(dir15, "any other").count() == 15


def test_search(dir15):
    assert set(names(search.search(dir15, product="MSME Loan"))) == {"121 Finance", "4Fin Finance", "Shriram Finance", "Bank of Baroda", "Axis Bank", "TJSB Sahakari Bank"}
    assert names(search.search(dir15, "MSME Loan", "Maharashtra", "small", "NBFC")) == ["4Fin Finance"]
    assert search.search(dir15, "", None, "", None).count() == 15
    assert facets.result_count(search.search(dir15, region="Maharashtra")).first().n == 10
    assert search.search(dir15, product="msme loan").isEmpty()


def test_order(dir15):
    got = names(search.order_directory(dir15))
    assert got[:5] == ["State Bank of India", "HDFC Bank", "ICICI Bank", "Bank of Baroda", "Punjab National Bank"] and got[-2:] == ["121 Finance", "4Fin Finance"]


def test_cards(dir15):
    got = {r.company_name: r for r in card(dir15).collect()}
    assert {n for n, r in got.items() if r.more == "+2 more"} == {"State Bank of India", "HDFC Bank"}
    assert got["Muthoot Finance"].ticket_label == "₹0.1L - ₹50L" and got["Muthoot Finance"].more is None
    assert got["State Bank of India"].size_label == "4,700,000" and got["Bajaj Finance"].preview == ["Personal Loan", "Home Loan", "Business Loan"]


def test_missing_values(spark):
    rows = [("a", "t", None, None, "", None, None), ("b", "t", 0, "X", None, None, 7), ("c", "t", 5, "X", "R", 60, None)]
    df = directory(spark, rows)
    assert names(search.order_directory(df)) == ["c", "b", "a"]
    assert [names(search.by_band(df, b)) for b in ("micro", "small", "medium", "large")] == [["a", "b"], ["a", "b"], ["a", "c"], ["a", "c"]]
    assert names(search.by_product(df, "X")) == ["b", "c"] and [r.value for r in facets.facet(df, "hq_state").collect()] == ["R"]
    got = {r.company_name: r for r in card(df).collect()}
    assert got["b"].size_label is None and got["c"].ticket_label is None and got["a"].preview is None


def test_service_area_filter(spark):
    df = spark.createDataFrame([("1", True, []), ("2", False, ["Maharashtra", "Gujarat"]), ("3", False, ["Tamil Nadu", "Kerala"])], "company_name string, pan_india boolean, operating_states array<string>")
    assert [names(search.serves(df, s)) for s in ("Maharashtra", "Kerala", "Delhi")] == [["1", "2"], ["1", "3"], ["1"]]


def test_pushdown(spark, tmp_path, dir15):
    dir15.write.parquet(str(tmp_path / "d"))
    df = search.by_region(spark.read.parquet(str(tmp_path / "d")), "Delhi").select("company_name")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(hq_state,Delhi)" in plan and "ReadSchema: struct<company_name:string,hq_state:string>" in plan


def test_load(spark):
    base = {f.name: None for f in RECORDS} | {"company_name": "a", "company_type": "t", "website": "w", "aum_crores": 1.25, "extraction_status": "success", "product_types": ["x"]}
    bad, failed = base | {"company_name": None}, base | {"website": "v", "extraction_status": "failed"}
    df = spark.createDataFrame([base, base, bad, failed], RECORDS)
    rows, rejects = to_directory(df, "2024-01-01 00:00:00")
    assert [(f.name, f.dataType) for f in rows.schema] == [(f.name, f.dataType) for f in DIRECTORY]
    assert rows.count() == 3 and rejects.count() == 1
    only, _ = to_directory(df, "2024-01-01 00:00:00", only_success=True, unique=True)
    assert only.count() == 1 and str(only.first().aum_crores) == "1.2500"
    assert {r.id for r in rows.collect()} >= {only.first().id}


def test_institutions_that_share_an_id_are_all_there(spark):
    from instdir.operators.load import colliding_ids, load_directory, second_id

    rows = [(f"bank {i % 40}", "t", None if i % 3 else f"http://{i % 40}", float(i), "success") for i in range(200)]
    df = spark.createDataFrame(rows, "company_name string, company_type string, website string, aum_crores double, extraction_status string")
    for f in DIRECTORY:
        if f.name not in (*df.columns, "id", "created_at", "last_updated"):
            df = df.withColumn(f.name, F.lit(None).cast(f.dataType))
    names = df.select("company_name", "website").distinct().count()
    for first in (lambda: F.lit(7).cast("long"), lambda: F.pmod(second_id(), F.lit(5))):
        one, two = ({(r.company_name, r.website): r.id for r in to_directory(d, "2024-01-01 00:00:00", unique=True, first=first)[0].collect()} for d in (df, df.repartition(7)))
        assert one == two and len(one) == names == len(set(one.values())) and colliding_ids(df, first).count() >= 1
    assert colliding_ids(df).count() == 0


def test_faults_of_a_load(spark, tmp_path):
    from instdir.operators.load import load_directory

    rows = [("a", "t", 1.0, None), (None, None, 2.0, None), ("b", "t", 1e30, [("year", "x", "int")]), ("c", "t", None, [])]
    df = spark.createDataFrame(rows, "company_name string, company_type string, aum_crores double, lost array<struct<field:string,text:string,rule:string>>")
    for f in DIRECTORY:
        if f.name not in (*df.columns, "id", "created_at", "last_updated"):
            df = df.withColumn(f.name, F.lit(None).cast(f.dataType))
    loaded, faults = load_directory(df, str(tmp_path / "d"), "2024-01-01 00:00:00", rescued="lost")
    assert sorted(r.company_name for r in loaded.collect()) == ["a", "b", "c"] and loaded.columns == DIRECTORY.names
    got = sorted((r.company_name or "", r.field, r.text or "", r.rule, r.left_out) for r in faults.collect())
    assert got == [("", "company_name", "", "required", True), ("", "company_type", "", "required", True), ("b", "aum_crores", "1.0E30", "decimal(20,4)", False), ("b", "year", "x", "int", False)]
