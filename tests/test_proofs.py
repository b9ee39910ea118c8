import oracle
import pytest

from instdir.plans.proofs import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_as_sql(spark, sf_dir, name):
    oracle.same(spark, sf_dir, QUERIES[name], ORACLE_SQL[name])


def test_entry(spark):
    import __spark_entry__ as e

    assert "company_name" in e.entry(spark).columns
    assert set(e.oracle_sql()) <= set(e.queries())


def test_whole_directory_in_order(spark, sf_dir):
    """Every row of the listing, in the order of its SQL, from the scanned table too."""
    sql = ORACLE_SQL["order_directory_all"]
    want = [r[0] for r in oracle.connect(sf_dir).execute(f"SELECT id FROM ({sql})").fetchall()]
    got = [r.id for r in QUERIES["order_directory_all"](spark, sf_dir).collect()]
    assert len(got) == spark.read.parquet(f"{sf_dir}/orders.parquet").count() > 100 and got == want
    assert got == [r.id for r in QUERIES["order_directory"](spark, sf_dir).collect()]


def test_flag_count_counts_files(spark, sf_dir, tmp_path):
    spark.read.parquet(f"{sf_dir}/pages.parquet").repartition(3).write.parquet(f"file://{tmp_path}/pages.parquet")
    one, three = (QUERIES["flag_count"](spark, d).first() for d in (sf_dir, f"file://{tmp_path}"))
    assert one.n_files == 1 and three.n_files == 3 and (one.n_rows, one.n_flagged) == (three.n_rows, three.n_flagged)


def test_run_report_is_the_same_for_tables_in_parts(spark, sf_dir, tmp_path):
    for name in ("pages", "events"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").repartition(3).write.parquet(f"file://{tmp_path}/{name}.parquet")
    got = QUERIES["run_report"](spark, f"file://{tmp_path}").toPandas()
    assert oracle.rows(got) == oracle.rows(oracle.connect(sf_dir).execute(ORACLE_SQL["run_report"]).df())
