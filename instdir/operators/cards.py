"""The display projection of a listing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import LISTING

PREVIEW = 3


def listing(df: DataFrame) -> DataFrame:
    """The columns of a directory that a listing shows."""
    return df.select(*LISTING)


def grouped(c: Column) -> Column:
    """A number with thousands separators and at most three decimals; null and 0 have no label."""
    return F.when(c != 0, F.call_function("format_number", c.cast("double"), F.lit("#,##0.###")))


def ticket_label(least: Column, most: Column) -> Column:
    """Only if both bounds are known."""
    plain = lambda c: F.call_function("format_number", c.cast("double"), F.lit("0.###"))
    return F.when(least.isNotNull() & most.isNotNull(), F.concat(F.lit("₹"), plain(least), F.lit("L - ₹"), plain(most), F.lit("L")))


def card(df: DataFrame) -> DataFrame:
    """What a card of the listing shows of each row."""
    shown = lambda c: F.nullif(F.col(c), F.lit(""))
    more = F.size("product_types") - PREVIEW
    return df.select(
        "id",
        "company_name",
        "company_type",
        shown("primary_product").alias("primary_product"),
        shown("hq_location").alias("hq_location"),
        F.nullif(F.col("established_year"), F.lit(0)).alias("established_year"),
        shown("website").alias("website"),
        grouped(F.col("aum_crores")).alias("size_label"),
        grouped(F.col("employee_count")).alias("employees_label"),
        ticket_label(F.col("ticket_size_min"), F.col("ticket_size_max")).alias("ticket_label"),
        F.slice("product_types", 1, PREVIEW).alias("preview"),
        F.when(more > 0, F.concat(F.lit("+"), more.cast("string"), F.lit(" more"))).alias("more"),
    )
