"""Searches of the directory: order, filters, bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INFINITE = float("inf")
#: Bounds in lakhs, both ends in: 5 is micro and small.
BANDS = {"micro": (0.0, 5.0), "small": (5.0, 50.0), "medium": (50.0, 500.0), "large": (500.0, INFINITE)}


def band_bounds(name: str | None) -> tuple[float, float]:
    return BANDS.get(name or "", (0.0, INFINITE))


def order_directory(df: DataFrame) -> DataFrame:
    """Largest first, unknown sizes last, ties by id."""
    return df.orderBy(F.desc_nulls_last("aum_crores"), "id")


def overlaps(low: Column, high: Column) -> Column:
    """Whether a row's tickets meet [low, high]; a missing bound is open, and rows with neither meet all."""
    least, most = F.col("ticket_size_min").cast("double"), F.col("ticket_size_max").cast("double")
    return (least.isNull() & most.isNull()) | ((F.coalesce(least, F.lit(0.0)) <= high) & (F.coalesce(most, F.lit(INFINITE)) >= low))


def matches(product: str | None = None, region: str | None = None, band: str | None = None, company_type: str | None = None) -> Column:
    """Whether a row meets all filters given; empty and None are none."""
    met = F.lit(True)
    if product:
        met &= F.array_contains("product_types", product)
    if region:
        met &= F.col("hq_state") == region
    if band:
        low, high = band_bounds(band)
        met &= overlaps(F.lit(low), F.lit(high))
    if company_type:
        met &= F.col("company_type") == company_type
    return met


def by_product(df: DataFrame, product: str) -> DataFrame:
    return df.filter(F.array_contains("product_types", product))


def by_region(df: DataFrame, region: str) -> DataFrame:
    return df.filter(F.col("hq_state") == region)


def by_band(df: DataFrame, band: str) -> DataFrame:
    low, high = band_bounds(band)
    return df.filter(overlaps(F.lit(low), F.lit(high)))


def by_type(df: DataFrame, company_type: str) -> DataFrame:
    return df.filter(F.col("company_type") == company_type)


def search(df: DataFrame, product: str | None = None, region: str | None = None, band: str | None = None, company_type: str | None = None) -> DataFrame:
    """Rows that meet all filters given; empty and None are none. The order of df stays."""
    return df.filter(matches(product, region, band, company_type))


def serves(df: DataFrame, region: str) -> DataFrame:
    """Rows active everywhere or in the region."""
    return df.filter(F.col("pan_india") | F.array_contains("operating_states", region))


def ticket_bands(df: DataFrame) -> DataFrame:
    """How many rows meet each band: a theta join with the four bands."""
    bands = df.sparkSession.createDataFrame([(k, *v) for k, v in BANDS.items()], "band string, low double, high double")
    return df.join(F.broadcast(bands), overlaps(F.col("low"), F.col("high"))).groupBy("band").agg(F.count("*").alias("n"))
