"""Candidates: cleaning, scenario, classification."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import classify_by_name, clean_name, pick_url, scenario

URL_COLUMNS = ("website", "validated_url", "raw_url")


def clean_candidates(df: DataFrame) -> DataFrame:
    """df with name, url and scenario; missing columns read as empty."""
    there = lambda c: F.col(c) if c in df.columns else F.lit("")
    out = df.withColumns({"name": clean_name(there("company_name")), "url": pick_url(*[there(c) for c in URL_COLUMNS])})
    return out.withColumn("scenario", scenario(F.col("name"), F.col("url")))


def drop_empty(df: DataFrame) -> DataFrame:
    """Rows with a name or a url."""
    return df.filter((F.col("name") != "") | (F.col("url") != ""))


def classify(df: DataFrame, rules: Sequence[tuple[str, Sequence[str]]], default: str, name: str = "name") -> DataFrame:
    return df.withColumn("company_type", classify_by_name(F.col(name), rules, default))
