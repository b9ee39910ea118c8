"""The batch from end to end: known institutions with the gate, candidates without it, both as one table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import clean, enrich, scoring
from ..rules import BANK_RULES, BANK_TYPES, DEFAULT_BANK_TYPE, INDIA, ScoringRules


def bank_requests(seeds: DataFrame, rules: ScoringRules = BANK_RULES, types: Sequence = BANK_TYPES, default: str = DEFAULT_BANK_TYPE) -> DataFrame:
    """Seeds (company_name, website, pan_india) typed by name, scored and gated, with their requests."""
    rows = clean.classify(clean.clean_candidates(seeds), types, default)
    return enrich.render_request(enrich.with_gate(scoring.score_candidates(rows, rules)))


def candidate_requests(candidates: DataFrame, company_type: str = "NBFC") -> DataFrame:
    """Candidates that aren't empty, of one type, active everywhere only by their answer, with their requests."""
    rows = clean.drop_empty(clean.clean_candidates(candidates))
    return enrich.render_request(enrich.without_gate(rows.withColumns({"company_type": F.lit(company_type), "pan_india": F.lit(False)})))


def all_records(banks: DataFrame, candidates: DataFrame, responses: DataFrame, on: str = "request_id", regions: Sequence[str] = INDIA) -> DataFrame:
    """The records of both kinds of requests, with their origin: bank or nbfc."""
    parts = [(banks, "bank"), (candidates, "nbfc")]
    rows = [enrich.build_records(df, responses, on, regions).select(on, "record.*").withColumn("origin", F.lit(name)) for df, name in parts]
    return rows[0].unionByName(rows[1])
