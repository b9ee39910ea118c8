"""Requests, their answers, and the records made of both.

The answers are a table: whatever asks the outside service writes them, and the join here is the only shuffle. Numbers
that don't cast become null, answers that aren't a non-empty object give failure records, and every row is written.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import answers as A
from ..functions.text import hq_label
from ..rules import INDIA
from ..schemas import RECORDS
from .scoring import gate_error

#: A request's wording by scenario; {name}, {type} and {url} are filled in.
TEMPLATES = {
    "both": "Report the public facts of the {type} {name} at {url} as one JSON object.",
    "name_only": "Find the site of the {type} {name} and report its public facts as one JSON object.",
    "url_only": "Name the {type} at {url} and report its public facts as one JSON object.",
}
NO_DATA = "no data returned"


def _filled(template: str, values: dict[str, Column]) -> Column:
    parts = [values[p[1:-1]] if p.startswith("{") else F.lit(p) for p in re.split(r"(\{(?:name|type|url)\})", template) if p]
    return F.concat(*parts)


def render_request(df: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """df(name, url, company_type, scenario) with prompt and request_id, its SHA-256."""
    values = {"name": F.col("name"), "type": F.col("company_type"), "url": F.col("url")}
    prompt = F.lit(None).cast("string")
    for scenario, template in (templates or TEMPLATES).items():
        prompt = F.when(F.col("scenario") == scenario, _filled(template, values)).otherwise(prompt)
    return df.withColumn("prompt", prompt).withColumn("request_id", F.sha2(F.col("prompt").cast("binary"), 256))


def best_answers(responses: DataFrame, on: str = "request_id", attempt: str | None = "attempt") -> DataFrame:
    """One row a request, with text: of several answers the one that counts.

    An answer with data is before any without, one with text before one without any, then the latest attempt (a column that
    may be missing; null is the earliest), then the text itself, so the choice is the same on every run. What is compared is
    worked out before the shuffle from status, text and whether the text parses; no field of an answer is read for it, and
    only the text is shuffled. Tasks keep one answer a request, so a request that was tried very often is no hot key.
    """
    text = A.response_text(F.col("http_status"), F.col("envelope"))
    tried = F.col(attempt).cast("long") if attempt in responses.columns else F.lit(None).cast("long")
    told = responses.select(on, tried.alias("attempt"), F.explode(F.array(text)).alias("text"))  # the text is worked out once
    rank = F.struct(A.has_data(F.col("text")).alias("usable"), F.col("text").isNotNull().alias("answered"), "attempt", "text")
    return told.select(on, rank.alias("rank")).groupBy(on).agg(F.max("rank").alias("rank")).select(on, "rank.text")


def enrich(requests: DataFrame, responses: DataFrame, on: str = "request_id", attempt: str | None = "attempt", asked: Column | None = None) -> DataFrame:
    """requests with text and answer (its fields; null without data), from the best of each one's answers.

    asked tells which requests take an answer (all, if not given).
    """
    best = best_answers(responses, on, attempt).withColumnRenamed(on, "__on")
    same = F.col(on) == F.col("__on")
    return A.read_answers(requests.join(best, same if asked is None else same & asked, "left").drop("__on"))


def records(df: DataFrame, regions: Sequence[str] = INDIA, source: str = "model", no_data: str = NO_DATA) -> DataFrame:
    """df with the fields of a record in the column ``record``, in one projection.

    df has name, url, company_type, pan_india, gate_error (null: let through) and answer. Rows that the gate stopped or
    that have no answer become failure records with all defaults; their pan_india stays, their service area is empty.
    """
    v = F.col("answer")
    failed = F.col("gate_error").isNotNull() | v.isNull()
    none = F.array().cast("array<string>")

    def given(key: str) -> Column:
        return F.when(~failed, v[key])

    fields = {
        "company_name": A.text_or(given("company_name"), F.col("name"), F.lit("Unknown")),
        "company_type": F.col("company_type"),
        "website": F.when(~failed, A.text_or(v["website"], F.col("url"))).otherwise(F.col("url")),
        **{k: given(k) for k in A.NUMBERS},
        "product_types": F.coalesce(given("product_types"), none),
        "primary_product": A.text_or(given("primary_product")),
        "hq_location": F.when(~failed, hq_label(A.text_or(v["hq_city"]), A.text_or(v["hq_state"]))).otherwise(""),
        "hq_state": A.text_or(given("hq_state")),
        "operating_states": F.when(~failed, A.service_area(F.col("pan_india"), v, regions)).otherwise(none),
        "pan_india": F.coalesce("pan_india", F.lit(False)) | F.coalesce(given("marked"), F.lit(False)),
        "has_subsidiaries": F.coalesce(given("has_subsidiaries"), F.lit(False)),
        "phone": A.text_or(given("phone")),
        "email": A.text_or(given("email")),
        "data_source": F.lit(source),
        "extraction_status": F.when(failed, "failed").otherwise("success"),
        "error": F.coalesce("gate_error", F.when(v.isNull(), no_data), F.lit("")),
    }
    return df.withColumn("record", F.struct(*[fields[f.name].cast(f.dataType).alias(f.name) for f in RECORDS]))


def with_gate(scored: DataFrame) -> DataFrame:
    """scored with gate_error: why a row isn't asked about, null if it is."""
    return scored.withColumn("gate_error", F.when(~F.col("is_valid"), gate_error()))


def without_gate(df: DataFrame) -> DataFrame:
    return df.withColumn("gate_error", F.lit(None).cast("string"))


def build_records(requests: DataFrame, responses: DataFrame, on: str = "request_id", regions: Sequence[str] = INDIA, attempt: str | None = "attempt") -> DataFrame:
    """The records of requests (with gate_error) and their answers; requests that the gate stopped take none.

    The gate is part of the join's condition, so each table is scanned once.
    """
    return records(enrich(requests, responses, on, attempt, F.col("gate_error").isNull()), regions)


def outcome(df: DataFrame) -> Column:
    """ok, failed, rejected (the gate) or skipped (nothing to ask with) for each row of ``records``."""
    empty = (F.col("name") == "") & (F.col("url") == "")
    return F.when(empty, "skipped").when(F.col("gate_error").isNotNull(), "rejected").when(F.col("answer").isNull(), "failed").otherwise("ok")
