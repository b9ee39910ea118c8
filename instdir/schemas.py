"""Shapes of the relations."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _D, _I, _B = T.StringType(), T.DoubleType(), T.IntegerType(), T.BooleanType()
_LIST = T.ArrayType(T.StringType())

#: Institutions known beforehand.
SEEDS = T.StructType([T.StructField("company_name", _S), T.StructField("website", _S), T.StructField("pan_india", _B)])

#: An enriched record, in the order of its CSV columns.
RECORDS = T.StructType(
    [
        T.StructField("company_name", _S),
        T.StructField("company_type", _S),
        T.StructField("website", _S),
        T.StructField("aum_crores", _D),
        T.StructField("product_types", _LIST),
        T.StructField("primary_product", _S),
        T.StructField("hq_location", _S),
        T.StructField("hq_state", _S),
        T.StructField("operating_states", _LIST),
        T.StructField("pan_india", _B),
        T.StructField("established_year", _I),
        T.StructField("employee_count", _I),
        T.StructField("ticket_size_min", _D),
        T.StructField("ticket_size_max", _D),
        T.StructField("has_subsidiaries", _B),
        T.StructField("phone", _S),
        T.StructField("email", _S),
        T.StructField("data_source", _S),
        T.StructField("extraction_status", _S),
        T.StructField("error", _S),
    ]
)

_MONEY = T.DecimalType(20, 4)

#: The directory table. Amounts are bounded decimals.
DIRECTORY = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("created_at", T.TimestampNTZType()),
        T.StructField("last_updated", T.TimestampNTZType()),
        T.StructField("company_name", _S, False),
        T.StructField("company_type", _S, False),
        T.StructField("aum_crores", _MONEY),
        T.StructField("product_types", _LIST),
        T.StructField("primary_product", _S),
        T.StructField("established_year", _I),
        T.StructField("hq_location", _S),
        T.StructField("employee_count", _I),
        T.StructField("ticket_size_min", _MONEY),
        T.StructField("ticket_size_max", _MONEY),
        T.StructField("has_subsidiaries", _B),
        T.StructField("hq_state", _S),
        T.StructField("website", _S),
        T.StructField("phone", _S),
        T.StructField("email", _S),
    ]
)

#: What a listing shows of a directory row.
LISTING = ("id", "company_name", "company_type", "aum_crores", "product_types", "primary_product", "established_year", "hq_location", "hq_state", "employee_count", "ticket_size_min", "ticket_size_max", "has_subsidiaries", "website")

CONTACTS = T.StructType([T.StructField("user_id", _S), T.StructField("email", _S), T.StructField("phone", _S)])
