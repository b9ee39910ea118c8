"""Contact quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REQUIRED, BAD_PHONE = "required", "phone"


def contact_error(email: Column, phone: Column) -> Column:
    """The first rule that fails: something is missing, or the phone's digits aren't ten from 6 to 9 on; null if none."""
    missing = (F.coalesce(email, F.lit("")) == "") | (F.coalesce(phone, F.lit("")) == "")
    digits = F.regexp_replace(phone, r"\D", "")
    return F.coalesce(F.when(missing, REQUIRED), F.when(~digits.rlike(r"^[6-9][0-9]{9}$"), BAD_PHONE))


def contact_rules(df: DataFrame) -> DataFrame:
    """df with error; the phone stays as it came."""
    return df.withColumn("error", contact_error(F.col("email"), F.col("phone")))
