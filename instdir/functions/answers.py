"""Column builders over semi-structured answers (variants).

The rule "x or default" of dynamic languages replaces every falsy JSON value: null, "", 0, false, [] and {}. Numbers that
don't cast become null. Answers that aren't a non-empty object are no data. A flag is true only as a JSON true.

``read_answers`` parses each answer once and reads each of its keys once, into a typed struct; what follows uses its fields.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import strip, strip_fences


def response_text(status: Column, envelope: Column, path: str = "$.candidates[0].content.parts[0].text") -> Column:
    """The nested text of an answer with status 200, stripped; else null."""
    return strip(F.when(status == 200, F.try_variant_get(F.try_parse_json(envelope), path, "string")))


def parse_response(text: Column) -> Column:
    """The variant of a text whose fences are off, if it is a non-empty object; else null.

    Duplicate keys and NaN are no JSON here. Text after the object is refused unless it ends in a brace too.
    """
    return _bound(strip_fences(text), lambda body: _bound(F.when(body.endswith("}"), F.try_parse_json(body)), lambda v: F.when(_has_data(v), v)))


def has_data(text: Column) -> Column:
    """Whether ``parse_response`` gives something; no key is read."""
    return F.coalesce(parse_response(text).isNotNull(), F.lit(False))


def _bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of the value, which is worked out once however often f names it."""
    return F.transform(F.array(value), f)[0]


def _has_data(v: Column) -> Column:
    kind = F.schema_of_variant(v)
    return kind.startswith("OBJECT") & (kind != "OBJECT<>")


def _get(v: Column, key: str, kind: str) -> Column:
    return F.try_variant_get(v, f"$.{key}", kind)


def truthy_text(value: Column) -> Column:
    """A variant's value as text if it is truthy, else null."""
    text, kind, full = F.try_variant_get(value, "$", "string"), F.schema_of_variant(value), F.to_json(value)
    return (
        F.when(kind == "STRING", F.nullif(text, F.lit("")))
        .when(kind == "BOOLEAN", F.when(text == "true", text))
        .when(kind.startswith("ARRAY") | kind.startswith("OBJECT"), F.when(~full.isin("[]", "{}"), full))
        .when(kind != "VOID", F.when(text.try_cast("double") != 0, text))
    )


def text_or(*choices: Column) -> Column:
    """The first choice that is neither null nor empty; empty if none."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in choices], F.lit(""))


def flag(value: Column) -> Column:
    """True for a JSON true alone; text is never a flag."""
    return F.coalesce(F.when(F.schema_of_variant(value) == "BOOLEAN", F.try_variant_get(value, "$", "boolean")), F.lit(False))


def text_list(value: Column) -> Column:
    """A list of texts; anything else is empty."""
    return F.coalesce(F.try_variant_get(value, "$", "array<string>"), F.array().cast("array<string>"))


def is_mark(value: Column, mark: str = "PAN_INDIA") -> Column:
    """Whether the value is the mark or a list of the mark alone."""
    as_text = F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))
    return F.coalesce(as_text == mark, F.lit(False)) | (text_list(value) == F.array(F.lit(mark)))


#: What is read of an answer: keys with texts, with numbers, with lists of texts.
TEXTS = ("company_name", "website", "primary_product", "hq_city", "hq_state", "phone", "email")
NUMBERS = {"aum_crores": "double", "established_year": "int", "employee_count": "int", "ticket_size_min": "double", "ticket_size_max": "double"}
#: What is told of a value that was made null: its field, its text, and the rule that it didn't meet.
FAULTS = "array<struct<field:string,text:string,rule:string>>"
#: The fields of an answer and their types; texts are null unless truthy. rescued has the faults of its numbers.
FIELDS = {
    **dict.fromkeys(TEXTS, "string"), **NUMBERS, "product_types": "array<string>", "operating_states": "array<string>", "marked": "boolean",
    "has_subsidiaries": "boolean", "filled": "int", "rescued": FAULTS,
}


def answer_type(keys: Sequence[str] = tuple(FIELDS)) -> str:
    return "struct<" + ", ".join(f"{k}: {t}" for k, t in FIELDS.items() if k in keys) + ">"


#: The column of an answer with all of its fields.
ANSWER = answer_type()


def _rescued(v: Column) -> Column:
    """The faults of numbers that are there and don't cast."""

    def fault(key: str, kind: str) -> Column:
        text = _get(v, key, "string")
        return F.when(text.isNotNull() & _get(v, key, kind).isNull(), F.struct(F.lit(key).alias("field"), text.alias("text"), F.lit(kind).alias("rule")))

    return F.array_compact(F.array(*[fault(k, t) for k, t in NUMBERS.items()]))


def _fields(v: Column, keys: Sequence[str]) -> Column:
    """A parsed answer's fields of these; each key is read once and its value bound by a lambda."""
    named = [k for k in TEXTS if k in keys]
    texts = F.transform(F.array(*[_get(v, k, "variant") for k in named]), truthy_text) if named else F.array().cast("array<string>")
    value = {k: (lambda x, i=i: x["texts"][i]) for i, k in enumerate(named)}
    value |= {k: (lambda _, k=k, t=t: _get(v, k, t)) for k, t in NUMBERS.items()}
    value["product_types"] = lambda _: _bound(_get(v, "product_types", "variant"), text_list)
    value |= {"operating_states": lambda x: x["area"]["list"], "marked": lambda x: x["area"]["marked"]}
    value["has_subsidiaries"] = lambda _: _bound(_get(v, "has_subsidiaries", "variant"), flag)
    value |= {"filled": lambda _: filled_fields(v), "rescued": lambda _: _rescued(v)}
    parts = [texts.alias("texts")]
    if {"operating_states", "marked"} & set(keys):
        parts.append(_bound(_get(v, "operating_states", "variant"), lambda x: F.struct(text_list(x).alias("list"), is_mark(x).alias("marked"))).alias("area"))
    return _bound(F.struct(*parts), lambda x: F.struct(*[value[k](x).alias(k) for k in FIELDS if k in keys]))


def read_answers(df: DataFrame, text: str = "text", keys: Sequence[str] = tuple(FIELDS)) -> DataFrame:
    """df with answer (see FIELDS; null without data), read from a column of texts; only these fields are read.

    The column comes out of a generator, so filters and projections above use its fields and never repeat the parse.
    """
    one = F.transform(F.array(parse_response(F.col(text))), lambda v: F.when(v.isNotNull(), _fields(v, keys)))
    return df.select(*[F.col(c) for c in df.columns if c != "answer"], F.explode(one.cast(f"array<{answer_type(keys)}>")).alias("answer"))


def everywhere(given: Column, answer: Column) -> Column:
    """Whether the flag is given, or the answer's service area is marked as everywhere."""
    return F.coalesce(given, F.lit(False)) | F.coalesce(answer["marked"], F.lit(False))


def service_area(given: Column, answer: Column, regions: Sequence[str]) -> Column:
    """All regions if everywhere, else the list of the answer."""
    own = F.coalesce(answer["operating_states"], F.array().cast("array<string>"))
    return F.when(everywhere(given, answer), F.array(*[F.lit(r) for r in regions])).otherwise(own)


def filled_fields(v: Column) -> Column:
    """Keys whose value isn't null, [] or ""; false, 0 and {} count."""
    fields = F.try_variant_get(v, "$", "map<string,variant>")
    told = F.map_filter(fields, lambda _, x: ~F.is_variant_null(x) & ~F.to_json(x).isin("[]", '""'))
    return F.coalesce(F.size(told), F.lit(0))


def json_array(c: Column) -> Column:
    """A list as JSON text, null as []."""
    return F.to_json(F.coalesce(c, F.array().cast("array<string>")))


def from_json_array(c: Column) -> Column:
    """A list from JSON text; what is none is empty."""
    return F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))
