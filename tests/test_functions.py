"""Scalar functions over one row each, with the cases that are easy to get wrong."""

import pytest
from pyspark.sql import functions as F

from instdir.functions import answers as A
from instdir.functions import text as X
from instdir.operators.contacts import contact_error
from instdir.rules import BANK_TYPES, DEFAULT_BANK_TYPE, INDIA


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).cast("string" if v is None or isinstance(v, str) else "boolean" if isinstance(v, bool) else "long").alias(k) for k, v in values.items()] or ["id"])
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize("text, want", [(None, ""), ("  a b\t\n", "a b"), ("", "")])
def test_clean_name(spark, text, want):
    assert one(spark, X.clean_name(F.col("t")), t=text) == want


@pytest.mark.parametrize("w, v, r, want", [("", "v", "r", "v"), (None, None, " r ", "r"), ("  ", "v", "r", ""), ("", "", None, ""), ("w", "v", "r", "w")])
def test_pick_url(spark, w, v, r, want):
    assert one(spark, X.pick_url(F.col("w"), F.col("v"), F.col("r")), w=w, v=v, r=r) == want


@pytest.mark.parametrize("name, url, want", [("a", "b", "both"), ("a", "", "name_only"), ("", "b", "url_only"), ("", "", None)])
def test_scenario(spark, name, url, want):
    assert one(spark, X.scenario(F.col("n"), F.col("u")), n=name, u=url) == want


@pytest.mark.parametrize("name, want", [("City Union Bank", "PSU Bank"), ("AU Small Finance Bank", "Small Finance Bank"), ("HSBC India", "Foreign Bank"), ("hsbc", "Private Bank"), ("Yes Bank", "Private Bank")])
def test_first_matching_rule(spark, name, want):
    assert one(spark, X.classify_by_name(F.col("n"), BANK_TYPES, DEFAULT_BANK_TYPE), n=name) == want


@pytest.mark.parametrize("url, want", [("https://www.A.com:80/x", "a.com:80"), ("http://https://b.c?q=1/2", "b.c?q=1"), ("", ""), ("mywww.x.in/y", "myx.in")])
def test_url_root(spark, url, want):
    assert one(spark, X.url_root(F.col("u")), u=url) == want


@pytest.mark.parametrize("city, state, want", [("Pune", "Maharashtra", "Pune, Maharashtra"), ("", "Kerala", "Kerala"), ("Pune", "", "Pune"), ("", "", ""), (None, "Goa", "Goa"), ("Pune ,", "Goa", "Pune ,, Goa")])
def test_hq_label(spark, city, state, want):
    assert one(spark, X.hq_label(F.col("c"), F.col("s")), c=city, s=state) == want


@pytest.mark.parametrize("text, want", [("```json\n{}\n```", "{}"), (" {} ", "{}"), ("a\n  ``` x\nb", "a\nb"), (None, None), ("```", "")])
def test_strip_fences(spark, text, want):
    assert one(spark, X.strip_fences(F.col("t")), t=text) == want


@pytest.mark.parametrize(
    "text, want",
    [("not json", False), ("{}", False), ("[1]", False), ('{"a":1}', True), ('{"a":1,"a":2}', False), ('{"a":NaN}', False), ('{"a":1} trailing', False), ('{"a":1} {"b":2}', True), (None, False), ('```json\n{"a":1}\n```', True)],
)
def test_parse_response(spark, text, want):
    """Duplicate keys, NaN and trailing text are no data; two objects in a row still pass."""
    assert one(spark, A.parse_response(F.col("t")).isNotNull(), t=text) is want


@pytest.mark.parametrize("status, body, want", [(200, '{"candidates":[{"content":{"parts":[{"text":" x "}]}}]}', "x"), (500, '{"candidates":[{"content":{"parts":[{"text":"x"}]}}]}', None), (200, "{}", None), (200, "no", None)])
def test_response_text(spark, status, body, want):
    assert one(spark, A.response_text(F.col("s"), F.col("b")), s=status, b=body) == want


def value(text):
    return F.try_variant_get(F.try_parse_json(F.lit(text)), "$.k", "variant")


def answer(spark, text, *columns):
    return A.read_answers(spark.createDataFrame([(text,)], "text string")).select(*columns).first()


@pytest.mark.parametrize(
    "text, want",
    [('{"k":"v"}', "v"), ('{"k":""}', "d"), ('{"k":null}', "d"), ('{"k":0}', "d"), ('{"k":false}', "d"), ('{"k":[]}', "d"), ('{"k":{}}', "d"), ("{}", "d"), ('{"k":7}', "7"), ('{"k":true}', "true"), ('{"k":"0"}', "0"), ('{"k":"false"}', "false")],
)
def test_falsy_values_take_the_default(spark, text, want):
    assert one(spark, A.text_or(A.truthy_text(value(text)), F.lit("d"))) == want


@pytest.mark.parametrize(
    "given, text, everywhere, size",
    [
        (True, '{"operating_states":["Goa"]}', True, 36), (False, '{"operating_states":["PAN_INDIA"]}', True, 36), (False, '{"operating_states":"PAN_INDIA"}', True, 36),
        (False, '{"operating_states":["Maharashtra","Gujarat"]}', False, 2), (False, '{"operating_states":["PAN_INDIA","X"]}', False, 2),
        (False, '{"operating_states":{"a":1}}', False, 0), (False, '{"operating_states":5}', False, 0), (False, '{"a":1}', False, 0), (None, '{"a":1}', False, 0),
    ],
)
def test_service_area(spark, given, text, everywhere, size):
    assert len(INDIA) == 36
    g = F.lit(given).cast("boolean")
    got = answer(spark, text, A.everywhere(g, F.col("answer")).alias("e"), A.service_area(g, F.col("answer"), INDIA).alias("s"))
    assert got.e is everywhere and len(got.s) == size


@pytest.mark.parametrize("text, want", [('{"a":null,"b":[],"c":"","d":false,"e":0,"f":{},"g":"x"}', 4), ("{}", 0), (None, 0)])
def test_filled_fields(spark, text, want):
    assert one(spark, A.filled_fields(F.try_parse_json(F.lit(text)))) == want


@pytest.mark.parametrize("text, want", [('{"k":true}', True), ('{"k":"true"}', False), ('{"k":"no"}', False), ("{}", False), ('{"k":1}', False)])
def test_flag(spark, text, want):
    assert one(spark, A.flag(value(text))) is want


@pytest.mark.parametrize("number, want", [('"12.5"', 12.5), ("3", 3.0), ('"much"', None), ("null", None), (None, None)])
def test_number(spark, number, want):
    text = '{"x":1}' if number is None else '{"aum_crores":%s}' % number
    assert answer(spark, text, "answer.aum_crores")[0] == want


def test_answers_are_read_once(spark):
    """A filter on an answer's fields doesn't repeat the parse, and no key is read more than once."""
    df = A.read_answers(spark.createDataFrame([('{"operating_states":["Goa"],"x":[]}',), ("[1]",), ("{}",), (None,)], "text string").withColumn("answer", F.lit("clash")))
    assert [r.answer is None for r in df.collect()] == [False, True, True, True] and df.first().answer.filled == 1
    wide = df.select(A.everywhere(F.lit(False), F.col("answer")).alias("pan_india"), A.service_area(F.lit(False), F.col("answer"), INDIA).alias("operating_states"))
    plan = wide.filter(F.col("pan_india") | F.array_contains("operating_states", "Goa"))._jdf.queryExecution().optimizedPlan().toString()
    keys = [*A.TEXTS, *A.NUMBERS, "product_types", "operating_states", "has_subsidiaries"]
    assert plan.lower().count("parsejson") + plan.count("parse_json") <= 1 and all(plan.count(f"$.{k}") <= 1 for k in keys) and len(plan) < 20_000


@pytest.mark.parametrize(
    "email, phone, want",
    [("e", "9876543210", None), ("e", "98765-43210", None), ("e", "+91 9876543210", "phone"), ("e", "5876543210", "phone"), ("e", "", "required"), ("", "9876543210", "required"), (None, None, "required"), ("e", "letters", "phone")],
)
def test_contact_rules(spark, email, phone, want):
    assert one(spark, contact_error(F.col("e"), F.col("p")), e=email, p=phone) == want
