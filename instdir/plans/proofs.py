"""Proof queries of the library's operators over the driver's tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import answers as A
from ..functions.text import hq_label, strip_fences, url_root
from ..operators import cards, clean, contacts, enrich, facets, load, scoring, search, terms
from ..rules import ScoringRules
from ..schemas import LISTING, RECORDS
from ..sources import files
from ..sources.scratch import fresh
from ..streaming.ingest import ingest_incremental, read_ingested
from . import adapters as ad
from . import batch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

PRODUCT, REGION, SEGMENT, LOAD_TS = "PROMO", "NATION_7", "BUILDING", "2024-01-01 00:00:00"


def proof(sql: str, *ctes: str, name: str | None = None):
    """Register a query under its function's name or another, with the SQL that must give the same.

    Integers that may be null are compared as doubles.
    """

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name or f.__name__] = f
        ORACLE_SQL[name or f.__name__] = (ad.with_sql(*ctes) if ctes else "") + sql
        return f

    return add


def joined(c: str | Column) -> Column:
    return F.coalesce(F.array_join(c, "|"), F.lit("-"))


def _joined(c: str) -> str:
    return f"coalesce(array_to_string({c}, '|'), '-')"


# Directory searches

_ROW = ("id", "company_name", "company_type", "aum_crores", "hq_state", "ticket_size_min", "ticket_size_max")
_ROW_SQL = ", ".join(_ROW) + f", {_joined('product_types')} AS products"
_OVERLAP = "(ticket_size_min IS NULL AND ticket_size_max IS NULL OR coalesce(ticket_size_min, 0) <= {high} AND coalesce(ticket_size_max, CAST('inf' AS DOUBLE)) >= {low})"


def _rows(df: DataFrame) -> DataFrame:
    return df.select(*_ROW, joined("product_types").alias("products"))


def _overlap(band: str) -> str:
    low, high = search.BANDS[band]
    return _OVERLAP.format(low=low, high="CAST('inf' AS DOUBLE)" if high == search.INFINITE else high)


_LISTED = [c for c in LISTING if c not in ("product_types", "established_year", "employee_count")]


@proof(
    f"""SELECT {", ".join(c for c in _LISTED if c != "has_subsidiaries")}, {_joined("product_types")} AS products, id % 2 = 0 AS has_subsidiaries,
    CAST(established_year AS DOUBLE) AS established_year, CAST(employee_count AS DOUBLE) AS employee_count FROM listing ORDER BY aum_crores DESC NULLS LAST, id""",
    "listing",
)
def order_directory(spark, sf_dir):
    """The whole directory: written as a table, scanned, what a listing shows of it, largest first."""
    path = fresh(spark, "directory")
    ad.listing(spark, sf_dir).withColumn("has_subsidiaries", F.col("id") % 2 == 0).withColumn("phone", F.lit("")).write.parquet(path)
    out = search.order_directory(cards.listing(files.scan_directory(spark, path)))
    return out.select(*_LISTED, joined("product_types").alias("products"), *[F.col(c).cast("double").alias(c) for c in ("established_year", "employee_count")])


@proof(f"SELECT {_ROW_SQL} FROM listing ORDER BY aum_crores DESC NULLS LAST, id", "listing")
def order_directory_all(spark, sf_dir):
    return _rows(search.order_directory(ad.listing(spark, sf_dir)))


@proof(f"SELECT {_ROW_SQL} FROM listing WHERE list_contains(product_types, '{PRODUCT}')", "listing")
def filter_product(spark, sf_dir):
    return _rows(search.by_product(ad.listing(spark, sf_dir), PRODUCT))


@proof(f"SELECT {_ROW_SQL} FROM listing WHERE hq_state = '{REGION}'", "listing")
def filter_region(spark, sf_dir):
    return _rows(search.by_region(ad.listing(spark, sf_dir), REGION))


@proof(f"SELECT {_ROW_SQL} FROM listing WHERE company_type = '{SEGMENT}'", "listing")
def filter_type(spark, sf_dir):
    return _rows(search.by_type(ad.listing(spark, sf_dir), SEGMENT))


def _band_proof(band: str) -> None:
    def query(spark, sf_dir):
        return _rows(search.by_band(ad.listing(spark, sf_dir), band))

    query.__name__ = f"ticket_{band}"
    proof(f"SELECT {_ROW_SQL} FROM listing WHERE {_overlap(band)}", "listing")(query)


for _band in search.BANDS:
    _band_proof(_band)


@proof(" UNION ALL ".join(f"SELECT '{b}' AS band, count(*) AS n FROM listing WHERE {_overlap(b)}" for b in search.BANDS), "listing")
def ticket_bands(spark, sf_dir):
    return search.ticket_bands(ad.listing(spark, sf_dir))


@proof(f"SELECT {_ROW_SQL} FROM listing WHERE list_contains(product_types, '{PRODUCT}') AND hq_state = '{REGION}' AND company_type = '{SEGMENT}' AND {_overlap('medium')}", "listing")
def search_all(spark, sf_dir):
    return _rows(search.order_directory(search.search(ad.listing(spark, sf_dir), PRODUCT, REGION, "medium", SEGMENT)))


@proof(f"SELECT count(*) AS n FROM listing WHERE hq_state = '{REGION}'", "listing")
def result_count(spark, sf_dir):
    return facets.result_count(search.search(ad.listing(spark, sf_dir), region=REGION))


@proof("SELECT DISTINCT unnest(product_types) AS value FROM listing ORDER BY value", "listing")
def facet_product(spark, sf_dir):
    return facets.facet(ad.listing(spark, sf_dir), "product_types")


@proof("SELECT DISTINCT hq_state AS value FROM listing WHERE hq_state <> '' ORDER BY value", "listing")
def facet_region(spark, sf_dir):
    return facets.facet(ad.listing(spark, sf_dir), "hq_state")


@proof("SELECT DISTINCT company_type AS value FROM listing WHERE company_type <> '' ORDER BY value", "listing")
def facet_type(spark, sf_dir):
    return facets.facet(ad.listing(spark, sf_dir), "company_type")


_FACETED = ["product_types", "hq_state", "company_type"]
_MET = f"list_contains(product_types, '{PRODUCT}') AND hq_state = '{REGION}' AND company_type = '{SEGMENT}' AND {_overlap('medium')}"


@proof(
    f"""SELECT 'product_types' AS facet, value, count(*) AS n FROM (SELECT unnest(list_distinct(product_types)) AS value FROM listing) GROUP BY value
    UNION ALL SELECT 'hq_state', hq_state, count(*) FROM listing WHERE hq_state <> '' GROUP BY hq_state
    UNION ALL SELECT 'company_type', company_type, count(*) FROM listing WHERE company_type <> '' GROUP BY company_type
    UNION ALL SELECT 'result', '', count(*) FROM listing WHERE {_MET}""",
    "listing",
)
def facet_screen(spark, sf_dir):
    """The three facets with counts, and the result count of a search, in one pass over the listing."""
    return facets.screen(ad.listing(spark, sf_dir), _FACETED, search.matches(PRODUCT, REGION, "medium", SEGMENT))


_GROUPED = r"CASE WHEN {0} <> 0 THEN regexp_replace(format('{{:,.3f}}', CAST({0} AS DOUBLE)), '\.?0+$', '') END".format
_PLAIN = r"regexp_replace(format('{{:.3f}}', {0}), '\.?0+$', '')".format


@proof(
    f"""SELECT id, company_name, company_type, nullif(primary_product, '') AS primary_product, nullif(hq_location, '') AS hq_location,
    CAST(nullif(established_year, 0) AS DOUBLE) AS established_year, nullif(website, '') AS website, {_GROUPED('aum_crores')} AS size_label, {_GROUPED('employee_count')} AS employees_label,
    CASE WHEN ticket_size_min IS NOT NULL AND ticket_size_max IS NOT NULL THEN '₹' || {_PLAIN('ticket_size_min')} || 'L - ₹' || {_PLAIN('ticket_size_max')} || 'L' END AS ticket_label,
    {_joined('product_types[1:3]')} AS preview, CASE WHEN len(product_types) > 3 THEN '+' || (len(product_types) - 3) || ' more' END AS more FROM listing""",
    "listing",
)
def card(spark, sf_dir):
    return cards.card(ad.listing(spark, sf_dir)).withColumns({"preview": joined("preview"), "established_year": F.col("established_year").cast("double")})


# Candidates

_CAND = ("candidates", "clean")


def _clean(spark, sf_dir, *more: Column) -> DataFrame:
    return clean.clean_candidates(ad.candidates(spark, sf_dir, *more))


def _typed(spark, sf_dir) -> DataFrame:
    return clean.classify(_clean(spark, sf_dir), ad.TYPES, ad.DEFAULT_TYPE)


def _scored(spark, sf_dir) -> DataFrame:
    return scoring.score_candidates(_typed(spark, sf_dir), ad.RULES)


@proof("SELECT row_number, name, url FROM clean", *_CAND)
def clean_candidates(spark, sf_dir):
    return _clean(spark, sf_dir).select("row_number", "name", "url")


@proof("SELECT row_number, scenario FROM clean", *_CAND)
def scenario(spark, sf_dir):
    return _clean(spark, sf_dir).select("row_number", "scenario")


@proof("SELECT coalesce(scenario, 'empty') AS scenario, count(*) AS n FROM clean GROUP BY 1", *_CAND)
def scenario_counts(spark, sf_dir):
    return facets.run_tally(_clean(spark, sf_dir).withColumn("scenario", F.coalesce("scenario", F.lit("empty"))), "scenario")


@proof("SELECT row_number FROM clean WHERE name <> '' OR url <> ''", *_CAND)
def drop_empty(spark, sf_dir):
    return clean.drop_empty(_clean(spark, sf_dir)).select("row_number")


@proof("SELECT row_number, name, company_type FROM typed", *_CAND, "typed")
def classify_type(spark, sf_dir):
    return _typed(spark, sf_dir).select("row_number", "name", "company_type")


def _prompt_sql() -> str:
    whens = []
    for s, t in enrich.TEMPLATES.items():
        text = "'" + t.replace("'", "''").replace("{name}", "' || name || '").replace("{type}", "' || company_type || '").replace("{url}", "' || url || '") + "'"
        whens.append(f"WHEN '{s}' THEN {text}")
    return f"CASE scenario {' '.join(whens)} END"


@proof(f"SELECT row_number, {_prompt_sql()} AS prompt, sha256({_prompt_sql()}) AS request_id FROM typed", *_CAND, "typed")
def render_request(spark, sf_dir):
    return enrich.render_request(_typed(spark, sf_dir)).select("row_number", "prompt", "request_id")


_SCORED = (*_CAND, "typed", "scored")
_SIGNALS = ["rejected", *[f"s_{s}" for s in scoring.SIGNALS]]


@proof("SELECT row_number, root FROM first", *_SCORED, name="url_root")
def url_root_of(spark, sf_dir):
    return _clean(spark, sf_dir).select("row_number", url_root(F.col("url")).alias("root"))


@proof(f"SELECT row_number, {', '.join(_SIGNALS)} FROM scored", *_SCORED)
def score_signals(spark, sf_dir):
    return scoring.score_signals(_clean(spark, sf_dir), ad.RULES).select("row_number", *_SIGNALS)


@proof("SELECT row_number, score, is_valid FROM scored", *_SCORED)
def score_total(spark, sf_dir):
    return _scored(spark, sf_dir).select("row_number", "score", "is_valid")


@proof("SELECT row_number, reason FROM scored", *_SCORED)
def score_reason(spark, sf_dir):
    return _scored(spark, sf_dir).select("row_number", "reason")


def _term_tables(spark, sf_dir) -> ScoringRules:
    """Rules whose sets are tables: names from two tables, the words of titles, hosts."""
    pages, host = ad.table(spark, sf_dir, "pages"), F.regexp_extract("url", r"^https?://([^/?#]+)", 1)
    words = pages.select(F.explode(F.split(F.lower(F.regexp_extract("html", r"<title>([^<]*)</title>", 1)), " ")).alias("term")).filter("length(term) > 5")
    names = ad.table(spark, sf_dir, "customer").select(F.lower("c_name").alias("term")).unionByName(ad.table(spark, sf_dir, "part").select(F.lower("p_name").alias("term")))
    hosts = pages.filter("page_id % 3 = 0").select(host.alias("term")).filter("length(term) > 0")
    return ScoringRules(reject_terms=names.unionByName(hosts.filter("term like 'a%'")), known_domains=hosts, keywords=names.unionByName(words), stopwords=ad.RULES.stopwords)


_TERM_SIGNALS = ["rejected", "s_known", "s_url_keyword", "s_name_keyword"]


def _term_proof(name: str, many: int):
    @proof(
        """, host AS (SELECT regexp_extract(url, '^https?://([^/?#]+)', 1) AS term FROM pages WHERE page_id % 3 = 0 AND length(regexp_extract(url, '^https?://([^/?#]+)', 1)) > 0),
    named AS (SELECT lower(c_name) AS term FROM customer UNION SELECT lower(p_name) FROM part),
    word AS (SELECT DISTINCT term FROM (SELECT unnest(string_split(lower(regexp_extract(html, '<title>([^<]*)</title>', 1)), ' ')) AS term FROM pages) WHERE length(term) > 5),
    kw AS (SELECT term FROM named UNION SELECT term FROM word), rej AS (SELECT term FROM named UNION SELECT term FROM host WHERE term LIKE 'a%'),
    u AS (SELECT DISTINCT u, root FROM low), m AS (SELECT DISTINCT m FROM low),
    ur AS (SELECT u, root, EXISTS (SELECT 1 FROM rej WHERE contains(u, term)) AS rejected, EXISTS (SELECT 1 FROM kw WHERE contains(u, term)) AS k, EXISTS (SELECT 1 FROM host WHERE contains(root, term)) AS d FROM u),
    mr AS (SELECT m, EXISTS (SELECT 1 FROM kw WHERE contains(m, term)) AS k FROM m)
    SELECT row_number, rejected, NOT rejected AND d AS s_known, NOT rejected AND ur.k AS s_url_keyword, NOT rejected AND mr.k AS s_name_keyword
    FROM low JOIN ur USING (u, root) JOIN mr USING (m)""",
        *_SCORED,
        name=name,
    )
    def query(spark, sf_dir):
        rows = scoring.score_signals(_clean(spark, sf_dir), _term_tables(spark, sf_dir), many=many)
        return rows.select("row_number", *_TERM_SIGNALS)


_term_proof("score_term_tables", terms.MANY)
_term_proof("score_terms_joined", 0)


_GATE_SQL = "CASE WHEN NOT is_valid THEN 'Bank validation failed (' || score || '/100): ' || reason END"


@proof(f"SELECT row_number, is_valid, {_GATE_SQL} AS gate_error FROM scored", *_SCORED)
def gate(spark, sf_dir):
    return enrich.with_gate(_scored(spark, sf_dir)).select("row_number", "is_valid", "gate_error")


# Answers

_PARSED = ("responses", "parsed")


def _texted(spark, sf_dir) -> DataFrame:
    r = ad.responses(spark, sf_dir)
    return r.withColumn("text", A.response_text(F.col("http_status"), F.col("envelope")))


def _parsed(spark, sf_dir, *keys: str) -> DataFrame:
    """The answers with these fields alone."""
    return A.read_answers(_texted(spark, sf_dir), keys=keys)


def _truthy_sql(key: str) -> str:
    x = f"v->>'$.{key}'"
    return (
        f"CASE json_type(v, '$.{key}') WHEN 'VARCHAR' THEN nullif({x}, '') WHEN 'BOOLEAN' THEN CASE WHEN {x} = 'true' THEN 'true' END WHEN 'NULL' THEN NULL "
        f"WHEN 'ARRAY' THEN nullif({x}, '[]') WHEN 'OBJECT' THEN nullif({x}, '{{}}') ELSE CASE WHEN TRY_CAST({x} AS DOUBLE) <> 0 THEN {x} END END"
    )


def _list_sql(key: str) -> str:
    return f"CASE WHEN json_type(v, '$.{key}') = 'ARRAY' THEN from_json(v->'$.{key}', '[\"VARCHAR\"]') ELSE CAST([] AS VARCHAR[]) END"


def _everywhere_sql(given: str) -> str:
    return f"coalesce({given}, FALSE) OR coalesce(json_type(v, '$.operating_states') = 'VARCHAR' AND v->>'$.operating_states' = 'PAN_INDIA', FALSE) OR coalesce({_list_sql('operating_states')} = ['PAN_INDIA'], FALSE)"


def _area_sql(given: str) -> str:
    return f"CASE WHEN {_everywhere_sql(given)} THEN {ad._list(ad.REGIONS)} ELSE {_list_sql('operating_states')} END"


_HQ_SQL = f"trim(coalesce({_truthy_sql('hq_city')}, '') || ', ' || coalesce({_truthy_sql('hq_state')}, ''), ', ')"


@proof("SELECT row_number, text FROM texted", *_PARSED)
def response_envelope(spark, sf_dir):
    return _texted(spark, sf_dir).select("row_number", "text")


@proof("SELECT row_number, plain FROM bare", *_PARSED, name="strip_fences")
def strip_fence_lines(spark, sf_dir):
    return _texted(spark, sf_dir).select("row_number", strip_fences(F.col("text")).alias("plain"))


@proof("SELECT row_number, v IS NOT NULL AS has_data FROM parsed", *_PARSED)
def parse_response(spark, sf_dir):
    return _parsed(spark, sf_dir, "company_name").select("row_number", F.col("answer").isNotNull().alias("has_data"))


@proof(f"SELECT row_number, coalesce({_truthy_sql('company_name')}, 'Unknown') AS company_name, coalesce({_truthy_sql('website')}, '') AS website FROM parsed", *_PARSED)
def resolve_identity(spark, sf_dir):
    v = F.col("answer")
    return _parsed(spark, sf_dir, "company_name", "website").select("row_number", A.text_or(v["company_name"], F.lit("Unknown")).alias("company_name"), A.text_or(v["website"]).alias("website"))


@proof(f"SELECT row_number, {_HQ_SQL} AS hq_location FROM parsed", *_PARSED, name="hq_label")
def hq_labels(spark, sf_dir):
    v = F.col("answer")
    return _parsed(spark, sf_dir, "hq_city", "hq_state").select("row_number", hq_label(A.text_or(v["hq_city"]), A.text_or(v["hq_state"])).alias("hq_location"))


_GIVEN = "row_number % 11 = 0"


def _areas(spark, sf_dir) -> DataFrame:
    v, given = F.col("answer"), F.expr(_GIVEN)
    return _parsed(spark, sf_dir, "operating_states", "marked").select("row_number", A.everywhere(given, v).alias("pan_india"), A.service_area(given, v, ad.REGIONS).alias("operating_states"))


@proof(f"SELECT row_number, {_everywhere_sql(_GIVEN)} AS pan_india, {_joined(_area_sql(_GIVEN))} AS operating_states FROM parsed", *_PARSED)
def service_area(spark, sf_dir):
    return _areas(spark, sf_dir).withColumn("operating_states", joined("operating_states"))


@proof(f"SELECT row_number FROM parsed WHERE {_everywhere_sql(_GIVEN)} OR list_contains({_area_sql(_GIVEN)}, 'North')", *_PARSED)
def service_area_filter(spark, sf_dir):
    return search.serves(_areas(spark, sf_dir), "North").select("row_number")


@proof(f"SELECT row_number, {_joined(_list_sql('product_types'))} AS product_types FROM parsed", *_PARSED)
def json_arrays(spark, sf_dir):
    text = A.json_array(F.col("answer.product_types"))
    return _parsed(spark, sf_dir, "product_types").select("row_number", joined(A.from_json_array(text)).alias("product_types"))


@proof(
    f"""SELECT row_number, coalesce({_truthy_sql('phone')}, '') AS phone, coalesce({_truthy_sql('email')}, '') AS email, TRY_CAST(v->>'$.aum_crores' AS DOUBLE) AS aum_crores,
    CAST(TRY_CAST(v->>'$.established_year' AS INTEGER) AS DOUBLE) AS established_year, TRY_CAST(v->>'$.ticket_size_min' AS DOUBLE) AS ticket_size_min,
    coalesce(json_type(v, '$.has_subsidiaries') = 'BOOLEAN' AND v->>'$.has_subsidiaries' = 'true', FALSE) AS has_subsidiaries FROM parsed""",
    *_PARSED,
)
def defaults(spark, sf_dir):
    v = F.col("answer")
    return _parsed(spark, sf_dir, "phone", "email", "aum_crores", "established_year", "ticket_size_min", "has_subsidiaries").select(
        "row_number",
        A.text_or(v["phone"]).alias("phone"),
        A.text_or(v["email"]).alias("email"),
        v["aum_crores"].alias("aum_crores"),
        v["established_year"].cast("double").alias("established_year"),
        v["ticket_size_min"].alias("ticket_size_min"),
        F.coalesce(v["has_subsidiaries"], F.lit(False)).alias("has_subsidiaries"),
    )


@proof(
    "SELECT row_number, CAST(coalesce(len(list_filter(json_keys(v), lambda k: NOT list_contains(['null', '[]', '\"\"'], CAST(json_extract(v, '$.\"' || k || '\"') AS VARCHAR)))), 0) AS INTEGER) AS filled FROM parsed", *_PARSED
)
def completeness(spark, sf_dir):
    return _parsed(spark, sf_dir, "filled").select("row_number", F.coalesce("answer.filled", F.lit(0)).alias("filled"))


# Requests with their answers

_BOTH = (*_SCORED, *_PARSED)
_OUT = [f.name for f in RECORDS if f.name not in ("product_types", "operating_states")]


def _record_sql(source: str, name: str, url: str, kind: str, pan: str, gate_error: str) -> str:
    """The records of a CTE that has v and these expressions."""
    failed = f"({gate_error} IS NOT NULL OR v IS NULL)"

    def good(value: str, otherwise: str) -> str:
        return f"CASE WHEN NOT {failed} THEN {value} ELSE {otherwise} END"

    text = lambda key: good(f"coalesce({_truthy_sql(key)}, '')", "''")
    num = lambda key, t: good(f"CAST(TRY_CAST(v->>'$.{key}' AS {t}) AS DOUBLE)", "NULL")
    return f"""SELECT row_number, {good(f"coalesce({_truthy_sql('company_name')}, nullif({name}, ''), 'Unknown')", f"coalesce(nullif({name}, ''), 'Unknown')")} AS company_name,
    {kind} AS company_type, {good(f"coalesce({_truthy_sql('website')}, {url})", url)} AS website, {num('aum_crores', 'DOUBLE')} AS aum_crores,
    {_joined(good(_list_sql('product_types'), 'CAST([] AS VARCHAR[])'))} AS products, {text('primary_product')} AS primary_product, {good(_HQ_SQL, "''")} AS hq_location,
    {text('hq_state')} AS hq_state, {_joined(good(_area_sql(pan), 'CAST([] AS VARCHAR[])'))} AS states, {good(_everywhere_sql(pan), pan)} AS pan_india,
    {num('established_year', 'INTEGER')} AS established_year, {num('employee_count', 'INTEGER')} AS employee_count, {num('ticket_size_min', 'DOUBLE')} AS ticket_size_min,
    {num('ticket_size_max', 'DOUBLE')} AS ticket_size_max, {good("coalesce(json_type(v, '$.has_subsidiaries') = 'BOOLEAN' AND v->>'$.has_subsidiaries' = 'true', FALSE)", 'FALSE')} AS has_subsidiaries,
    {text('phone')} AS phone, {text('email')} AS email, 'model' AS data_source, CASE WHEN {failed} THEN 'failed' ELSE 'success' END AS extraction_status,
    coalesce({gate_error}, CASE WHEN v IS NULL THEN '{enrich.NO_DATA}' END, '') AS error FROM {source}"""


_PAN = "row_number % 6 = 0"
_BANKS_SQL = _record_sql(f"(SELECT s.*, CASE WHEN is_valid THEN p.v END AS v, {_GATE_SQL} AS ge, s.{_PAN} AS pan FROM scored s LEFT JOIN parsed p USING (row_number) WHERE scenario = 'both')", "name", "url", "company_type", "pan", "ge")
_OTHERS_SQL = _record_sql("(SELECT s.*, p.v, CAST(NULL AS VARCHAR) AS ge FROM scored s LEFT JOIN parsed p USING (row_number) WHERE name <> '' OR url <> '')", "name", "url", "'NBFC'", "FALSE", "ge")


def _bank_requests(spark, sf_dir) -> DataFrame:
    """Named candidates with a url as known institutions."""
    seeds = ad.candidates(spark, sf_dir).withColumn("pan_india", F.expr(_PAN))
    return batch.bank_requests(seeds, ad.RULES, ad.TYPES, ad.DEFAULT_TYPE).filter("scenario = 'both'")


def _banks(spark, sf_dir) -> DataFrame:
    return enrich.build_records(_bank_requests(spark, sf_dir), ad.responses(spark, sf_dir), "row_number", ad.REGIONS)


def _others(spark, sf_dir) -> DataFrame:
    return enrich.build_records(batch.candidate_requests(ad.candidates(spark, sf_dir)), ad.responses(spark, sf_dir), "row_number", ad.REGIONS)


def _shown(df: DataFrame) -> DataFrame:
    ints = {c: F.col(c).cast("double") for c in ("established_year", "employee_count")}
    return df.withColumns(ints).select("row_number", *_OUT, joined("product_types").alias("products"), joined("operating_states").alias("states"))


@proof(f"SELECT * FROM ({_BANKS_SQL}) WHERE extraction_status = 'failed'", *_BOTH)
def failure_records(spark, sf_dir):
    return _shown(_banks(spark, sf_dir).select("row_number", "record.*")).filter("extraction_status = 'failed'")


@proof("SELECT c.row_number, p.plain IS NOT NULL AS answered, p.v IS NOT NULL AS has_data FROM clean c LEFT JOIN parsed p USING (row_number)", *_BOTH)
def enrich_join(spark, sf_dir):
    out = enrich.enrich(_clean(spark, sf_dir), ad.responses(spark, sf_dir), "row_number")
    return out.select("row_number", F.col("text").isNotNull().alias("answered"), F.col("answer").isNotNull().alias("has_data"))


@proof("SELECT c.row_number, p.text IS NOT NULL AS answered, p.v IS NOT NULL AS has_data, coalesce(sha256(p.text), '') AS told FROM clean c LEFT JOIN picked p USING (row_number)", *_BOTH, "picked")
def enrich_retries(spark, sf_dir):
    """Requests with three answers each: failed, empty, fenced, broken and good ones in every order."""
    out = enrich.enrich(_clean(spark, sf_dir), ad.retried(spark, sf_dir), "row_number")
    told = F.coalesce(F.sha2(F.col("text").cast("binary"), 256), F.lit("")).alias("told")
    return out.select("row_number", F.col("text").isNotNull().alias("answered"), F.col("answer").isNotNull().alias("has_data"), told)


@proof(f"SELECT 'bank' AS origin, * FROM ({_BANKS_SQL}) UNION ALL SELECT 'nbfc' AS origin, * FROM ({_OTHERS_SQL})", *_BOTH)
def pipeline_records(spark, sf_dir):
    banks, others = (_shown(f(spark, sf_dir).select("row_number", "record.*")).withColumn("origin", F.lit(name)) for f, name in ((_banks, "bank"), (_others, "nbfc")))
    return banks.unionByName(others)


@proof(
    """SELECT CASE WHEN name = '' AND url = '' THEN 'skipped' WHEN NOT is_valid THEN 'rejected' WHEN v IS NULL THEN 'failed' ELSE 'ok' END AS outcome, count(*) AS n
    FROM scored LEFT JOIN parsed USING (row_number) GROUP BY 1""",
    *_BOTH,
)
def run_tally(spark, sf_dir):
    rows = enrich.with_gate(_scored(spark, sf_dir).withColumn("pan_india", F.lit(False)))
    out = enrich.build_records(rows, ad.responses(spark, sf_dir), "row_number", ad.REGIONS)
    return facets.run_tally(out.withColumn("outcome", enrich.outcome(out)))


@proof(
    f"""SELECT 'n_rows' AS metric, count(*) AS n FROM clean UNION ALL SELECT 'n_files', 1 UNION ALL SELECT 'n_flagged', count(*) FROM clean WHERE {_PAN}
    UNION ALL SELECT 'required_company_name', 1 UNION ALL SELECT 'required_company_type', 1
    UNION ALL SELECT 'outcome_' || o.outcome, count(t.outcome) FROM (SELECT unnest(['ok', 'failed', 'rejected', 'skipped']) AS outcome) o LEFT JOIN
    (SELECT CASE WHEN name = '' AND url = '' THEN 'skipped' WHEN NOT is_valid THEN 'rejected' WHEN v IS NULL THEN 'failed' ELSE 'ok' END AS outcome FROM scored LEFT JOIN parsed USING (row_number)) t
    ON t.outcome = o.outcome GROUP BY o.outcome""",
    *_BOTH,
)
def run_report(spark, sf_dir):
    """What a run that writes its records finds on the way: rows, files, flagged rows, outcomes, checks.

    A table is one file of the run's input, in however many parts it is stored.
    """
    told, seen = observed_run(spark, sf_dir)
    told.write.parquet(fresh(spark, "run"))
    return spark.createDataFrame([(k, int(v)) for k, v in seen.get.items()], "metric string, n long")


def observed_run(spark, sf_dir):
    """The records of a run with their outcome, observed."""
    rows = clean.classify(_clean(spark, sf_dir, ad.input_of("pages").alias("file")), ad.TYPES, ad.DEFAULT_TYPE)
    rows = enrich.with_gate(scoring.score_candidates(rows, ad.RULES)).withColumn("pan_india", F.expr(_PAN))
    out = enrich.build_records(rows, ad.responses(spark, sf_dir), "row_number", ad.REGIONS)
    told = out.select("record.*", enrich.outcome(out).alias("outcome"), F.col("pan_india").alias("given"), "file")
    told, seen = facets.observed(told, F.col("outcome"), "given", F.col("file"), ["company_name", "company_type"])
    return told.drop("given", "file"), seen


@proof(f"SELECT count(*) AS n_rows, CAST(1 AS BIGINT) AS n_files, count(*) FILTER (WHERE {_PAN}) AS n_flagged FROM clean", *_CAND)
def flag_count(spark, sf_dir):
    rows = _clean(spark, sf_dir, F.col("_metadata.file_path").alias("file"))
    return facets.totals(rows.withColumn("pan_india", F.expr(_PAN)), "pan_india", F.col("file"))


@proof(
    "SELECT 'rows' AS \"check\", (SELECT count(*) FROM listing) = (SELECT count(*) FROM orders) AS ok "
    + " ".join(f"UNION ALL SELECT '{c}', (SELECT bool_and({c} IS NOT NULL) FROM listing)" for c in ("id", "company_name", "product_types")),
    "listing",
)
def relation_checks(spark, sf_dir):
    return facets.relation_checks(ad.listing(spark, sf_dir), ad.table(spark, sf_dir, "orders").count(), ["id", "company_name", "product_types"])


_LOADED = ["company_name", "company_type", "primary_product", "established_year", "hq_location", "employee_count", "has_subsidiaries", "hq_state", "website", "phone", "email"]


@proof(
    f"""SELECT {', '.join(_LOADED)}, '{LOAD_TS}' AS created_at, '{LOAD_TS}' AS last_updated, CAST(CAST(aum_crores AS DECIMAL(20,4)) AS DOUBLE) AS aum_crores, products,
    CAST(CAST(ticket_size_min AS DECIMAL(20,4)) AS DOUBLE) AS ticket_size_min, CAST(CAST(ticket_size_max AS DECIMAL(20,4)) AS DOUBLE) AS ticket_size_max FROM ({_OTHERS_SQL})""",
    *_BOTH,
)
def load_directory(spark, sf_dir):
    rows, _ = load.to_directory(_others(spark, sf_dir).select("record.*"), LOAD_TS)
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    money = [F.col(c).cast("double").alias(c) for c in ("aum_crores", "ticket_size_min", "ticket_size_max")]
    rows = rows.withColumns({c: F.col(c).cast("double") for c in ("established_year", "employee_count")})
    return rows.select(*_LOADED, stamp("created_at"), stamp("last_updated"), joined("product_types").alias("products"), *money)


@proof(
    """SELECT user_id, phone, CASE WHEN email = '' OR phone = '' THEN 'required' WHEN NOT regexp_full_match(regexp_replace(phone, '[^0-9]', '', 'g'), '[6-9][0-9]{9}') THEN 'phone' END AS error FROM contacts""",
    "contacts",
)
def contact_rules(spark, sf_dir):
    return contacts.contact_rules(ad.contacts(spark, sf_dir)).select("user_id", "phone", "error")


@proof(
    f"SELECT count(*) AS n_names, count(*) AS n_ids, bool_and(n = 1) AS one_each FROM (SELECT count(DISTINCT company_name || '|' || company_type || '|' || website) AS n FROM ({_OTHERS_SQL}) GROUP BY company_name, company_type, website)",
    *_BOTH,
)
def surrogate_ids(spark, sf_dir):
    """One id for each name, type and site, and none for two of them."""
    rows, _ = load.to_directory(_others(spark, sf_dir).select("record.*"), LOAD_TS)
    names = rows.groupBy("company_name", "company_type", "website").agg(F.count_distinct("id").alias("n"), F.min("id").alias("id"))
    return names.agg(F.count("*").alias("n_names"), F.count_distinct("id").alias("n_ids"), F.bool_and(F.col("n") == 1).alias("one_each"))


@proof(f"SELECT count(*) AS n_rows, count(DISTINCT (company_name, company_type, website)) AS n_ids, TRUE AS same_again FROM (SELECT DISTINCT company_name, company_type, website FROM ({_OTHERS_SQL}))", *_BOTH)
def colliding_ids(spark, sf_dir):
    """With a hash of a few hundred values institutions share ids; none is lost, each gets one of its own, a second run the same."""
    few = lambda: F.pmod(load.surrogate_id(), F.lit(301))
    records = _others(spark, sf_dir).select("record.*")
    one, two = (load.to_directory(r, LOAD_TS, unique=True, first=few)[0].select("id", *load.NAMES) for r in (records, records.repartition(5, "website")))
    both = one.join(two.withColumnRenamed("id", "again"), load.NAMES)
    return both.agg(F.count("*").alias("n_rows"), F.count_distinct("id").alias("n_ids"), F.bool_and(F.col("id") == F.col("again")).alias("same_again"))


_LOST_SQL = " UNION ALL ".join(
    f"SELECT row_number, '{k}' AS field, v->>'$.{k}' AS text, '{t}' AS rule FROM parsed WHERE v->>'$.{k}' IS NOT NULL AND TRY_CAST(v->>'$.{k}' AS {'INTEGER' if t == 'int' else 'DOUBLE'}) IS NULL" for k, t in A.NUMBERS.items()
)


@proof(
    f""", o AS (SELECT row_number, CASE WHEN row_number % 19 <> 0 THEN company_name END AS company_name, company_type, website FROM ({_OTHERS_SQL})),
    f AS ({_LOST_SQL} UNION ALL SELECT row_number, 'company_name', NULL, 'required' FROM o WHERE company_name IS NULL)
    SELECT company_name, company_type, website, field, text, rule, company_name IS NULL AS left_out FROM o JOIN f USING (row_number)
    UNION ALL SELECT company_name, company_type, website, '', NULL, 'loaded', FALSE FROM o WHERE company_name IS NOT NULL""",
    *_BOTH,
)
def load_faults(spark, sf_dir):
    """Records loaded in one write: the rows, and a row with its rule for every record left out and every value made null."""
    records = _others(spark, sf_dir).select("row_number", "record.*", F.col("answer.rescued").alias("rescued"))
    records = records.withColumn("company_name", F.when(F.col("row_number") % 19 != 0, F.col("company_name")))
    rows, faults = load.load_directory(records, fresh(spark, "loaded"), LOAD_TS, rescued="rescued")
    loaded = rows.select(*load.NAMES, F.lit("").alias("field"), F.lit(None).cast("string").alias("text"), F.lit("loaded").alias("rule"), F.lit(False).alias("left_out"))
    return faults.drop("id").unionByName(loaded)


# Sources

@proof(_OTHERS_SQL, *_BOTH)
def records_round_trip(spark, sf_dir):
    """Records written as CSV and read back, with their lists."""
    path = fresh(spark, "records")
    rows = _others(spark, sf_dir).select(F.col("row_number").cast("string").alias("row_number"), "record.*")
    numbered = rows.withColumn("data_source", F.concat_ws(" ", "row_number", "data_source")).select(*[f.name for f in RECORDS])
    files.write_records(numbered, path)
    back = files.read_records(spark, path)
    parts = F.split("data_source", " ", 2)
    return _shown(back.withColumns({"row_number": parts[0].cast("long"), "data_source": parts[1]}))


@proof("SELECT p_name AS company_name, CASE WHEN p_partkey % 3 = 0 THEN '' WHEN p_partkey % 3 = 1 THEN 'https://' || p_partkey ELSE p_brand END AS website, CASE WHEN p_partkey % 3 = 1 THEN p_brand ELSE '' END AS \"line\nend\" FROM part")
def union_odd_sources(spark, sf_dir):
    """CSV files in folders with brackets, three headers: one column, a quoted name with a line end, a repeated name whose last column counts."""
    path, part = fresh(spark, "csv"), ad.table(spark, sf_dir, "part")
    key = F.col("p_partkey").cast("string")
    site = F.concat(F.lit("https://"), key)
    kinds = [("company_name", ["p_name"]), ('company_name,"line\nend",website', ["p_name", "p_brand", site]), ("website,company_name,website", [key, "p_name", "p_brand"])]
    for i, (header, columns) in enumerate(kinds):
        row = F.to_csv(F.struct(*[c if isinstance(c, str) else c.alias("c") for c in columns]), {"escape": '"'})
        lines = part.filter(F.col("p_partkey") % 3 == i).select((F.col("p_partkey") % 5).alias("b"), F.col("p_partkey").alias("nth"), row.alias("value"))
        heads = lines.select("b").distinct().select("b", F.lit(-1).cast(part.schema["p_partkey"].dataType).alias("nth"), F.lit(header).alias("value"))
        lines.unionByName(heads).repartition("b").sortWithinPartitions("b", "nth").select("b", "value").write.partitionBy("b").text(f"{path}/kind[{i}]")
    return files.read_candidates(spark, f"{path}/*/*/*.txt").select("company_name", "website", F.col("`line\nend`"))


@proof("SELECT user_id, email, phone FROM contacts", "contacts")
def append_contacts(spark, sf_dir):
    """Contacts added in two batches."""
    path, rows = fresh(spark, "contacts"), ad.contacts(spark, sf_dir)
    for batch_of in (0, 1):
        files.append_contacts(rows.filter(F.crc32(F.col("user_id").cast("binary")) % 2 == batch_of), path)
    return files.read_contacts(spark, path)


@proof("SELECT user_id, email, phone FROM contacts", "contacts")
def append_contacts_again(spark, sf_dir):
    """Three named batches, of which two come again: each is there once."""
    path, rows = fresh(spark, "contacts"), ad.contacts(spark, sf_dir)
    for batch_of in (0, 1, 0, 2, 1):
        files.append_contacts(rows.filter(F.crc32(F.col("user_id").cast("binary")) % 3 == batch_of), path, f"batch-{batch_of}")
    return files.read_contacts(spark, path)


@proof(
    """SELECT CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE p_brand END AS company_name, CASE WHEN p_partkey % 2 = 0 THEN 'http://' || p_partkey ELSE 'https://' || p_partkey END AS website,
    CASE WHEN p_partkey % 2 = 0 THEN '' ELSE CAST(p_size AS VARCHAR) END AS extra FROM part"""
)
def union_sources(spark, sf_dir):
    """Two groups of CSV files, their columns in another order, read back as one table by name."""
    path, part = fresh(spark, "csv"), ad.table(spark, sf_dir, "part")
    key = F.col("p_partkey").cast("string")
    even = part.filter("p_partkey % 2 = 0").select(F.col("p_name").alias("company_name"), F.concat(F.lit("http://"), key).alias("website"))
    odd = part.filter("p_partkey % 2 = 1").select(F.concat(F.lit("https://"), key).alias("website"), F.col("p_brand").alias("company_name"), F.col("p_size").cast("string").alias("extra"))
    for df in (even, odd):
        df.write.mode("append").options(header=True, escape='"').csv(path)
    return files.read_candidates(spark, f"{path}/*.csv").select("company_name", "website", "extra")


@proof("SELECT event_id, user_id, event_type FROM events WHERE value >= 10")
def incremental_ingest(spark, sf_dir):
    """Twelve files taken three at a time: a run that fails at a row, one that takes what is left, one that finds nothing new."""
    root, events = fresh(spark, "ingest"), ad.table(spark, sf_dir, "events")
    events.repartition(12, "event_id").write.parquet(f"{root}/in")
    columns = events.select("event_id", "user_id", "event_type").schema
    worst = events.filter("value >= 10").agg(F.max("event_id")).first()[0]
    broken = lambda df: wanted(df).withColumn("event_id", F.when(F.col("event_id") == worst, F.raise_error(F.lit("a broken row"))).otherwise(F.col("event_id")))
    wanted = lambda df: df.filter("value >= 10").select("event_id", "user_id", "event_type")
    for transform in (broken, wanted, wanted):
        try:
            ingest_incremental(spark, f"{root}/in", events.schema, f"{root}/out", f"{root}/log", transform, files_per_batch=3)
        except StreamingQueryException:
            if transform is not broken:
                raise
    return read_ingested(spark, f"{root}/out", columns)
