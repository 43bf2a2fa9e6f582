"""Domain tables derived from the driver's TPC-H-shaped parquet.

The driver ships generic tables; these builders shape them into the
engine's domain (contacts, history, consumption, ...). Every derived
table keeps all rows of its sources: the modulo expressions below only
*shape* values (inject blanks, nulls, freelancers; spread events over
tenants), they never filter.

Dimension tables that are configuration in the real application
(pricing, subscriptions, settings, prompts, rubric) are fixed rows here;
they are only ever joined to the scaled tables.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas as S

# Fixed "today" of the two domains (the day after the last order / the end
# of the usage month).
AS_OF_CONTACTS = dt.datetime(2001, 8, 2)
AS_OF_USAGE = dt.datetime(2024, 1, 31)


# Schemas of the driver's tables (TESTDATA.md). Reads name them, so no
# footer-reading job runs to infer a schema on every scan.
SOURCE_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "orders": ("o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
               "o_orderdate timestamp_ntz, o_orderpriority string"),
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "benchmark": "item_id bigint, text string",
    "pages": "page_id bigint, url string, html string",
}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    r = spark.read
    if name in SOURCE_SCHEMAS:
        r = r.schema(SOURCE_SCHEMAS[name])
    return r.parquet(f"{sf_dir}/{name}.parquet")


def geography(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nation -> (company, client). TPC-H fixes nation at 25 and region at 5
    rows at every scale, so broadcasting this side is bounded."""
    nation = read(spark, sf_dir, "nation")
    region = read(spark, sf_dir, "region")
    return F.broadcast(
        nation.join(region, nation.n_regionkey == region.r_regionkey)
        .select("n_nationkey", F.col("n_name").alias("company"),
                F.col("r_name").alias("client")))


def _name_part(c: Column, i: int) -> Column:
    return F.split_part(c, F.lit("#"), F.lit(i))


def contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw (dirty) contacts: every customer and every supplier.

    Suppliers have no orders, so they are the never-searched contacts.
    """
    geo = geography(spark, sf_dir)
    cust = read(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    first = _name_part(F.col("c_name"), 1)
    c = cust.join(geo, cust.c_nationkey == geo.n_nationkey).select(
        "client",
        (k * 2).alias("src_row"),
        F.when(k % 50 == 0, F.concat(F.lit("  "), first, F.lit(" "))).otherwise(first)
        .alias("first_name"),
        F.when(k % 97 == 0, F.lit(None).cast("string"))
        .otherwise(_name_part(F.col("c_name"), 2)).alias("last_name"),
        "company",
        F.when(k % 10 == 0, F.concat(F.lit("Freelance "), F.col("c_mktsegment")))
        .when(k % 10 == 1, F.lit(None).cast("string"))
        .otherwise(F.col("c_mktsegment")).alias("position"),
        F.lit(None).cast("string").alias("url"),
    )
    supp = read(spark, sf_dir, "supplier")
    s = supp.join(geo, supp.s_nationkey == geo.n_nationkey).select(
        "client",
        (F.col("s_suppkey") * 2 + 1).alias("src_row"),
        _name_part(F.col("s_name"), 1).alias("first_name"),
        _name_part(F.col("s_name"), 2).alias("last_name"),
        "company",
        F.lit("Supplier").alias("position"),
        F.lit(None).cast("string").alias("url"),
    )
    return c.unionByName(s)


def history(spark: SparkSession, sf_dir: str, with_text: bool = False) -> DataFrame:
    """Past searches: one per order. ``search_results`` is the document whose
    id equals the order key (left join: every order kept, every document
    used once). Text is joined only when asked for, so key-only plans never
    drag long strings through their shuffles."""
    geo = geography(spark, sf_dir)
    orders = read(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    cust = read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    k = F.col("o_orderkey")
    nov = k % 11
    act = F.floor(k / F.lit(11.0)).cast("bigint") % 3
    srv = F.floor(k / F.lit(33.0)).cast("bigint") % 11
    h = (orders.join(cust, orders.o_custkey == cust.c_custkey)
         .join(geo, F.col("c_nationkey") == geo.n_nationkey))
    cols = [
        "client", k.alias("search_id"),
        _name_part(F.col("c_name"), 1).alias("first_name"),
        _name_part(F.col("c_name"), 2).alias("last_name"),
        "company",
        F.col("o_orderdate").cast("timestamp_ntz").alias("search_date"),
        nov.alias("novelty_score"), act.alias("activity_score"),
        srv.alias("services_need_score"), (nov + act + srv).alias("total_score"),
        F.when((F.col("o_orderstatus") == "F")
               & (F.col("o_orderdate") < F.lit(dt.datetime(2001, 7, 25))),
               F.col("o_orderdate").cast("timestamp_ntz") + F.expr("INTERVAL 7 DAYS"))
        .alias("email_date"),
    ]
    empty = ["search_event_type", "search_query", "search_raw", "url_facebook",
             "url_linkedin", "url_company", "email_content", "email_batch_recipient"]
    if not with_text:
        empty.append("search_results")
    h = h.select(*cols, *[F.lit(None).cast("string").alias(c) for c in empty])
    if with_text:
        h = h.join(history_text(spark, sf_dir), "search_id", "left")
    return h.select(*[f.name for f in S.HISTORY.fields])


def history_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(search_id, search_results): the stored result text of each search,
    kept apart so plans filter on keys first and fetch text last."""
    return read(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("search_id"), F.col("text").alias("search_results"))


def consumption(spark: SparkSession, sf_dir: str) -> DataFrame:
    """API usage: one record per event, spread over the five tenants."""
    ev = read(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    region = F.broadcast(read(spark, sf_dir, "region"))  # 5 rows at every scale
    return ev.join(region, (ev.user_id % 5) == region.r_regionkey).select(
        F.col("r_name").alias("client"),
        F.col("event_id").alias("usage_id"),
        F.col("ts").cast("timestamp_ntz").alias("search_date"),
        F.lit("search").alias("function"),
        F.col("event_type").alias("model"),
        F.when(F.col("event_type") == "view", 1).otherwise(0).cast("bigint").alias("search_calls"),
        F.floor(F.col("value") * 1000).cast("bigint").alias("input_tokens"),
        F.floor(F.col("value") * 100).cast("bigint").alias("output_tokens"),
    )


def _d(s):
    return None if s is None else dt.datetime.fromisoformat(s)


def _sql_lit(v, t) -> str:
    """Spark SQL literal of a fixed value, typed by the target field."""
    ts = t.simpleString()
    if v is None:
        return f"CAST(NULL AS {ts})"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, (list, tuple)):
        inner = t.elementType
        return f"CAST(array({', '.join(_sql_lit(x, inner) for x in v)}) AS {ts})" if v else f"CAST(array() AS {ts})"
    if isinstance(v, dt.datetime):
        return f"TIMESTAMP_NTZ '{v.isoformat(sep=' ')}'"
    if isinstance(v, dt.date):
        return f"DATE '{v.isoformat()}'"
    if isinstance(v, str):
        return "'" + v.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"
    return f"CAST({v!r} AS {ts})"


def local_table(spark: SparkSession, rows, schema) -> DataFrame:
    """A fixed table as a JVM local relation (``VALUES``): no Python worker
    is involved when it is scanned, and Catalyst knows its exact size."""
    if isinstance(schema, str):
        schema = spark.createDataFrame([], schema).schema
    names = [f.name for f in schema.fields]
    if not rows:
        return spark.createDataFrame([], schema)
    vals = ",\n".join("(" + ", ".join(_sql_lit(v, f.dataType) for v, f in zip(r, schema.fields)) + ")"
                      for r in rows)
    cols = ", ".join(f"CAST({n} AS {f.dataType.simpleString()}) AS {n}" for n, f in zip(names, schema.fields))
    return spark.sql(f"SELECT {cols} FROM VALUES {vals} AS t({', '.join(names)})")


# The price list (file order = ord). Token prices per million,
# search price per call.
PRICE_ROWS = [
    (1, "click", "2024-01-01", "2024-01-10", 1.0, 2.0, 0.01),
    (2, "click", "2024-01-11", "2024-01-20", 1.5, 2.5, 0.01),
    (3, "click", "2024-01-25", None, 1.6, 2.6, 0.01),
    (4, "view", "2024-01-01", None, 0.5, 1.0, 0.005),
    (5, "view", "2024-01-15", None, 0.6, 1.2, 0.005),
    (6, "purchase", "2024-01-15", "2024-01-31", 5.0, 10.0, 0.0),
    (7, "purchase", "2024-01-05", "2024-01-20", 4.0, 8.0, 0.02),
    (8, "error", "2024-01-01", "2024-01-05", 2.0, None, 0.01),
]


def pricing(spark: SparkSession) -> DataFrame:
    rows = [(o, m, _d(s), _d(e), a, b, c) for o, m, s, e, a, b, c in PRICE_ROWS]
    return local_table(spark, rows, S.PRICING)


# Tenant subscriptions.
SUBSCRIPTION_ROWS = [
    ("AFRICA", "2000-01-01", None, 1000000.0),
    ("AMERICA", "2000-01-01", "2030-12-31", 0.5),
    ("ASIA", "2000-01-01", "2001-01-01", 1000000.0),
    ("EUROPE", None, None, 1000000.0),
    ("MIDDLE EAST", "2000-01-01", "2030-12-31", 1000000.0),
    (None, "2000-01-01", None, 1000000.0),
]


def subscriptions(spark: SparkSession) -> DataFrame:
    def day(s):
        return None if s is None else dt.date.fromisoformat(s)
    rows = [(c, day(s), day(e), b) for c, s, e, b in SUBSCRIPTION_ROWS]
    return local_table(spark, rows, S.SUBSCRIPTIONS)


# Per-tenant settings
# (client, batch, mini_batch, max_emails, max_tavily, max_pplx, llm_search,
#  llm_email, email_days_of_week, send_proposed_emails).
SETTINGS_ROWS = [
    ("AFRICA", 6, 2, 3, 3, 2, "gpt-4o-mini", "gpt-4o", ["Wednesday", "Friday"], False),
    ("AMERICA", 20, 4, 2, 5, 2, "gpt-4o", "gpt-4o-mini", ["Thursday"], False),
    ("ASIA", 10, 3, 5, 3, 2, "gpt-4", "gpt-4o", ["monday", "THURSDAY"], True),
    ("EUROPE", 6, 8, 3, 25, 2, "gpt-4o-mini", "gpt-4o", ["Thursday"], False),
    ("MIDDLE EAST", 300, 50, 4, 3, 2, "gpt-4o-mini", "gpt-4o", ["Friday", "Thursday"], False),
    ("NEW TENANT", 5, None, None, 3, 2, "gpt-4o", "gpt-4o", ["Thursday"], False),
]


def settings(spark: SparkSession) -> DataFrame:
    rows = [(c, b, m, e, t, p, ls, le, days, send, "user@example.com", "team@example.com")
            for c, b, m, e, t, p, ls, le, days, send in SETTINGS_ROWS]
    return local_table(spark, rows, S.SETTINGS)


# The standard search query template (tenant prompt
# "standard_query"; the attribute form reads fields of the contact).
STANDARD_QUERY = ("{candidate.first_name} {candidate.last_name}, {candidate.company} "
                  "official blog or case studies {search_period}")

# Per-tenant prompt rows (client, name, body); a tenant without its own row
# uses the default.
PROMPT_ROWS = [
    ("ASIA", "standard_query",
     "{candidate.first_name} {candidate.last_name} {candidate.company} news {search_period}"),
    ("AFRICA", "email_template",
     "Dear {first_name},\n\nCongratulations on the news at {company}. {{Team}}"),
]
DEFAULT_PROMPT_ROWS = [
    ("standard_query", STANDARD_QUERY),
    ("email_template", "Hello {first_name},\n\nWe read about {company} and would like to talk."),
    ("business_description",
     "We produce short customer videos and case studies for industrial companies.\n\n"
     "Our team turns product launches, awards and new partnerships into news stories.\n\n"
     "We also run event coverage and blog updates for teams without a media department."),
]


# Rubrics of the tenants, one row per keyword (client, metric, points, keyword,
# needs_person, needs_company); rows without a client are the default.
RUBRIC_ROWS = [
    (None, "A", 3, "case study", False, True), (None, "A", 3, "case studies", False, True),
    (None, "B", 2, "launch", True, False), (None, "B", 2, "launched", True, False),
    (None, "C", 1, "conference", True, True), (None, "D", 4, "record year", False, False),
    ("AMERICA", "A", 3, "mit license", False, False), ("AMERICA", "A", 3, "apache license", False, False),
    ("AMERICA", "B", 2, "general public license", False, False), ("AMERICA", "C", 1, "the", True, False),
    ("ASIA", "A", 5, "of the", False, False), ("ASIA", "B", 4, "license", False, False),
    ("ASIA", "C", 3, "und die", False, False), ("ASIA", "D", 1, "the", False, True),
]


def rubric(spark: SparkSession) -> DataFrame:
    return local_table(spark, RUBRIC_ROWS, "client string, metric string, points bigint, keyword string, "
                                           "needs_person boolean, needs_company boolean")


def prompts(spark: SparkSession) -> DataFrame:
    return local_table(spark, PROMPT_ROWS, S.PROMPTS)


def default_prompts(spark: SparkSession) -> DataFrame:
    return local_table(spark, DEFAULT_PROMPT_ROWS, "name string, body string")
