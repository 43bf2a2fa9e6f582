"""Branches that the plain tables never reach: the same operators over tables
with null dates, duplicate and non-ASCII contacts, missing usage fields, dirty
dates, dropped template variables and texts full of links. All rows are derived
from the driver's tables, none are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import fixtures as fx
from .. import oracle as O
from ..functions import text as TX
from ..operators import checks as CK
from ..operators import contacts as CT
from ..operators import shortlist as SH
from ..registry import register
from ..sources import sinks as K
from ..sources import tables as S


@register("p14_fill_search_date", O.with_views("""SELECT client, search_id,
       coalesce(d, max(d) OVER (PARTITION BY client)) AS search_date
  FROM (SELECT client, search_id, CASE WHEN search_id % 13 <> 0 THEN search_date END AS d FROM history)"""))
def fill_search_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every thirteenth search has lost its date."""
    h = fx.history(spark, sf_dir).select("client", "search_id", F.when(
        F.col("search_id") % 13 != 0, F.col("search_date")).alias("search_date"))
    return SH.fill_search_date(h)


_DIRTY = """SELECT client, src_row * 3 + r AS src_row,
       CASE WHEN src_row % 7 = 0 THEN first_name || 'é' ELSE first_name END AS first_name, last_name, company,
       position, CASE WHEN src_row % 5 = 0 THEN NULL WHEN src_row % 5 = 1 THEN 'HTTPS://www.' || company || '.example/a?b#c'
                      ELSE 'http://' || company || '.example/x;p=1' END AS url
  FROM contacts, (VALUES (0), (1)) AS twice(r) WHERE r = 0 OR src_row % 4 = 0"""


def _dirty_contacts(spark, sf_dir):
    """Every fourth contact twice, every seventh with a non-ASCII name, URLs."""
    c = fx.contacts(spark, sf_dir)
    r = F.col("src_row")
    site = F.concat(F.col("company"), F.lit(".example"))
    c = c.select("client", F.explode(F.when(r % 4 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("n"),
                 "src_row", F.when(r % 7 == 0, F.concat("first_name", F.lit("é"))).otherwise(F.col("first_name")).alias("first_name"),
                 "last_name", "company", "position",
                 F.when(r % 5 == 1, F.concat(F.lit("HTTPS://www."), site, F.lit("/a?b#c")))
                 .when(r % 5 != 0, F.concat(F.lit("http://"), site, F.lit("/x;p=1"))).alias("url"))
    return c.withColumn("src_row", (F.col("src_row") * 3 + F.col("n")).cast("bigint")).drop("n")


@register("a11_dirty_contacts", O.with_views(r"""SELECT client, min(src_row) AS src_row, first_name, last_name, company, position, url
  FROM (SELECT client, src_row, replace(trim(first_name), 'é', '') AS first_name, last_name, company, position,
               lower(CASE WHEN url IS NULL THEN NULL WHEN url LIKE 'HTTPS%' THEN 'www.' || company || '.example/a'
                          ELSE company || '.example/x' END) AS url
          FROM dirty WHERE last_name IS NOT NULL)
 GROUP BY ALL""", [("dirty", _DIRTY)]))
def dirty_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A11 + F1 + F2 on contacts: duplicates, URLs and non-ASCII names."""
    c = CT.ascii_only(CT.clean(_dirty_contacts(spark, sf_dir)))
    return c.select("client", "src_row", "first_name", "last_name", "company", "position", "url")


_MISSING = """SELECT client, usage_id, CASE WHEN usage_id % 17 <> 0 THEN function END AS function,
       CASE WHEN usage_id % 19 <> 0 THEN model END AS model, search_calls,
       CASE WHEN usage_id % 17 <> 0 THEN input_tokens END AS input_tokens, output_tokens FROM consumption"""


@register("c4_usage_missing_fields", O.with_views("""SELECT client, 'usage_missing_fields' AS "check", CAST(usage_id AS VARCHAR) AS key,
       'missing required fields: ' || CASE WHEN usage_id % 323 = 0 THEN 'function, model, input_tokens'
            WHEN usage_id % 17 = 0 THEN 'function, input_tokens' ELSE 'model' END AS detail
  FROM missing WHERE usage_id % 17 = 0 OR usage_id % 19 = 0""", [("missing", _MISSING)]))
def usage_missing_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C4: usage records that lack one or more required fields."""
    i = F.col("usage_id")
    u = fx.consumption(spark, sf_dir).withColumns({
        "function": F.when(i % 17 != 0, F.col("function")), "model": F.when(i % 19 != 0, F.col("model")),
        "input_tokens": F.when(i % 17 != 0, F.col("input_tokens"))})
    return CK.usage_violations(u)


_RAW_PRICES = """SELECT event_id AS ord, event_type AS model,
       CASE WHEN event_id % 7 = 0 THEN 'soon' WHEN event_id % 11 = 0 THEN ' ' WHEN event_id % 5 = 0 THEN NULL
            ELSE strftime(ts, '%Y-%m-%d') END AS start_date,
       CASE WHEN event_id % 3 = 0 THEN 'open' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS end_date,
       CASE WHEN event_id % 13 = 0 THEN CAST('nan' AS DOUBLE) ELSE value END AS price FROM events"""


def _raw_prices(spark, sf_dir):
    e = fx.read(spark, sf_dir, "events")
    i = F.col("event_id")
    price = F.when(i % 13 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    return e.select(
        i.alias("ord"), F.col("event_type").alias("model"),
        F.when(i % 7 == 0, "soon").when(i % 11 == 0, " ").when(i % 5 == 0, F.lit(None))
        .otherwise(F.date_format("ts", "yyyy-MM-dd")).alias("start_date"),
        F.when(i % 3 == 0, "open").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("end_date"),
        price.alias("input_price"), price.alias("output_price"), price.alias("search_price"))


@register("f24_dirty_prices", f"""SELECT ord, model, TRY_CAST(start_date AS TIMESTAMP) AS start_date,
       TRY_CAST(end_date AS TIMESTAMP) AS end_date, CASE WHEN NOT isnan(price) THEN price END AS input_price
  FROM ({_RAW_PRICES})""")
def dirty_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S5 + F24 + P12: dates that don't parse become null, NaN becomes null."""
    parsed, _ = S.parse_prices(_raw_prices(spark, sf_dir))
    return parsed.select("ord", "model", "start_date", "end_date", "input_price")


@register("c6_price_dates", f"""SELECT CAST(NULL AS VARCHAR) AS client, 'start_date_unparsed' AS "check", 'pricing' AS key,
       count(*) || ' start dates could not be parsed' AS detail FROM ({_RAW_PRICES}) WHERE start_date = 'soon'
UNION ALL
SELECT NULL, 'start_date_blank', 'pricing', count(*) || ' start dates are blank'
  FROM ({_RAW_PRICES}) WHERE start_date IS NULL OR start_date = ' '
UNION ALL
SELECT NULL, 'empty_source', 'pricing', 'the pricing file is empty' FROM (SELECT count(*) AS n FROM events) WHERE n < 0
UNION ALL
SELECT NULL, 'empty_source', 'pricing', 'the pricing file is empty'""")
def price_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C6 + C9: failed and blank start dates; the checks of an empty list."""
    raw = _raw_prices(spark, sf_dir)
    _, issues = S.parse_prices(raw)
    _, none = S.parse_prices(raw.filter(F.col("ord") < 0))
    return issues.unionByName(none)


_PROMPTS = """SELECT r_name AS client, 'p' || page_id AS name,
       'Hello {first_name} of {company}, see ' || url || CASE WHEN page_id % 2 = 0 THEN ' {search_period}' ELSE '' END AS old,
       'Hello ' || CASE WHEN page_id % 3 = 0 THEN '' ELSE '{first_name} ' END || 'of {company} {extra}' AS new
  FROM pages JOIN region ON r_regionkey = page_id % 5"""


def _prompts(spark, sf_dir):
    i = F.col("page_id")
    region = fx.read(spark, sf_dir, "region")
    p = fx.read(spark, sf_dir, "pages").select("page_id", "url").join(F.broadcast(region), i % 5 == F.col("r_regionkey"))
    return p.select(
        F.col("r_name").alias("client"), F.concat(F.lit("p"), i.cast("string")).alias("name"),
        F.concat(F.lit("Hello {first_name} of {company}, see "), F.col("url"),
                 F.when(i % 2 == 0, " {search_period}").otherwise("")).alias("old"),
        F.concat(F.lit("Hello "), F.when(i % 3 == 0, "").otherwise("{first_name} "), F.lit("of {company} {extra}")).alias("new"))


@register("c10_template_edits", f"""WITH t AS ({_PROMPTS}),
v AS (SELECT client, name, unnest(list_filter(list_distinct(regexp_extract_all(old, '\\{{([^}}]+)\\}}', 1)),
        lambda x: NOT list_contains(regexp_extract_all(new, '\\{{([^}}]+)\\}}', 1), x))) AS var FROM t)
SELECT client, 'template_variable_removed' AS "check", name || ':' || var AS key,
       'cannot remove {{' || var || '}}' AS detail FROM v""")
def template_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C10 + U4 + F14: variables that an edited prompt has lost."""
    p = _prompts(spark, sf_dir)
    return CK.template_violations(p.select("client", "name", F.col("old").alias("body")),
                                  p.select("client", "name", F.col("new").alias("body")))


@register("f30_conformed_orders", """SELECT CAST(o_orderkey AS BIGINT) AS id, CAST(o_custkey AS VARCHAR) AS customer,
       CAST(o_orderdate AS DATE) AS day FROM orders""")
def conformed_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C3 + F30: new rows take the stored table's column order and types."""
    stored = T.StructType([T.StructField("id", T.LongType()), T.StructField("customer", T.StringType()),
                           T.StructField("day", T.DateType())])
    o = fx.read(spark, sf_dir, "orders").select(
        F.col("o_orderdate").alias("day"), F.col("o_custkey").alias("customer"), F.col("o_orderkey").cast("string").alias("id"))
    return K.conform(o, stored)


@register("f27_tenant_of_path", """SELECT c_custkey AS id, n_name || CASE WHEN c_custkey % 3 = 1 THEN ' ' ELSE '' END AS tenant
  FROM customer JOIN nation ON n_nationkey = c_nationkey""")
def tenant_of_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the tenant of a folder path, with or without closing slashes."""
    k = F.col("c_custkey")
    nation = fx.read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    c = fx.read(spark, sf_dir, "customer").join(F.broadcast(nation), F.col("n_nationkey") == F.col("c_nationkey"))
    path = F.concat(F.lit("/data/clients/"), F.col("n_name"),
                    F.when(k % 3 == 0, "//").when(k % 3 == 1, " ").otherwise("/"))
    return c.select(k.alias("id"), S.tenant_name(path).alias("tenant"))


_LINKED = """SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x, i:
         x || CASE WHEN i % 4 = 1 THEN ' ( https://a' || doc_id || '.example.org/p(' || i || ')/q ) '
                   WHEN i % 4 = 2 THEN ' [http://b.example.org/x,y] , ' WHEN i % 4 = 3 THEN ' {https://c.example.org/z?d=' || i || '}'
                   ELSE '' END), chr(10)) AS text FROM documents"""


def _linked(spark, sf_dir):
    d = fx.read(spark, sf_dir, "documents").select("doc_id", "text")
    n = lambda i: (i + 1).cast("string")

    def line(x, i):
        k = (i + 1) % 4
        return F.concat(x, F.when(k == 1, F.concat(F.lit(" ( https://a"), F.col("doc_id").cast("string"),
                                                   F.lit(".example.org/p("), n(i), F.lit(")/q ) ")))
                        .when(k == 2, F.lit(" [http://b.example.org/x,y] , "))
                        .when(k == 3, F.concat(F.lit(" {https://c.example.org/z?d="), n(i), F.lit("}"))).otherwise(F.lit("")))

    return d.select("doc_id", F.array_join(F.transform(F.split("text", "\n", -1), line), "\n").alias("text"))


@register("f9_links_in_documents", f"""WITH t AS ({_LINKED}),
u AS (SELECT doc_id, regexp_extract_all(text, 'https?://(?:a[0-9]+\\.example\\.org/p\\([0-9]+\\)/q|b\\.example\\.org/x,y|c\\.example\\.org/z\\?d=[0-9]+)') AS urls
  FROM t)
SELECT doc_id, len(urls) AS n_urls, md5(array_to_string(urls, ' ')) AS urls_md5 FROM u""")
def links_in_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8 + F9 over whole document texts with links between their lines, in
    brackets, with brackets and commas inside."""
    t = _linked(spark, sf_dir).select("doc_id", TX.find_urls(TX.tidy_url_parens("text")).alias("urls"))
    return t.select("doc_id", F.size("urls").alias("n_urls"), F.md5(F.array_join("urls", " ")).alias("urls_md5"))
