"""Contact preparation and daily batch plans (all tenants at once)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixtures as fx
from .. import oracle as O
from ..operators import contacts as CT
from ..operators import selection as SL
from ..operators import tenants as TN
from ..operators.grouping import row_number_per_group
from ..registry import register

AS_OF = fx.AS_OF_CONTACTS
SEED = AS_OF.strftime("%Y-%m-%d")

# --- oracle building blocks ----------------------------------------------

_STRIP = "regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"
_ASCII = "regexp_replace({c}, '[^\\x00-\\x7F]+', '', 'g')"


def _clean(c):
    return _STRIP.format(c=c)


def _ascii(c):
    return _ASCII.format(c=c)


CLEAN_CTES = [
    ("stripped", f"""SELECT client, src_row, {_clean('first_name')} AS first_name,
       {_clean('last_name')} AS last_name, {_clean('company')} AS company,
       {_clean('position')} AS position, {_clean('url')} AS url
  FROM contacts"""),
    ("cleaned", """SELECT client, first_name, last_name, company, position, url, min(src_row) AS src_row
  FROM stripped
  WHERE first_name IS NOT NULL AND length(first_name) > 0
    AND last_name IS NOT NULL AND length(last_name) > 0
    AND company IS NOT NULL AND length(company) > 0
  GROUP BY client, first_name, last_name, company, position, url"""),
    ("ascii_c", f"""SELECT client, src_row, {_ascii('first_name')} AS first_name, {_ascii('last_name')} AS last_name,
       {_ascii('company')} AS company, {_ascii('position')} AS position, {_ascii('url')} AS url
  FROM cleaned"""),
    ("person", """SELECT client, first_name, last_name, company,
       arg_min(position, src_row) AS position, arg_min(url, src_row) AS url, min(src_row) AS src_row
  FROM ascii_c GROUP BY client, first_name, last_name, company"""),
    ("latest", """SELECT client, first_name, last_name, company,
       arg_max(search_id, (search_date, search_id)) AS last_search_id,
       max(search_date) AS last_search_date,
       arg_max(total_score, (search_date, search_id)) AS last_total_score,
       count(*) AS n_searches
  FROM history GROUP BY client, first_name, last_name, company"""),
    ("cands", """SELECT p.client, p.first_name, p.last_name, p.company, p.position, p.src_row,
       l.last_search_id, l.last_search_date, l.last_total_score, l.n_searches
  FROM person p LEFT JOIN latest l
    ON p.client = l.client AND p.first_name = l.first_name AND p.last_name = l.last_name
   AND p.company = l.company"""),
    ("elig", """SELECT *, last_search_id IS NULL AS is_new FROM cands
  WHERE coalesce(NOT starts_with(lower(position), 'freelance'), TRUE)
    AND (last_search_date IS NULL
         OR floor(date_diff('second', last_search_date, TIMESTAMP '2001-08-02 00:00:00') / 86400) > 30)"""),
]

TENANT_CTES = O.PRICE_PICK + [
    ("valid_settings", """SELECT * FROM settings
  WHERE send_proposed_emails IS NOT NULL AND max_emails IS NOT NULL AND mini_batch_size IS NOT NULL
    AND max_tavily_searches > 0 AND max_tavily_searches < 20
    AND max_pplx_searches > 0 AND max_pplx_searches < 10
    AND batch_size > 0 AND batch_size < 1000
    AND NOT (coalesce(mini_batch_size, 0) > coalesce(batch_size, 0))
    AND llm_search IN ('gpt-4o-mini', 'gpt-4o', 'gpt-4')
    AND starts_with(llm_email, 'gpt-4o')
    AND len(email_days_of_week) >= 1"""),
    ("gate", """SELECT s.client, s.monthly_budget
  FROM subscriptions s
  LEFT JOIN (SELECT client, sum(money) AS mtd FROM detail
             WHERE date >= TIMESTAMP '2001-08-01 00:00:00' GROUP BY client) m ON s.client = m.client
  WHERE s.client IS NOT NULL AND trim(s.client) <> ''
    AND s.start_date <= DATE '2001-08-02' AND (s.end_date IS NULL OR s.end_date >= DATE '2001-08-02')
    AND greatest(coalesce(m.mtd, 0), 0) < s.monthly_budget"""),
    ("tenants", "SELECT v.* FROM valid_settings v JOIN gate g ON v.client = g.client"),
]

U_SQL = ("((('0x' || substr(md5(concat_ws('|', '2001-08-02', e.client, e.first_name, e.last_name, "
         "e.company)), 1, 13))::UBIGINT)::DOUBLE + 0.5) / 4503599627370496.0")

BATCH_CTES = CLEAN_CTES + TENANT_CTES + [
    ("keyed", f"""SELECT e.*, t.batch_size, t.mini_batch_size,
       CASE WHEN e.is_new THEN 0 WHEN e.last_total_score > 0 THEN 1 ELSE 2 END AS tier,
       {U_SQL} AS u
  FROM elig e JOIN tenants t ON e.client = t.client"""),
    ("ranked", """SELECT *, row_number() OVER (PARTITION BY client ORDER BY tier,
         CASE WHEN tier = 1 THEN -ln(u) / last_total_score ELSE u END,
         first_name, last_name, company) AS pick_rank
  FROM keyed"""),
]


# --- queries -------------------------------------------------------------

def _prepared(spark, sf_dir):
    return CT.ascii_only(CT.clean(fx.contacts(spark, sf_dir)))


@register("p2_clean_contacts", O.with_views(
    "SELECT client, src_row, first_name, last_name, company, position, url FROM ascii_c", CLEAN_CTES))
def clean_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P2 + P3 + F1 + A11 + F2."""
    return _prepared(spark, sf_dir).select(
        "client", "src_row", "first_name", "last_name", "company", "position", "url")


@register("o1_contacts_numbered", O.with_views(
    """SELECT client, first_name, last_name, company, src_row,
       row_number() OVER (PARTITION BY client ORDER BY first_name, last_name, company, src_row) AS row_no
  FROM cleaned""", CLEAN_CTES))
def contacts_numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O1: contacts sorted by name and company and renumbered per tenant,
    numbered without sorting a whole tenant in one task."""
    c = CT.clean(fx.contacts(spark, sf_dir))
    n = row_number_per_group(c, ["client"], ["first_name", "last_name", "company", "src_row"])
    return n.select("client", "first_name", "last_name", "company", "src_row", "row_no")


@register("j1_contacts_history", O.with_views(
    """SELECT a.client, a.first_name, a.last_name, a.company, a.position, h.search_id,
       h.search_date AS search_date_previous, h.total_score,
       (h.search_date IS NULL OR h.search_date < TIMESTAMP '2001-08-02 00:00:00' - INTERVAL 30 DAY)
         AS eligible_for_processing
  FROM ascii_c a LEFT JOIN history h
    ON a.client = h.client AND a.first_name = h.first_name AND a.last_name = h.last_name
   AND a.company = h.company""", CLEAN_CTES))
def contacts_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J1 + P1 + P5: one row per (contact, past search)."""
    j = CT.join_history(_prepared(spark, sf_dir), fx.history(spark, sf_dir), AS_OF)
    return j.select("client", "first_name", "last_name", "company", "position", "search_id",
                    "search_date_previous", "total_score", "eligible_for_processing")


@register("a8_latest_search", O.with_views(
    """SELECT client, first_name, last_name, company, position, last_search_id, last_search_date,
       last_total_score, coalesce(n_searches, 0) AS n_searches
  FROM cands""", CLEAN_CTES))
def latest_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A8 + D11: one row per person with the latest of all its searches."""
    c = SL.candidates(fx.contacts(spark, sf_dir), fx.history(spark, sf_dir), AS_OF)
    return c.select("client", "first_name", "last_name", "company", "position", "last_search_id",
                    "last_search_date", "last_total_score",
                    F.coalesce("n_searches", F.lit(0).cast("bigint")).alias("n_searches"))


@register("p6_eligible", O.with_views(
    """SELECT client, first_name, last_name, company, position, is_new, last_search_date
  FROM elig""", CLEAN_CTES))
def eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P4 + P6: contacts that may be searched today."""
    e = SL.eligible(SL.candidates(fx.contacts(spark, sf_dir), fx.history(spark, sf_dir), AS_OF), AS_OF)
    return e.select("client", "first_name", "last_name", "company", "position", "is_new",
                    "last_search_date")


def _tenants(spark, sf_dir):
    return TN.runnable_tenants(fx.subscriptions(spark), fx.settings(spark),
                               fx.consumption(spark, sf_dir), fx.pricing(spark), AS_OF)


@register("o4_daily_batch", O.with_views(
    """SELECT client, first_name, last_name, company, position, is_new, last_search_date,
       last_total_score, pick_rank, CAST(floor((pick_rank - 1) / mini_batch_size) AS BIGINT) AS mini_batch
  FROM ranked WHERE pick_rank <= batch_size""", BATCH_CTES))
def daily_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P17 + P19 + O2 + O3 + O4 + W5: today's batch for every runnable tenant."""
    e = SL.eligible(SL.candidates(fx.contacts(spark, sf_dir), fx.history(spark, sf_dir), AS_OF), AS_OF)
    settings = fx.settings(spark)
    b = SL.daily_batch(e, _tenants(spark, sf_dir), SEED, tenant_bound=settings, k_max=SL.k_bound(settings, "batch_size"))
    return b.select("client", "first_name", "last_name", "company", "position", "is_new",
                    "last_search_date", "last_total_score", "pick_rank", "mini_batch")


@register("a10_batch_plan", O.with_views(
    """SELECT t.client, t.batch_size, coalesce(a.n_eligible, 0) AS n_eligible, coalesce(a.n_new, 0) AS n_new,
       coalesce(a.n_existing, 0) AS n_existing, coalesce(a.max_score, 1) AS max_score,
       least(coalesce(a.n_new, 0), t.batch_size) AS new_taken,
       least(t.batch_size - least(coalesce(a.n_new, 0), t.batch_size), coalesce(a.n_existing, 0)) AS sampled
  FROM tenants t LEFT JOIN (
    SELECT client, count(*) AS n_eligible, count(*) FILTER (WHERE is_new) AS n_new,
           count(*) FILTER (WHERE NOT is_new) AS n_existing,
           coalesce(max(CASE WHEN NOT is_new THEN last_total_score END), 1) AS max_score
    FROM elig GROUP BY client) a ON t.client = a.client""", CLEAN_CTES + TENANT_CTES))
def batch_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A9 + A10: new vs. existing split and the slots left for sampling."""
    e = SL.eligible(SL.candidates(fx.contacts(spark, sf_dir), fx.history(spark, sf_dir), AS_OF), AS_OF)
    return SL.batch_plan(e, _tenants(spark, sf_dir), tenant_bound=fx.settings(spark))
