"""Weekly shortlist plans (section 3.2): all due tenants in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixtures as fx
from .. import oracle as O
from ..operators import shortlist as SH
from ..operators import tenants as TN
from ..operators.sizing import is_small, maybe_broadcast, rows_of
from ..registry import register
from .selection import CLEAN_CTES, TENANT_CTES

TODAY = fx.AS_OF_CONTACTS
TODAY_SQL = "TIMESTAMP '2001-08-02 00:00:00'"
WEEKDAY = TODAY.strftime("%A").lower()

SHORT_CTES = [c for c in TENANT_CTES if c[0] == "valid_settings"] + [
    ("lastmail", """SELECT client, first_name, last_name, company, max(email_date) AS last_email_date
  FROM history GROUP BY client, first_name, last_name, company"""),
    ("sc", f"""SELECT h.*, h.activity_score + h.services_need_score AS combined_score, l.last_email_date
  FROM history h JOIN lastmail l
    ON h.client = l.client AND h.first_name = l.first_name AND h.last_name = l.last_name
   AND h.company = l.company
  WHERE coalesce(h.novelty_score > 5, FALSE) AND h.email_date IS NULL
    AND floor(date_diff('second', h.search_date, {TODAY_SQL}) / 86400) <= 31
    AND (l.last_email_date IS NULL
         OR floor(date_diff('second', l.last_email_date, {TODAY_SQL}) / 86400) > 31)"""),
    ("due", f"""SELECT * FROM valid_settings
  WHERE list_contains(list_transform(email_days_of_week, lambda d: lower(d)), '{WEEKDAY}')"""),
    ("sc2", """SELECT s.*, d.max_emails FROM sc s JOIN due d ON s.client = d.client"""),
    ("tops", "SELECT client, max(combined_score) AS top_score FROM sc2 GROUP BY client"),
    ("cnt", """SELECT s.client, count(*) AS top_count FROM sc2 s JOIN tops t
  ON s.client = t.client AND s.combined_score = t.top_score GROUP BY s.client"""),
    ("feat", f"""SELECT s.*, t.top_score, c.top_count,
       (c.top_count > s.max_emails AND s.combined_score = t.top_score) AS tie,
       CAST(regexp_matches(coalesce(x.text, ''), '{SH.PROMOTABLE}') AS INTEGER) AS promo,
       len(regexp_extract_all(coalesce(x.text, ''), '{SH.URL_TOKEN}')) AS links,
       length(coalesce(x.text, '')) AS len
  FROM sc2 s JOIN tops t ON s.client = t.client LEFT JOIN cnt c ON s.client = c.client
  LEFT JOIN documents x ON x.doc_id = s.search_id"""),
    ("ranked_s", """SELECT *, row_number() OVER (PARTITION BY client ORDER BY combined_score DESC,
         CASE WHEN tie THEN promo END DESC NULLS LAST, CASE WHEN tie THEN links END DESC NULLS LAST,
         CASE WHEN tie THEN len END DESC NULLS LAST, search_id) AS pick_rank
  FROM feat"""),
    ("picked", "SELECT * FROM ranked_s WHERE pick_rank <= max_emails"),
]


def _due_tenants(spark):
    s = TN.valid_settings(fx.settings(spark))
    return s.filter(TN.weekday_due(s, TODAY))


def _k_max(spark) -> int:
    # One aggregate row over the (dimension) settings table: the literal
    # bound that lets the per-tenant top-k run as a group limit.
    return SH.k_bound(fx.settings(spark), "max_emails")


def _cands(spark, sf_dir):
    return SH.candidates(SH.history_keys(fx.history(spark, sf_dir)), TODAY)


def picked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SH.shortlist(_cands(spark, sf_dir), fx.history_text(spark, sf_dir), _due_tenants(spark), _k_max(spark))


@register("w8_last_email", O.with_views(
    "SELECT client, first_name, last_name, company, last_email_date FROM lastmail", SHORT_CTES))
def last_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest e-mail per person (replaces an O(n^2) row scan)."""
    return SH.last_email_per_person(fx.history(spark, sf_dir))


@register("p11_shortlist_candidates", O.with_views(
    """SELECT client, search_id, search_date, combined_score, last_email_date FROM sc""", SHORT_CTES))
def shortlist_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P14 + W8 + P11 + F21."""
    return _cands(spark, sf_dir).select("client", "search_id", "search_date", "combined_score",
                                        "last_email_date")


@register("a6_top_score_ties", O.with_views(
    """SELECT t.client, t.top_score, c.top_count, d.max_emails, c.top_count > d.max_emails AS tie
  FROM tops t JOIN cnt c ON t.client = c.client JOIN due d ON t.client = d.client""", SHORT_CTES))
def top_score_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A6 + W3 + P16: top combined score per due tenant, how many share it
    and whether that is a tie beyond ``max_emails``."""
    c = _cands(spark, sf_dir).join(_due_tenants(spark).select("client", "max_emails"), "client")
    top = c.groupBy("client", "max_emails").agg(F.max("combined_score").alias("top_score"))
    cnt = (c.join(top.select("client", "top_score"), "client")
           .filter(F.col("combined_score") == F.col("top_score"))
           .groupBy("client").agg(F.count(F.lit(1)).alias("top_count")))
    return top.join(cnt, "client").select(
        "client", "top_score", "top_count", "max_emails",
        (F.col("top_count") > F.col("max_emails")).alias("tie"))


@register("w4_weekly_shortlist", O.with_views(
    """SELECT client, search_id, first_name, last_name, company, search_date, combined_score,
       total_score, pick_rank, CASE WHEN tie THEN pick_rank END AS rank
  FROM picked""", SHORT_CTES))
def weekly_shortlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O5 + T8 + J3 + W4/O6 + P20: the best leads of every due tenant."""
    return picked(spark, sf_dir).select(
        "client", "search_id", "first_name", "last_name", "company", "search_date",
        "combined_score", "total_score", "pick_rank", "rank")


@register("a4_searches_since_email", O.with_views(
    """SELECT h.client, m.last_email_date,
       count(*) FILTER (WHERE h.search_date IS NOT NULL
                        AND (m.last_email_date IS NULL OR h.search_date > m.last_email_date))
         AS searches_since_last_email
  FROM history h JOIN (SELECT client, max(email_date) AS last_email_date FROM history GROUP BY client) m
    ON h.client = m.client
  GROUP BY h.client, m.last_email_date""", SHORT_CTES))
def searches_since_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4 + A5."""
    return SH.searches_since_last_email(fx.history(spark, sf_dir), fx.settings(spark))


@register("k6_history_update", O.with_views(
    f"""SELECT h.client, h.search_id,
       CASE WHEN p.search_id IS NOT NULL THEN {TODAY_SQL} ELSE h.email_date END AS email_date,
       CASE WHEN p.search_id IS NOT NULL THEN 'team@example.com' END AS email_batch_recipient,
       CASE WHEN p.search_id IS NOT NULL THEN h.company || ', ' || h.first_name || ' ' || h.last_name END
         AS email_subject,
       p.search_id IS NOT NULL AS emailed_now
  FROM history h LEFT JOIN picked p ON h.search_id = p.search_id""", SHORT_CTES))
def history_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K6 + J5 + F32: every history row, the picked ones marked e-mailed today."""
    p = picked(spark, sf_dir).join(
        maybe_broadcast(_due_tenants(spark).select("client", "email_batch_recipient")), "client")
    caption = F.format_string("%s, %s %s", "company", "first_name", "last_name")
    # picked <= tenants x k_max rows: proven small through the settings table.
    small = is_small(fx.settings(spark), max(1, rows_of(SH.LEAD_BYTES) // _k_max(spark)))
    u = SH.history_update(fx.history(spark, sf_dir), p, TODAY, caption,
                          F.col("email_batch_recipient"), picked_small=small)
    return u.select("client", "search_id", "email_date", "email_batch_recipient",
                    F.col("email_content").alias("email_subject"), "emailed_now")


@register("w6_ranking_requests", O.with_views(
    """SELECT client, CAST(floor((tie_no - 1) / 6) AS BIGINT) AS batch_no, count(*) AS n_texts,
       string_agg('<text first_name="' || first_name || '", last_name="' || last_name || '", company="'
                  || company || '">' || chr(10) || coalesce(x.text, 'None') || chr(10) || '</text>' || chr(10),
                  '' ORDER BY tie_no)
         || 'There are ' || count(*) || ' texts. You must return ' || count(*) || ' rankings' AS request
  FROM (SELECT f.*, row_number() OVER (PARTITION BY f.client ORDER BY f.search_id) AS tie_no
          FROM feat f WHERE tie) t
  LEFT JOIN documents x ON x.doc_id = t.search_id
 GROUP BY client, CAST(floor((tie_no - 1) / 6) AS BIGINT)""", SHORT_CTES))
def ranking_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W6 + F31: ranking requests of six tied texts for every due tenant."""
    return SH.ranking_requests(SH.tie_flags(_cands(spark, sf_dir), _due_tenants(spark)), fx.history_text(spark, sf_dir))
