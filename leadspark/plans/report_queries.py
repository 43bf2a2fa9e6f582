"""Checks, history views and the lead report plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixtures as fx
from .. import oracle as O
from ..operators import checks as CK
from ..operators import pricing as P
from ..operators import report as RP
from ..operators import shortlist as SH
from ..operators.sizing import maybe_broadcast
from ..registry import register
from .shortlist import SHORT_CTES, TODAY, _due_tenants, picked

ROWS_PER_PAGE = 20
PAGE = 9


@register("w1_price_sequence", O.with_views(
    """SELECT model, ord, start_date, end_date, next_start, issue FROM (
  SELECT *, CASE WHEN next_start IS NULL THEN NULL WHEN end_date IS NULL THEN 'open_ended'
                 WHEN end_date < next_start THEN 'gap' END AS issue
    FROM (SELECT model, ord, start_date, end_date,
                 lead(start_date) OVER (PARTITION BY model ORDER BY start_date, ord) AS next_start
            FROM pricing) s) t
 WHERE issue IS NOT NULL AND model IN (SELECT DISTINCT model FROM consumption)"""))
def price_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W1 / C8 for the models in use."""
    seq = P.price_sequence_issues(fx.pricing(spark))
    # Distinct models in use: materialised once (a short list), then checked.
    used = fx.consumption(spark, sf_dir).select("model").distinct().checkpoint(eager=True)
    used = F.broadcast(used) if P.is_small(used, P.MAX_BROADCAST_PRICE_ROWS) else used
    return seq.join(used, "model", "left_semi")


CHECKS_SQL = O.with_views("""SELECT client, 'model_without_price' AS "check", model AS key,
       'no price for this model' AS detail
  FROM (SELECT DISTINCT client, model FROM consumption WHERE model NOT IN (SELECT model FROM pricing)) m
UNION ALL
SELECT NULL, 'price_sequence', model || '#' || ord, issue FROM (
  SELECT *, CASE WHEN next_start IS NULL THEN NULL WHEN end_date IS NULL THEN 'open_ended'
                 WHEN end_date < next_start THEN 'gap' END AS issue
    FROM (SELECT model, ord, start_date, end_date,
                 lead(start_date) OVER (PARTITION BY model ORDER BY start_date, ord) AS next_start
            FROM pricing) s) t WHERE issue IS NOT NULL
UNION ALL
SELECT client, 'usage_missing_fields', CAST(usage_id AS VARCHAR), 'missing required fields: '
       || array_to_string(list_filter([CASE WHEN function IS NULL THEN 'function' END,
            CASE WHEN model IS NULL THEN 'model' END, CASE WHEN search_calls IS NULL THEN 'search_calls' END,
            CASE WHEN input_tokens IS NULL THEN 'input_tokens' END,
            CASE WHEN output_tokens IS NULL THEN 'output_tokens' END], lambda x: x IS NOT NULL), ', ')
  FROM consumption
 WHERE function IS NULL OR model IS NULL OR search_calls IS NULL OR input_tokens IS NULL
    OR output_tokens IS NULL
UNION ALL
SELECT client, 'mini_batch', client, 'mini_batch_size must be <= batch_size' FROM settings
 WHERE coalesce(mini_batch_size, 0) > coalesce(batch_size, 0)
UNION ALL
SELECT client, 'max_tavily', client, 'max_tavily_searches must be in 1..19' FROM settings
 WHERE NOT coalesce(max_tavily_searches > 0 AND max_tavily_searches < 20, FALSE)
UNION ALL
SELECT client, 'max_pplx', client, 'max_pplx_searches must be in 1..9' FROM settings
 WHERE NOT coalesce(max_pplx_searches > 0 AND max_pplx_searches < 10, FALSE)
UNION ALL
SELECT client, 'batch_size', client, 'batch_size must be in 1..999' FROM settings
 WHERE NOT coalesce(batch_size > 0 AND batch_size < 1000, FALSE)
UNION ALL
SELECT client, 'llm_search', client, 'llm_search must be gpt-4o-mini, gpt-4o or gpt-4' FROM settings
 WHERE NOT coalesce(llm_search IN ('gpt-4o-mini', 'gpt-4o', 'gpt-4'), FALSE)
UNION ALL
SELECT client, 'llm_email', client, 'llm_email must start with gpt-4o' FROM settings
 WHERE NOT coalesce(starts_with(llm_email, 'gpt-4o'), FALSE)
UNION ALL
SELECT client, 'missing_max_emails', client, 'max_emails must be given' FROM settings WHERE max_emails IS NULL
UNION ALL
SELECT client, 'missing_mini_batch_size', client, 'mini_batch_size must be given' FROM settings WHERE mini_batch_size IS NULL
UNION ALL
SELECT client, 'send_flag', client, 'send_proposed_emails must be true or false' FROM settings
 WHERE send_proposed_emails IS NULL
UNION ALL
SELECT client, 'email_days', client, 'at least one weekday is needed' FROM settings
 WHERE coalesce(len(email_days_of_week) < 1, TRUE)""")


@register("c5_quality_checks", CHECKS_SQL)
def quality_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C4 + C5 + C7 + C8 as one (client, check, key, detail) table."""
    return CK.all_checks(fx.settings(spark), fx.pricing(spark), fx.consumption(spark, sf_dir))


PAGES_SQL = O.with_views(f"""SELECT client, search_id, search_date,
       row_number() OVER (PARTITION BY client ORDER BY search_date DESC, search_id) AS row_no,
       CAST(floor((row_number() OVER (PARTITION BY client ORDER BY search_date DESC, search_id) - 1)
            / {ROWS_PER_PAGE}) AS BIGINT) + 1 AS page_no,
       CAST(ceil(count(*) OVER (PARTITION BY client) / {ROWS_PER_PAGE}) AS BIGINT) AS n_pages
  FROM history""")


def _paged(spark, sf_dir):
    h = fx.history(spark, sf_dir).select("client", "search_id", "search_date")
    return RP.history_pages(h, ROWS_PER_PAGE, [F.col("search_date").desc(), F.col("search_id")])


@register("w7_history_pages", PAGES_SQL)
def history_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O7 + W7: newest-first history with row, page and page count."""
    return _paged(spark, sf_dir).select("client", "search_id", "search_date", "row_no", "page_no",
                                        "n_pages")


@register("o8_history_page", f"""SELECT * FROM ({PAGES_SQL}) p
 WHERE page_no = least(greatest({PAGE}, 1), n_pages)""")
def history_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page 9 of every tenant's history, clamped to the last page."""
    return RP.history_page(_paged(spark, sf_dir), PAGE).select(
        "client", "search_id", "search_date", "row_no", "page_no", "n_pages")


@register("u1_usage_union", O.with_views("""SELECT client, usage_id, model, input_tokens, output_tokens
  FROM consumption WHERE model = 'click'
UNION ALL
SELECT client, usage_id, model, input_tokens, NULL FROM consumption WHERE model <> 'click'"""))
def usage_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two usage frames concatenated by column name, missing columns
    null (one frame lacks ``output_tokens``)."""
    u = fx.consumption(spark, sf_dir)
    a = u.filter(F.col("model") == "click").select("client", "usage_id", "model", "input_tokens",
                                                   "output_tokens")
    b = u.filter(F.col("model") != "click").select("model", "usage_id", "client", "input_tokens")
    return a.unionByName(b, allowMissingColumns=True)


@register("u3_unpriced_models", O.with_views(
    "SELECT model FROM consumption EXCEPT SELECT model FROM pricing"))
def unpriced_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set difference of model names (EXCEPT DISTINCT)."""
    return fx.consumption(spark, sf_dir).select("model").subtract(fx.pricing(spark).select("model"))


def leads_with_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shortlisted leads with their T9 draft (tenant template + business
    text from the prompts table, default when the tenant has none)."""
    from ..sources.tables import prompt_for
    p = SH.with_texts(picked(spark, sf_dir), fx.history_text(spark, sf_dir))
    names = _due_tenants(spark).select(
        "client", F.explode(F.array(F.lit("email_template"), F.lit("business_description"))).alias("name"))
    texts = prompt_for(names, fx.prompts(spark), fx.default_prompts(spark)).groupBy("client").pivot(
        "name", ["email_template", "business_description"]).agg(F.first("body"))
    j = p.join(maybe_broadcast(texts), "client", "left")
    return j.withColumn("email_content", RP.draft_email(
        F.col("email_template"), F.col("business_description"), F.col("search_results"),
        F.col("first_name"), F.col("last_name"), F.col("company")))


_TOKS = r"list_distinct(regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}]+'))"


def _render_sql(t):
    r = f"replace(replace({t}, '{{{{', chr(1)), '}}}}', chr(2))"
    for name, col in [("first_name", "first_name"), ("last_name", "last_name"), ("company", "company"),
                      ("search_name_first", "first_name"), ("search_name_last", "last_name"),
                      ("search_company", "company")]:
        r = f"replace({r}, '{{{name}}}', coalesce({col}, 'None'))"
    return f"replace(replace({r}, chr(1), '{{'), chr(2), '}}')"


DRAFT_CTES = [
    ("prompts", O.PROMPTS),
    ("defaults", f"""SELECT * FROM (VALUES {O._values(fx.DEFAULT_PROMPT_ROWS)}) AS t(name, body)"""),
    ("leads", """SELECT p.client, p.search_id, p.pick_rank, p.first_name, p.last_name, p.company,
       x.text AS search_results,
       coalesce((SELECT body FROM prompts r WHERE r.client = p.client AND r.name = 'email_template'),
                (SELECT body FROM defaults d WHERE d.name = 'email_template')) AS email_template,
       coalesce((SELECT body FROM prompts r WHERE r.client = p.client AND r.name = 'business_description'),
                (SELECT body FROM defaults d WHERE d.name = 'business_description')) AS business
  FROM picked p LEFT JOIN documents x ON x.doc_id = p.search_id"""),
    ("paras", f"""SELECT search_id, p, i,
       len(list_intersect({_TOKS.format(x='p')}, {_TOKS.format(x="coalesce(search_results, '')")})) AS n
  FROM (SELECT search_id, search_results, unnest(ps) AS p, unnest(generate_series(1, len(ps))) AS i
          FROM (SELECT search_id, search_results,
                       list_filter(regexp_split_to_array(coalesce(business, ''), '\\n\\s*\\n'),
                                   lambda q: length(q) > 0) AS ps FROM leads) a) b"""),
    ("best", "SELECT search_id, arg_max(p, n * 1000000 - i) AS best FROM paras GROUP BY search_id"),
    ("drafted", f"""SELECT l.*, CASE WHEN b.best IS NOT NULL
            THEN {_render_sql('l.email_template')} || chr(10) || chr(10) || b.best
            ELSE {_render_sql('l.email_template')} END AS text0
  FROM leads l LEFT JOIN best b ON l.search_id = b.search_id"""),
    ("mailed", "SELECT *, text0 AS email_content FROM drafted"),
]


@register("t9_email_drafts", O.with_views(
    """SELECT client, search_id, pick_rank,
       'Proposed email for ' || first_name || ' ' || last_name || ' of ' || company AS email_subject,
       email_content,
       email_content || chr(10) || '=======================' || chr(10)
         || 'This proposed email follows from the below search results:' || chr(10)
         || coalesce(search_results, 'None') AS email_with_evidence,
       CAST(len(regexp_extract_all(email_content, '[^ \\t\\n\\x0B\\f\\r]+')) AS BIGINT) AS n_words,
       len(regexp_extract_all(email_content, '[^ \\t\\n\\x0B\\f\\r]+')) > 200 AS over_limit
  FROM mailed""", SHORT_CTES + DRAFT_CTES))
def email_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The proposed e-mail of every shortlisted lead (F33 subject)."""
    from ..functions import text as TX
    j = leads_with_email(spark, sf_dir)
    return j.select("client", "search_id", "pick_rank",
                    TX.email_subject("first_name", "last_name", "company").alias("email_subject"),
                    "email_content",
                    TX.with_evidence("email_content", "search_results").alias("email_with_evidence"),
                    *RP.draft_size(F.col("email_content")))


_FIND2 = r"https?://[^\s()\[\]{},]+"
_STRIP = "regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
REPORT_CTES = [
    ("since", """SELECT h.client, count(*) FILTER (WHERE h.search_date IS NOT NULL
                        AND (m.last_email_date IS NULL OR h.search_date > m.last_email_date)) AS n_since
  FROM history h JOIN (SELECT client, max(email_date) AS last_email_date FROM history GROUP BY client) m
    ON h.client = m.client GROUP BY h.client"""),
    ("cap", """SELECT *, company || ', ' || first_name || ' ' || last_name AS caption,
       regexp_replace(replace(coalesce(search_results, ''), '\\n', chr(10)),
                      '\\(\\s*(\\bhttps?://[^\\s\\)]+)\\s*\\)', '(\\1)', 'g') AS body
  FROM mailed
 WHERE client IN (SELECT client FROM settings WHERE NOT send_proposed_emails)"""),
    ("pieces", f"""SELECT *, regexp_split_to_array(body, '{_FIND2}') AS parts,
       regexp_extract_all(body, '{_FIND2}') AS urls FROM cap"""),
    ("runs", f"""SELECT client, pick_rank, 2 * (i - 1) AS k, 'text' AS kind, {_STRIP.format(x='parts[i]')} AS text,
       CAST(NULL AS VARCHAR) AS url
  FROM (SELECT *, unnest(generate_series(1, len(parts))) AS i FROM pieces) a
UNION ALL
SELECT client, pick_rank, 2 * (i - 1) + 1, 'link', {_STRIP.format(x='urls[i]')}, {_STRIP.format(x='urls[i]')}
  FROM (SELECT *, unnest(generate_series(1, len(parts))) AS i FROM pieces) a WHERE i <= len(urls)"""),
    ("nruns", "SELECT client, pick_rank, count(*) AS n_runs FROM runs GROUP BY client, pick_rank"),
    ("tenants_r", """SELECT c.client, count(*) AS n_leads, coalesce(max(s.n_since), 0) AS n_since
  FROM cap c LEFT JOIN since s ON c.client = s.client GROUP BY c.client"""),
]

REPORT_SQL = O.with_views("""SELECT client, 0 AS section_no, 1 AS line_no, 'h1' AS kind, 'Proposed Leads' AS text,
       CAST(NULL AS VARCHAR) AS url FROM tenants_r
UNION ALL SELECT client, 0, 2, 'p', 'As of Thu 02-Aug-2001', NULL FROM tenants_r
UNION ALL SELECT client, 0, 3, 'p', 'Since the last email, ' || n_since
       || ' searches were completed. These are the most promising leads:', NULL FROM tenants_r
UNION ALL SELECT client, 0, 4, 'h2', 'Contents', NULL FROM tenants_r
UNION ALL SELECT client, 0, n_leads + 5, 'h2', 'Results', NULL FROM tenants_r
UNION ALL SELECT client, n_leads + 1, 0, 'h2', 'End of Report', NULL FROM tenants_r
UNION ALL SELECT client, 0, pick_rank + 4, 'li', caption, NULL FROM cap
UNION ALL SELECT client, pick_rank, 0, 'h3', caption, NULL FROM cap
UNION ALL SELECT client, pick_rank, 1, 'p', 'Search Date: ' || strftime(search_date, '%a %d-%b-%Y'), NULL
  FROM cap c JOIN history h USING (search_id, client)
UNION ALL SELECT client, pick_rank, k + 2, kind, text, url FROM runs
UNION ALL SELECT c.client, c.pick_rank, n.n_runs + 2, 'bold', 'Proposed Email', NULL
  FROM cap c JOIN nruns n ON c.client = n.client AND c.pick_rank = n.pick_rank
UNION ALL SELECT c.client, c.pick_rank, n.n_runs + 3, 'p', coalesce(c.email_content, ''), NULL
  FROM cap c JOIN nruns n ON c.client = n.client AND c.pick_rank = n.pick_rank
UNION ALL SELECT c.client, c.pick_rank, n.n_runs + 4, 'p', repeat('_', 50), NULL
  FROM cap c JOIN nruns n ON c.client = n.client AND c.pick_rank = n.pick_rank""",
    SHORT_CTES + DRAFT_CTES + REPORT_CTES)


@register("k8_report_rows", REPORT_SQL)
def report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K8 + A4: the lead report of every due tenant as ordered lines."""
    leads = RP.reported(leads_with_email(spark, sf_dir), _due_tenants(spark))
    since = SH.searches_since_last_email(fx.history(spark, sf_dir), fx.settings(spark))
    return RP.report_lines(leads, since, TODAY).select(
        "client", "section_no", "line_no", "kind", "text", "url")
