"""Scalar text, date and JSON-payload operators over the driver's tables.

Inputs are the driver's own columns (page URLs, document texts, order dates,
event payloads); payload variants (valid, missing key, invalid) are derived
from each event row, so every branch of every parser is exercised at every
scale.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixtures as fx
from .. import oracle as O
from ..functions import payloads as PL
from ..functions import text as TX
from ..operators import selection as SL
from ..operators import steps as ST
from ..operators import token_counts as TK
from ..operators.sizing import maybe_broadcast
from ..registry import register
from .selection import AS_OF, CLEAN_CTES

# --- F1 / F8-F10: URLs ---------------------------------------------------

URL_CLEAN_SQL = """SELECT page_id,
       CASE WHEN length(regexp_extract(u, '^([^/?#]*)', 1)) > 0
            THEN regexp_extract(u, '^([^/?#]*)', 1)
                 || regexp_replace(regexp_extract(u, '^[^/?#]*([^?#]*)', 1), ';[^/]*$', '')
       END AS url_clean
  FROM (SELECT page_id, replace(replace(lower(url), 'http://', ''), 'https://', '') AS u FROM pages) p"""


@register("f1_clean_url", URL_CLEAN_SQL)
def clean_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1 on every page URL."""
    return fx.read(spark, sf_dir, "pages").select("page_id", TX.clean_url("url").alias("url_clean"))


def _link_text(pages: DataFrame) -> DataFrame:
    """Report-like text around each page URL, then F8 (tidy parentheses)."""
    raw = F.concat(F.lit("see ( "), F.col("url"), F.lit(" ) ok"))
    return pages.select("page_id", TX.tidy_url_parens(raw).alias("text"))


# RE2 twin of the find pattern, valid on these inputs (no look-ahead needed).
_FIND_RE2 = r"https?://[^\s()\[\]{},]+"
_TIDY_SQL = r"""regexp_replace('see ( ' || url || ' ) ok', '\(\s*(\bhttps?://[^\s\)]+)\s*\)', '(\1)')"""


@register("f9_find_urls", f"""SELECT page_id, text, len(regexp_extract_all(text, '{_FIND_RE2}')) AS n_urls,
       regexp_extract_all(text, '{_FIND_RE2}')[1] AS first_url
  FROM (SELECT page_id, {_TIDY_SQL} AS text FROM pages) t""")
def find_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8 + F9."""
    t = _link_text(fx.read(spark, sf_dir, "pages"))
    u = TX.find_urls("text")
    return t.select("page_id", "text", F.size(u).alias("n_urls"), F.try_element_at(u, F.lit(1)).alias("first_url"))


@register("f10_link_runs", f"""WITH t AS (SELECT page_id, {_TIDY_SQL} AS text FROM pages),
s AS (SELECT page_id, regexp_split_to_array(text, '{_FIND_RE2}') AS parts,
             regexp_extract_all(text, '{_FIND_RE2}') AS urls FROM t),
i AS (SELECT page_id, parts, urls, unnest(generate_series(1, len(parts))) AS i FROM s)
SELECT page_id, 2 * (i - 1) AS pos, 'text' AS kind,
       regexp_replace(parts[i], '^\\s+|\\s+$', '', 'g') AS value FROM i
UNION ALL
SELECT page_id, 2 * (i - 1) + 1, 'url', regexp_replace(urls[i], '^\\s+|\\s+$', '', 'g') FROM i
 WHERE i <= len(urls)""")
def link_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F10 + F11: text interleaved with its links as ordered report runs."""
    t = _link_text(fx.read(spark, sf_dir, "pages"))
    z = F.arrays_zip(TX.split_on_urls("text").alias("part"), TX.find_urls("text").alias("url"))
    runs = F.flatten(F.transform(z, lambda e, i: F.array(
        F.struct((i * 2).cast("bigint").alias("pos"), F.lit("text").alias("kind"),
                 TX.strip_ws(TX.unescape_newlines(e["part"])).alias("value")),
        F.struct((i * 2 + 1).cast("bigint").alias("pos"), F.lit("url").alias("kind"),
                 TX.strip_ws(e["url"]).alias("value")))))
    out = t.select("page_id", F.inline(runs))
    return out.filter(~((F.col("kind") == "url") & F.col("value").isNull()))


# --- F2 / F29: document text --------------------------------------------

@register("f2_ascii_text", """SELECT doc_id,
       length(regexp_replace(text, '[^\\x00-\\x7F]+', '', 'g')) AS ascii_chars,
       md5(regexp_replace(text, '[^\\x00-\\x7F]+', '', 'g')) AS ascii_md5
  FROM documents""")
def ascii_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F2 over whole document texts."""
    d = fx.read(spark, sf_dir, "documents").select("doc_id", TX.strip_non_ascii("text").alias("t"))
    return d.select("doc_id", F.length("t").alias("ascii_chars"), F.md5("t").alias("ascii_md5"))


@register("f29_token_count", """SELECT doc_id,
       len(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+')) AS n_tokens FROM documents""")
def token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F29 (native default of the pluggable token counter)."""
    return fx.read(spark, sf_dir, "documents").select("doc_id", TX.token_count("text").alias("n_tokens"))


@register("f29_tokenizer_counts")
def tokenizer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F29 plugged: every whole text counted by a real tokenizer (a library's
    merges: no SQL), the session's or a public one."""
    from public_tokenizers import path
    name = spark.conf.get(TK.CONF, None) or path("byte_bpe_50k.json")
    return fx.read(spark, sf_dir, "documents").select("doc_id", TK.counter(name)("text").alias("n_tokens"))


# --- F4 / F12 / F13 / T3: per-contact query text -------------------------

PERIOD_SQL = """CASE WHEN len(names) = 1 THEN names[1]
            WHEN len(names) = 2 THEN names[1] || ' and ' || names[2]
            WHEN len(names) <= 6 THEN array_to_string(names[1:len(names) - 1], ', ') || ', and ' || names[len(names)]
            ELSE names[1] || ' - ' || names[len(names)] END"""

PERIOD_CTES = CLEAN_CTES + [
    ("per", """SELECT *, CASE WHEN last_search_date > TIMESTAMP '2001-08-02 00:00:00'
                   THEN CAST(DATE '2001-08-02' - INTERVAL 3 MONTH AS DATE)
                   ELSE coalesce(CAST(last_search_date AS DATE), CAST(DATE '2001-08-02' - INTERVAL 2 MONTH AS DATE))
              END AS p0 FROM cands"""),
    ("named", """SELECT *, list_transform(generate_series(CAST(date_trunc('month', p0) AS TIMESTAMP),
                     TIMESTAMP '2001-08-02 00:00:00', INTERVAL 1 MONTH), lambda m: strftime(m, '%B %Y')) AS names
  FROM per"""),
]


@register("f4_search_period", O.with_views(
    f"""SELECT client, first_name, last_name, company, last_search_date, {PERIOD_SQL} AS search_period
  FROM named""", PERIOD_CTES))
def search_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F4 (D19: the period starts at each person's latest search)."""
    c = SL.candidates(fx.contacts(spark, sf_dir), fx.history(spark, sf_dir), AS_OF)
    return c.select("client", "first_name", "last_name", "company", "last_search_date",
                    TX.search_period("last_search_date", AS_OF).alias("search_period"))


@register("t3_standard_query", O.with_views(
    f"""SELECT named.client, first_name, last_name, company,
       replace(replace(replace(replace(coalesce(pr.body, '{fx.STANDARD_QUERY.replace("'", "''")}'),
         '{{candidate.first_name}}', first_name), '{{candidate.last_name}}', last_name),
         '{{candidate.company}}', company), '{{search_period}}', {PERIOD_SQL}) AS standard_query,
       'What kind of events, blogs and updates are typically published by ' || first_name || ' ' || last_name
         || ', who works as ' || coalesce(position, 'None') || ' at this company: ' || company
         || '. Ignore similar named companies and people. Focus on this one only.' AS event_question
  FROM named LEFT JOIN prompts pr ON pr.client = named.client AND pr.name = 'standard_query'""",
    PERIOD_CTES + [("prompts", O.PROMPTS)]))
def standard_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T3 + F12 + F13: the tenant's standard query rendered for every contact
    and the event-type question of T1."""
    c = SL.candidates(fx.contacts(spark, sf_dir), fx.history(spark, sf_dir), AS_OF)
    prompts = fx.prompts(spark).filter(F.col("name") == "standard_query").select(
        "client", F.col("body").alias("template"))
    c = c.join(maybe_broadcast(prompts), "client", "left")
    period = TX.search_period("last_search_date", AS_OF)
    q = TX.render_template(F.coalesce("template", F.lit(fx.STANDARD_QUERY)), {
        "candidate.first_name": F.col("first_name"), "candidate.last_name": F.col("last_name"),
        "candidate.company": F.col("company"), "search_period": period})
    return c.select("client", "first_name", "last_name", "company", q.alias("standard_query"),
                    TX.event_question("first_name", "last_name", "position", "company")
                    .alias("event_question"))


# --- F20: date formats ----------------------------------------------------

@register("f20_date_formats", O.with_views(
    """SELECT search_id, strftime(search_date, '%Y%m%d') AS day_label,
       strftime(search_date, '%Y%m%d_%H%M') AS stamp_label,
       strftime(search_date, '%a %d-%b-%Y') AS heading, strftime(search_date, '%d-%b') AS short_day,
       strftime(search_date, '%A') AS weekday, strftime(search_date, '%B %Y') AS month_label
  FROM history"""))
def date_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F20 over every search date."""
    d = F.col("search_date")
    return fx.history(spark, sf_dir).select(
        "search_id", F.date_format(d, TX.FMT_DAY).alias("day_label"),
        F.date_format(d, TX.FMT_STAMP).alias("stamp_label"),
        F.date_format(d, TX.FMT_HEADING).alias("heading"),
        F.date_format(d, TX.FMT_SHORT).alias("short_day"),
        F.date_format(d, TX.FMT_WEEKDAY).alias("weekday"),
        F.date_format(d, TX.FMT_MONTH).alias("month_label"))


# --- F15-F19, S9: payload parsers ---------------------------------------

def _events(spark, sf_dir):
    return fx.read(spark, sf_dir, "events").select("event_id", "props", (F.col("event_id") % 3).alias("m"))


def _variant(valid, missing, invalid):
    m = F.col("m")
    return F.when(m == 0, valid).when(m == 1, missing).otherwise(invalid)


def _sql_variant(valid, missing, invalid):
    return f"CASE event_id % 3 WHEN 0 THEN {valid} WHEN 1 THEN {missing} ELSE {invalid} END"


# Column builders are functions: nothing here may touch Spark at import time
# (the oracle SQL is read without a session).
def _p():
    return F.col("props")


def _eid():
    return F.col("event_id").cast("string")

def _score_json():
    P, EID = _p(), _eid()
    return _variant(
        F.replace(F.replace(P, F.lit('"k"'), F.lit('"services_need_score"')), F.lit("}"),
                  F.concat(F.lit(', "reasoning": "r", "summary_of_facts": "s'), EID, F.lit('"}'))),
        F.replace(P, F.lit('"k"'), F.lit('"services_need_score"')),
        F.concat(F.lit("{"), P))


SCORE_SQL = _sql_variant(
    """replace(replace(props, '"k"', '"services_need_score"'), '}', ', "reasoning": "r", "summary_of_facts": "s' || event_id || '"}')""",
    """replace(props, '"k"', '"services_need_score"')""", "'{' || props")


def _json_ok(j):
    return f"({j} IS NOT NULL)"


def _has(j, k):
    # ``j`` is already NULL when the text is not valid JSON (see _valid).
    return f"coalesce(list_contains(json_keys({j}), '{k}'), FALSE)"


def _valid(expr):
    return f"CASE WHEN coalesce(json_valid({expr}), FALSE) THEN {expr} END"


def _int(j, k):
    return f"CAST(trunc(TRY_CAST(json_extract_string({j}, '$.{k}') AS DOUBLE)) AS BIGINT)"


@register("f15_target_score", f"""WITH e AS (SELECT event_id, {_valid(SCORE_SQL)} AS j FROM events),
o AS (SELECT event_id, {_has('j', 'services_need_score')} AND {_has('j', 'reasoning')}
        AND {_has('j', 'summary_of_facts')} AND {_int('j', 'services_need_score')} IS NOT NULL AS ok, j FROM e)
SELECT event_id, CAST(0 AS BIGINT) AS activity_score,
       CASE WHEN ok THEN {_int('j', 'services_need_score')} ELSE 0 END AS services_need_score,
       CASE WHEN ok THEN json_extract_string(j, '$.summary_of_facts') ELSE '' END AS summary
  FROM o""")
def target_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F15."""
    e = _events(spark, sf_dir).select("event_id", PL.target_score(_score_json()).alias("s"))
    return e.select("event_id", "s.*")


def _novelty_json():
    P, EID = _p(), _eid()
    return _variant(
        F.replace(F.replace(P, F.lit('"k"'), F.lit('"novelty_score"')), F.lit("}"),
                  F.concat(F.lit(', "reasoning": "because '), EID, F.lit('"}'))),
        F.replace(P, F.lit('"k"'), F.lit('"reasoning"')),
        F.concat(F.lit("{"), P))


NOVELTY_SQL = _sql_variant(
    """replace(replace(props, '"k"', '"novelty_score"'), '}', ', "reasoning": "because ' || event_id || '"}')""",
    """replace(props, '"k"', '"reasoning"')""", "'{' || props")


@register("f16_novelty_payload", f"""WITH e AS (SELECT event_id, {_valid(NOVELTY_SQL)} AS j FROM events)
SELECT event_id,
       CASE WHEN NOT {_json_ok('j')} THEN -1 WHEN NOT {_has('j', 'novelty_score')} THEN -1
            WHEN NOT {_has('j', 'reasoning')} THEN -1 ELSE {_int('j', 'novelty_score')} END AS novelty_score,
       CASE WHEN NOT {_json_ok('j')} THEN 'Error: Invalid JSON'
            WHEN NOT {_has('j', 'novelty_score')} THEN 'Error: Missing key in JSON: ''novelty_score'''
            WHEN NOT {_has('j', 'reasoning')} THEN 'Error: Missing key in JSON: ''reasoning'''
            ELSE json_extract_string(j, '$.reasoning') END AS reasoning
  FROM e""")
def novelty_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F16."""
    e = _events(spark, sf_dir).select("event_id", PL.novelty(_novelty_json()).alias("s"))
    return e.select("event_id", "s.*")


def _queries_json():
    P, EID = _p(), _eid()
    return _variant(
        F.concat(F.lit('{"search_queries": ["'), F.replace(P, F.lit('"'), F.lit("")), F.lit('", "q'), EID,
                 F.lit('"]}')),
        P, F.concat(F.lit("["), P))


QUERIES_SQL = _sql_variant(
    """'{"search_queries": ["' || replace(props, '"', '') || '", "q' || event_id || '"]}'""",
    "props", "'[' || props")


@register("f17_search_queries", f"""WITH e AS (SELECT event_id, {_valid(QUERIES_SQL)} AS j FROM events)
SELECT event_id, coalesce(CASE WHEN {_json_ok('j')} THEN
         from_json(j, '{{"search_queries": ["VARCHAR"]}}').search_queries END, []) AS queries,
       coalesce(array_to_string(CASE WHEN {_json_ok('j')} THEN
         from_json(j, '{{"search_queries": ["VARCHAR"]}}').search_queries END, chr(10) || '===' || chr(10)), '')
         AS query_text
  FROM e""")
def search_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F17 + F5."""
    e = _events(spark, sf_dir).select("event_id", PL.search_queries(_queries_json()).alias("queries"))
    return e.select("event_id", "queries", TX.join_queries("queries").alias("query_text"))


RANK_PREFIX = '{"rankings": [{"first_name": "a", "last_name": "b", "company": "c", "rank": '
def _rank_json():
    P, EID = _p(), _eid()
    return _variant(
        F.concat(F.replace(P, F.lit('{"k": '), F.lit(RANK_PREFIX)), F.lit("]}")),
        P, F.concat(F.lit("{"), P))


RANK_SQL = _sql_variant(
    f"""replace(props, '{{"k": ', '{RANK_PREFIX}') || ']}}'""", "props", "'{' || props")


@register("f18_rankings", f"""WITH e AS (SELECT event_id, {_valid(RANK_SQL)} AS j FROM events),
r AS (SELECT event_id, CASE WHEN NOT {_json_ok('j')}
         THEN [{{'first_name': 'Unknown', 'last_name': 'Unknown', 'company': 'Unknown', 'rank': CAST(-1 AS BIGINT)}}]
         ELSE coalesce(from_json(j, '{{"rankings": [{{"first_name": "VARCHAR", "last_name": "VARCHAR", "company": "VARCHAR", "rank": "BIGINT"}}]}}').rankings, [])
         END AS rs FROM e),
u AS (SELECT event_id, unnest(rs) AS x FROM r)
SELECT event_id, x.first_name AS first_name, x.last_name AS last_name, x.company AS company, x.rank AS rank
  FROM u""")
def rankings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F18 (JSON -> rows)."""
    e = _events(spark, sf_dir).select("event_id", PL.rankings(_rank_json()).alias("rs"))
    return e.select("event_id", F.inline("rs"))


def _url_json():
    P, EID = _p(), _eid()
    return _variant(
        F.concat(F.lit('{"url_facebook": "https://facebook.com/p'), EID,
                 F.lit('", "url_linkedin": "https://linkedin.com/in/p'), EID,
                 F.lit('", "url_company": "https://c'), EID, F.lit('.example.com"}')),
        F.concat(F.lit('{"url_facebook": "https://facebook.com/p'), EID,
                 F.lit('", "url_company": "https://c'), EID, F.lit('.example.com"}')),
        F.concat(F.lit("{"), P))


URL_SQL = _sql_variant(
    """'{"url_facebook": "https://facebook.com/p' || event_id || '", "url_linkedin": "https://linkedin.com/in/p' || event_id || '", "url_company": "https://c' || event_id || '.example.com"}'""",
    """'{"url_facebook": "https://facebook.com/p' || event_id || '", "url_company": "https://c' || event_id || '.example.com"}'""",
    "'{' || props")


@register("f19_url_payload", f"""WITH e AS (SELECT event_id, {_valid(URL_SQL)} AS j FROM events)
SELECT event_id,
       CASE WHEN {_has('j', 'url_facebook')} THEN json_extract_string(j, '$.url_facebook') ELSE '' END AS url_facebook,
       CASE WHEN {_has('j', 'url_facebook')} AND {_has('j', 'url_linkedin')}
            THEN json_extract_string(j, '$.url_linkedin') ELSE '' END AS url_linkedin,
       CASE WHEN {_has('j', 'url_facebook')} AND {_has('j', 'url_linkedin')} AND {_has('j', 'url_company')}
            THEN json_extract_string(j, '$.url_company') ELSE '' END AS url_company
  FROM e""")
def url_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F19."""
    e = _events(spark, sf_dir).select("event_id", PL.urls(_url_json()).alias("s"))
    return e.select("event_id", "s.*")


_STEP_NAMES = ["target_score_agent", "results_comparison_agent", "url_extraction_agent", "search_proposal_agent",
               "results_ranking_agent"]


def _steps_sql() -> str:
    """Written apart from the operator's step table."""
    answer = "CASE event_id % 5 " + " ".join(f"WHEN {i} THEN {sql}" for i, sql in enumerate(
        [SCORE_SQL, NOVELTY_SQL, URL_SQL, QUERIES_SQL, RANK_SQL])) + " END"
    name = "CASE event_id % 5 " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(_STEP_NAMES)) + " END"
    missing = lambda *keys: " ".join(
        f"WHEN NOT {_has('j', k)} THEN 'Error: Missing key in JSON: ''{k}'''" for k in keys)
    rank = '{"rankings": [{"first_name": "VARCHAR", "last_name": "VARCHAR", "company": "VARCHAR", "rank": "BIGINT"}]}'
    return f"""WITH r AS (SELECT event_id, event_id % 5 AS k, {name} AS function,
         CASE WHEN event_id % 7 = 0 THEN 'TimeoutError: no answer' END AS error, {answer} AS response FROM events),
v AS (SELECT *, CASE WHEN error IS NULL THEN {_valid('response')} END AS j FROM r),
w AS (SELECT *, CASE WHEN error IS NOT NULL THEN error WHEN j IS NULL THEN 'Error: Invalid JSON'
         WHEN k = 0 THEN CASE {missing('services_need_score', 'reasoning', 'summary_of_facts')} END
         WHEN k = 1 THEN CASE {missing('novelty_score', 'reasoning')} END
         WHEN k = 2 THEN CASE {missing('url_facebook', 'url_linkedin', 'url_company')} END
         WHEN k = 3 THEN CASE {missing('search_queries')} END
         ELSE CASE {missing('rankings')} END END AS problem FROM v)
SELECT event_id, function, problem,
  CASE WHEN k = 0 THEN CASE WHEN problem IS NULL AND {_int('j', 'services_need_score')} IS NOT NULL
    THEN {_int('j', 'services_need_score')} ELSE 0 END END AS services_need_score,
  CASE WHEN k = 0 THEN CASE WHEN problem IS NULL AND {_int('j', 'services_need_score')} IS NOT NULL
    THEN json_extract_string(j, '$.summary_of_facts') ELSE '' END END AS summary,
  CASE WHEN k = 1 THEN CASE WHEN problem IS NULL THEN {_int('j', 'novelty_score')} ELSE -1 END END AS novelty_score,
  CASE WHEN k = 2 THEN CASE WHEN {_has('j', 'url_facebook')} THEN json_extract_string(j, '$.url_facebook') ELSE '' END END AS url_facebook,
  CASE WHEN k = 2 THEN CASE WHEN {_has('j', 'url_facebook')} AND {_has('j', 'url_linkedin')} AND {_has('j', 'url_company')}
    THEN json_extract_string(j, '$.url_company') ELSE '' END END AS url_company,
  CASE WHEN k = 3 THEN CASE WHEN problem IS NULL THEN len(from_json(j, '{{"search_queries": ["VARCHAR"]}}').search_queries) ELSE 0 END END
    AS n_queries,
  CASE WHEN k = 4 THEN CASE WHEN j IS NULL THEN -1 WHEN problem IS NOT NULL THEN NULL
    ELSE from_json(j, '{rank}').rankings[1].rank END END AS first_rank
FROM w"""


@register("t14_failure_values", _steps_sql())
def failure_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One answer per event, dealt over the five steps: good ones, errored calls, bad JSON, missing keys."""
    k = F.col("event_id") % 5
    answers = [_score_json(), _novelty_json(), _url_json(), _queries_json(), _rank_json()]
    pick = lambda values: reduce(lambda a, x: a.when(k == x[0], x[1]), enumerate(values[1:], 1), F.when(k == 0, values[0]))
    e = _events(spark, sf_dir).select(
        "event_id", pick([F.lit(n) for n in _STEP_NAMES]).alias("function"), pick(answers).alias("response"),
        F.when(F.col("event_id") % 7 == 0, "TimeoutError: no answer").alias("error"))
    o = ST.outcomes(e)
    ranks = F.col("results_ranking_agent.rankings")
    return o.select(
        "event_id", "function", "problem", "target_score_agent.services_need_score", "target_score_agent.summary",
        "results_comparison_agent.novelty_score", "url_extraction_agent.url_facebook", "url_extraction_agent.url_company",
        F.when(k == 3, F.size("search_proposal_agent.search_queries")).cast("bigint").alias("n_queries"),
        F.try_element_at(ranks, F.lit(1))["rank"].alias("first_rank"))


@register("s9_search_reply", """WITH r AS (SELECT page_id,
       CASE WHEN page_id % 2 = 0 THEN '[{''title'': ''p' || page_id || ''', ''link'': ''' || url || '''}]'
            ELSE 'no results' END AS reply FROM pages),
j AS (SELECT page_id, replace(reply, '''', '"') AS j FROM r)
SELECT page_id, len(h) AS n_hits, h[1].link AS first_link
  FROM (SELECT page_id, coalesce(CASE WHEN coalesce(json_valid(j), FALSE)
          THEN from_json(j, '[{"title": "VARCHAR", "link": "VARCHAR"}]') END, []) AS h FROM j) x""")
def search_reply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search replies given as single-quoted list literals."""
    pg = fx.read(spark, sf_dir, "pages")
    reply = F.when(F.col("page_id") % 2 == 0, F.concat(
        F.lit("[{'title': 'p"), F.col("page_id").cast("string"), F.lit("', 'link': '"), F.col("url"),
        F.lit("'}]"))).otherwise(F.lit("no results"))
    h = pg.select("page_id", PL.search_hits(reply).alias("h"))
    return h.select("page_id", F.size("h").alias("n_hits"), F.try_element_at("h", F.lit(1))["link"].alias("first_link"))
