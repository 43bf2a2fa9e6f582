"""Native enrichment plans over the driver's corpus tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixtures as fx
from .. import oracle as O
from ..operators import enrich as EN
from ..operators import rubric as RB
from ..operators import search_index as SI
from ..operators.sizing import spread
from ..registry import register

_TOK = r"[\p{L}\p{N}]+"


def _tok(x):
    return f"regexp_extract_all(lower({x}), '{_TOK}')"


SEARCH_SQL = f"""WITH q AS (SELECT DISTINCT item_id AS q_id, unnest({_tok('text')}) AS term FROM benchmark),
qt AS (SELECT DISTINCT term FROM q),
d AS (SELECT doc_id, unnest({_tok('text')}) AS term FROM documents),
tf AS (SELECT doc_id, d.term, count(*) AS tf FROM d JOIN qt ON d.term = qt.term GROUP BY doc_id, d.term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
n AS (SELECT count(*) AS n FROM documents),
s AS (SELECT q.q_id, tf.doc_id, sum(tf.tf * ln(1 + n.n / df.df)) AS raw_score
        FROM q JOIN tf ON q.term = tf.term JOIN df ON df.term = q.term, n GROUP BY q.q_id, tf.doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY round(raw_score, 9) DESC, doc_id) AS rank FROM s)
SELECT q_id, rank, doc_id, round(raw_score, 6) AS score FROM r WHERE rank <= 3"""


def corpus_index(spark: SparkSession, sf_dir: str) -> SI.Index:
    """The stored index of the whole corpus, extended by documents that are new."""
    docs = fx.read(spark, sf_dir, "documents").select("doc_id", "text")
    return SI.extend(docs, SI.shared_path(spark, sf_dir))


@register("t4_corpus_search", SEARCH_SQL)
def corpus_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4: every benchmark passage searched (whole text) in the whole
    document corpus; top 3 documents each."""
    q = fx.read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("q_id"), F.col("text").alias("query"))
    return SI.search(corpus_index(spark, sf_dir), q, k=3)


def _link_text_col():
    pid = F.col("page_id").cast("string")
    return F.concat(
        F.when(F.col("page_id") % 5 == 0, F.lit("Profile https://facebook.com/ and "))
        .otherwise(F.concat(F.lit("Profile https://www.facebook.com/p"), pid, F.lit(" and "))),
        F.lit("("), F.col("url"), F.lit(") then https://linkedin.com/in/u"), (F.col("page_id") % 7).cast("string"),
        F.when(F.col("page_id") % 4 == 0, F.lit("")).otherwise(F.concat(F.lit(" also "), F.col("url"))),
        F.lit(" or https://news.example.org/a"), (F.col("page_id") % 3).cast("string"))


_LINK_TEXT_SQL = """CASE WHEN page_id % 5 = 0 THEN 'Profile https://facebook.com/ and '
            ELSE 'Profile https://www.facebook.com/p' || page_id || ' and ' END
       || '(' || url || ') then https://linkedin.com/in/u' || (page_id % 7)
       || CASE WHEN page_id % 4 = 0 THEN '' ELSE ' also ' || url END
       || ' or https://news.example.org/a' || (page_id % 3)"""
_FIND = r"https?://[^\s()\[\]{},]+"
_HOSTX = r"""regexp_replace(regexp_extract(lower(x), '^[a-z]+://([^/?#:]+)', 1), '^www\.', '')"""

URLS_SQL = f"""WITH t AS (SELECT page_id, {_LINK_TEXT_SQL} AS text FROM pages),
u AS (SELECT page_id, regexp_extract_all(text, '{_FIND}') AS urls FROM t),
hs AS (SELECT page_id, urls, list_filter(list_transform(urls, lambda x: {_HOSTX}),
          lambda h: length(h) > 0 AND NOT regexp_matches(h, '(^|\\.)(facebook|linkedin)\\.com$')) AS hosts FROM u),
h AS (SELECT page_id, unnest(hosts) AS host, unnest(generate_series(1, len(hosts))) AS pos FROM hs),
c AS (SELECT page_id, host, count(*) AS n, min(pos) AS p FROM h GROUP BY page_id, host),
b AS (SELECT page_id, arg_max(host, n * 1000000 - p) AS host FROM c GROUP BY page_id)
SELECT hs.page_id,
       coalesce(list_filter(urls, lambda x: regexp_matches(lower(x), '^https?://([a-z0-9-]+\\.)*facebook\\.com/[^/?#]'))[1], '')
         AS url_facebook,
       coalesce(list_filter(urls, lambda x: regexp_matches(lower(x), '^https?://([a-z0-9-]+\\.)*linkedin\\.com/in/'))[1], '')
         AS url_linkedin,
       coalesce('https://' || b.host, '') AS url_company
  FROM hs LEFT JOIN b ON hs.page_id = b.page_id"""


@register("t5_url_extraction", URLS_SQL)
def url_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T5 on a result text per page (the page URL among social links)."""
    pg = fx.read(spark, sf_dir, "pages").select("page_id", _link_text_col().alias("text"))
    return pg.select("page_id", EN.extract_urls("text").alias("u")).select("page_id", "u.*")


def _rubric_sql(x):
    parts = [f"CASE WHEN regexp_matches(lower({x}), '{EN.word_pattern_re2(kw)}') THEN {pts} ELSE 0 END"
             for _, pts, kw in EN.RUBRIC]
    return " + ".join(parts)


_ANY_FACT = EN.word_pattern_re2(EN.any_keyword())

RUBRIC_SQL = f"""SELECT doc_id, CAST(0 AS BIGINT) AS activity_score,
       CAST(least({_rubric_sql("coalesce(text, '')")}, 10) AS BIGINT) AS services_need_score,
       md5(array_to_string(list_filter(string_split(coalesce(text, ''), chr(10)),
           lambda s: regexp_matches(lower(s), '{_ANY_FACT}')), chr(10))) AS summary_md5
  FROM documents"""


@register("t6_rubric_score", RUBRIC_SQL)
def rubric_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T6 on every whole document text."""
    docs = spread(fx.read(spark, sf_dir, "documents").select("doc_id", "text"))
    d = docs.select("doc_id", EN.rubric_score("text").alias("s"))
    return d.select("doc_id", "s.activity_score", "s.services_need_score",
                    F.md5("s.summary").alias("summary_md5"))


def _tenant_rubric_sql() -> str:
    rows = ", ".join("(" + ", ".join("NULL" if v is None else str(v).upper() if isinstance(v, bool) else
                                     str(v) if isinstance(v, int) else f"'{v}'" for v in r) + ")" for r in fx.RUBRIC_ROWS)
    return O.with_views("""SELECT h.search_id, h.client, least(coalesce(p.total, 0), 10)::BIGINT AS services_need_score,
       coalesce(p.metrics, '') AS metrics, md5(coalesce(l.summary, '')) AS summary_md5
  FROM history h LEFT JOIN per p USING (search_id) LEFT JOIN lined l USING (search_id)""", [
        ("rubric", f"""SELECT CAST(client AS VARCHAR) AS client, metric, points, keyword, needs_person, needs_company
  FROM (VALUES {rows}) AS t(client, metric, points, keyword, needs_person, needs_company)"""),
        ("raw_lines", """SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
       generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS line_no FROM documents"""),
        ("lines", f"SELECT *, ' ' || array_to_string({_tok('line')}, ' ') || ' ' AS words FROM raw_lines"),
        ("hits", f"""SELECT h.search_id, r.metric, r.points, l.line_no, l.line
  FROM history h JOIN lines l ON l.doc_id = h.search_id JOIN rubric r
    ON r.client IS NOT DISTINCT FROM CASE WHEN h.client IN (SELECT client FROM rubric WHERE client IS NOT NULL) THEN h.client END
   AND contains(l.words, ' ' || r.keyword || ' ')
 WHERE (NOT r.needs_person OR contains(l.words, ' ' || array_to_string({_tok("h.first_name || ' ' || h.last_name")}, ' ') || ' '))
   AND (NOT r.needs_company OR contains(l.words, ' ' || array_to_string({_tok('h.company')}, ' ') || ' '))"""),
        ("per", """SELECT search_id, sum(points) AS total, string_agg(metric, ',' ORDER BY metric) AS metrics
  FROM (SELECT DISTINCT search_id, metric, points FROM hits) GROUP BY search_id"""),
        ("lined", """SELECT search_id, string_agg(line, chr(10) ORDER BY line_no) AS summary
  FROM (SELECT DISTINCT search_id, line_no, line FROM hits) GROUP BY search_id"""),
    ])


@register("t6_tenant_rubrics", _tenant_rubric_sql())
def tenant_rubrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T6 with each tenant's own rubric: every stored search, its whole text, its person and company."""
    h = fx.history(spark, sf_dir).select("search_id", "client", F.concat_ws(" ", "first_name", "last_name").alias("person"), "company")
    texts = fx.history_text(spark, sf_dir).select(F.col("search_id").alias("text_id"), F.col("search_results").alias("text"))
    subjects = h.select(F.col("search_id").alias("subject_id"), F.col("search_id").alias("text_id"), "client", "person", "company")
    s = RB.scored(texts, subjects, fx.rubric(spark))
    return h.join(s, h["search_id"] == s["subject_id"]).select(
        "search_id", "client", "services_need_score", "metrics", F.md5("summary").alias("summary_md5"))


NOVELTY_SQL = O.with_views(f"""SELECT k.client, k.search_id, k.prev_search_id,
       CASE WHEN len(coalesce(a.toks, [])) = 0 AND len(coalesce(b.toks, [])) = 0 THEN 0
            WHEN len(coalesce(b.toks, [])) = 0 THEN 10
            ELSE CAST(floor(10.0 * (1.0 - len(list_intersect(coalesce(a.toks, []), b.toks))
                  / len(list_distinct(list_concat(coalesce(a.toks, []), b.toks)))) + 0.5) AS BIGINT)
       END AS novelty_score
  FROM k LEFT JOIN t a ON a.doc_id = k.search_id LEFT JOIN t b ON b.doc_id = k.prev_search_id""", [
    ("k", """SELECT client, search_id, lag(search_id) OVER (PARTITION BY client, first_name, last_name, company
         ORDER BY search_date, search_id) AS prev_search_id FROM history"""),
    ("t", f"SELECT doc_id, list_distinct({_tok('text')}) AS toks FROM documents"),
])


@register("t7_novelty", NOVELTY_SQL)
def novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W2 + T7: every stored search scored against the person's previous one."""
    h = fx.history(spark, sf_dir).select("client", "first_name", "last_name", "company",
                                         "search_date", "search_id")
    n = EN.novelty(h, fx.history_text(spark, sf_dir), ["client", "first_name", "last_name", "company"])
    return n.select("client", "search_id", "prev_search_id", "novelty_score")


# --- T10 / T11: the day's research over the whole batch --------------------

def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import research as PP
    from ..operators import selection as SL
    from .selection import AS_OF, SEED, _tenants
    settings = fx.settings(spark)
    tenants = _tenants(spark, sf_dir)
    e = SL.eligible(SL.candidates(fx.contacts(spark, sf_dir), fx.history(spark, sf_dir), AS_OF), AS_OF)
    batch = SL.daily_batch(e, tenants, SEED, tenant_bound=settings, k_max=SL.k_bound(settings, "batch_size"))
    templates = fx.prompts(spark).filter(F.col("name") == "standard_query").select(
        "client", F.col("body").alias("template"))
    docs = fx.read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return PP.enrich_batch(batch, tenants, templates, docs, fx.history_text(spark, sf_dir), AS_OF,
                           tenant_bound=settings, index=corpus_index(spark, sf_dir))


def enrich_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T1-T7 + T10 + T13: HISTORY rows of today's research for every
    runnable tenant's batch (native backend)."""
    from ..schemas import HISTORY
    e = enriched(spark, sf_dir)
    cols = [f.name for f in HISTORY.fields if f.name != "search_id"]
    return e.select(*cols)


def usage_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T11 + P15: one CONSUMPTION row per call made by the day's research."""
    from ..operators import research as PP
    return PP.usage_table(enriched(spark, sf_dir))


# --- DuckDB oracle of the composed pipeline (T10) ---------------------------

def _search_ctes(prefix: str, queries: str) -> list[tuple[str, str]]:
    """tf-idf top-3 over the whole corpus for the (qid, query) rows of the
    CTE ``queries``; mirrors :func:`leadspark.operators.search_index.search`."""
    return [
        (f"{prefix}_qt", f"SELECT DISTINCT qid, unnest(list_distinct({_tok('query')})) AS term FROM {queries}"),
        (f"{prefix}_terms", f"SELECT DISTINCT term FROM {prefix}_qt"),
        (f"{prefix}_tf", f"""SELECT i.doc_id, i.term, i.tf FROM idx i JOIN {prefix}_terms t ON i.term = t.term"""),
        (f"{prefix}_df", f"SELECT term, count(*) AS df FROM {prefix}_tf GROUP BY term"),
        (f"{prefix}_s", f"""SELECT q.qid, f.doc_id, sum(f.tf * ln(1 + ndocs.n / d.df)) AS raw_score
  FROM {prefix}_qt q JOIN {prefix}_tf f ON q.term = f.term JOIN {prefix}_df d ON d.term = q.term, ndocs
 GROUP BY q.qid, f.doc_id"""),
        (f"{prefix}_top", f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid
         ORDER BY round(raw_score, 9) DESC, doc_id) AS rank FROM {prefix}_s) r WHERE rank <= 3"""),
        (f"{prefix}_hits", f"""SELECT t.qid, list({{'url': 'https://' || d.source || '.example.org/doc/' || d.doc_id,
                             'content': d.text}} ORDER BY t.rank) AS hits
  FROM {prefix}_top t JOIN documents d ON d.doc_id = t.doc_id GROUP BY t.qid"""),
    ]


def _render(template: str, values: list[tuple[str, str]]) -> str:
    r = f"replace(replace({template}, '{{{{', chr(1)), '}}}}', chr(2))"
    for name, expr in values:
        r = f"replace({r}, '{{{name}}}', coalesce({expr}, 'None'))"
    return f"replace(replace({r}, chr(1), '{{'), chr(2), '}}')"


def _e1(h: str) -> str:
    body = f"coalesce(array_to_string(list_transform({h}, lambda x: x.content), chr(10) || chr(10)), '')"
    cites = (f"array_to_string(list_transform(generate_series(1, len({h})), "
             f"lambda i: i || ', ' || {h}[i].url), chr(10))")
    return f"CASE WHEN len(coalesce({h}, [])) > 0 THEN {body} || chr(10) || chr(10) || {cites} ELSE {body} END"


def _e2(h: str) -> str:
    ok = f"list_filter(coalesce({h}, []), lambda x: x.url IS NOT NULL AND x.content IS NOT NULL)"
    body = (f"array_to_string(list_transform({ok}, lambda x: 'URL: ' || x.url || chr(10) || 'Content: ' "
            f"|| x.content || chr(10) || repeat('-', 50) || chr(10)), '')")
    return f"CASE WHEN len({ok}) > 0 THEN {body} ELSE 'No search results available.' END"


def _research_ctes() -> list[tuple[str, str]]:
    from .selection import BATCH_CTES
    from .text_queries import PERIOD_SQL
    std = fx.STANDARD_QUERY.replace("'", "''")
    fields = [("first_name", "first_name"), ("last_name", "last_name"), ("company", "company"),
              ("candidate.first_name", "first_name"), ("candidate.last_name", "last_name"),
              ("candidate.company", "company"), ("search_period", "search_period")]
    ev = fields + [("search_event_type", "search_event_type")]
    props = [_render(p, ev) for p in (
        "'{first_name} {last_name} {company} {search_event_type} {search_period}'",
        "'{company} news and updates {search_period}'")]
    question = ("'What kind of events, blogs and updates are typically published by ' || first_name || ' ' "
                "|| last_name || ', who works as ' || coalesce(position, 'None') || ' at this company: ' "
                "|| company || '. Ignore similar named companies and people. Focus on this one only.'")
    any_fact = EN.word_pattern_re2(EN.any_keyword())
    rubric = " + ".join(f"CASE WHEN regexp_matches(lower(search_raw), '{EN.word_pattern_re2(kw)}') THEN {pts} ELSE 0 END"
                        for _, pts, kw in EN.RUBRIC)
    ctes = BATCH_CTES + [
        ("prompts", O.PROMPTS),
        ("batch", f"""SELECT r.*, t.max_tavily_searches, pr.body AS template,
       r.client || '|' || r.first_name || '|' || r.last_name || '|' || r.company AS cid
  FROM ranked r JOIN tenants t ON r.client = t.client
  LEFT JOIN prompts pr ON pr.client = r.client AND pr.name = 'standard_query'
 WHERE r.pick_rank <= r.batch_size"""),
        ("per", """SELECT *, CASE WHEN last_search_date > TIMESTAMP '2001-08-02 00:00:00'
                   THEN CAST(DATE '2001-08-02' - INTERVAL 3 MONTH AS DATE)
                   ELSE coalesce(CAST(last_search_date AS DATE), CAST(DATE '2001-08-02' - INTERVAL 2 MONTH AS DATE))
              END AS p0 FROM batch"""),
        ("named", """SELECT *, list_transform(generate_series(CAST(date_trunc('month', p0) AS TIMESTAMP),
                     TIMESTAMP '2001-08-02 00:00:00', INTERVAL 1 MONTH), lambda m: strftime(m, '%B %Y')) AS names
  FROM per"""),
        ("c0", f"SELECT *, {PERIOD_SQL} AS search_period, {question} AS event_q FROM named"),
        ("idx", f"""SELECT doc_id, term, count(*) AS tf
  FROM (SELECT doc_id, unnest({_tok('text')}) AS term FROM documents) GROUP BY doc_id, term"""),
        ("ndocs", "SELECT count(*) AS n FROM documents"),
        ("q1", "SELECT cid AS qid, event_q AS query FROM c0"),
    ] + _search_ctes("s1", "q1") + [
        ("c1", """SELECT c0.*, coalesce(split_part(coalesce(h.hits[1].content, ''), chr(10), 1), '')
         AS search_event_type
  FROM c0 LEFT JOIN s1_hits h ON h.qid = c0.cid"""),
        ("c2", f"""SELECT *, [{props[0]}, {props[1]},
         {_render(f"coalesce(template, '{std}')", fields)}] AS queries FROM c1"""),
        ("q2", "SELECT cid || '#' || i AS qid, queries[i] AS query FROM (SELECT cid, queries, unnest([1, 2, 3]) AS i FROM c2)"),
    ] + _search_ctes("s2", "q2") + [
        ("c3", f"""SELECT c2.*, h1.hits AS h1, h2.hits AS h2, h3.hits AS h3 FROM c2
  LEFT JOIN s2_hits h1 ON h1.qid = c2.cid || '#1'
  LEFT JOIN s2_hits h2 ON h2.qid = c2.cid || '#2'
  LEFT JOIN s2_hits h3 ON h3.qid = c2.cid || '#3'"""),
        ("c4", f"""SELECT *, CASE WHEN coalesce(max_tavily_searches, 0) > 0
            THEN [{_e1('h1')}, {_e1('h2')}, {_e1('h3')}, {_e2('h1')}]
            ELSE [{_e1('h1')}, {_e1('h2')}, {_e1('h3')}] END AS results FROM c3"""),
        ("c5", """SELECT *, array_to_string(results, '/n===/n') AS search_raw,
       array_to_string(queries, chr(10) || '===' || chr(10)) AS search_query FROM c4"""),
        ("c6", f"""SELECT c5.*, CAST(least({rubric}, 10) AS BIGINT) AS services_need_score,
       array_to_string(list_filter(string_split(search_raw, chr(10)), lambda s: regexp_matches(lower(s), '{any_fact}')),
                       chr(10)) AS search_results,
       {_tok('search_raw')} AS raw_toks,
       list_distinct({_tok("coalesce(d.text, '')")}) AS prev_toks
  FROM c5 LEFT JOIN documents d ON d.doc_id = c5.last_search_id"""),
        ("c7", """SELECT *, list_distinct(raw_toks) AS a, prev_toks AS b FROM c6"""),
        ("c8", """SELECT *, CASE WHEN len(a) = 0 AND len(b) = 0 THEN 0 WHEN len(b) = 0 THEN 10
            ELSE CAST(floor(10.0 * (1.0 - len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))))
                 + 0.5) AS BIGINT) END AS novelty_score FROM c7"""),
    ] + _url_ctes()
    return ctes


def _research_sql() -> str:
    body = """SELECT c8.client, first_name, last_name, company,
       TIMESTAMP '2001-08-02 00:00:00' AS search_date, search_event_type, search_query, search_raw,
       u.url_facebook, u.url_linkedin, u.url_company, search_results, novelty_score,
       CAST(0 AS BIGINT) AS activity_score, services_need_score,
       novelty_score + services_need_score AS total_score,
       CAST(NULL AS TIMESTAMP) AS email_date, CAST(NULL AS VARCHAR) AS email_content,
       CAST(NULL AS VARCHAR) AS email_batch_recipient
  FROM c8 JOIN urls u ON u.cid = c8.cid"""
    return O.with_views(body, _research_ctes())


def _usage_sql() -> str:
    def n(x):
        return f"CAST(len(regexp_extract_all({x}, '[^ \\t\\n\\x0B\\f\\r]+')) AS BIGINT)"
    calls = [
        ("'search_event_type'", 1, "event_q", "search_event_type"),
        ("'search_proposal_agent'", 0, "event_q", "array_to_string(queries[1:2], chr(10) || '===' || chr(10))"),
        ("'search_engine_1'", 1, "queries[1]", "results[1]"),
        ("'search_engine_1'", 1, "queries[2]", "results[2]"),
        ("'search_engine_1'", 1, "queries[3]", "results[3]"),
        ("'search_engine_2'", 1, "queries[1]", "results[len(results)]"),
        ("'url_extraction_agent'", 0, "search_raw",
         "concat_ws(' ', u.url_facebook, u.url_linkedin, u.url_company)"),
        ("'target_score_agent'", 0, "search_raw", "search_results"),
        ("'results_comparison_agent'", 0, "search_raw", "CAST(novelty_score AS VARCHAR)"),
    ]
    parts = []
    for i, (fn, sc, a, b) in enumerate(calls):
        if fn == "'search_engine_2'":
            no, cond = "5", "coalesce(max_tavily_searches, 0) > 0"
        else:
            no = str(i) if i < 5 else f"{i} - CASE WHEN coalesce(max_tavily_searches, 0) > 0 THEN 0 ELSE 1 END"
            cond = "TRUE"
        parts.append(f"""SELECT c8.client, TIMESTAMP '2001-08-02 00:00:00' AS search_date, {fn} AS function,
       'native' AS model, CAST({sc} AS BIGINT) AS search_calls, {n(a)} AS input_tokens, {n(b)} AS output_tokens,
       CAST({no} AS BIGINT) AS call_no
  FROM c8 JOIN urls u ON u.cid = c8.cid WHERE {cond}""")
    return O.with_views("\nUNION ALL\n".join(parts), _research_ctes())


def _url_ctes() -> list[tuple[str, str]]:
    fb = r"'^https?://([a-z0-9-]+\.)*facebook\.com/[^/?#]'"
    li = r"'^https?://([a-z0-9-]+\.)*linkedin\.com/in/'"
    return [
        ("uu", f"SELECT cid, regexp_extract_all(search_raw, '{_FIND}') AS urls FROM c8"),
        ("uhs", f"""SELECT cid, urls, list_filter(list_transform(urls, lambda x: {_HOSTX}),
          lambda h: length(h) > 0 AND NOT regexp_matches(h, '(^|\\.)(facebook|linkedin)\\.com$')) AS hosts FROM uu"""),
        ("uh", "SELECT cid, unnest(hosts) AS host, unnest(generate_series(1, len(hosts))) AS pos FROM uhs"),
        ("uc", "SELECT cid, host, count(*) AS n, min(pos) AS p FROM uh GROUP BY cid, host"),
        ("ub", "SELECT cid, arg_max(host, n * 1000000 - p) AS host FROM uc GROUP BY cid"),
        ("urls", f"""SELECT uhs.cid,
       coalesce(list_filter(urls, lambda x: regexp_matches(lower(x), {fb}))[1], '') AS url_facebook,
       coalesce(list_filter(urls, lambda x: regexp_matches(lower(x), {li}))[1], '') AS url_linkedin,
       coalesce('https://' || ub.host, '') AS url_company
  FROM uhs LEFT JOIN ub ON uhs.cid = ub.cid"""),
    ]


register("t10_enrich_batch", _research_sql())(enrich_batch)
register("t11_usage_rows", _usage_sql())(usage_rows)
