"""The per-contact research pipeline as one DataFrame plan over a
whole day's batch (all tenants), producing HISTORY rows and usage rows.

Steps (reference order): event type (T1) -> two proposed queries (T2) ->
standard query (T3) -> searches on engine 1 for every query and on engine 2
for the first one when the tenant allows it (T4) -> URLs (T5) -> business
need score (T6) -> novelty against the previous result (T7) -> scores
(F21). Every step is native here; :mod:`.provider` replaces a step by an
external call. The queries of all contacts are searched together in one search per
step, from a stored index: the corpus is not tokenised again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as TX
from ..schemas import KEY3
from . import enrich as EN
from . import provider as PV
from . import search_index as SI
from . import steps as ST
from .sizing import broadcast_bounded, is_small, maybe_broadcast, spread

# Search ids of one day's batch: bounded by tenants x 999.
MAX_BROADCAST_IDS = 2_000_000

# Templates of the two proposed queries.
PROPOSALS = [
    "{first_name} {last_name} {company} {search_event_type} {search_period}",
    "{company} news and updates {search_period}",
]
NATIVE_MODEL = "native"

# Function names of the usage rows, one per call.
FN_EVENT, FN_PROPOSAL, FN_SEARCH1, FN_SEARCH2 = (
    "search_event_type", "search_proposal_agent", "search_engine_1", "search_engine_2")
FN_URLS, FN_SCORE, FN_NOVELTY = ("url_extraction_agent", "target_score_agent",
                                 "results_comparison_agent")

FUNCTIONS = [FN_EVENT, FN_PROPOSAL, FN_SEARCH1, FN_SEARCH2, FN_URLS, FN_SCORE, FN_NOVELTY]


def _render(template: str, values: dict[str, Column]) -> Column:
    return TX.render_template(F.lit(template), values)


def engine1_text(h: Column) -> Column:
    """Engine-1 style answer: hit contents, then numbered citations."""
    body = F.array_join(F.transform(h, lambda x: x["content"]), "\n\n")
    return TX.with_citations(body, F.transform(h, lambda x: x["url"]))


def enrich_batch(batch: DataFrame, tenants: DataFrame, standard_templates: DataFrame,
                 docs: DataFrame, prev_texts: DataFrame, as_of, k: int = EN.DEFAULT_TOP_K,
                 tenant_bound: DataFrame | bool | None = None, with_previous: bool = False,
                 index: SI.Index | None = None) -> DataFrame:
    """Run the native pipeline for every contact of ``batch``.

    ``batch``: client, first_name, last_name, company, position,
    last_search_id, last_search_date. ``tenants``: client,
    max_tavily_searches. ``standard_templates``: client, template (tenant
    overrides; default otherwise). ``docs``: doc_id, text, source.
    ``prev_texts``: search_id, search_results of stored searches.
    Returns one row per contact with the HISTORY columns plus ``usage``
    (array of call records) and ``contact_id``. ``tenant_bound``: the
    dimension table (or its check result) bounding ``tenants``' rows.
    ``with_previous`` adds the previous result's text as ``previous_results``
    (for a provider that compares). ``index``: the stored index of ``docs``,
    of which then only the hits' texts are read; without one it is made here.
    """
    from ..fixtures import STANDARD_QUERY  # the default template

    t = broadcast_bounded(tenants.select("client", "max_tavily_searches"),
                          tenants if tenant_bound is None else tenant_bound)
    st = maybe_broadcast(standard_templates.select("client", "template"))  # a prompt table
    # The batch is today's durable decision and small (<= tenants x 999):
    # materialise it once so later size checks and stages never re-run the
    # selection plan.
    c = (batch.join(t, "client", "left").join(st, "client", "left")
         .withColumn("contact_id", F.md5(F.to_json(F.struct(*KEY3))))
         .withColumn("search_period", TX.search_period("last_search_date", as_of))
         .checkpoint(eager=True))
    index = index or SI.extend(docs, SI.scratch_path(docs.sparkSession))
    fields = {"first_name": F.col("first_name"), "last_name": F.col("last_name"),
              "company": F.col("company"), "candidate.first_name": F.col("first_name"),
              "candidate.last_name": F.col("last_name"), "candidate.company": F.col("company"),
              "search_period": F.col("search_period")}

    # The event question, searched first (its answer feeds T2).
    c = c.withColumn("event_q", TX.event_question("first_name", "last_name", "position", "company"))
    q1 = c.select(F.struct("contact_id", F.lit(0).alias("qpos")).alias("qid"),
                  F.col("event_q").alias("query"))
    top1 = SI.search(index, q1, k, "qid")
    h1 = EN.hits(top1, docs, id_col="qid")
    ev = h1.select(F.col("qid.contact_id").alias("contact_id"), F.col("hits").alias("event_hits"))
    # The event type is the first line of the best document (whole line).
    c = c.join(ev, "contact_id", "left").withColumn(
        "search_event_type", F.coalesce(F.split(
            F.coalesce(F.try_element_at("event_hits", F.lit(1))["content"], F.lit("")), "\n")[0],
            F.lit("")))

    # T2 + T3: proposals and the standard query.
    fields["search_event_type"] = F.col("search_event_type")
    queries = F.array(*[_render(p, fields) for p in PROPOSALS],
                      TX.render_template(F.coalesce("template", F.lit(STANDARD_QUERY)), fields))
    c = c.withColumn("queries", queries).checkpoint(eager=True)

    # T4: all queries of all contacts in one corpus search.
    q = c.select("contact_id", F.posexplode("queries").alias("qpos", "query")).select(
        F.struct("contact_id", (F.col("qpos") + 1).alias("qpos")).alias("qid"), "qpos", "query")
    top = SI.search(index, q, k, "qid")
    hs = EN.hits(top, docs, id_col="qid").select(
        F.col("qid.contact_id").alias("contact_id"), F.col("qid.qpos").alias("qpos"), "hits")
    per_contact = hs.groupBy("contact_id").agg(  # <= len(queries) rows per contact
        F.array_sort(F.collect_list(F.struct("qpos", "hits"))).alias("qhits"))
    c = c.join(per_contact, "contact_id", "left")
    n_q = F.size("queries")
    hits_at = lambda i: F.coalesce(
        F.try_element_at(F.filter("qhits", lambda x: x["qpos"] == i), F.lit(1))["hits"],
        F.array().cast("array<struct<url:string,content:string>>"))
    e1 = F.transform(F.sequence(F.lit(1), n_q), lambda i: engine1_text(hits_at(i)))
    use_e2 = F.coalesce(F.col("max_tavily_searches"), F.lit(0)) > 0
    e2 = TX.hits_text(hits_at(F.lit(1)))
    results = F.when(use_e2, F.concat(e1, F.array(e2))).otherwise(e1)
    # Materialise the research texts once (one row per contact): every later
    # step reads them several times, and Catalyst would otherwise inline the
    # text-building expressions into each use.
    c = (c.withColumn("results", results).withColumn("search_raw", TX.join_results("results"))
         .drop("qhits", "event_hits").checkpoint(eager=True))
    # Previous result text of the person's latest stored search.
    # Only the stored texts this batch compares against are tokenised: the
    # batch's search ids (<= batch rows, materialised above) cut the text
    # table first.
    ids = c.select(F.col("last_search_id").alias("search_id")).where("search_id IS NOT NULL").distinct()
    ids = F.broadcast(ids) if is_small(ids, MAX_BROADCAST_IDS) else ids
    prev = prev_texts.join(ids, "search_id", "left_semi").select(
        F.col("search_id").alias("last_search_id"), F.col("search_results").alias("previous_results"))
    # A day's batch is a few rows per tenant but each carries long texts:
    # spread them over the cores for the regex and token work below, which
    # follows the last exchange (else it ran in the few tasks of the join).
    c = spread(c.join(prev, "last_search_id", "left").checkpoint(eager=True))

    # T5, T6.
    c = (c.withColumn("_u", EN.extract_urls("search_raw"))
         .withColumn("_s", EN.rubric_score("search_raw")))
    # Each token list and count is made once, not once per use.
    c = c.withColumn("_toks", EN.token_set("search_raw")).withColumn("_prev_toks", EN.token_set("previous_results")).withColumn(
        "_n_raw", TX.token_count("search_raw").cast("bigint"))
    c = c.withColumn("novelty_score", EN.novelty_score(F.col("_toks"), F.col("_prev_toks")))

    usage = usage_records(c, use_e2)
    act, srv = F.col("_s.activity_score"), F.col("_s.services_need_score")
    return c.select(
        "client", "contact_id", *KEY3[1:],
        F.lit(as_of).cast("timestamp_ntz").alias("search_date"),
        "search_event_type", TX.join_queries("queries").alias("search_query"), "search_raw",
        F.col("_u.url_facebook").alias("url_facebook"), F.col("_u.url_linkedin").alias("url_linkedin"),
        F.col("_u.url_company").alias("url_company"),
        F.col("_s.summary").alias("search_results"),
        "novelty_score", act.alias("activity_score"), srv.alias("services_need_score"),
        (F.col("novelty_score") + act + srv).alias("total_score"),
        F.lit(None).cast("timestamp_ntz").alias("email_date"),
        F.lit(None).cast("string").alias("email_content"),
        F.lit(None).cast("string").alias("email_batch_recipient"),
        usage.alias("usage"), *(["previous_results", "search_period"] if with_previous else []))


def _call(fn: str, calls: int, prompt: Column, answer: Column, n_prompt: Column | None = None) -> Column:
    """``n_prompt``: the prompt's tokens, where they are counted already."""
    return F.struct(F.lit(fn).alias("function"), F.lit(NATIVE_MODEL).alias("model"),
                    F.lit(calls).cast("bigint").alias("search_calls"),
                    (TX.token_count(prompt).cast("bigint") if n_prompt is None else n_prompt).alias("input_tokens"),
                    TX.token_count(answer).cast("bigint").alias("output_tokens"))


def usage_records(c: DataFrame, use_e2: Column) -> Column:
    """One record per call made for the contact (native model)."""
    q = F.col("queries")
    e1 = [_call(FN_SEARCH1, 1, q[i], F.col("results")[i]) for i in range(len(PROPOSALS) + 1)]
    e2 = _call(FN_SEARCH2, 1, q[0], F.element_at("results", -1))
    base = F.array(
        _call(FN_EVENT, 1, F.col("event_q"), F.col("search_event_type")),
        _call(FN_PROPOSAL, 0, F.col("event_q"), TX.join_queries(F.slice(q, 1, len(PROPOSALS)))),
        *e1)
    raw, n_raw = F.col("search_raw"), F.col("_n_raw")
    tail = F.array(
        _call(FN_URLS, 0, raw, F.concat_ws(" ", "_u.url_facebook", "_u.url_linkedin", "_u.url_company"), n_raw),
        _call(FN_SCORE, 0, raw, F.col("_s.summary"), n_raw),
        _call(FN_NOVELTY, 0, raw, F.col("novelty_score").cast("string"), n_raw))
    return F.when(use_e2, F.concat(base, F.array(e2), tail)).otherwise(F.concat(base, tail))


def usage_table(enriched: DataFrame) -> DataFrame:
    """T11 -> CONSUMPTION rows (client and date first, P15)."""
    # not posexplode: its filter for empty arrays would make every usage array a second time, below the spread
    u = enriched.select("client", "search_date", F.posexplode_outer("usage").alias("call_no", "u")).where("call_no IS NOT NULL")
    return u.select("client", "search_date", "u.function", "u.model", "u.search_calls",
                    "u.input_tokens", "u.output_tokens", "call_no")


USAGE_TYPE = ("array<struct<function:string,model:string,search_calls:bigint,"
              "input_tokens:bigint,output_tokens:bigint>>")


#: Steps that a provider may take over, and the column of their results.
PROVIDER_STEPS = (FN_SCORE, FN_NOVELTY)


def rescore_with_provider(enriched: DataFrame, factory, partitions: int,
                          calls_per_minute: float | dict[str, float] = PV.CALLS_PER_MINUTE,
                          steps: tuple[str, ...] = PROVIDER_STEPS, ledger: str | None = None) -> DataFrame:
    """T5, T6 and T7 (those in ``steps``) through an external provider (T12): one request
    per contact and step, answers read by the step table (T14), so that a failed step yields its
    failure values; results and usage records of those steps are the provider's. With a ``ledger`` a repeated run of the
    day asks only for what is not answered. Requests are at most three per contact of the batch."""
    e = enriched
    person = F.concat(F.lit("Person: "), F.concat_ws(" ", "first_name", "last_name"), F.lit("\nCompany: "),
                      F.col("company"), F.lit("\nPeriod: "), F.coalesce("search_period", F.lit("None")), F.lit("\n\n"))
    prompts = {FN_SCORE: F.concat(person, F.col("search_raw")), FN_URLS: F.concat(person, F.col("search_raw")),
               FN_NOVELTY: F.concat(person, F.lit("Previous results:\n"), F.coalesce("previous_results", F.lit("None")),
                                    F.lit("\n\nNew results:\n"), F.col("search_raw"))}
    # a request is known by contact, day and step, so that a ledger can tell it from another day's
    name = lambda fn: F.concat_ws(":", "contact_id", F.date_format("search_date", "yyyy-MM-dd"), F.lit(fn))
    req = e.select(F.explode(F.array(*[
        F.struct(name(fn).alias("request_id"), F.lit(fn).alias("function"), prompts[fn].alias("prompt"), F.col("client").alias("client"))
        for fn in steps])).alias("r")).select("r.*")
    if ledger:
        answers = PV.call_with_ledger(req, factory, partitions, ledger, calls_per_minute)
    else:
        answers = PV.call_provider(req, factory, partitions, calls_per_minute)
    a = ST.outcomes(answers).withColumn("contact_id", F.split("request_id", ":")[0]).withColumn(
        "call", F.struct("function", "model", F.lit(0).cast("bigint").alias("search_calls"), "input_tokens", "output_tokens"))
    per = a.groupBy("contact_id").agg(*[F.first(fn, ignorenulls=True).alias(fn) for fn in steps],
                                      F.collect_list("call").alias("_calls"))  # one per step
    j = e.join(per, "contact_id", "left")
    put = {}
    if FN_SCORE in steps:
        put |= {"services_need_score": F.col(f"{FN_SCORE}.services_need_score"), "activity_score": F.col(f"{FN_SCORE}.activity_score"),
                "search_results": F.col(f"{FN_SCORE}.summary")}
    if FN_NOVELTY in steps:
        put["novelty_score"] = F.col(f"{FN_NOVELTY}.novelty_score")
    if FN_URLS in steps:
        put |= {c: F.col(f"{FN_URLS}.{c}") for c in ("url_facebook", "url_linkedin", "url_company")}
    kept = F.filter("usage", lambda u: ~u["function"].isin(*steps))
    return (j.withColumns(put)
            .withColumn("total_score", F.col("novelty_score") + F.col("activity_score") + F.col("services_need_score"))
            .withColumn("usage", F.concat(kept, F.coalesce("_calls", F.array().cast(USAGE_TYPE))))
            .drop(*steps, "_calls", "previous_results", "search_period"))
