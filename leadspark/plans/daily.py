"""The daily run as one Spark application: today's batch is researched and
stored, due tenants get their shortlist, history update and report, and the
month's costs are written. Every step is a DataFrame plan over all tenants;
the writes are the only actions besides lineage cuts.

``run_daily`` reads the domain tables through :mod:`leadspark.fixtures`
(the driver's parquet shaped into the domain); a deployment points the same
steps at its own tables via :mod:`leadspark.sources.tables`. What it writes it
reads back the next day: ``history`` (first filled from the past searches) with
its e-mail marks, and ``usage``, which counts for the budget and the costs.

A run is known by its day. It stores its rows by two flushes, the research (searches
and usage) and the calls of the shortlist; each is visible as a whole or not at all.
Repeating a run after a failure selects the same batch and leads (what
the failed attempt stored is set aside), does only the research that is not stored,
and stores only what is missing.
"""

from __future__ import annotations

import posixpath

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .. import fixtures as fx
from .. import schemas as S
from ..functions import text as TX
from ..operators import checks as CK
from ..operators import identity as ID
from ..operators import pricing as P
from ..operators import provider as PV
from ..operators import report as RP
from ..operators import research as RS
from ..operators import search_index as SI
from ..operators import selection as SL
from ..operators import shortlist as SH
from ..operators import tenants as TN
from ..operators.contacts import as_ts
from ..operators.sizing import is_small, maybe_broadcast, rows_of
from ..sources import sinks as K
from ..sources.tables import prompt_for

HISTORY_COLS = [f.name for f in S.HISTORY.fields]
USAGE_COLS = [f.name for f in S.CONSUMPTION.fields]
# Function names of the usage rows of the shortlist's calls.
FN_RANKING, FN_EMAIL = SH.FN_RANKING, RP.FN_EMAIL


# The dictionary of searches (F28) and the counter of usage rows.
SEARCH_IDS, SEARCH_KEY = "search_ids", ["client", "first_name", "last_name", "company", "search_date"]
USAGE_IDS = "usage_ids"


def stored_history(spark: SparkSession, sf_dir: str, out: str, with_run: bool = False) -> DataFrame:
    """The engine's history table; the first time it is filled with the past
    searches and their texts. New searches are numbered after them."""
    if not K.is_flushed(spark, out, "initial"):
        past = fx.history(spark, sf_dir, with_text=True)
        last = fx.history(spark, sf_dir).agg(F.max("search_id")).first()[0]
        K.flush(spark, out, "initial", {"history": K.with_month(past)}, {"history": K.HISTORY_PARTITIONS},
                counter=SEARCH_IDS, last=last or 0)
    return K.stored(spark, out, "history", S.HISTORY).select(*HISTORY_COLS, *(["run"] if with_run else []))


def all_usage(spark: SparkSession, sf_dir: str, out: str) -> DataFrame:
    """Usage that was there before plus what this engine has stored."""
    usage = fx.consumption(spark, sf_dir).select(*USAGE_COLS)
    return usage.unionByName(K.stored(spark, out, "usage", S.CONSUMPTION).select(*USAGE_COLS))


def number_usage(calls: DataFrame, sf_dir: str, out: str) -> tuple[DataFrame, int]:
    """CONSUMPTION rows of the calls, numbered after all usage there is, and
    the last number."""
    spark = calls.sparkSession
    last = K.last_id(spark, out, USAGE_IDS)
    if last is None:
        last = fx.consumption(spark, sf_dir).agg(F.max("usage_id")).first()[0] or 0
    rows = ID.numbered(calls, ["client", "function", "subject", "call_no"], last, "usage_id")
    return rows.select(*USAGE_COLS), last + rows.count()


def research_usage(enriched: DataFrame) -> DataFrame:
    """T11 of the research calls."""
    u = enriched.select("client", "search_date", F.col("contact_id").alias("subject"),
                        F.posexplode("usage").alias("call_no", "u"))
    return u.select("client", "search_date", F.col("subject").cast("string").alias("subject"), "call_no", "u.*")


def _native_call(df: DataFrame, as_of, fn: str, subject, prompt, answer_tokens) -> DataFrame:
    return df.select(
        "client", F.lit(as_ts(as_of)).alias("search_date"), F.lit(fn).alias("function"),
        F.lit(RS.NATIVE_MODEL).alias("model"), F.lit(0).cast("bigint").alias("search_calls"),
        TX.token_count(prompt).cast("bigint").alias("input_tokens"),
        answer_tokens.cast("bigint").alias("output_tokens"), subject.cast("string").alias("subject"),
        F.lit(0).alias("call_no"))


def run_daily(spark: SparkSession, sf_dir: str, out: str, as_of=fx.AS_OF_CONTACTS,
              seed: str | None = None, provider=None, provider_partitions: int = 4,
              calls_per_minute: float | dict[str, float] = PV.CALLS_PER_MINUTE,
              provider_steps: tuple[str, ...] = RS.PROVIDER_STEPS) -> dict:
    """Run one day. Returns the stage row counts (A13) and the output paths.

    ``provider`` takes over ``provider_steps`` (scores, novelty, URLs, e-mail drafts) and the ranking; its
    answers go to a ledger beside the history, so a repeated run asks only for what is missing."""
    today = F.lit(as_ts(as_of))
    day = as_of.strftime("%Y-%m-%d")
    seed = seed or day
    ledger = posixpath.join(out, "provider_ledger")
    settings, subs, prices = fx.settings(spark), fx.subscriptions(spark), fx.pricing(spark)

    # Tenants that run today (P7, P8, P17, P19) and their batches.
    # Rows of an earlier attempt at this day are set aside.
    usage = all_usage(spark, sf_dir, out)
    before = usage.filter(~F.col("function").isin(*RS.FUNCTIONS, FN_RANKING, FN_EMAIL) | (F.col("search_date") != today))
    seen: dict[str, Observation] = {}

    def counted(df: DataFrame, stage: str) -> DataFrame:
        """The stage's rows are counted by the job that first consumes it."""
        df, seen[stage] = CK.observed(df, stage)
        return df

    tenants = counted(TN.runnable_tenants(subs, settings, before, prices, as_of), "tenants").checkpoint(eager=True)
    history = stored_history(spark, sf_dir, out)
    past = history.filter(F.col("search_date").isNull() | (F.col("search_date") != today))
    elig = counted(SL.eligible(SL.candidates(fx.contacts(spark, sf_dir), counted(past, "history"), as_of), as_of), "eligible")
    batch = counted(SL.daily_batch(elig, tenants, seed, tenant_bound=settings), "batch")

    # Research (T1-T11); optionally scores through an external provider.
    # A day's research that is stored is not done again; its batch is counted all the same.
    research, shortlist = f"{day}-research", f"{day}-shortlist"
    if K.is_flushed(spark, out, research):
        batch.write.format("noop").mode("overwrite").save()
    else:
        templates = fx.prompts(spark).filter(F.col("name") == "standard_query").select(
            "client", F.col("body").alias("template"))
        docs = fx.read(spark, sf_dir, "documents").select("doc_id", "text", "source")
        texts = past.select("search_id", "search_results")
        index = SI.extend(docs, posixpath.join(out, "corpus_index"))  # kept, and extended by new documents only
        enriched = RS.enrich_batch(batch, tenants, templates, docs, texts, as_of, tenant_bound=settings,
                                   with_previous=provider is not None, index=index)
        if provider is not None:
            steps = tuple(fn for fn in provider_steps if fn != FN_EMAIL)
            enriched = RS.rescore_with_provider(enriched, provider, provider_partitions, calls_per_minute, steps, ledger)
        # K5: one materialisation (a retried or re-planned write never repeats the research), then both tables in one flush.
        done = enriched.checkpoint(eager=True)
        ids = ID.extend(done, out, SEARCH_IDS, SEARCH_KEY, "search_id", where=F.col("search_date") == today)
        done = ID.attach(done.drop("search_id"), ids, SEARCH_KEY, "search_id")
        rows, last = number_usage(research_usage(done), sf_dir, out)
        K.flush(spark, out, research, {"history": K.with_month(done.select(*HISTORY_COLS)), "usage": rows},
                {"history": K.HISTORY_PARTITIONS, "usage": ("client",)}, USAGE_IDS, last)

    # Weekly shortlist for tenants due today (P16), over keys; texts by id.
    history = stored_history(spark, sf_dir, out)
    texts = history.select("search_id", "search_results")
    due = TN.valid_settings(settings).filter(TN.weekday_due(settings, as_of))
    keys = SH.history_keys(history.withColumn(  # marks of an earlier attempt at this day are set aside
        "email_date", F.when(F.col("email_date") != today, F.col("email_date"))))
    cands = SH.candidates(keys, as_of)
    k_max = SH.k_bound(settings, "max_emails")
    requests = SH.ranking_requests(SH.tie_flags(cands, due, settings), texts).checkpoint(eager=True)
    ranks, answers = SH.provider_ranks(requests, provider, provider_partitions, calls_per_minute, ledger, day) if provider is not None else (None, None)
    leads = SH.with_texts(SH.shortlist(cands, texts, due, k_max, tenant_bound=settings, ranks=ranks), texts)
    names = due.select("client", F.explode(F.array(F.lit("email_template"),
                                                   F.lit("business_description"))).alias("name"))
    bodies = prompt_for(names, fx.prompts(spark), fx.default_prompts(spark)).groupBy("client").pivot(
        "name", ["email_template", "business_description"]).agg(F.first("body"))
    leads = leads.join(maybe_broadcast(bodies), "client", "left").join(
        maybe_broadcast(due.select("client", "email_batch_recipient", "send_proposed_emails")), "client")
    leads = leads.withColumn("draft", RP.draft_email(
        F.col("email_template"), F.col("business_description"), F.col("search_results"),
        F.col("first_name"), F.col("last_name"), F.col("company")))
    drafts = None
    if provider is not None and FN_EMAIL in provider_steps:
        leads, drafts = RP.provider_drafts(leads.checkpoint(eager=True), provider, provider_partitions, calls_per_minute, ledger, day)
    leads = leads.withColumn("email_content", RP.sent_content(
        F.col("send_proposed_emails"), F.col("draft"), F.col("search_results")))
    leads = counted(leads, "leads").checkpoint(eager=True)

    # Usage of the ranking requests (W6) and the drafts.
    def made(answers: DataFrame) -> DataFrame:
        return answers.select(
            F.split_part("request_id", F.lit("|"), F.lit(1)).alias("client"), today.alias("search_date"), "function", "model",
            F.lit(0).cast("bigint").alias("search_calls"), "input_tokens", "output_tokens",
            F.col("request_id").alias("subject"), F.lit(0).alias("call_no"))

    calls = made(answers) if answers is not None else _native_call(
        requests, as_of, FN_RANKING, F.col("batch_no"), F.col("request"), F.col("n_texts"))
    calls = calls.unionByName(made(drafts) if drafts is not None else _native_call(
        leads, as_of, FN_EMAIL, F.col("search_id"),
        F.concat_ws("\n", "email_template", "business_description", "search_results"), TX.token_count("draft")))
    if not K.is_flushed(spark, out, shortlist):
        rows, last = number_usage(calls, sf_dir, out)
        K.flush(spark, out, shortlist, {"usage": rows}, {"usage": ("client",)}, USAGE_IDS, last)

    # K6: the e-mail marks go into the history itself; K8: the report.
    since = SH.searches_since_last_email(keys, settings)
    report = RP.report_lines(RP.reported(leads, due), since, as_of)
    K.write_partitioned(report, posixpath.join(out, "report"))
    small = is_small(settings, max(1, rows_of(SH.LEAD_BYTES) // k_max))
    K.update_history(stored_history(spark, sf_dir, out, with_run=True), posixpath.join(out, "history"), leads, lambda rows: SH.history_update(
        rows, leads, as_of, F.col("email_content"), F.col("email_batch_recipient"), picked_small=small).drop("emailed_now"))

    # Costs of all usage (A14) under the tenant's period label (K4).
    detail = P.cost_detail(all_usage(spark, sf_dir, out), prices).checkpoint(eager=True)
    totals = P.cost_total(detail)
    labels = totals.select("client", P.period_label(totals).alias("period_label"))
    K.write_costs(P.cost_daily(detail).join(labels, "client"), posixpath.join(out, "costs"))
    # The stages' counts, a handful of rows, once all their jobs are done
    stages = {stage: obs.get["rows"] for stage, obs in seen.items()}
    rows = [(day, stage, n) for stage, n in stages.items()]
    K.write_partitioned(fx.local_table(spark, rows, "day string, stage string, n_rows bigint").coalesce(1),
                        posixpath.join(out, "metrics"), partition_by=("day",))
    return {"batch_rows": stages["batch"], "stages": stages, "out": out}


def usage_of_day(spark: SparkSession, out: str, as_of) -> DataFrame:
    """The usage that the runs of a day have stored."""
    return K.stored(spark, out, "usage", S.CONSUMPTION).filter(F.col("search_date") == F.lit(as_ts(as_of)))
