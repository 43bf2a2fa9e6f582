"""Weekly shortlist of leads per tenant, history update and report counts.

Per-tenant and per-person facts (latest e-mail, top score, tie size) are
computed as aggregates and joined back instead of as windows over a whole
tenant, so a tenant or person holding a third of all rows is reduced
map-side before it is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import payloads as PL
from ..functions import text as TX
from ..schemas import KEY3
from . import provider as PV
from .contacts import as_ts
from .grouping import row_number_per_group, top_k_per_group
from .selection import k_bound, whole_days  # noqa: F401
from .sizing import MAX_BROADCAST_TENANTS, broadcast_bounded, is_small, rows_of

# Native stand-ins for the ranking criteria (promotable fact,
# detail, links). Boundaries are spelled out so that the pattern means the
# same in Java regex and RE2.
PROMOTABLE = (r"(?i)(^|[^A-Za-z0-9_])(launch(ed|es)?|opening|opened|award(s|ed)?|record|"
              r"milestone|partnership|expansion|new)([^A-Za-z0-9_]|$)")
URL_TOKEN = r"https?://[^ \t\n\r\f()<>]+"
# A picked lead with its draft, generously.
LEAD_BYTES = 4096
# Search ids (8 bytes) of a broadcast.
MAX_BROADCAST_IDS = rows_of(32)
EMAIL_GAP_DAYS = 31
SEARCH_AGE_DAYS = 31
MIN_NOVELTY = 5


def fill_search_date(history: DataFrame, given=None) -> DataFrame:
    """A null ``search_date`` becomes ``given`` or the tenant's latest.

    Only the undated rows are joined to the per-tenant maximum; dated rows
    pass through without any shuffle."""
    if given is not None:
        return history.withColumn("search_date", F.coalesce("search_date", F.lit(as_ts(given))))
    latest = (history.filter(F.col("search_date").isNotNull())
              .groupBy("client").agg(F.max("search_date").alias("_latest")))
    dated = history.filter(F.col("search_date").isNotNull())
    undated = (history.filter(F.col("search_date").isNull()).join(latest, "client", "left")
               .withColumn("search_date", F.col("_latest")).drop("_latest"))
    return dated.unionByName(undated.select(*history.columns))


def last_email_per_person(history: DataFrame) -> DataFrame:
    """Latest ``email_date`` of each person (map-side partial max)."""
    return history.groupBy(*KEY3).agg(F.max("email_date").alias("last_email_date"))


KEYS = ["client", "search_id", "first_name", "last_name", "company", "search_date", "novelty_score",
        "activity_score", "services_need_score", "total_score", "email_date"]


def history_keys(history: DataFrame) -> DataFrame:
    """The history without its texts, materialised: the shortlist reads it
    several times (tenant maximum, last e-mail, candidates)."""
    return history.select(*KEYS).checkpoint(eager=True)


def candidates(history: DataFrame, today) -> DataFrame:
    """P11 + F21: novel (> 5), not yet e-mailed, searched within 31 days,
    person not e-mailed within 31 days; ``combined_score`` = activity +
    services need. A null novelty is not novel."""
    t = F.lit(as_ts(today))
    h = fill_search_date(history).join(last_email_per_person(history), KEY3, "left")
    person_ok = (F.col("last_email_date").isNull()
                 | (whole_days(F.col("last_email_date"), t) > EMAIL_GAP_DAYS))
    keep = (F.coalesce(F.col("novelty_score") > MIN_NOVELTY, F.lit(False))
            & F.col("email_date").isNull()
            & (whole_days(F.col("search_date"), t) <= SEARCH_AGE_DAYS)
            & person_ok)
    return h.filter(keep).withColumn(
        "combined_score", F.col("activity_score") + F.col("services_need_score"))


def rank_features(text: Column) -> list[Column]:
    """T8 native criteria: promotable-fact hit, number of links, length."""
    t = F.coalesce(text, F.lit(""))
    return [t.rlike(PROMOTABLE).cast("int").alias("_promo"),
            F.size(F.regexp_extract_all(t, F.lit(URL_TOKEN), 0)).alias("_links"),
            F.length(t).alias("_len")]


def tie_flags(cands: DataFrame, tenants: DataFrame,
              tenant_bound: DataFrame | bool | None = None) -> DataFrame:
    """A6 + W3: candidates of the given tenants with ``top_score``,
    ``top_count`` and ``_tie`` (more rows share the top combined score than
    ``max_emails``). The candidates, keys without texts, are materialised
    once; per-tenant facts are aggregates broadcast back (at most one row per
    tenant), not windows over a whole tenant."""
    bound = tenants if tenant_bound is None else tenant_bound
    small = bound if isinstance(bound, bool) else is_small(bound, MAX_BROADCAST_TENANTS)
    c = cands.join(broadcast_bounded(tenants.select("client", "max_emails"), small), "client").checkpoint(eager=True)
    per_score = c.groupBy("client", "combined_score").agg(F.count(F.lit(1)).alias("n"))
    top = per_score.groupBy("client").agg(F.max("combined_score").alias("top_score"),
                                          F.max_by("n", "combined_score").alias("top_count"))
    c = c.join(broadcast_bounded(top, small), "client")
    in_tie = (F.col("top_count") > F.col("max_emails")) & (F.col("combined_score") == F.col("top_score"))
    return c.withColumn("_tie", in_tie)


# Function name of a ranking call; texts per ranking request.
FN_RANKING = "SearchResultsRankingAgent"
RANK_BATCH = 6


def ranking_requests(flagged: DataFrame, texts: DataFrame, batch_size: int = RANK_BATCH) -> DataFrame:
    """W6 + F31: the tie group of each tenant cut into requests of
    ``batch_size`` texts in ``search_id`` order (for a provider-backed T8).
    Rows are numbered with the range-partitioned numbering, so a huge tie
    group is never sorted in one task; each request gathers at most
    ``batch_size`` rows. The closing line states the request's own size."""
    tie = flagged.filter(F.col("_tie")).select("client", "search_id", "first_name", "last_name", "company")
    n = row_number_per_group(tie, ["client"], ["search_id"], name="tie_no")
    n = n.join(of_ids(texts, tie.select("search_id")), "search_id", "left")
    n = n.withColumn("batch_no", F.floor((F.col("tie_no") - 1) / batch_size).cast("bigint"))
    block = TX.rank_block("first_name", "last_name", "company", "search_results")
    g = n.groupBy("client", "batch_no").agg(
        F.array_sort(F.collect_list(F.struct("tie_no", block.alias("b")))).alias("bs"))
    cnt = F.size("bs")
    text = F.concat(F.array_join(F.transform("bs", lambda x: x["b"]), ""),
                    F.format_string("There are %d texts. You must return %d rankings", cnt, cnt))
    return g.select("client", "batch_no", cnt.cast("bigint").alias("n_texts"), text.alias("request"))


def of_ids(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """The texts of the given searches: ids are counted, and broadcast where
    few, so that no other text leaves the scan."""
    if is_small(ids, MAX_BROADCAST_IDS):
        ids = F.broadcast(ids)
    return texts.join(ids, "search_id", "left_semi")


def provider_ranks(requests: DataFrame, factory, partitions: int, calls_per_minute: float | dict[str, float] = PV.CALLS_PER_MINUTE,
                   ledger: str | None = None, day: str = "") -> tuple[DataFrame, DataFrame]:
    """T8 through a provider (T12): the ranking requests (W6) answered, and the
    answers parsed (F18). Returns the ranks by person (``client, first_name,
    last_name, company, rank``; the best where a person is named twice) and the
    calls as the provider counted them. A ``ledger`` tells requests apart by ``day`` too."""
    req = requests.select(F.concat_ws("|", "client", "batch_no", F.lit(day)).alias("request_id"), F.lit(FN_RANKING).alias("function"),
                          F.col("request").alias("prompt"), "client")
    if ledger:
        answers = PV.call_with_ledger(req, factory, partitions, ledger, calls_per_minute)
    else:
        answers = PV.call_provider(req, factory, partitions, calls_per_minute)
    named = answers.select(F.split_part("request_id", F.lit("|"), F.lit(1)).alias("client"),
                           F.inline(PL.rankings("response")))
    return named.groupBy(*KEY3).agg(F.min("rank").alias("rank")), answers


def shortlist(cands: DataFrame, texts: DataFrame, tenants: DataFrame, k_max: int,
              tenant_bound: DataFrame | bool | None = None, ranks: DataFrame | None = None) -> DataFrame:
    """A6 + W3 + T8 + O5 + W4/O6 + P20: best ``max_emails`` leads per tenant.

    When more rows share the top combined score than ``max_emails`` (a tie),
    the tie group is ordered by the native ranking criteria; ``rank`` is the
    resulting unique rank (1 = best) of the chosen tie rows. Otherwise rows
    follow the combined score, ``search_id`` breaking equal scores.
    ``k_max`` is a literal upper bound of every tenant's ``max_emails``.
    ``texts`` (search_id, search_results) is read for the tie rows only; the
    result holds no text (see :func:`with_texts`). ``ranks`` (a provider's, by
    person) order the tie rows instead of the native criteria; unranked ones
    come last.
    """
    c = tie_flags(cands, tenants, tenant_bound)
    if ranks is not None:
        c = c.join(ranks.withColumnRenamed("rank", "_rank"), KEY3, "left")
        order = [F.col("combined_score").desc(), F.when(F.col("_tie"), F.col("_rank")).asc_nulls_last(),
                 F.col("search_id").asc()]
        best = top_k_per_group(c, ["client"], order, "max_emails", k_max, rank_col="pick_rank")
        return best.withColumn("rank", F.when(F.col("_tie"), F.col("pick_rank"))).drop("_rank")
    tied = of_ids(texts, c.filter("_tie").select("search_id"))
    c = c.join(tied.select("search_id", *rank_features(F.col("search_results"))), "search_id", "left")
    none = {"_promo": 0, "_links": 0, "_len": 0}  # a tie row without a stored text
    c = c.na.fill(none)
    order = [F.col("combined_score").desc(),
             *[F.when(F.col("_tie"), F.col(x)).desc_nulls_last() for x in ("_promo", "_links", "_len")],
             F.col("search_id").asc()]
    top_k = top_k_per_group(c, ["client"], order, "max_emails", k_max, rank_col="pick_rank")
    return top_k.withColumn("rank", F.when(F.col("_tie"), F.col("pick_rank"))).drop(
        "_promo", "_links", "_len")


def with_texts(picked: DataFrame, texts: DataFrame) -> DataFrame:
    """Picked leads (at most tenants x max_emails) with their result text."""
    p = picked.checkpoint(eager=True)
    return p.join(of_ids(texts, p.select("search_id")), "search_id", "left")


def history_update(history: DataFrame, picked: DataFrame, today, content: Column,
                   recipient: Column, picked_small: bool = True) -> DataFrame:
    """Set the e-mail columns on the picked rows (by ``search_id``)
    and keep every other row unchanged. ``picked`` holds at most
    tenants x max_emails rows; ``picked_small`` is that bound's check."""
    p = broadcast_bounded(picked.select(
        "search_id", F.lit(as_ts(today)).alias("_ed"), content.alias("_ec"),
        recipient.alias("_er")), picked_small)
    h = history.join(p, "search_id", "left")
    hit = F.col("_ed").isNotNull()
    return (h.withColumn("email_date", F.when(hit, F.col("_ed")).otherwise(F.col("email_date")))
            .withColumn("email_content", F.when(hit, F.col("_ec")).otherwise(F.col("email_content")))
            .withColumn("email_batch_recipient",
                        F.when(hit, F.col("_er")).otherwise(F.col("email_batch_recipient")))
            .withColumn("emailed_now", hit).drop("_ed", "_ec", "_er"))


def searches_since_last_email(history: DataFrame, tenants: DataFrame | None = None) -> DataFrame:
    """A4 + A5: per tenant the latest e-mail date and how many dated searches
    came after it (all dated searches when the tenant never e-mailed).

    With ``tenants`` (a dimension table, size-checked) the history is first
    cut to those tenants, so the per-tenant maximum is bounded by that table
    and is broadcast back; without it the join is left to AQE."""
    small = False
    if tenants is not None:
        small = is_small(tenants, MAX_BROADCAST_TENANTS)
        history = history.join(broadcast_bounded(tenants.select("client"), small), "client", "left_semi")
    last = history.groupBy("client").agg(F.max("email_date").alias("last_email_date"))
    h = history.join(broadcast_bounded(last, small), "client")
    after = F.col("search_date").isNotNull() & (
        F.col("last_email_date").isNull() | (F.col("search_date") > F.col("last_email_date")))
    return h.groupBy("client", "last_email_date").agg(
        F.count_if(after).alias("searches_since_last_email"))


def weekday_name(today) -> str:
    return as_ts(today).strftime("%A")
