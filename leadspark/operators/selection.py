"""Daily batch selection: eligibility, repeatable shuffle and weighted
sampling without replacement, all tenants in one plan.

Random draws are repeatable and engine-independent: a uniform ``u`` in
(0, 1) comes from the first 13 hex digits of ``md5(seed|key)``. Weighted
sampling without replacement uses the Efraimidis-Spirakis key
``-ln(u) / w`` (smallest first), so drawing ``n`` rows is "take the first
``n`` by key" and runs as a per-tenant top-k.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import KEY3
from . import contacts as CT
from .grouping import top_k_per_group
from .sizing import broadcast_bounded

HEX13 = float(16 ** 13)


def uniform(seed: str, *cols) -> Column:
    """Repeatable U(0,1) from md5 of ``seed|col1|col2...`` (never 0 or 1)."""
    h = F.md5(F.concat_ws("|", F.lit(seed), *[F.col(c) if isinstance(c, str) else c for c in cols]))
    n = F.conv(F.substring(h, 1, 13), 16, 10).cast("double")
    return (n + F.lit(0.5)) / F.lit(HEX13)


def k_bound(settings: DataFrame, column: str) -> int:
    """Literal upper bound of a per-tenant limit: one aggregate row read from
    the settings dimension (never from the large tables)."""
    v = settings.agg(F.max(column)).first()[0]
    return max(int(v or 1), 1)


def latest_search(history: DataFrame) -> DataFrame:
    """Per person the latest search (by date, then id) and its score.
    Partial aggregation runs map-side, so a hot person costs one row per
    map task in the shuffle."""
    best = F.max_by(F.struct("search_id", "search_date", "total_score"),
                    F.struct("search_date", "search_id"))
    return history.groupBy(*KEY3).agg(best.alias("_b"), F.count(F.lit(1)).alias("n_searches")).select(
        *KEY3, F.col("_b.search_id").alias("last_search_id"),
        F.col("_b.search_date").alias("last_search_date"),
        F.col("_b.total_score").alias("last_total_score"), "n_searches")


def whole_days(start, end) -> Column:
    """whole elapsed days, floored like a Python timedelta."""
    return F.floor(F.timestamp_diff("SECOND", start, end) / F.lit(86400)).cast("bigint")


def candidates(contacts: DataFrame, history: DataFrame, as_of) -> DataFrame:
    """Clean contacts (one per person) with their latest search attached.

    Exact-duplicate removal (A11) is folded into the per-person aggregate:
    the person keeps the first ``src_row`` either way, so contacts are
    shuffled once, on Key3, and the history aggregate on Key3 joins them
    without another exchange."""
    c = CT.one_per_person(CT.ascii_only(CT.clean(contacts, dedupe=False)))
    return c.join(latest_search(history), KEY3, "left")


def eligible(cands: DataFrame, as_of) -> DataFrame:
    """P4 + P6: not a freelancer; never searched or last search more than
    30 whole days before ``as_of``."""
    a = F.lit(CT.as_ts(as_of))
    ok = F.col("last_search_date").isNull() | (whole_days(F.col("last_search_date"), a) > 30)
    return cands.filter(CT.not_freelancer() & ok).withColumn(
        "is_new", F.col("last_search_id").isNull())


def daily_batch(elig: DataFrame, tenants: DataFrame, seed: str,
                salts: int | None = None, tenant_bound: DataFrame | bool | None = None,
                k_max: int | None = None) -> DataFrame:
    """O2 + O3 + O4 + W5: per tenant, never-searched contacts first (in
    shuffled order), then the rest drawn by weight ``last_total_score``
    without replacement; null/non-positive weights come after all positive
    ones (in shuffled order). ``tenants`` gives ``batch_size`` and
    ``mini_batch_size``; ``tenant_bound`` is the dimension table (or the
    result of its size check) that bounds ``tenants``' rows; ``k_max`` a
    known bound of every ``batch_size`` (else read from ``tenants``)."""
    u = uniform(seed, *KEY3)
    w = F.col("last_total_score")
    tier = F.when(F.col("is_new"), 0).when(w > 0, 1).otherwise(2)
    key = F.when(tier == 1, -F.log(u) / w.cast("double")).otherwise(u)
    t = broadcast_bounded(tenants.select("client", "batch_size", "mini_batch_size"),
                          tenants if tenant_bound is None else tenant_bound)
    d = elig.join(t, "client").withColumn("_tier", tier).withColumn("_key", key)
    order = [F.col("_tier"), F.col("_key"), *[F.col(c) for c in KEY3[1:]]]
    kw = {"salts": salts} if salts else {}
    top = top_k_per_group(d, ["client"], order, "batch_size", k_max or k_bound(tenants, "batch_size"),
                          rank_col="pick_rank", **kw)
    return top.withColumn(
        "mini_batch", F.floor((F.col("pick_rank") - 1) / F.col("mini_batch_size")).cast("bigint")
    ).drop("_tier", "_key")


def batch_plan(elig: DataFrame, tenants: DataFrame,
               tenant_bound: DataFrame | bool | None = None) -> DataFrame:
    """A9 + A10: per tenant the eligible split into new/existing, the top
    score (1 when none) and the slots left for weighted sampling."""
    t = broadcast_bounded(tenants.select("client", "batch_size"),
                          tenants if tenant_bound is None else tenant_bound)
    agg = elig.groupBy("client").agg(
        F.count(F.lit(1)).alias("n_eligible"),
        F.count_if(F.col("is_new")).alias("n_new"),
        F.count_if(~F.col("is_new")).alias("n_existing"),
        F.coalesce(F.max(F.when(~F.col("is_new"), F.col("last_total_score"))), F.lit(1))
        .cast("bigint").alias("max_score"))
    out = t.join(agg, "client", "left").na.fill(0, ["n_eligible", "n_new", "n_existing"])
    out = out.withColumn("max_score", F.coalesce("max_score", F.lit(1).cast("bigint")))
    new_taken = F.least(F.col("n_new"), F.col("batch_size"))
    return out.select(
        "client", "batch_size", "n_eligible", "n_new", "n_existing", "max_score",
        new_taken.cast("bigint").alias("new_taken"),
        F.least(F.col("batch_size") - new_taken, F.col("n_existing")).cast("bigint")
        .alias("sampled"))
