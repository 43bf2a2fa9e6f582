"""Tenant gates: live subscription, config validity, budget, weekday.

All tenant-level tables (subscriptions, settings, budgets) have one row per
tenant, so they are tiny next to contacts/history and are joined with a
broadcast hint only after :func:`leadspark.operators.pricing.is_small`.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .pricing import cost_mtd
from .sizing import MAX_BROADCAST_TENANTS, broadcast_bounded, is_small, maybe_broadcast  # noqa: F401


def _day(v) -> dt.date:
    if isinstance(v, str):
        v = dt.datetime.fromisoformat(v)
    return v.date() if isinstance(v, dt.datetime) else v


def live_subscriptions(subs: DataFrame, today) -> DataFrame:
    """P7 + P8: named tenant, ``start <= today`` and open or ``end >= today``
    (a null start is not live)."""
    t = F.lit(_day(today))
    named = F.col("client").isNotNull() & (F.trim(F.col("client")) != "")
    live = (F.col("start_date") <= t) & (F.col("end_date").isNull() | (F.col("end_date") >= t))
    return subs.filter(named & live)


# Settings that must be given (beside those with a range).
REQUIRED = ["mini_batch_size", "max_emails", "email_user", "email_batch_recipient"]


def _rules() -> list[tuple[str, str, Column]]:
    # The allowed ranges and models.
    c = F.col
    rules: list[tuple[str, str, Column]] = [
        *[(f"missing_{name}", f"{name} must be given", c(name).isNull()) for name in REQUIRED],
        ("send_flag", "send_proposed_emails must be true or false",
         c("send_proposed_emails").isNull()),
        ("max_tavily", "max_tavily_searches must be in 1..19",
         ~F.coalesce((c("max_tavily_searches") > 0) & (c("max_tavily_searches") < 20), F.lit(False))),
        ("max_pplx", "max_pplx_searches must be in 1..9",
         ~F.coalesce((c("max_pplx_searches") > 0) & (c("max_pplx_searches") < 10), F.lit(False))),
        ("batch_size", "batch_size must be in 1..999",
         ~F.coalesce((c("batch_size") > 0) & (c("batch_size") < 1000), F.lit(False))),
        ("mini_batch", "mini_batch_size must be <= batch_size",
         F.coalesce(c("mini_batch_size"), F.lit(0)) > F.coalesce(c("batch_size"), F.lit(0))),
        ("llm_search", "llm_search must be gpt-4o-mini, gpt-4o or gpt-4",
         ~F.coalesce(c("llm_search").isin("gpt-4o-mini", "gpt-4o", "gpt-4"), F.lit(False))),
        ("llm_email", "llm_email must start with gpt-4o",
         ~F.coalesce(c("llm_email").startswith("gpt-4o"), F.lit(False))),
        ("email_days", "at least one weekday is needed",
         F.coalesce(F.size(c("email_days_of_week")) < 1, F.lit(True))),
    ]
    return rules


def settings_violations(settings: DataFrame) -> DataFrame:
    """One row per broken settings rule (client, check, key, detail)."""
    rules = _rules()
    arr = F.array(*[F.when(pred, F.struct(F.lit(name).alias("check"), F.lit(msg).alias("detail")))
                    for name, msg, pred in rules])
    return (settings.select("client", F.explode(F.filter(arr, lambda x: x.isNotNull())).alias("v"))
            .select("client", F.col("v.check").alias("check"),
                    F.col("client").alias("key"), F.col("v.detail").alias("detail")))


def valid_settings(settings: DataFrame) -> DataFrame:
    """Tenants whose settings break no rule (the anti join of the
    violations, evaluated row-wise: no shuffle, no join)."""
    broken = F.lit(False)
    for _, _, pred in _rules():
        broken = broken | F.coalesce(pred, F.lit(False))
    return settings.filter(~broken)


def budget_gate(subs: DataFrame, usage: DataFrame, prices: DataFrame, as_of) -> DataFrame:
    """P19 (+A1b, J11): live tenants with month-to-date cost and whether they
    may run (``mtd_cost < monthly_budget``; missing usage counts as 0)."""
    live = live_subscriptions(subs, as_of)
    small = is_small(subs, MAX_BROADCAST_TENANTS)
    # mtd has at most one row per live tenant (usage is cut to them first).
    mtd = broadcast_bounded(cost_mtd(usage, prices, as_of, live, small), small)
    out = live.join(mtd, "client", "left").select(
        "client", "monthly_budget",
        F.greatest(F.coalesce(F.col("mtd_cost"), F.lit(0.0)), F.lit(0.0)).alias("mtd_cost"))
    return out.withColumn("runnable", F.col("mtd_cost") < F.col("monthly_budget"))


def weekday_due(settings: DataFrame, as_of) -> Column:
    """``as_of``'s weekday name, any case, is in the tenant's list."""
    name = F.lower(F.date_format(F.lit(as_of), "EEEE"))
    return F.array_contains(F.transform(F.col("email_days_of_week"), lambda d: F.lower(d)), name)


def runnable_tenants(subs: DataFrame, settings: DataFrame, usage: DataFrame,
                     prices: DataFrame, as_of) -> DataFrame:
    """Tenants that run today: live, valid config, under budget.
    A subset of the settings rows (semi join), so bounded by that table."""
    gate = budget_gate(subs, usage, prices, as_of).filter("runnable").select("client")
    return valid_settings(settings).join(broadcast_bounded(gate, subs), "client", "left_semi")
