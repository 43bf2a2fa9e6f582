"""Cost plans (price list, as-of lookup, roll-ups, budget gate)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixtures as fx
from .. import oracle as O
from ..operators import pricing as P
from ..operators import tenants as TN
from ..registry import register

# Period used by the bounded cost report.
PERIOD_FROM = "2024-01-08"
PERIOD_TO = "2024-01-21 23:59:59"


def _usage(spark, sf_dir):
    return fx.consumption(spark, sf_dir)


@register("a14_cost_detail", O.with_views(
    """SELECT client, usage_id, date, model, price_ord, CAST(money AS DOUBLE) AS cost, price_missing
  FROM detail""", O.PRICE_PICK))
def cost_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = P.cost_detail(_usage(spark, sf_dir), fx.pricing(spark))
    return d.select("client", "usage_id", "date", "model", "price_ord",
                    F.col("money").cast("double").alias("cost"), "price_missing")


@register("a14_cost_daily", O.with_views(
    """SELECT client, CAST(date AS DATE) AS day, model, CAST(sum(money) AS DOUBLE) AS cost,
       count(*) AS n_records
  FROM detail GROUP BY client, CAST(date AS DATE), model""", O.PRICE_PICK))
def cost_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = P.cost_detail(_usage(spark, sf_dir), fx.pricing(spark))
    return P.cost_daily(d)


@register("j2_long_price_list", """WITH prices AS (
  SELECT CASE WHEN event_id % 2 = 0 THEN event_id ELSE 1000000000000 - event_id END AS ord, event_type AS model,
         ts AS start_date, CASE WHEN event_type = 'view' AND event_id % 50 = 0 THEN NULL
              ELSE ts + to_minutes(CAST(floor(value) AS BIGINT)) END AS end_date
  FROM events),
best AS (
  SELECT u.event_id, max(CASE WHEN p.end_date IS NULL OR p.end_date >= u.ts THEN 10000000000000 ELSE 0 END + p.ord) AS best
  FROM events u LEFT JOIN prices p ON p.model = u.event_type AND p.start_date <= u.ts GROUP BY u.event_id)
SELECT event_id AS usage_id, best % 10000000000000 AS price_ord, best >= 10000000000000 AS price_valid FROM best""")
def long_price_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J2 with a price row per event: periods of minutes that overlap, some
    open, in a file order of their own."""
    ev = fx.read(spark, sf_dir, "events")
    start, odd = F.col("ts").cast("timestamp_ntz"), F.col("event_id") % 2 != 0
    is_open = (F.col("event_type") == "view") & (F.col("event_id") % 50 == 0)
    prices = ev.select(
        F.when(odd, F.lit(10**12) - F.col("event_id")).otherwise(F.col("event_id")).alias("ord"),
        F.col("event_type").alias("model"), start.alias("start_date"),
        F.when(~is_open, start + F.make_dt_interval(F.lit(0), F.lit(0), F.floor("value").cast("int"))).alias("end_date"),
        F.col("value").alias("input_price"), F.col("value").alias("output_price"), F.lit(0.0).alias("search_price"))
    return P.price_asof(_usage(spark, sf_dir), prices).select("usage_id", "price_ord", "price_valid")


@register("a1_cost_period", O.with_views(
    """SELECT client, CAST(sum(money) AS DOUBLE) AS total_cost, min(date) AS first_date,
       max(date) AS last_date, count(*) AS n_records,
       client || '_20240108_' || strftime(max(date), '%Y%m%d') AS period_label
  FROM detail
  WHERE date >= TIMESTAMP '2024-01-08 00:00:00'
  GROUP BY client""", O.PRICE_PICK))
def cost_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1 + A2 + K4 + P9: total per tenant from a start date on (no end)."""
    d = P.cost_detail(_usage(spark, sf_dir), fx.pricing(spark), date_from=PERIOD_FROM)
    t = P.cost_total(d)
    return t.select("client", "total_cost", "first_date",
                    "last_date", "n_records",
                    P.period_label(t, date_from=PERIOD_FROM).alias("period_label"))


@register("p9_cost_between", O.with_views(
    """SELECT client, model, CAST(sum(money) AS DOUBLE) AS cost, count(*) AS n_records
  FROM detail
  WHERE date >= TIMESTAMP '2024-01-08 00:00:00' AND date <= TIMESTAMP '2024-01-21 23:59:59'
  GROUP BY client, model""", O.PRICE_PICK))
def cost_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = P.cost_detail(_usage(spark, sf_dir), fx.pricing(spark), PERIOD_FROM, PERIOD_TO)
    return d.groupBy("client", "model").agg(F.sum("money").cast("double").alias("cost"),
                                            F.count(F.lit(1)).alias("n_records"))


@register("j10_cost_by_measure", O.with_views(
    """SELECT client, model, measure, CAST(sum(amount) AS BIGINT) AS amount, CAST(sum(money) AS DOUBLE) AS cost
  FROM (
    SELECT client, model, 'input_tokens' AS measure, input_tokens AS amount,
           CASE WHEN input_price IS NOT NULL AND input_price <> 0 THEN CAST(input_tokens AS DECIMAL(13,0)) * CAST(input_price AS DECIMAL(15,9)) * 0.000001 ELSE 0 END AS money
      FROM priced
    UNION ALL
    SELECT client, model, 'output_tokens', output_tokens,
           CASE WHEN output_price IS NOT NULL AND output_price <> 0 THEN CAST(output_tokens AS DECIMAL(13,0)) * CAST(output_price AS DECIMAL(15,9)) * 0.000001 ELSE 0 END
      FROM priced
    UNION ALL
    SELECT client, model, 'search_calls', search_calls,
           CASE WHEN search_price IS NOT NULL AND search_price <> 0 THEN CAST(search_calls AS DECIMAL(13,0)) * CAST(search_price AS DECIMAL(15,9)) ELSE 0 END
      FROM priced) m
  GROUP BY client, model, measure""", O.PRICE_PICK))
def cost_by_measure(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = P.cost_by_measure(_usage(spark, sf_dir), fx.pricing(spark))
    return m.select("client", "model", "measure", "amount", "cost")


@register("a3_usage_rollup", O.with_views(
    """SELECT client, CAST(sum(search_calls) AS BIGINT) AS search_calls,
       CAST(sum(input_tokens) AS BIGINT) AS input_tokens,
       CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
       arg_max(function, (search_date, usage_id)) AS function,
       arg_max(model, (search_date, usage_id)) AS model, count(*) AS n_calls
  FROM consumption GROUP BY client"""))
def usage_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.usage_rollup(_usage(spark, sf_dir))


@register("j7_models_without_price", O.with_views(
    """SELECT DISTINCT client, model FROM consumption
  WHERE model NOT IN (SELECT model FROM pricing)"""))
def models_without_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.models_without_price(_usage(spark, sf_dir), fx.pricing(spark)).select("client", "model")


@register("p19_budget_gate", O.with_views(
    """SELECT s.client, s.monthly_budget, CAST(greatest(coalesce(m.mtd_cost, 0), 0) AS DOUBLE) AS mtd_cost,
       greatest(coalesce(m.mtd_cost, 0), 0) < s.monthly_budget AS runnable
  FROM subscriptions s
  LEFT JOIN (SELECT client, sum(money) AS mtd_cost FROM detail
             WHERE date >= TIMESTAMP '2024-01-01 00:00:00' GROUP BY client) m ON s.client = m.client
  WHERE s.client IS NOT NULL AND trim(s.client) <> ''
    AND s.start_date <= DATE '2024-01-31' AND (s.end_date IS NULL OR s.end_date >= DATE '2024-01-31')""",
    O.PRICE_PICK))
def budget_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P7 + P8 + P10 + A1b + P19."""
    g = TN.budget_gate(fx.subscriptions(spark), _usage(spark, sf_dir), fx.pricing(spark),
                       fx.AS_OF_USAGE)
    return g
