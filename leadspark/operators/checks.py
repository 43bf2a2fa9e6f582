"""Data-quality checks as rows ``(client, check, key, detail)``
and stage counters (A13).

Checks never raise; a plan filters on them (P17) or reports them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import text as TX
from .pricing import models_without_price, price_sequence_issues
from .tenants import settings_violations

USAGE_REQUIRED = ["function", "model", "search_calls", "input_tokens", "output_tokens"]


def _rows(df: DataFrame, client, check: str, key, detail) -> DataFrame:
    lit = lambda v: F.lit(v) if isinstance(v, str) or v is None else v
    return df.select(lit(client).cast("string").alias("client"), F.lit(check).alias("check"),
                     lit(key).cast("string").alias("key"), lit(detail).cast("string").alias("detail"))


def usage_violations(usage: DataFrame, id_col: str = "usage_id") -> DataFrame:
    """C4: usage records with a missing required field."""
    missing = F.filter(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in USAGE_REQUIRED]),
                       lambda x: x.isNotNull())
    u = usage.select("client", id_col, missing.alias("m")).filter(F.size("m") > 0)
    return _rows(u, F.col("client"), "usage_missing_fields", F.col(id_col),
                 F.concat(F.lit("missing required fields: "), F.array_join("m", ", ")))


def price_checks(prices: DataFrame, usage: DataFrame) -> DataFrame:
    """C7 + C8: models used without any price; gaps and open ends."""
    unpriced = _rows(models_without_price(usage, prices), F.col("client"), "model_without_price",
                     F.col("model"), F.lit("no price for this model"))
    seq = price_sequence_issues(prices)
    gaps = _rows(seq, None, "price_sequence", F.concat_ws("#", "model", F.col("ord").cast("string")),
                 F.col("issue"))
    return unpriced.unionByName(gaps)


def template_violations(old: DataFrame, new: DataFrame) -> DataFrame:
    """C10 + U4: an edited tenant prompt may not drop variables of the
    stored one; one row per dropped variable."""
    j = old.select("client", "name", F.col("body").alias("old")).join(
        new.select("client", "name", F.col("body").alias("new")), ["client", "name"])
    lost = j.select("client", "name", F.explode(TX.missing_vars("old", "new")).alias("var"))
    return _rows(lost, F.col("client"), "template_variable_removed",
                 F.concat_ws(":", "name", "var"), F.concat(F.lit("cannot remove {"), F.col("var"), F.lit("}")))


def all_checks(settings: DataFrame, prices: DataFrame, usage: DataFrame) -> DataFrame:
    """C4 + C5 + C7 + C8 in one table."""
    return (settings_violations(settings).select("client", "check", "key", "detail")
            .unionByName(price_checks(prices, usage))
            .unionByName(usage_violations(usage)))


def is_empty_source(df: DataFrame) -> bool:
    """An empty source (reads at most one row)."""
    return df.isEmpty()


def observed(df: DataFrame, stage: str) -> tuple[DataFrame, Observation]:
    """Count the rows passing a stage as a side effect of the job that
    consumes them (no extra pass). Read ``obs.get`` after an action."""
    obs = Observation(stage)
    return df.observe(obs, F.count(F.lit(1)).alias("rows")), obs
