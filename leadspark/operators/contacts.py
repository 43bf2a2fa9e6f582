"""Contact cleaning and the contact <-> history join."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as TX
from ..schemas import KEY3

NAME_COLS = ["first_name", "last_name", "company"]
TEXT_COLS = ["first_name", "last_name", "company", "position", "url"]


def clean(contacts: DataFrame, dedupe: bool = True) -> DataFrame:
    """Strip whitespace on every text column, drop rows
    with a null or blank name part or company (D9), clean the URL, drop
    exact duplicate rows (the first ``src_row`` is kept). ``dedupe=False``
    leaves A11 to a later per-person aggregation (which subsumes it), saving
    a shuffle."""
    c = contacts.select(*[TX.strip_ws(F.col(n).cast("string")).alias(n) if n in TEXT_COLS
                          else F.col(n) for n in contacts.columns])
    keep = F.lit(True)
    for name in NAME_COLS:
        keep = keep & F.col(name).isNotNull() & (F.length(name) > 0)
    c = c.filter(keep)
    if "url" in c.columns:
        c = c.withColumn("url", TX.clean_url("url"))
    if not dedupe:
        return c
    business = ["client"] + [x for x in TEXT_COLS if x in c.columns]
    return c.groupBy(*business).agg(F.min("src_row").alias("src_row"))


def ascii_only(contacts: DataFrame) -> DataFrame:
    """F2 on every contact text column (null stays null, D10)."""
    return contacts.select(*[TX.strip_non_ascii(n).alias(n) if n in TEXT_COLS else F.col(n)
                             for n in contacts.columns])


def one_per_person(contacts: DataFrame) -> DataFrame:
    """One row per person (Key3); the first ``src_row`` wins. The
    aggregate hash-partitions on Key3, which the history join reuses."""
    other = [c for c in contacts.columns if c not in KEY3]
    return contacts.groupBy(*KEY3).agg(
        F.min_by(F.struct(*other), F.col("src_row")).alias("_r")).select(*KEY3, "_r.*")


def not_freelancer():
    """Drop positions starting with 'freelance' (any case); null kept."""
    return F.coalesce(~F.lower(F.col("position")).startswith("freelance"), F.lit(True))


def join_history(contacts: DataFrame, history: DataFrame, as_of) -> DataFrame:
    """J1 + P1 + P5: contacts LEFT JOIN history on Key3, one row per past
    search (or one row with null history), renamed as in the reference.

    Written as (history INNER contacts) UNION (contacts ANTI distinct keys
    of history): a person with a huge history is then on the splittable side
    of the inner join (AQE skew split) and the anti join sees one row per
    key after a map-side distinct.
    """
    cols = ["search_id", "search_date", "search_event_type", "search_query", "search_raw",
            "url_facebook", "url_linkedin", "url_company", "search_results", "total_score"]
    h = history.select(*KEY3, *cols)
    c = contacts.select(*KEY3, "position")
    inner = h.join(c, KEY3)
    none = c.join(h.select(*KEY3).distinct(), KEY3, "left_anti")
    for x in cols:
        none = none.withColumn(x, F.lit(None).cast(h.schema[x].dataType))
    both = inner.unionByName(none)
    limit = F.lit(as_of) - F.expr("INTERVAL 30 DAYS")
    return both.select(
        *KEY3, "position", F.col("search_date").alias("search_date_previous"),
        *[x for x in cols if x != "search_date"],
        (F.col("search_date").isNull() | (F.col("search_date") < limit))
        .alias("eligible_for_processing"))


def as_ts(v) -> dt.datetime:
    if isinstance(v, str):
        v = dt.datetime.fromisoformat(v)
    if isinstance(v, dt.date) and not isinstance(v, dt.datetime):
        v = dt.datetime(v.year, v.month, v.day)
    return v
