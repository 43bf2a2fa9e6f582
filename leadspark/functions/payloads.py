"""Parsers of the JSON payloads the enrichment steps return.

Every parser is a native expression: invalid JSON and missing keys become
values (the defaults below), never exceptions, so one bad row cannot fail a
task.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col

# Failure values of each step.
INVALID_JSON = "Error: Invalid JSON"
MISSING_KEY = "Error: Missing key in JSON: '%s'"
UNKNOWN = "Unknown"


def keys(payload) -> Column:
    """Top-level keys of a JSON object; null when it is not valid JSON."""
    return F.json_object_keys(col(payload))


def has(payload, key: str) -> Column:
    return F.coalesce(F.array_contains(keys(payload), F.lit(key)), F.lit(False))


def as_int(v: Column) -> Column:
    """Python ``int()`` of a number or numeric text (truncates)."""
    return v.try_cast("double").cast("bigint")


def field(payload, key: str) -> Column:
    return F.get_json_object(col(payload), f"$.{key}")


def target_score(payload) -> Column:
    """struct(activity_score, services_need_score, summary). Activity is
    always 0 (D14); any missing key, bad JSON or non-number gives 0, 0, ''."""
    p = col(payload)
    ok = (has(p, "services_need_score") & has(p, "reasoning") & has(p, "summary_of_facts")
          & as_int(field(p, "services_need_score")).isNotNull())
    return F.struct(
        F.lit(0).cast("bigint").alias("activity_score"),
        F.when(ok, as_int(field(p, "services_need_score"))).otherwise(F.lit(0).cast("bigint"))
        .alias("services_need_score"),
        F.when(ok, F.coalesce(field(p, "summary_of_facts"), F.lit(""))).otherwise(F.lit(""))
        .alias("summary"))


def novelty(payload) -> Column:
    """F16: struct(novelty_score, reasoning); bad JSON -> -1 and
    ``Error: Invalid JSON``; a missing key -> -1 and a message naming it."""
    p = col(payload)
    valid = keys(p).isNotNull()
    score = F.when(~valid, F.lit(-1)).when(~has(p, "novelty_score"), F.lit(-1)) \
        .when(~has(p, "reasoning"), F.lit(-1)).otherwise(as_int(field(p, "novelty_score")))
    why = (F.when(~valid, F.lit(INVALID_JSON))
           .when(~has(p, "novelty_score"), F.lit(MISSING_KEY % "novelty_score"))
           .when(~has(p, "reasoning"), F.lit(MISSING_KEY % "reasoning"))
           .otherwise(field(p, "reasoning")))
    return F.struct(score.cast("bigint").alias("novelty_score"), why.alias("reasoning"))


def search_queries(payload) -> Column:
    """the proposed queries; anything else -> empty list."""
    arr = F.from_json(col(payload), "struct<search_queries: array<string>>")["search_queries"]
    return F.coalesce(arr, F.array().cast("array<string>"))


RANK_SCHEMA = "struct<rankings: array<struct<first_name: string, last_name: string, company: string, rank: bigint>>>"


def rankings(payload) -> Column:
    """ranking rows; no ``rankings`` key -> none; bad JSON -> one
    ``Unknown`` row with rank -1."""
    p = col(payload)
    parsed = F.from_json(p, RANK_SCHEMA)["rankings"]
    sentinel = F.array(F.struct(F.lit(UNKNOWN).alias("first_name"), F.lit(UNKNOWN).alias("last_name"),
                                F.lit(UNKNOWN).alias("company"), F.lit(-1).cast("bigint").alias("rank")))
    empty = F.array().cast("array<struct<first_name:string,last_name:string,company:string,rank:bigint>>")
    return F.when(keys(p).isNull(), sentinel).otherwise(F.coalesce(parsed, empty))


def urls(payload) -> Column:
    """struct(url_facebook, url_linkedin, url_company), '' by default;
    keys are read in that order and reading stops at the first missing one."""
    p = col(payload)
    fb, li, co = has(p, "url_facebook"), has(p, "url_linkedin"), has(p, "url_company")
    blank = F.lit("")
    return F.struct(
        F.when(fb, field(p, "url_facebook")).otherwise(blank).alias("url_facebook"),
        F.when(fb & li, field(p, "url_linkedin")).otherwise(blank).alias("url_linkedin"),
        F.when(fb & li & co, field(p, "url_company")).otherwise(blank).alias("url_company"))


HIT_SCHEMA = "array<struct<title: string, link: string>>"


def search_hits(reply) -> Column:
    """A search reply given as a list literal of dicts (single quotes
    accepted); not a list -> empty."""
    return F.coalesce(F.from_json(col(reply), HIT_SCHEMA, {"allowSingleQuotes": "true"}),
                      F.array().cast(HIT_SCHEMA))
