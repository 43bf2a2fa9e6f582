"""Fixed schemas of the engine's tables (never inferred)."""

from __future__ import annotations

from pyspark.sql import types as T

S = T.StringType()
TS = T.TimestampNTZType()
L = T.LongType()
D = T.DoubleType()


def _struct(*fields):
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


KEY3 = ["client", "first_name", "last_name", "company"]

CONTACTS = _struct(
    ("client", S), ("src_row", L), ("first_name", S), ("last_name", S),
    ("company", S), ("position", S), ("url", S))

# 18 business columns of a stored search, plus tenant and surrogate id.
HISTORY = _struct(
    ("client", S), ("search_id", L),
    ("first_name", S), ("last_name", S), ("company", S),
    ("search_date", TS), ("search_event_type", S), ("search_query", S),
    ("search_raw", S), ("url_facebook", S), ("url_linkedin", S),
    ("url_company", S), ("search_results", S),
    ("novelty_score", L), ("activity_score", L), ("services_need_score", L),
    ("total_score", L),
    ("email_date", TS), ("email_content", S), ("email_batch_recipient", S))

CONSUMPTION = _struct(
    ("client", S), ("usage_id", L), ("search_date", TS), ("function", S),
    ("model", S), ("search_calls", L), ("input_tokens", L), ("output_tokens", L))

PRICING = _struct(
    ("ord", L), ("model", S), ("start_date", TS), ("end_date", TS),
    ("input_price", D), ("output_price", D), ("search_price", D))

SUBSCRIPTIONS = _struct(
    ("client", S), ("start_date", T.DateType()), ("end_date", T.DateType()),
    ("monthly_budget", D))

SETTINGS = T.StructType([
    T.StructField("client", S), T.StructField("batch_size", L),
    T.StructField("mini_batch_size", L), T.StructField("max_emails", L),
    T.StructField("max_tavily_searches", L), T.StructField("max_pplx_searches", L),
    T.StructField("llm_search", S), T.StructField("llm_email", S),
    T.StructField("email_days_of_week", T.ArrayType(S)),
    T.StructField("send_proposed_emails", T.BooleanType()),
    T.StructField("email_user", S), T.StructField("email_batch_recipient", S),
])

PROMPTS = _struct(("client", S), ("name", S), ("body", S))

COSTS = _struct(("date", TS), ("model", S), ("cost", D))

CHECKS = _struct(("client", S), ("check", S), ("key", S), ("detail", S))

HITS = T.ArrayType(T.StructType([
    T.StructField("url", S), T.StructField("content", S)]))

RANKINGS = T.ArrayType(T.StructType([
    T.StructField("first_name", S), T.StructField("last_name", S),
    T.StructField("company", S), T.StructField("rank", L)]))

# One usage record per external (or native) call made during enrichment.
USAGE = T.ArrayType(T.StructType([
    T.StructField("function", S), T.StructField("model", S),
    T.StructField("search_calls", L), T.StructField("input_tokens", L),
    T.StructField("output_tokens", L)]))
