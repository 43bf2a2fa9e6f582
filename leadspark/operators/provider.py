"""The pluggable call-out to external services (LLM / web search).

Requests are rows ``(request_id, function, prompt)``. They are spread over
``partitions`` tasks; each task builds its own provider object (clients are
not serialisable), keeps its share of the global rate limit, retries with
random exponential back-off and turns a final failure into an ``error``
value on that row. The answers are checkpointed to the shared folder at
once, so a later stage, a retried task or AQE re-planning never repeats an
external call; a request id answered twice (a retried task) is de-duplicated.

With a *ledger* (a table of answers by request id) requests go out in waves of about a minute's calls,
and each wave's answers are stored when it ends. A repeated run reads the ledger first: what is answered is never
asked again, a final failure is asked again under the next attempt number. Each function (engine)
has its own rate, and within a wave tenants take turns, so none waits for another's backlog.

:class:`OfflineProvider` is a deterministic stand-in used by tests and
offline runs; real providers implement the same ``complete`` method.
"""

from __future__ import annotations

import hashlib
import json
import random
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import path_exists
from .grouping import row_number_per_group

RESPONSE_SCHEMA = ("request_id string, function string, response string, model string, "
                   "input_tokens bigint, output_tokens bigint, attempts int, error string")

# Limits of the reference's daily run.
CALLS_PER_MINUTE = 20
MAX_ATTEMPTS = 6
BACKOFF_MIN_S, BACKOFF_MAX_S = 1.0, 60.0
MAX_IN_FLIGHT = 10


class Provider:
    """Contract: answer one request; raise on a transient failure."""
    model = "unknown"

    def complete(self, function: str, prompt: str) -> tuple[str, int, int]:
        raise NotImplementedError


class OfflineProvider(Provider):
    """Deterministic answers derived from the prompt (no network)."""
    model = "offline"

    def complete(self, function: str, prompt: str) -> tuple[str, int, int]:
        h = int(hashlib.md5(prompt.encode("utf-8")).hexdigest()[:8], 16)
        if function == "target_score_agent":
            out = {"services_need_score": h % 11, "reasoning": "offline",
                   "summary_of_facts": f"facts {h}"}
        elif function == "results_comparison_agent":
            out = {"novelty_score": h % 11, "reasoning": "offline"}
        elif function == "search_proposal_agent":
            out = {"search_queries": [f"query {h} news", f"query {h} blog"]}
        elif function == "url_extraction_agent":
            out = {"url_facebook": "", "url_linkedin": "", "url_company": ""}
        else:
            out = {"text": f"text {h}"}
        text = json.dumps(out)
        return text, len(prompt.split()), len(text.split())


def _run_partition(factory: Callable[[], Provider], per_task_rate: float,
                   max_attempts: int, sleep: Callable[[float], None]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider = factory()
        gap = 60.0 / per_task_rate if per_task_rate > 0 else 0.0
        last = 0.0
        for b in batches:
            out = []
            for rid, fn, prompt in zip(b["request_id"], b["function"], b["prompt"]):
                attempts, err, resp, tin, tout = 0, None, None, 0, 0
                while attempts < max_attempts:
                    attempts += 1
                    wait = last + gap - time.monotonic()
                    if wait > 0:
                        sleep(wait)
                    last = time.monotonic()
                    try:
                        resp, tin, tout = provider.complete(fn, prompt or "")
                        err = None
                        break
                    except Exception as e:  # noqa: BLE001 - becomes data
                        err = f"{type(e).__name__}: {e}"
                        if attempts < max_attempts:
                            sleep(min(BACKOFF_MAX_S, random.uniform(BACKOFF_MIN_S, 2 ** attempts)))
                out.append((rid, fn, resp, getattr(provider, "model", "unknown") if err is None
                            else "unknown", tin if err is None else 0, tout if err is None else 0,
                            attempts, err))
            yield pd.DataFrame(out, columns=["request_id", "function", "response", "model",
                                             "input_tokens", "output_tokens", "attempts", "error"])
    return run


LEDGER_SCHEMA = RESPONSE_SCHEMA + ", attempt int"


def call_with_ledger(requests: DataFrame, factory: Callable[[], Provider], partitions: int, ledger: str,
                     calls_per_minute: float | dict[str, float] = CALLS_PER_MINUTE, max_attempts: int = MAX_ATTEMPTS,
                     sleep: Callable[[float], None] = time.sleep, max_in_flight: int = MAX_IN_FLIGHT,
                     wave: int | None = None) -> DataFrame:
    """As :func:`call_provider`, through a ledger. ``calls_per_minute`` may give each function its
    own rate. ``wave``: requests of a function per wave (a minute's calls by default): at most
    that many are asked twice when a run dies. ``requests`` may carry ``client``."""
    spark = requests.sparkSession
    asked = requests.withColumn("client", F.col("client") if "client" in requests.columns else F.lit(None).cast("string"))
    asked = asked.select("request_id", "function", "prompt", "client").dropDuplicates(["request_id"]).checkpoint(eager=True)
    known = spark.read.schema(LEDGER_SCHEMA).parquet(ledger) if path_exists(spark, ledger) else spark.createDataFrame([], LEDGER_SCHEMA)
    tried = known.groupBy("request_id").agg(F.max("attempt").alias("tried"), F.max(F.col("error").isNull()).alias("done"))
    left = asked.join(tried, "request_id", "left").filter("done is null or not done").select(
        "request_id", "function", "prompt", "client", (F.coalesce("tried", F.lit(0)) + 1).alias("attempt"))
    # turns: the n-th request of each tenant before the next one of any; then places in that order
    left = _turns(left)
    left = left.checkpoint(eager=True)
    functions = [r[0] for r in left.select("function").distinct().collect()]  # the engines, a handful
    for function in sorted(functions):
        rate = calls_per_minute.get(function, CALLS_PER_MINUTE) if isinstance(calls_per_minute, dict) else calls_per_minute
        size = wave or max(1, int(rate) or 1000)
        mine = left.filter(F.col("function") == function)
        last = mine.agg(F.max("place")).head()[0]
        for first in range(0, last, size):
            now = mine.filter((F.col("place") > first) & (F.col("place") <= first + size))
            out = call_provider(now, factory, partitions, rate, max_attempts, sleep, max_in_flight)
            out.join(now.select("request_id", "attempt"), "request_id").select(
                *[c.split()[0] for c in LEDGER_SCHEMA.split(", ")]).write.mode("append").parquet(ledger)
    if not path_exists(spark, ledger):
        return spark.createDataFrame([], RESPONSE_SCHEMA)
    mine = spark.read.schema(LEDGER_SCHEMA).parquet(ledger).join(asked.select("request_id"), "request_id", "left_semi")
    # a good answer wins, else the last failure
    best = mine.groupBy("request_id").agg(F.max_by(F.struct(*[c for c in mine.columns if c != "request_id"]), F.struct(
        F.col("error").isNull().alias("good"), "attempt")).alias("x"))
    return best.select("request_id", "x.*").select(*[c.split()[0] for c in RESPONSE_SCHEMA.split(", ")])


def _turns(left: DataFrame) -> DataFrame:
    """``place`` of each request within its function: tenants take turns."""
    left = left.withColumn("tenant", F.coalesce("client", F.lit("")))
    left = row_number_per_group(left, ["function", "tenant"], ["request_id"], "turn")
    return row_number_per_group(left, ["function"], ["turn", "tenant", "request_id"], "place")


def call_provider(requests: DataFrame, factory: Callable[[], Provider], partitions: int,
                  calls_per_minute: float = CALLS_PER_MINUTE, max_attempts: int = MAX_ATTEMPTS,
                  sleep: Callable[[float], None] = time.sleep,
                  max_in_flight: int = MAX_IN_FLIGHT) -> DataFrame:
    """Answer every request once; returns RESPONSE_SCHEMA rows.

    ``partitions`` is the number of concurrent callers, at most the service's
    ``max_in_flight``; each gets ``calls_per_minute / partitions``.
    """
    if partitions > max_in_flight:
        raise ValueError(f"{partitions} callers exceed the service's limit of {max_in_flight} calls in flight")
    n = max(1, partitions)
    fn = _run_partition(factory, calls_per_minute / n, max_attempts, sleep)
    spread = requests.select("request_id", "function", "prompt").repartition(n, "request_id")
    answered = spread.mapInPandas(fn, RESPONSE_SCHEMA)
    done = answered.checkpoint(eager=True)
    return done.dropDuplicates(["request_id"])


def usage_of(responses: DataFrame) -> DataFrame:
    """Usage rows of the calls (failed calls: model ``unknown``,
    zero tokens)."""
    return responses.select(
        "request_id", "function", "model",
        F.when(F.col("function").startswith("search"), F.lit(1)).otherwise(F.lit(0))
        .cast("bigint").alias("search_calls"), "input_tokens", "output_tokens")
