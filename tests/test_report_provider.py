import datetime as dt
import sys

import pytest

from pyspark import cloudpickle

from pyspark.sql import functions as F

from leadspark.operators import provider as PV
from leadspark.operators import report as RP


def test_paging_clamps_to_last_page(spark):
    h = spark.range(1, 46).select(F.lit("T").alias("client"), F.col("id").alias("search_id"),
                                  F.lit(dt.datetime(2024, 1, 1)).alias("search_date"))
    paged = RP.history_pages(h, 20, [F.col("search_id")])
    page = RP.history_page(paged, 9).collect()
    assert sorted(r.row_no for r in page) == list(range(41, 46))
    assert {r.page_no for r in page} == {3} and {r.n_pages for r in page} == {3}


def test_report_lines_layout(spark):
    leads = spark.createDataFrame(
        [("T", 1, "Ann", "Lee", "Co", dt.datetime(2024, 1, 2), "see ( https://a.b/x ) now", "mail")],
        "client string, pick_rank bigint, first_name string, last_name string, company string, "
        "search_date timestamp_ntz, search_results string, email_content string")
    since = spark.createDataFrame([("T", 4)], "client string, searches_since_last_email bigint")
    rows = RP.report_lines(leads, since, dt.datetime(2024, 1, 5)).orderBy("section_no", "line_no").collect()
    kinds = [(r.section_no, r.kind, r.text) for r in rows]
    assert kinds[0] == (0, "h1", "Proposed Leads")
    assert (0, "li", "Co, Ann Lee") in kinds
    assert (1, "link", "https://a.b/x") in kinds and (1, "text", "see (") in kinds
    assert kinds[-1] == (2, "h2", "End of Report")


def test_long_email_draft_is_kept(spark):
    df = spark.createDataFrame([("Hi {first_name} " + "w " * 300, "p one\n\nlaunch news", "launch")],
                               "t string, b string, r string")
    got = df.select(RP.draft_email(F.col("t"), F.col("b"), F.col("r"), F.lit("A"), F.lit("B"),
                                   F.lit("C")).alias("e")).select("e", *RP.draft_size(F.col("e"))).first()
    assert got.e == "Hi A " + "w " * 300 + "\n\nlaunch news"
    assert got.n_words == 304 and got.over_limit


def test_more_callers_than_the_service_allows(spark):
    req = spark.createDataFrame([("1", "f", "ok")], "request_id string, function string, prompt string")
    with pytest.raises(ValueError):
        PV.call_provider(req, PV.OfflineProvider, 20)
    out = PV.call_provider(req, PV.OfflineProvider, 20, calls_per_minute=0, max_in_flight=20, sleep=lambda s: None)
    assert out.count() == 1


class Flaky(PV.Provider):
    model = "flaky"
    calls = {}

    def complete(self, function, prompt):
        n = Flaky.calls.get(prompt, 0) + 1
        Flaky.calls[prompt] = n
        if prompt == "never" or n < 3:
            raise RuntimeError("busy")
        return "{}", 1, 1


def test_provider_retries_and_errors(spark):
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # ship Flaky by value
    req = spark.createDataFrame([("1", "f", "ok"), ("2", "f", "never")], "request_id string, function string, prompt string")
    out = {r.request_id: r for r in PV.call_provider(req, Flaky, 1, calls_per_minute=0,
                                                     sleep=lambda s: None).collect()}
    assert out["1"].error is None and out["1"].attempts == 3 and out["1"].model == "flaky"
    assert out["2"].error.startswith("RuntimeError") and out["2"].model == "unknown"


def test_offline_provider_feeds_parsers(spark):
    from leadspark.functions import payloads as PL
    req = spark.createDataFrame([(str(i), "target_score_agent", f"text {i}") for i in range(20)],
                                "request_id string, function string, prompt string")
    out = PV.call_provider(req, PV.OfflineProvider, 4, calls_per_minute=0, sleep=lambda s: None)
    s = out.select(PL.target_score("response").alias("s")).collect()
    assert len(s) == 20 and all(0 <= r.s.services_need_score <= 10 for r in s)
    assert PV.usage_of(out).count() == 20
