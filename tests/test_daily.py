import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from leadspark import fixtures as fx
from leadspark import registry
from leadspark.operators import provider as PV
from leadspark.operators import selection as SL
from leadspark.operators import tenants as TN
from leadspark.plans import daily as D

SF = "/root/testdata/sf0.001"
DAY1 = fx.AS_OF_CONTACTS
DAY2 = DAY1 + dt.timedelta(days=7)


def read(spark, out, name):
    return spark.read.parquet(os.path.join(out, name))


@pytest.fixture(scope="module")
def two_days(spark, tmp_path_factory):
    """A day, the same day again (a repeated run), and the day a week later."""
    out = str(tmp_path_factory.mktemp("daily"))
    steps = []
    for day in (DAY1, DAY1, DAY2):
        D.run_daily(spark, SF, out, as_of=day)
        h = read(spark, out, "history").select("client", "search_id", "first_name", "last_name", "company", "search_date",
                                               "novelty_score", "email_date", "email_content").toPandas()
        steps.append((h, D.usage_of_day(spark, out, day).toPandas(), read(spark, out, "costs").toPandas()))
    return out, steps


def emailed(h, day):
    return h[h["email_date"] == day]


def test_history_holds_past_and_new_searches(spark, two_days):
    h = two_days[1][0][0]
    past = fx.history(spark, SF).count()
    new = h[h["search_date"] == DAY1]
    assert len(new) > 0 and len(h) == past + len(new) and h["search_id"].is_unique


def test_stage_counts_equal_plain_counts(spark, two_days):
    out, steps = two_days
    h = steps[0][0]
    got = {r["stage"]: r["n_rows"] for r in read(spark, out, "metrics").filter(F.col("day") == DAY1.strftime("%Y-%m-%d")).collect()}
    subs, settings, prices = fx.subscriptions(spark), fx.settings(spark), fx.pricing(spark)
    past = fx.history(spark, SF)
    assert got == {
        "tenants": TN.runnable_tenants(subs, settings, fx.consumption(spark, SF), prices, DAY1).count(),
        "history": past.count(), "eligible": SL.eligible(SL.candidates(fx.contacts(spark, SF), past, DAY1), DAY1).count(),
        "batch": (h["search_date"] == DAY1).sum(), "leads": len(emailed(h, DAY1))}


def test_novelty_compares_with_the_stored_text(spark, two_days):
    h = two_days[1][0][0]
    want = registry.queries()["t10_enrich_batch"](spark, SF).select(
        "client", "first_name", "last_name", "company", "novelty_score").toPandas()
    key = ["client", "first_name", "last_name", "company"]
    got = h[h["search_date"] == DAY1][[*key, "novelty_score"]]
    assert sorted(map(tuple, got.values)) == sorted(map(tuple, want.values))
    assert (got["novelty_score"] < 10).any()


def test_a_repeated_run_changes_nothing(two_days):
    (h1, u1, c1), (h2, u2, c2) = two_days[1][:2]
    for a, b in ((h1, h2), (u1, u2), (c1, c2)):
        order = sorted(a.columns)
        assert sorted(map(str, a[order].values.tolist())) == sorted(map(str, b[order].values.tolist()))


def test_marks_stay_and_nobody_is_mailed_twice_within_31_days(two_days):
    h1, h2 = two_days[1][1][0], two_days[1][2][0]
    first, second = emailed(h1, DAY1), emailed(h2, DAY2)
    assert len(first) > 0 and len(emailed(h2, DAY1)) == len(first)
    assert first["email_content"].notna().all()
    people = ["client", "first_name", "last_name", "company"]
    assert not set(map(tuple, first[people].values)) & set(map(tuple, second[people].values))


def test_stored_usage_counts_for_the_budget(spark, two_days):
    out, steps = two_days
    u = steps[1][1]
    assert {"search_engine_1", D.FN_EMAIL} <= set(u["function"])
    assert u["usage_id"].is_unique
    assert (u["function"] == D.FN_EMAIL).sum() == len(emailed(steps[1][0], DAY1))
    prices = fx.pricing(spark).limit(1).select(
        F.lit(99).cast("bigint").alias("ord"), F.lit("native").alias("model"),
        F.lit(dt.datetime(2001, 1, 1)).cast("timestamp_ntz").alias("start_date"),
        F.lit(None).cast("timestamp_ntz").alias("end_date"), F.lit(1000.0).alias("input_price"),
        F.lit(0.0).alias("output_price"), F.lit(0.0).alias("search_price")).unionByName(fx.pricing(spark))
    subs = fx.subscriptions(spark)
    without = TN.budget_gate(subs, fx.consumption(spark, SF), prices, DAY2)
    counted = TN.budget_gate(subs, D.all_usage(spark, SF, out), prices, DAY2)
    cost = {r["client"]: r["mtd_cost"] for r in without.collect()}
    assert any(r["mtd_cost"] > cost[r["client"]] for r in counted.collect())


def test_costs_stand_under_their_period(two_days):
    costs = two_days[1][2][2]
    assert len(costs) > 0
    assert all(label.startswith(f"{client}_") and len(label) == len(client) + 18
               for client, label in set(zip(costs["client"], costs["period_label"])))


def test_reported_tenants_have_their_drafts_not_sent(spark, two_days):
    out = two_days[0]
    sent = {r["client"] for r in fx.settings(spark).filter("send_proposed_emails").collect()}
    assert sent and not sent & {r["client"] for r in read(spark, out, "report").select("client").distinct().collect()}
    h = two_days[1][0][0]
    mailed = emailed(h, DAY1)
    for client, content in zip(mailed["client"], mailed["email_content"]):
        assert ("This proposed email follows" in content) == (client in sent)


class Comparing(PV.Provider):
    """Judges novelty by the texts that the request holds."""
    model = "comparing"

    def complete(self, function, prompt):
        if function == "results_comparison_agent":
            previous, new = prompt.split("Previous results:\n")[1].split("\n\nNew results:\n")
            score = 9 if previous == "None" else 1 if new else 0
            return '{"novelty_score": %d, "reasoning": "r"}' % score, 1, 1
        assert prompt.startswith("Person: ") and "Company: " in prompt and "Period: " in prompt
        return '{"services_need_score": 3, "reasoning": "r", "summary_of_facts": "f"}', 1, 1


def test_provider_sees_both_texts(spark, tmp_dir):
    import sys

    from pyspark import cloudpickle
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    out = os.path.join(tmp_dir, "run2")
    D.run_daily(spark, SF, out, provider=Comparing, provider_partitions=2, calls_per_minute=0)
    h = read(spark, out, "history").filter(F.col("search_date") == F.lit(DAY1))
    assert {r["novelty_score"] for r in h.collect()} == {1, 9}
    u = D.usage_of_day(spark, out, DAY1)
    assert u.filter("model = 'comparing'").count() == 2 * h.count()


class Dying(PV.Provider):
    """Notes each call; its worker dies at the first draft of an e-mail while a file says so."""
    model = "dying"

    def __init__(self, home):
        self.home = home

    def complete(self, function, prompt):
        with open(f"{self.home}/calls", "a") as log:
            log.write(function + "\n")
        if function == "email_proposal_agent":
            if os.path.exists(f"{self.home}/die"):
                os._exit(1)
            return "A drafted e-mail.", 1, 1
        if function == "url_extraction_agent":
            return '{"url_facebook": "f", "url_linkedin": "l", "url_company": "c"}', 1, 1
        if function == "results_comparison_agent":
            return '{"novelty_score": 9, "reasoning": "r"}', 1, 1
        return '{"services_need_score": 10, "reasoning": "r", "summary_of_facts": "f"}', 1, 1


def test_a_day_that_died_repeats_no_answered_call(spark, tmp_dir):
    import sys
    from collections import Counter

    from pyspark import cloudpickle
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    out = os.path.join(tmp_dir, "run3")
    steps = ("target_score_agent", "results_comparison_agent", "url_extraction_agent", "email_proposal_agent")

    def run(home=tmp_dir):
        return D.run_daily(spark, SF, out, provider=lambda: Dying(home), provider_partitions=2, calls_per_minute=0, provider_steps=steps)

    open(f"{tmp_dir}/die", "w").close()
    with pytest.raises(Exception):
        run()
    os.rename(f"{tmp_dir}/die", f"{tmp_dir}/alive")
    before = Counter(open(f"{tmp_dir}/calls").read().split())
    run()
    calls = Counter(open(f"{tmp_dir}/calls").read().split())
    h = read(spark, out, "history").filter(F.col("search_date") == F.lit(DAY1))
    n = h.count()
    for step in steps[:3]:
        assert calls[step] == before[step] == n
    assert calls["email_proposal_agent"] > before["email_proposal_agent"] > 0
    assert {r["url_company"] for r in h.select("url_company").distinct().collect()} == {"c"}
    mailed = read(spark, out, "history").filter(F.col("email_date") == F.lit(DAY1)).select("email_content").collect()
    assert mailed and all("A drafted e-mail." in r["email_content"] for r in mailed)


def test_no_stored_key_is_a_hash(spark, two_days):
    out, steps = two_days
    h, past = steps[2][0], fx.history(spark, SF)
    new = h[h["search_date"].isin([DAY1, DAY2])]
    first = past.agg(F.max("search_id")).first()[0] + 1
    assert sorted(new["search_id"]) == list(range(first, first + len(new)))
    first = fx.consumption(spark, SF).agg(F.max("usage_id")).first()[0] + 1
    u = D.K.stored(spark, out, "usage").toPandas()
    assert sorted(u["usage_id"]) == list(range(first, first + len(u)))
    ids = D.K.stored(spark, out, D.SEARCH_IDS).toPandas()
    assert sorted(ids["search_id"]) == sorted(new["search_id"])
