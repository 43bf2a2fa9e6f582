"""T6 with tenants' rubrics, T14 failure values, T12 request ledger."""

import os
import sys
from collections import Counter


import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from leadspark.operators import provider as PV
from leadspark.operators import rubric as RB
from leadspark.operators import steps as ST

RULES = "client string, metric string, points bigint, keyword string, needs_person boolean, needs_company boolean"
SUBJECTS = "subject_id bigint, text_id bigint, client string, person string, company string"


def score(spark, texts, subjects, rules):
    out = RB.scored(spark.createDataFrame(texts, "text_id bigint, text string"), spark.createDataFrame(subjects, SUBJECTS),
                    spark.createDataFrame(rules, RULES))
    return {r.subject_id: (r.services_need_score, r.metrics, r.summary) for r in out.collect()}


TEXT = ("Ford press: John DOE led the launch-team.\nA case  study by Acme.\nNothing here.\n"
        "Ford Motor: record year, case studies\n")
RULE_ROWS = [(None, "A", 3, "Case Study", False, True), (None, "B", 2, "launch team", True, False), (None, "D", 4, "record year", False, True),
             ("T2", "A", 9, "case study", False, False), ("T2", "A", 9, "case studies", False, False), ("T2", "D", 4, "record", False, False),
             ("T2", "Z", 5, "stud", False, False)]


@pytest.mark.parametrize("bound", [RB.MAX_BROADCAST_RUBRIC, 2])
def test_each_tenant_has_its_rubric(spark, monkeypatch, bound):
    monkeypatch.setattr(RB, "MAX_BROADCAST_RUBRIC", bound)
    subjects = [(1, 1, "T1", "John Doe", "Ford Motor"), (2, 1, "T2", "x", "y"), (3, 1, "T1", "Jane Door", "Acme"),
                (4, 1, None, "John Doe", None), (5, 2, "T1", "John Doe", "Ford"), (6, 3, "T2", None, None), (7, 9, "T2", "a", "b")]
    got = score(spark, [(1, TEXT), (2, None), (3, "")], subjects, RULE_ROWS + RULE_ROWS[:1])
    lines = TEXT.split("\n")
    assert got[1] == (6, "B,D", f"{lines[0]}\n{lines[3]}")  # "case study" names another company
    assert got[2] == (10, "A,D", f"{lines[1]}\n{lines[3]}")  # capped; parts of words don't count
    assert got[3] == (3, "A", lines[1])
    assert got[4] == (2, "B", lines[0])
    assert got[5] == got[6] == got[7] == (0, "", "")


def test_empty_rubric(spark):
    assert score(spark, [(1, TEXT)], [(1, 1, "T", "a", "b")], []) == {1: (0, "", "")}


def test_failure_values_of_each_step(spark):
    rows = [("target_score_agent", None, "Boom: x"), ("target_score_agent", "{", None), ("target_score_agent", '{"reasoning": "r"}', None),
            ("results_comparison_agent", '{"novelty_score": 4}', None), ("url_extraction_agent", '{"url_facebook": "f"}', None),
            ("search_proposal_agent", "[]", None), ("results_ranking_agent", "no", None), ("results_ranking_agent", "{}", None),
            ("other", "{}", None), (None, None, None), ("target_score_agent", '{"services_need_score": 7, "reasoning": "", "summary_of_facts": "s"}', "late")]
    out = ST.outcomes(spark.createDataFrame(rows, "function string, response string, error string")).collect()
    assert [r.problem for r in out] == [
        "Boom: x", "Error: Invalid JSON", "Error: Missing key in JSON: 'services_need_score'", "Error: Missing key in JSON: 'reasoning'",
        "Error: Missing key in JSON: 'url_linkedin'", "Error: Invalid JSON", "Error: Invalid JSON", "Error: Missing key in JSON: 'rankings'",
        "Error: Unknown function other", "Error: Unknown function None", "late"]
    assert all(tuple(out[i].target_score_agent) == (0, 0, "") for i in (0, 1, 2, 10))
    assert out[3].results_comparison_agent.novelty_score == -1 and out[4].url_extraction_agent.url_facebook == "f"
    assert out[5].search_proposal_agent.search_queries == [] and out[6].results_ranking_agent.rankings[0].rank == -1
    assert out[7].results_ranking_agent.rankings == [] and out[8].target_score_agent is None


class Logged(PV.Provider):
    """Notes each call in a file; dies, or fails, where the file says so."""
    model = "logged"

    def complete(self, function, prompt):
        home = os.environ["CALL_LOG"] if "CALL_LOG" in os.environ else Logged.home
        with open(f"{home}/calls", "a") as log:
            log.write(prompt + "\n")
        if os.path.exists(f"{home}/die-{prompt}"):
            os._exit(1)  # the worker is gone, the run dies
        if os.path.exists(f"{home}/fail-{prompt}"):
            raise RuntimeError("busy")
        return "{}", 1, 1


def test_a_repeated_run_calls_only_what_is_missing(spark, tmp_path):
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    home, ledger = str(tmp_path), str(tmp_path / "ledger")
    Logged.home = home

    def factory(home=home):
        Logged.home = home
        return Logged()

    rows = [(f"r{i:02}", "f" if i < 8 else "g", f"p{i:02}", f"t{i % 2}" if i else None) for i in range(12)]
    req = spark.createDataFrame(rows, "request_id string, function string, prompt string, client string")
    call = lambda: PV.call_with_ledger(req, factory, 1, ledger, {"f": 0, "g": 0}, max_attempts=1,
                                       sleep=lambda s: None, wave=2)
    calls = lambda: Counter(open(f"{home}/calls").read().split())
    (tmp_path / "die-p07").touch()
    (tmp_path / "fail-p01").touch()
    with pytest.raises(Exception):
        call()
    first = calls()
    stored = {r.request_id for r in spark.read.parquet(ledger).filter("error is null").collect()}
    assert 2 <= len(stored) < 8
    (tmp_path / "die-p07").rename(tmp_path / "alive")
    got = {r.request_id: r for r in call().collect()}
    assert set(got) == {r[0] for r in rows} and got["r01"].error.startswith("RuntimeError")
    # what was answered is not asked again; what died in its wave is, once
    assert all(calls()[f"p{i[1:]}"] == 1 for i in stored) and max((calls() - first).values()) == 1
    (tmp_path / "fail-p01").rename(tmp_path / "well")
    before = calls()
    got = {r.request_id: r for r in call().collect()}
    assert all(r.error is None for r in got.values()) and calls() - before == Counter({"p01": 1})
    tries = spark.read.parquet(ledger).filter("request_id = 'r01'").orderBy("attempt").collect()
    assert [r.attempt for r in tries] == list(range(1, len(tries) + 1))
    before = calls()
    assert call().count() == 12 and calls() == before  # nothing left to ask


def test_tenants_take_turns(spark):
    rows = [(f"a{i}", "f", "p", "big") for i in range(20)] + [("z1", "f", "p", "small"), ("z2", "f", "p", "small")]
    left = spark.createDataFrame(rows, "request_id string, function string, prompt string, client string").withColumn("attempt", F.lit(1))
    place = {r.request_id: r.place for r in PV._turns(left).collect()}
    assert place["z1"] <= 2 and place["z2"] <= 4 and sorted(place.values()) == list(range(1, 23))
