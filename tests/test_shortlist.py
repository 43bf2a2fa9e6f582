import datetime as dt

from pyspark.sql import functions as F

from leadspark.operators import shortlist as SH

TODAY = dt.datetime(2024, 6, 1)
HCOLS = ("client string, search_id bigint, first_name string, last_name string, company string, "
         "search_date timestamp_ntz, novelty_score bigint, activity_score bigint, "
         "services_need_score bigint, total_score bigint, email_date timestamp_ntz, "
         "search_results string, email_content string, email_batch_recipient string")


def _h(spark, rows):
    full = [(c, i, f, "l", "co", d, n, a, s, None if n is None else n + a + s, e, t, None, None)
            for c, i, f, d, n, a, s, e, t in rows]
    return spark.createDataFrame(full, HCOLS)


def test_candidate_predicate(spark):
    d = TODAY - dt.timedelta(days=3)
    h = _h(spark, [("T", 1, "a", d, 5, 1, 1, None, ""), ("T", 2, "b", d, 6, 1, 1, None, ""),
                   ("T", 3, "c", d, None, 1, 1, None, ""),
                   ("T", 4, "d", TODAY - dt.timedelta(days=40), 9, 1, 1, None, ""),
                   ("T", 5, "e", d, 9, 1, 1, None, ""),
                   ("T", 6, "e", d - dt.timedelta(days=20), 9, 1, 1, TODAY - dt.timedelta(days=10), "")])
    got = sorted(r.search_id for r in SH.candidates(h, TODAY).collect())
    assert got == [2]  # 5 not novel, null not novel, 40 days old, person e mailed 10 days ago


def test_tie_ranks_are_a_permutation_and_update_touches_only_picked(spark):
    d = TODAY - dt.timedelta(days=1)
    rows = [("T", i, f"p{i}", d, 9, 1, 3, None, "launch" if i % 2 else "x" * i) for i in range(1, 8)]
    rows.append(("T", 50, "low", d, 9, 0, 1, None, ""))
    h = _h(spark, rows)
    tenants = spark.createDataFrame([("T", 3)], "client string, max_emails bigint")
    picked = SH.shortlist(SH.candidates(h, TODAY), h.select("search_id", "search_results"), tenants, 5)
    got = sorted((r.pick_rank, r.rank, r.search_id) for r in picked.collect())
    assert [g[0] for g in got] == [1, 2, 3] and [g[1] for g in got] == [1, 2, 3]
    assert all(g[2] % 2 == 1 for g in got)  # promotable texts win the tie
    upd = SH.history_update(h, picked, TODAY, F.lit("mail"), F.lit("team"))
    changed = upd.filter("emailed_now").select("search_id").collect()
    assert sorted(r.search_id for r in changed) == sorted(g[2] for g in got)
    assert upd.count() == h.count()
    assert upd.filter("NOT emailed_now AND email_content IS NOT NULL").count() == 0


def test_searches_since_last_email(spark):
    h = _h(spark, [("T", 1, "a", dt.datetime(2024, 1, 1), 1, 1, 1, dt.datetime(2024, 2, 1), ""),
                   ("T", 2, "a", dt.datetime(2024, 3, 1), 1, 1, 1, None, ""),
                   ("U", 3, "a", dt.datetime(2024, 3, 1), 1, 1, 1, None, "")])
    got = {r.client: r.searches_since_last_email for r in SH.searches_since_last_email(h).collect()}
    assert got == {"T": 1, "U": 1}


def test_ranking_requests_batches_of_six(spark):
    d = TODAY - dt.timedelta(days=1)
    h = _h(spark, [("T", i, f"p{i}", d, 9, 1, 3, None, None) for i in range(1, 15)])
    tenants = spark.createDataFrame([("T", 3)], "client string, max_emails bigint")
    req = SH.ranking_requests(SH.tie_flags(SH.candidates(h, TODAY), tenants), h.select("search_id", "search_results")).orderBy("batch_no").collect()
    assert [r.n_texts for r in req] == [6, 6, 2]
    assert req[2].request.endswith("There are 2 texts. You must return 2 rankings")
    assert req[0].request.startswith('<text first_name="p1", last_name="l", company="co">\nNone\n</text>\n')


def test_provider_ranks_order_the_tie(spark):
    import sys

    from pyspark import cloudpickle

    from leadspark.operators import provider as PV

    class Backwards(PV.Provider):
        """Ranks the texts of a request from last to first."""
        model = "backwards"

        def complete(self, function, prompt):
            import json
            import re
            names = re.findall(r'<text first_name="(.*?)", last_name="(.*?)", company="(.*?)">', prompt)
            rows = [{"first_name": a, "last_name": b, "company": c, "rank": len(names) - i} for i, (a, b, c) in enumerate(names)]
            return json.dumps({"rankings": rows}), 5, 7

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    import datetime as dt
    day = dt.datetime(2024, 1, 5)
    rows = [("T", i, f"p{i}", "x", "c", day, 9, 2, 3, 14, None) for i in range(5)] + [("T", 9, "low", "x", "c", day, 9, 1, 1, 11, None)]
    keys = spark.createDataFrame(rows, "client string, search_id long, first_name string, last_name string, company string, "
                                       "search_date timestamp_ntz, novelty_score long, activity_score long, "
                                       "services_need_score long, total_score long, email_date timestamp_ntz")
    cands = SH.candidates(keys, day)
    due = spark.createDataFrame([("T", 3)], "client string, max_emails long")
    texts = spark.createDataFrame([(i, f"text {i}") for i in range(5)], "search_id long, search_results string")
    requests = SH.ranking_requests(SH.tie_flags(cands, due), texts)
    ranks, answers = SH.provider_ranks(requests, Backwards, 1, calls_per_minute=0)
    got = SH.shortlist(cands, texts, due, 3, ranks=ranks).orderBy("pick_rank").collect()
    assert [r.search_id for r in got] == [4, 3, 2]
    native = SH.shortlist(cands, texts, due, 3).orderBy("pick_rank").collect()
    assert [r.search_id for r in native] == [0, 1, 2]
    assert [(r.function, r.model, r.output_tokens) for r in answers.collect()] == [("SearchResultsRankingAgent", "backwards", 7)]
