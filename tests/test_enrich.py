from pyspark.sql import functions as F

from leadspark.operators import enrich as EN


def test_rubric_points(spark):
    df = spark.createDataFrame([("A new case study.\nWe posted on the blog.",), ("",), (None,),
                                ("award record milestone launch case study blog",)], "t string")
    got = [r.s for r in df.select(EN.rubric_score("t").alias("s")).collect()]
    assert [g.services_need_score for g in got] == [4, 0, 0, 10]
    assert got[0].summary == "A new case study.\nWe posted on the blog."


def test_novelty_rules(spark):
    df = spark.createDataFrame([("a b c", ""), ("a b c", "c b a"), ("", ""), ("a b", "c d"),
                                ("a b c d", "a b")], "x string, y string")
    got = [r[0] for r in df.select(EN.novelty_score(EN.token_set("x"), EN.token_set("y"))).collect()]
    assert got == [10, 0, 0, 10, 5]


def test_corpus_search_small(spark):
    docs = spark.createDataFrame([(1, "red apple red"), (2, "green apple"), (3, "blue sky")],
                                 "doc_id bigint, text string")
    q = spark.createDataFrame([(10, "red apple"), (11, "sky"), (12, "nothing")], "q_id bigint, query string")
    got = [(r.q_id, r.rank, r.doc_id) for r in EN.corpus_search(q, docs, k=2).orderBy("q_id", "rank").collect()]
    assert got == [(10, 1, 1), (10, 2, 2), (11, 1, 3)]


def test_url_extraction(spark):
    t = ("see https://www.facebook.com/acme and https://facebook.com/ and https://linkedin.com/in/jo "
         "and https://acme.com/a https://www.acme.com/b https://other.org/x")
    r = spark.createDataFrame([(t,), ("",)], "t string").select(EN.extract_urls("t").alias("u")).collect()
    assert tuple(r[0].u) == ("https://www.facebook.com/acme", "https://linkedin.com/in/jo", "https://acme.com")
    assert tuple(r[1].u) == ("", "", "")


def test_stems_follow_the_rubric():
    assert EN.stems(EN.RUBRIC[0][2]) == ["case stud", "customer stor", "success stor"]
    assert EN.stems("colou?r|new") == ["colo", "new"]
    assert EN.stems("(a|b)c|new") == []


def test_other_rubric(spark):
    df = spark.createDataFrame([("A colour of merger talks",), ("nothing",)], "t string")
    got = df.select(EN.rubric_score("t", [("X", 5, "(a|b)cquir(es|ed)|merger"), ("Y", 3, "colou?r")]).alias("s")).collect()
    assert [r.s.services_need_score for r in got] == [8, 0]
    assert [r.s.summary for r in got] == ["A colour of merger talks", ""]


def test_long_event_type_keeps_the_period(spark):
    import datetime as dt

    from leadspark.operators import research as RS
    first = "Ann Lee Acme events " + "long " * 400
    docs = spark.createDataFrame([(1, first + "\nsecond line", "src0")], "doc_id long, text string, source string")
    batch = spark.createDataFrame([("T", "Ann", "Lee", "Acme", "CEO", None, None)],
                                  "client string, first_name string, last_name string, company string, position string, "
                                  "last_search_id long, last_search_date timestamp_ntz")
    tenants = spark.createDataFrame([("T", 1)], "client string, max_tavily_searches long")
    empty = spark.createDataFrame([], "client string, template string")
    prev = spark.createDataFrame([], "search_id long, search_results string")
    row = RS.enrich_batch(batch, tenants, empty, docs, prev, dt.datetime(2001, 8, 2)).first()
    period = row.search_query.split("\n===\n")[0]
    assert len(period) > 2000 and period.endswith("August 2001")


def test_usage_arrays_are_made_once(spark):
    """No filter for empty arrays that would make them a second time; empty and null ones give no row."""
    from leadspark.operators import research as PP
    call = "struct('f' AS function, 'm' AS model, 1L AS search_calls, id AS input_tokens, 2L AS output_tokens)"
    e = spark.range(6).selectExpr(
        "'T' AS client", "timestamp_ntz'2024-01-01' AS search_date",
        f"CASE WHEN id = 5 THEN NULL WHEN id = 4 THEN slice(array({call}), 1, 0) ELSE array_repeat({call}, int(id) + 1) END AS usage")
    t = PP.usage_table(e)
    assert "size(" not in t._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.input_tokens, r.call_no) for r in t.collect()) == [(i, n) for i in range(4) for n in range(i + 1)]
