from leadspark.functions import payloads as PL


def _rows(spark, fn, payloads):
    df = spark.createDataFrame([(p,) for p in payloads], "j string")
    return [r[0] for r in df.select(fn("j")).collect()]


def test_target_score(spark):
    got = _rows(spark, PL.target_score, [
        '{"services_need_score":"7","reasoning":"r","summary_of_facts":"s"}',
        '{"services_need_score":7.9,"reasoning":"r","summary_of_facts":"s"}',
        '{bad', '{"services_need_score":3}'])
    assert [(g.activity_score, g.services_need_score, g.summary) for g in got] == [
        (0, 7, "s"), (0, 7, "s"), (0, 0, ""), (0, 0, "")]


def test_novelty(spark):
    got = _rows(spark, PL.novelty, ['{bad', '{"reasoning":"r"}', '{"novelty_score": 4}',
                                    '{"novelty_score": 8, "reasoning": "x"}'])
    assert [(g.novelty_score, g.reasoning) for g in got] == [
        (-1, "Error: Invalid JSON"), (-1, "Error: Missing key in JSON: 'novelty_score'"),
        (-1, "Error: Missing key in JSON: 'reasoning'"), (8, "x")]


def test_rankings_and_urls(spark):
    got = _rows(spark, PL.rankings, ['{}', '{bad',
                                     '{"rankings":[{"first_name":"a","last_name":"b","company":"c","rank":2}]}'])
    assert got[0] == []
    assert [(x.first_name, x.rank) for x in got[1]] == [("Unknown", -1)]
    assert [(x.company, x.rank) for x in got[2]] == [("c", 2)]
    got = _rows(spark, PL.urls, ['{"url_facebook":"f","url_company":"c"}', '{bad',
                                 '{"url_facebook":"f","url_linkedin":"l","url_company":"c"}'])
    assert [tuple(g) for g in got] == [("f", "", ""), ("", "", ""), ("f", "l", "c")]


def test_queries_and_search_reply(spark):
    got = _rows(spark, PL.search_queries, ['{"search_queries":["a","b"]}', "{bad", "{}"])
    assert got == [["a", "b"], [], []]
    got = _rows(spark, PL.search_hits, ["[{'title': 't', 'link': 'l'}]", "nope"])
    assert [[(h.title, h.link) for h in g] for g in got] == [[("t", "l")], []]
