import datetime as dt

from pyspark.sql import functions as F

from leadspark.functions import text as TX
from leadspark.operators import checks as CK
from leadspark.operators import contacts as CT


def _one(spark, expr, data, schema):
    return [r[0] for r in spark.createDataFrame(data, schema).select(expr).collect()]


def test_search_period_golden(spark):
    today = dt.datetime(2024, 10, 15)
    got = _one(spark, TX.search_period("p", today),
               [(None,), (dt.datetime(2024, 10, 3),), (dt.datetime(2024, 9, 20),),
                (dt.datetime(2024, 3, 1),), (dt.datetime(2025, 1, 1),)], "p timestamp_ntz")
    assert got == ["August 2024, September 2024, and October 2024", "October 2024",
                   "September 2024 and October 2024", "March 2024 - October 2024",
                   "July 2024, August 2024, September 2024, and October 2024"]


def test_clean_url_golden(spark):
    got = _one(spark, TX.clean_url("u"), [("HTTPS://Www.A.com/P?q=1#x",), (None,), ("",),
                                          ("http://a.b/c;x=1",)], "u string")
    assert got == ["www.a.com/p", None, None, "a.b/c"]


def test_strip_and_drop_blank_names(spark):
    df = spark.createDataFrame([("T", 1, "\tAnn  ", "Lee", "Co", "FREELANCE writer", None),
                                ("T", 2, "Bob", None, "Co", None, None),
                                ("T", 3, "Cy", "   ", "Co", "Editor", None),
                                ("T", 4, "Di", "Ma", "Co", None, None),
                                ("T", 5, "Di", "Ma", "Co", None, None)],
                               "client string, src_row bigint, first_name string, last_name string, "
                               "company string, position string, url string")
    c = CT.clean(df)
    assert sorted((r.first_name, r.src_row) for r in c.collect()) == [("Ann", 1), ("Di", 4)]
    kept = c.filter(CT.not_freelancer()).select("first_name").collect()
    assert [r.first_name for r in kept] == ["Di"]


def test_hits_text_and_citations(spark):
    got = _one(spark, TX.hits_text("h"), [([],), ([("u", None)],), ([("u", "c")],)],
               "h array<struct<url:string,content:string>>")
    assert got[0] == got[1] == "No search results available."
    assert got[2] == "URL: u\nContent: c\n" + "-" * 50 + "\n"
    got = _one(spark, TX.with_citations("c", "l"), [("c", ["x", "y"]), ("c", [])],
               "c string, l array<string>")
    assert got == ["c\n\n1, x\n2, y", "c"]


def test_template_vars_render_and_check(spark):
    got = _one(spark, TX.template_vars("t"), [("Hi {a}, {b} {a}",)], "t string")
    assert got == [["a", "b"]]
    got = _one(spark, TX.render_template("t", {"a": F.lit("A"), "candidate.b": F.lit("B")}),
               [("{a}-{candidate.b} {{a}}",)], "t string")
    assert got == ["A-B {a}"]
    old = spark.createDataFrame([("T", "p", "x {a} {b}")], "client string, name string, body string")
    new = spark.createDataFrame([("T", "p", "x {a}")], "client string, name string, body string")
    v = CK.template_violations(old, new).collect()
    assert [(r.client, r.key) for r in v] == [("T", "p:b")]


def test_urls_find_split(spark):
    df = spark.createDataFrame([("see ( https://a.b/c ) ok, http://x.y/(z),w end",)], "t string")
    r = df.select(TX.tidy_url_parens("t").alias("a")).select(
        "a", TX.find_urls("a").alias("u"), TX.split_on_urls("a").alias("p")).first()
    assert r.a == "see (https://a.b/c) ok, http://x.y/(z),w end"
    assert r.u == ["https://a.b/c", "http://x.y/(z),w"]
    assert r.p == ["see (", ") ok, ", " end"]


def test_date_formats(spark):
    d = dt.datetime(2001, 8, 2, 13, 45)
    df = spark.createDataFrame([(d,)], "d timestamp_ntz")
    r = df.select(*[F.date_format("d", f) for f in (TX.FMT_DAY, TX.FMT_STAMP, TX.FMT_HEADING,
                                                    TX.FMT_SHORT, TX.FMT_WEEKDAY, TX.FMT_MONTH)]).first()
    assert list(r) == ["20010802", "20010802_1345", "Thu 02-Aug-2001", "02-Aug", "Thursday", "August 2001"]
