"""T6 with the rubric as data: every tenant has a rubric of its own.

A rubric is a table ``(client, metric, points, keyword, needs_person, needs_company)`` with one row
per keyword, a sequence of words; rows without a client are the default of tenants that have none. A line of
a text is a *fact* of a metric when one of its keywords' words stand in it one after the other (any
case, whatever separates them), and, where the row asks for it, the words of the subject's name or
company stand in that line too. A metric counts once, the total is capped.

All texts are scanned once for all tenants: the word sequences of each line, as long as
keywords are, meet the distinct keywords by hash (broadcast, as the table is proven small), so nothing but lines
with a keyword goes on. These meet the subjects of the text and the rows of their tenants; a text
that several subjects share is scanned once.

Null or empty text: no facts, score 0. Repeated keyword rows count once. Several subjects of one
id are one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .enrich import MAX_SCORE, tokens
from .sizing import broadcast_bounded, is_small, spread

# Rows of a rubric table that is broadcast.
MAX_BROADCAST_RUBRIC = 1_000_000


def _words(text) -> Column:
    """A text's words, each between two spaces."""
    return F.concat(F.lit(" "), F.array_join(tokens(text), " "), F.lit(" "))


def facts(texts: DataFrame, keywords: DataFrame, small: bool) -> DataFrame:
    """``(text_id, line_no, line, words, keyword)``: the lines of ``(text_id, text)`` that hold
    a keyword (``keyword``: its words, single spaces), one row per line and keyword."""
    longest = keywords.agg(F.max(F.size(F.split("keyword", " ")))).head()[0] or 0
    lines = spread(texts.select("text_id", "text")).select(
        "text_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("line_no", "line")).select(
        "text_id", "line_no", "line", tokens("line").alias("t"))

    def runs_of(n: int) -> Column:
        """The line's runs of n words."""
        starts = F.when(F.size("t") >= n, F.sequence(F.lit(1), F.size("t") - (n - 1)))
        return F.coalesce(F.transform(starts, lambda i: F.array_join(F.slice("t", i, n), " ")), F.array().cast("array<string>"))

    runs = [runs_of(n) for n in range(1, longest + 1)]
    if not runs:
        return lines.limit(0).select("text_id", "line_no", "line", F.lit("").alias("words"), F.lit("").alias("keyword"))
    found = lines.select("text_id", "line_no", "line", F.explode(F.array_distinct(F.concat(*runs))).alias("keyword"))
    found = found.join(F.broadcast(keywords) if small else keywords, "keyword")
    return found.select("text_id", "line_no", "line", _words("line").alias("words"), "keyword")


def scored(texts: DataFrame, subjects: DataFrame, rubric: DataFrame) -> DataFrame:
    """``(subject_id, services_need_score, metrics, summary)`` per subject ``(subject_id, text_id,
    client, person, company)``: its score, the metrics that count, and its fact lines in order."""
    small = is_small(rubric, MAX_BROADCAST_RUBRIC)
    rules = rubric.select("client", "metric", "points", _words("keyword").alias("keyword"), "needs_person", "needs_company")
    rules = rules.withColumn("keyword", F.trim("keyword")).filter("keyword <> ''")
    found = facts(texts, rules.select("keyword").distinct(), small)
    owners = rules.select(F.col("client").alias("owner")).filter("owner is not null").distinct()
    s = subjects.select("subject_id", "text_id", "client", _words("person").alias("person"), _words("company").alias("company"))
    s = s.join(broadcast_bounded(owners, small), F.col("client") == F.col("owner"), "left").drop("client")
    at = s.join(found, "text_id").alias("a")
    r = (F.broadcast(rules) if small else rules).alias("r")
    hit = at.join(r, (F.col("a.keyword") == F.col("r.keyword")) & F.col("a.owner").eqNullSafe(F.col("r.client")))
    stands = lambda who: F.contains("words", F.col(who)) & (F.length(who) > 2)
    hit = hit.filter((~F.col("needs_person") | stands("person")) & (~F.col("needs_company") | stands("company")))
    # a subject's facts are lines of one text: a bounded group
    per = hit.groupBy("subject_id").agg(
        F.array_sort(F.collect_set(F.struct("metric", "points"))).alias("m"),
        F.array_sort(F.collect_set(F.struct("line_no", "line"))).alias("f"))
    per = per.select("subject_id", F.aggregate("m", F.lit(0).cast("bigint"), lambda a, x: a + x["points"]).alias("total"),
                     F.array_join(F.col("m.metric"), ",").alias("metrics"), F.array_join(F.col("f.line"), "\n").alias("summary"))
    ids = subjects.select("subject_id").distinct()
    return ids.join(per, "subject_id", "left").select(
        "subject_id", F.least(F.coalesce("total", F.lit(0)), F.lit(MAX_SCORE)).cast("bigint").alias("services_need_score"),
        F.coalesce("metrics", F.lit("")).alias("metrics"), F.coalesce("summary", F.lit("")).alias("summary"))
