"""Native enrichment operators: the web-search and LLM steps of the
per-contact pipeline re-expressed as deterministic Spark jobs.

* T4 corpus search: top-k documents per query by tf-idf, from a stored
  inverted index (:mod:`.search_index`).
* T5 URL extraction from the raw result text.
* T6 additive rubric score on the result text.
* T7 novelty of a result against the person's previous one (token-set
  Jaccard distance on a 0-10 scale).

All of them are column expressions, joins and aggregates; the only
per-group ordering uses the skew-safe helpers of :mod:`.grouping`.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as TX
from . import search_index as SI
from .grouping import previous_in_group
from .sizing import is_small, spread

# Tokenisation (letters and digits of any script, lower-cased;
# the same class is valid in Java regex and RE2).
TOKEN = r"[\p{L}\p{N}]+"
# Hit document ids (at most k per query).
MAX_BROADCAST_IDS = 2_000_000
DEFAULT_TOP_K = 3

# The business-need rubric (metric, points, keywords). Points
# follow the scoring guide: A +3 case study, B +2 news/launch, C +1 recent
# activity, D +4 promotable fact; the total is capped at 10. Keywords match
# whole words of the lower-cased text.
RUBRIC = [
    ("A", 3, r"case stud(y|ies)|customer stor(y|ies)|success stor(y|ies)"),
    ("B", 2, r"launch(ed|es)?|releas(e|ed|es)|announc(e|ed|es|ement)|news"),
    ("C", 1, r"blog|post(ed|s)?|events?|webinars?|conferences?|updates?"),
    ("D", 4, r"awards?|records?|milestones?|partnerships?|expansion|funding"),
]
_WORD_CHAR = r"[\p{L}\p{N}_]"


def stems(keywords: str) -> list[str]:
    """Literal text that each top-level alternative of a keyword pattern starts
    with (a cheap substring test before the regex runs); empty when one of
    them starts with no literal, so that the test can't be used."""
    parts, depth = [""], 0
    for c in keywords:
        depth += (c == "(") - (c == ")")
        if c == "|" and depth == 0:
            parts.append("")
        else:
            parts[-1] += c
    found = [re.match(r"(?:[^\\^$.|?*+()\[\]{}](?![?*{]))*", p)[0] for p in parts]
    return found if all(found) else []


def word_pattern(keywords: str) -> str:
    """Whole-word match (Java regex): look-arounds test the neighbours
    without consuming them, so each position is tried once."""
    return rf"(?<!{_WORD_CHAR})(?:{keywords})(?!{_WORD_CHAR})"


def word_pattern_re2(keywords: str) -> str:
    """The same matches for an engine without look-arounds (RE2)."""
    return rf"(^|[^\p{{L}}\p{{N}}_])({keywords})([^\p{{L}}\p{{N}}_]|$)"


def any_keyword(rubric=None) -> str:
    return "|".join(f"(?:{kw})" for _, _, kw in (rubric or RUBRIC))


MAX_SCORE = 10


def tokens(text) -> Column:
    """Lower-cased word tokens of a text (null text -> empty)."""
    return F.coalesce(F.regexp_extract_all(F.lower(TX.col(text)), F.lit(TOKEN), 0),
                      F.array().cast("array<string>"))


def token_set(text) -> Column:
    return F.array_distinct(tokens(text))


# --- T4 -------------------------------------------------------------------

def corpus_search(queries: DataFrame, docs: DataFrame, k: int = DEFAULT_TOP_K,
                  id_col: str = "q_id", text_col: str = "query", index: SI.Index | None = None) -> DataFrame:
    """T4: top-``k`` documents per query by tf-idf, exact, from a stored index
    (:mod:`.search_index`); without one, an index of ``docs`` is made for this
    search. Ties: lower doc_id."""
    index = index or SI.extend(docs, SI.scratch_path(docs.sparkSession))
    return SI.search(index, queries, k, id_col, text_col)


def doc_url(source: Column, doc_id: Column) -> Column:
    """A stable address for a corpus document (the corpus has no URLs)."""
    return F.concat(F.lit("https://"), source, F.lit(".example.org/doc/"), doc_id.cast("string"))


def hits(top: DataFrame, docs: DataFrame, id_col: str = "q_id") -> DataFrame:
    """(q_id, hits array<struct<url, content>>) in rank order; the content
    is the whole document. A query has at most ``k`` hits, so the per-query
    list is bounded."""
    top = top.checkpoint(eager=True)
    ids = top.select("doc_id").distinct()
    d = docs.select("doc_id", doc_url(F.col("source"), F.col("doc_id")).alias("url"),
                    F.col("text").alias("content"))  # the whole document
    if is_small(ids, MAX_BROADCAST_IDS):  # only the hits' texts leave the scan
        d = d.join(F.broadcast(ids), "doc_id", "left_semi")
    j = top.join(d, "doc_id")
    h = j.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("rank", "url", "content"))).alias("h"))
    return h.select(id_col, F.transform("h", lambda x: F.struct(x["url"].alias("url"),
                                                                  x["content"].alias("content")))
                    .alias("hits"))


# --- T5 -------------------------------------------------------------------

HOST = r"^[a-z]+://([^/?#:]+)"


def _host(u: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(F.lower(u), HOST, 1), r"^www\.", "")


def extract_urls(text) -> Column:
    """T5: struct(url_facebook, url_linkedin, url_company) from raw text:
    the first facebook.com URL with a path, the first linkedin.com/in/ URL,
    and ``https://host`` of the most frequent other host (first seen wins a
    tie); ``''`` when absent."""
    urls = TX.find_urls(text)
    fb = F.filter(urls, lambda u: F.lower(u).rlike(r"^https?://([a-z0-9-]+\.)*facebook\.com/[^/?#]"))
    li = F.filter(urls, lambda u: F.lower(u).rlike(r"^https?://([a-z0-9-]+\.)*linkedin\.com/in/"))
    others = F.filter(F.transform(urls, _host), lambda h: (F.length(h) > 0)
                      & ~h.rlike(r"(^|\.)(facebook|linkedin)\.com$"))
    distinct = F.array_distinct(others)  # first-seen order
    counted = F.transform(distinct, lambda h, i: F.struct(
        F.size(F.filter(others, lambda x: x == h)).alias("n"), (-i).alias("neg_pos"), h.alias("host")))
    best = F.array_max(counted)["host"]
    blank = F.lit("")
    return F.struct(
        F.coalesce(F.try_element_at(fb, F.lit(1)), blank).alias("url_facebook"),
        F.coalesce(F.try_element_at(li, F.lit(1)), blank).alias("url_linkedin"),
        F.coalesce(F.concat(F.lit("https://"), best), blank).alias("url_company"))


# --- T6 -------------------------------------------------------------------

def rubric_score(text, rubric=RUBRIC) -> Column:
    """struct(activity_score 0, services_need_score, summary). Points of
    every rubric line whose keywords occur (whole words, any case), capped
    at 10; the summary is the text lines that carry a fact.

    Long texts are tested with plain substring searches for the keyword
    stems first; the word-boundary regex only runs where a stem occurs, and
    lines are only searched when the text has a fact at all."""
    raw = F.coalesce(TX.col(text), F.lit(""))
    t = F.lower(raw)
    flags = []
    for _, pts, kw in rubric:
        starts = stems(kw)
        stem = F.lit(not starts)
        for st in starts:
            stem = stem | (F.instr(t, st) > 0)
        flags.append((pts, stem & t.rlike(word_pattern(kw))))
    total = sum((F.when(f, F.lit(pts)).otherwise(F.lit(0)) for pts, f in flags), F.lit(0))
    any_fact = F.lit(False)
    for _, f in flags:
        any_fact = any_fact | f
    fact = word_pattern(any_keyword(rubric))
    lines = F.filter(F.split(raw, "\n", -1), lambda s: F.lower(s).rlike(fact))
    summary = F.when(any_fact, F.array_join(lines, "\n")).otherwise(F.lit(""))
    return F.struct(F.lit(0).cast("bigint").alias("activity_score"),
                    F.least(total, F.lit(MAX_SCORE)).cast("bigint").alias("services_need_score"),
                    summary.alias("summary"))


# --- T7 -------------------------------------------------------------------

def novelty_score(cur_tokens: Column, prev_tokens: Column) -> Column:
    """``round(10 * (1 - |A n B| / |A u B|))`` on token sets; previous
    empty -> 10; both empty -> 0 (half rounds up)."""
    a = F.coalesce(cur_tokens, F.array().cast("array<string>"))
    b = F.coalesce(prev_tokens, F.array().cast("array<string>"))
    inter = F.size(F.array_intersect(a, b))
    union = F.size(F.array_union(a, b))
    j = F.floor(F.lit(10.0) * (F.lit(1.0) - inter / union) + F.lit(0.5)).cast("bigint")
    return (F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(0).cast("bigint"))
            .when(F.size(b) == 0, F.lit(10).cast("bigint"))
            .otherwise(j))


def previous_search(history_keys: DataFrame, group: list[str]) -> DataFrame:
    """W2 (D2): (search_id, prev_search_id) per person in (date, id) order,
    numbered without sorting a whole person in one task."""
    return previous_in_group(history_keys, group, ["search_date", "search_id"], "search_id",
                             "prev_search_id")


def novelty(history_keys: DataFrame, texts: DataFrame, group: list[str]) -> DataFrame:
    """T7 over stored searches: each search against the person's previous
    one. ``texts`` is (search_id, search_results); token sets are built once
    per text, materialised, and joined by id (long texts never enter the
    ordering)."""
    prev = previous_search(history_keys, group)
    ts = spread(texts.select("search_id", "search_results")).select(
        "search_id", token_set("search_results").alias("toks")).checkpoint(eager=True)
    cur = prev.join(ts, "search_id", "left")
    prv = ts.select(F.col("search_id").alias("prev_search_id"), F.col("toks").alias("prev_toks"))
    both = cur.join(prv, "prev_search_id", "left")
    return both.select(*[c for c in prev.columns], novelty_score(F.col("toks"), F.col("prev_toks"))
                       .alias("novelty_score"))
