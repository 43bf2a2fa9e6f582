"""Scalar text functions as native Spark expressions (no Python UDFs).

Each function maps Column(s) to a Column, so it runs inside whole-stage
code generation (or as a JVM higher-order function) on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and literals the results depend on.
WS_TRIM = r"(?U)^\s+|\s+$"              # strip all whitespace at both ends
NON_ASCII = r"[^\x00-\x7F]+"             # runs of non-ASCII characters
URL_HOST = r"^([^/?#]*)"                 # host part of a scheme-less URL
URL_PATH = r"^[^/?#]*([^?#]*)"           # path part (query, fragment dropped)
URL_LAST_PARAMS = r";[^/]*$"             # ';params' on the last path segment
TEMPLATE_VAR = r"\{([^}]+)\}"            # a {variable} in a template
WORD = r"\S+"                            # a whitespace-delimited token
HIT_RULE = "-" * 50                      # separator after each search hit
NO_RESULTS = "No search results available."
QUERY_JOIN = "\n===\n"                   # between queries
RESULT_JOIN = "/n===/n"                  # between results (literal, as written)


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ws(c) -> Column:
    """Remove all leading/trailing whitespace (not just spaces)."""
    return F.regexp_replace(col(c), WS_TRIM, "")


def strip_non_ascii(c) -> Column:
    """drop runs of non-ASCII characters; null stays null."""
    return F.regexp_replace(col(c), NON_ASCII, "")


def blank_to_null(c) -> Column:
    return F.when(F.length(col(c)) > 0, col(c))


def clean_url(c) -> Column:
    """lower; drop every ``http://`` then every ``https://`` (anywhere);
    keep host + path; host empty -> null; null -> null."""
    u = F.replace(F.replace(F.lower(col(c)), F.lit("http://"), F.lit("")),
                  F.lit("https://"), F.lit(""))
    host = F.regexp_extract(u, URL_HOST, 1)
    path = F.regexp_replace(F.regexp_extract(u, URL_PATH, 1), URL_LAST_PARAMS, "")
    return F.when(F.length(host) > 0, F.concat(host, path))


def token_count(c) -> Column:
    """F29 (default): number of whitespace-delimited tokens (counted without
    building the token list)."""
    return F.regexp_count(col(c), F.lit(WORD))


def template_vars(c) -> Column:
    """distinct ``{name}`` variables of a template, in first-seen order."""
    return F.array_distinct(F.regexp_extract_all(col(c), F.lit(TEMPLATE_VAR), 1))

# URL patterns of the report text (Java regex; the find
# pattern uses a look-ahead, so it has no RE2 twin).
URL_IN_PARENS = r"\(\s*(\bhttps?://[^\s\)]+)\s*\)"
URL_FIND = (r"https?://[^\s()\[\]{},]+(?:\([^\s()\[\]{},]*\))?[^\s()\[\]{},]*"
            r"(?:,(?=[^\s,]))?[^\s()\[\]{},]*")
# Date formats (Spark pattern letters) used in file names,
# report headings and prompts.
FMT_DAY = "yyyyMMdd"
FMT_STAMP = "yyyyMMdd_HHmm"
FMT_HEADING = "EEE dd-MMM-yyyy"
FMT_SHORT = "dd-MMM"
FMT_WEEKDAY = "EEEE"
FMT_MONTH = "MMMM yyyy"
NO_MONTHS = "Error: No valid months in range"
EVENT_QUESTION = ("What kind of events, blogs and updates are typically published by %s %s, "
                  "who works as %s at this company: %s. Ignore similar named companies and "
                  "people. Focus on this one only.")
SUBJECT = "Proposed email for %s %s of %s"
EVIDENCE = "\n=======================\nThis proposed email follows from the below search results:\n"


def search_period(prev, today) -> Column:
    """the months from the first of ``prev``'s month to ``today`` in
    words. ``prev`` null -> today - 2 months; ``prev`` after today ->
    today - 3 months. 1 month ``April 2024``; 2 ``A and B``; 3-6
    ``A, B, and C``; more ``A - Z``."""
    t = F.lit(today) if not isinstance(today, Column) else today
    p = F.coalesce(col(prev).cast("date"), F.add_months(t.cast("date"), -2))
    p = F.when(col(prev).cast("timestamp_ntz") > t.cast("timestamp_ntz"),
               F.add_months(t.cast("date"), -3)).otherwise(p)
    months = F.sequence(F.trunc(p, "MM"), t.cast("date"), F.expr("INTERVAL 1 MONTH"))
    names = F.transform(months, lambda m: F.date_format(m, FMT_MONTH))
    n = F.size(names)
    return (F.when(n < 1, F.lit(NO_MONTHS))
            .when(n == 1, F.element_at(names, 1))
            .when(n == 2, F.concat(F.element_at(names, 1), F.lit(" and "), F.element_at(names, 2)))
            .when(n <= 6, F.concat(F.array_join(F.slice(names, F.lit(1), n - 1), ", "),
                                   F.lit(", and "), F.element_at(names, -1)))
            .otherwise(F.concat(F.element_at(names, 1), F.lit(" - "), F.element_at(names, -1))))


def hits_text(hits) -> Column:
    """``URL: ..\\nContent: ..\\n`` + 50 dashes per hit having both
    fields; no such hit -> ``No search results available.``"""
    ok = F.filter(col(hits), lambda h: h["url"].isNotNull() & h["content"].isNotNull())
    body = F.array_join(F.transform(ok, lambda h: F.concat(
        F.lit("URL: "), h["url"], F.lit("\nContent: "), h["content"], F.lit("\n" + HIT_RULE + "\n"))), "")
    return F.when(F.coalesce(F.size(ok), F.lit(0)) > 0, body).otherwise(F.lit(NO_RESULTS))


def with_citations(content, citations) -> Column:
    """append ``1, url`` lines after a blank line when there are any."""
    cites = F.coalesce(col(citations), F.array().cast("array<string>"))
    lines = F.array_join(F.transform(cites, lambda u, i: F.concat((i + 1).cast("string"), F.lit(", "), u)),
                         "\n")
    return F.when(F.size(cites) > 0, F.concat(col(content), F.lit("\n\n"), lines)).otherwise(col(content))


def join_queries(queries) -> Column:
    """the queries of a search joined with ``\\n===\\n``."""
    return F.array_join(col(queries), QUERY_JOIN)


def join_results(results) -> Column:
    """the result texts joined with the literal ``/n===/n``."""
    return F.array_join(col(results), RESULT_JOIN)


def tidy_url_parens(c) -> Column:
    """F8: ``( url )`` -> ``(url)``."""
    return F.regexp_replace(col(c), URL_IN_PARENS, "($1)")


def find_urls(c) -> Column:
    """all URLs in order (balanced bracket and inner commas allowed)."""
    return F.regexp_extract_all(col(c), F.lit(URL_FIND), 0)


def split_on_urls(c) -> Column:
    """the text pieces around the URLs (``len(urls) + 1`` pieces)."""
    return F.split(col(c), URL_FIND, -1)


def unescape_newlines(c) -> Column:
    """a literal backslash-n becomes a line break."""
    return F.replace(col(c), F.lit("\\n"), F.lit("\n"))


# Sentinels for escaped braces while a template is rendered.
_OPEN, _CLOSE = "\u0001", "\u0002"


def render_template(template, values: dict[str, Column]) -> Column:
    """replace ``{name}`` by ``values[name]`` (``{{``/``}}`` are literal
    braces). Names may carry an object prefix, e.g. ``candidate.first_name``."""
    t = F.replace(F.replace(col(template), F.lit("{{"), F.lit(_OPEN)), F.lit("}}"), F.lit(_CLOSE))
    for name, v in values.items():
        t = F.replace(t, F.lit("{" + name + "}"), F.coalesce(v.cast("string"), F.lit("None")))
    return F.replace(F.replace(t, F.lit(_OPEN), F.lit("{")), F.lit(_CLOSE), F.lit("}"))


def event_question(first, last, position, company) -> Column:
    """the question asked for the contact's typical events."""
    return F.format_string(EVENT_QUESTION, *[F.coalesce(col(x), F.lit("None"))
                                             for x in (first, last, position, company)])


def lead_caption(first, last, company) -> Column:
    """F32: ``company, first last``."""
    return F.format_string("%s, %s %s", col(company), col(first), col(last))


def email_subject(first, last, company) -> Column:
    """subject line of a proposed e-mail."""
    return F.format_string(SUBJECT, col(first), col(last), col(company))


def with_evidence(content, results) -> Column:
    """the proposed e-mail followed by the search results it is from."""
    return F.concat(col(content), F.lit(EVIDENCE), F.coalesce(col(results), F.lit("None")))


def rank_block(first, last, company, text) -> Column:
    """one ``<text ...>`` block of a ranking request."""
    return F.format_string('<text first_name="%s", last_name="%s", company="%s">\n%s\n</text>\n',
                           col(first), col(last), col(company), F.coalesce(col(text), F.lit("None")))


def missing_vars(old, new) -> Column:
    """Variables of ``old`` that ``new`` no longer has."""
    return F.array_except(template_vars(old), template_vars(new))
