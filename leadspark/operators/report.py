"""Lead report and history views.

The report is a table of lines ``(client, section_no, line_no, kind, text,
url)`` per tenant instead of a document file: every tenant's report is
built in the same plan from its shortlisted leads (at most ``max_emails``
rows per tenant), so no step is per tenant or per row on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as TX
from . import enrich as EN
from . import provider as PV
from .grouping import row_number_per_group
from .sizing import maybe_broadcast

# Report wording.
TITLE = "Proposed Leads"
CONTENTS = "Contents"
RESULTS = "Results"
END = "End of Report"
EMAIL_HEADING = "Proposed Email"
RULE = "_" * 50
# Words a draft is asked to stay within (reported, never enforced).
EMAIL_WORDS = 200


def draft_email(template: Column, business: Column, results: Column,
                first: Column, last: Column, company: Column) -> Column:
    """T9 (native): the tenant's e-mail template rendered for the lead,
    followed by the paragraph of the business description that shares the
    most words with the lead's results (first on ties)."""
    body = TX.render_template(template, {
        "first_name": first, "last_name": last, "company": company,
        "search_name_first": first, "search_name_last": last, "search_company": company})
    paras = F.filter(F.split(F.coalesce(business, F.lit("")), r"\n\s*\n", -1), lambda p: F.length(p) > 0)
    rt = EN.token_set(results)
    scored = F.transform(paras, lambda p, i: F.struct(
        F.size(F.array_intersect(EN.token_set(p), rt)).alias("n"), (-i).alias("neg_pos"), p.alias("p")))
    best = F.array_max(scored)["p"]
    return F.when(best.isNotNull(), F.concat(body, F.lit("\n\n"), best)).otherwise(body)


def draft_size(content: Column) -> list[Column]:
    """Words of a draft, and whether it is longer than was asked for."""
    n = TX.token_count(content).cast("bigint")
    return [n.alias("n_words"), (n > EMAIL_WORDS).alias("over_limit")]


def sent_content(send: Column, content: Column, results: Column) -> Column:
    """The stored e-mail: where the tenant has its drafts sent one by one
    (SEND_PROPOSED_EMAILS), the evidence follows the draft (F33)."""
    return F.when(send, TX.with_evidence(content, results)).otherwise(content)


def reported(leads: DataFrame, tenants: DataFrame) -> DataFrame:
    """Leads that go into the report: those of tenants whose drafts were not
    sent one by one."""
    batch = tenants.filter(~F.col("send_proposed_emails")).select("client")
    return leads.join(maybe_broadcast(batch), "client", "left_semi")


def _line(section, line, kind: str, text: Column, url: Column | None = None) -> Column:
    return F.struct(F.lit(section).cast("bigint").alias("section_no") if isinstance(section, int)
                    else section.cast("bigint").alias("section_no"),
                    F.lit(line).cast("bigint").alias("line_no") if isinstance(line, int)
                    else line.cast("bigint").alias("line_no"),
                    F.lit(kind).alias("kind"), text.alias("text"),
                    (url if url is not None else F.lit(None).cast("string")).alias("url"))


def report_lines(leads: DataFrame, since: DataFrame, as_of) -> DataFrame:
    """K8: report lines of every tenant with leads.

    ``leads``: client, pick_rank, first_name, last_name, company,
    search_date, search_results, email_content (<= max_emails per tenant).
    ``since``: client, searches_since_last_email (A4).
    Section 0 is the head and contents, section ``pick_rank`` a lead,
    the last section the end line.
    """
    day = F.date_format(F.lit(as_of), TX.FMT_HEADING)
    cap = TX.lead_caption("first_name", "last_name", "company")
    # Lead sections: caption, date, result runs (F8-F11), e-mail.
    text = TX.tidy_url_parens(TX.unescape_newlines(F.coalesce("search_results", F.lit(""))))
    z = F.arrays_zip(TX.split_on_urls(text).alias("part"), TX.find_urls(text).alias("url"))
    runs = F.flatten(F.transform(z, lambda e, i: F.array(
        F.struct(F.lit("text").alias("kind"), TX.strip_ws(e["part"]).alias("text"),
                 F.lit(None).cast("string").alias("url")),
        F.struct(F.lit("link").alias("kind"), TX.strip_ws(e["url"]).alias("text"),
                 TX.strip_ws(e["url"]).alias("url")))))
    runs = F.filter(runs, lambda r: r["text"].isNotNull())
    sec = F.col("pick_rank")
    lead_lines = leads.select("client", F.inline(F.concat(
        F.array(_line(sec, 0, "h3", cap),
                _line(sec, 1, "p", F.concat(F.lit("Search Date: "),
                                            F.date_format("search_date", TX.FMT_HEADING)))),
        F.transform(runs, lambda r, i: _line(sec, i + 2, r["kind"], r["text"], r["url"])),
        F.array(_line(sec, F.size(runs) + 2, "bold", F.lit(EMAIL_HEADING)),
                _line(sec, F.size(runs) + 3, "p", F.coalesce("email_content", F.lit(""))),
                _line(sec, F.size(runs) + 4, "p", F.lit(RULE))))))
    # Contents entries (one per lead) go in section 0 after the intro.
    contents = leads.select("client", F.inline(F.array(
        _line(0, F.col("pick_rank") + 4, "li", cap))))
    per_tenant = leads.groupBy("client").agg(F.count(F.lit(1)).alias("n_leads")).join(
        since, "client", "left")
    n = F.col("n_leads")
    head = per_tenant.select("client", F.inline(F.array(
        _line(0, 1, "h1", F.lit(TITLE)),
        _line(0, 2, "p", F.concat(F.lit("As of "), day)),
        _line(0, 3, "p", F.format_string(
            "Since the last email, %d searches were completed. These are the most promising leads:",
            F.coalesce("searches_since_last_email", F.lit(0)))),
        _line(0, 4, "h2", F.lit(CONTENTS)),
        _line(0, n + 5, "h2", F.lit(RESULTS)),
        _line(n + 1, 0, "h2", F.lit(END)))))
    return head.unionByName(contents).unionByName(lead_lines)


def history_pages(history: DataFrame, rows_per_page: int, order: list) -> DataFrame:
    """O7 + W7: per tenant, rows in view order (newest first by default) with
    their row, page number and the tenant's page count."""
    n = row_number_per_group(history, ["client"], order, name="row_no")
    # One row per tenant: materialised once, then broadcast behind a count.
    counts = maybe_broadcast(
        history.groupBy("client").agg(F.count(F.lit(1)).alias("_n")).checkpoint(eager=True))
    return n.join(counts, "client").withColumn(
        "page_no", F.floor((F.col("row_no") - 1) / rows_per_page).cast("bigint") + 1).withColumn(
        "n_pages", F.ceil(F.col("_n") / F.lit(rows_per_page)).cast("bigint")).drop("_n")


def history_page(paged: DataFrame, page: int) -> DataFrame:
    """The requested page of every tenant, clamped to its last page."""
    want = F.least(F.greatest(F.lit(page), F.lit(1)), F.col("n_pages"))
    return paged.filter(F.col("page_no") == want)


FN_EMAIL = "email_proposal_agent"


def provider_drafts(leads: DataFrame, factory, partitions: int, calls_per_minute=PV.CALLS_PER_MINUTE, ledger: str | None = None,
                    day: str = "") -> tuple[DataFrame, DataFrame]:
    """T9 through a provider (T12): one request per lead (template, business description, results); the
    answer is the draft. A lead whose call failed keeps its native draft. Returns the leads and the answers."""
    req = leads.select(F.concat_ws("|", "client", F.col("search_id").cast("string"), F.lit(day)).alias("request_id"),
                       F.lit(FN_EMAIL).alias("function"),
                       F.concat_ws("\n", "email_template", "business_description", "search_results").alias("prompt"), "client")
    if ledger:
        answers = PV.call_with_ledger(req, factory, partitions, ledger, calls_per_minute)
    else:
        answers = PV.call_provider(req, factory, partitions, calls_per_minute)
    # try_cast: the projection may be planned before the ledger is cut to these requests
    given = answers.filter("error is null").select(
        F.split_part("request_id", F.lit("|"), F.lit(1)).alias("client"),
        F.split_part("request_id", F.lit("|"), F.lit(2)).try_cast("bigint").alias("search_id"), F.col("response").alias("_answer"))
    return leads.join(given, ["client", "search_id"], "left").withColumn(
        "draft", F.coalesce("_answer", "draft")).drop("_answer"), answers
