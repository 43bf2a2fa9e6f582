"""What each research step yields, and what it yields when it fails.

:data:`STEPS` is the step table: per function the parser of its answer and the keys that an
answer must have. :func:`outcomes` turns every answer row into the results of its step; an
errored call, an answer that is no JSON, or one without a key takes the failure values of
its parser (an answer of null), and ``error`` says why. A failure is data: it never ends a run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import payloads as PL

#: function -> (parser, keys of the answer, in the order in which they are read)
STEPS = {
    "target_score_agent": (PL.target_score, ("services_need_score", "reasoning", "summary_of_facts")),
    "results_comparison_agent": (PL.novelty, ("novelty_score", "reasoning")),
    "url_extraction_agent": (PL.urls, ("url_facebook", "url_linkedin", "url_company")),
    "search_proposal_agent": (lambda p: F.struct(PL.search_queries(p).alias("search_queries")), ("search_queries",)),
    "results_ranking_agent": (lambda p: F.struct(PL.rankings(p).alias("rankings")), ("rankings",)),
}


def problem(function: str, response: Column, error: Column) -> Column:
    """Why an answer of the step can't be used; null for a good one."""
    why = F.when(error.isNotNull(), error).when(PL.keys(response).isNull(), F.lit(PL.INVALID_JSON))
    for key in STEPS[function][1]:
        why = why.when(~PL.has(response, key), F.lit(PL.MISSING_KEY % key))
    return why


def outcomes(answers: DataFrame) -> DataFrame:
    """``answers`` (``function, response, error`` and any others) with one struct column per
    step (null for the rows of other steps) and ``problem``. Rows of an unknown function have a problem."""
    f, out = F.col("function"), answers
    why = F.lit(None).cast("string")
    unknown = ~F.coalesce(f.isin(list(STEPS)), F.lit(False))
    for name, (parser, _) in STEPS.items():
        # an errored call has no answer, whatever came with it
        used = F.when(F.col("error").isNull(), F.col("response"))
        out = out.withColumn(name, F.when(f == name, parser(used)))
        why = F.when(f == name, problem(name, used, F.col("error"))).otherwise(why)
    return out.withColumn("problem", F.when(unknown, F.concat(F.lit("Error: Unknown function "), F.coalesce(f, F.lit("None"))))
                          .otherwise(why))
