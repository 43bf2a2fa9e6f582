r"""Quality rules: cross-document line frequency.

Lines are normalised (A-Z lower-cased, runs of white space made one space,
trimmed) and hashed. For each host (the ``source`` column) the operator counts
the distinct documents that hold a line; a line of any length is boilerplate when it stands
in more than ``limit`` of them. Documents of equal text count as one, and so do the near copies
of a text, so that copying does not condemn a clean document:

* a line is *frequent* when more than ``limit`` distinct texts hold it (nothing else can be boilerplate);
* a text made of frequent lines for the most part (``min_kept`` of its words) is either a page of boilerplate
  or one of many near copies. Such texts are grouped by their least frequent-line hash. A group's *core* are
  the lines that at least CORE of its texts hold. Copies share nearly all their lines, pages put
  together from boilerplate don't: a text is a copy when the core covers that same part of its words;
* all copies of a group count as one document. (A copy with its least line edited falls to the
  group of the next one, so copies make a handful of groups, however many there are.)

Boilerplate lines are removed; a document that keeps less than ``min_kept`` of
its words is depleted and rejected, as are those that fail the base rules
(fewer than 20 words; over 30 % of words in repeated 8-word windows).

Words are ``[^\x20\x09-\x0D]+``. Null text: no words, no lines; fails the base
rules. A null host is a host of its own. Repeated rows count once as a document
and each get their own result row. Texts of any length are measured whole, a text of one line is one line.
Further columns of any name are left alone. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW = 8
_SYMBOLS = b"#*$%&|<>"
#: Distinct documents of a host above which a line goes.
LIMIT = 20
MIN_KEPT = 0.5
#: Part of a group's texts that hold a core line.
CORE = 0.8

_MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def repeat_words(words: list[bytes]) -> int:
    """Words in 8-word windows that are found twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    windows = list(zip(*(words[k:] for k in range(WINDOW))))
    if len(set(windows)) == n:
        return 0
    seen: dict[tuple, int] = {}
    for w in windows:
        seen[w] = seen.get(w, 0) + 1
    total, end = 0, 0
    for at, w in enumerate(windows):
        if seen[w] > 1:
            total += at + WINDOW - max(at, end)
            end = at + WINDOW
    return total


def measure(text: bytes) -> tuple[int, int, int, int, int]:
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    return (len(words), len(b"".join(words).decode("utf-8", "replace")),
            len(text) - len(text.translate(None, _SYMBOLS)), len(lines) - len(set(lines)), repeat_words(words))


def _measures(text: Column) -> Column:
    @F.pandas_udf(_MEASURES)
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in _MEASURES.split(", ")]
        for t in texts:
            yield pd.DataFrame([measure(x) for x in t], columns=names, dtype="int64")

    return run(text.cast("binary"))


def _normal(line: Column) -> Column:
    low = F.translate(line, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.trim(F.regexp_replace(low, common.SPACE + "+", " "))


def _hash(norm: Column) -> Column:
    """60 bits of the MD5, which SQL engines have too; a blank line has none."""
    return F.when(norm == "", 0).otherwise(F.conv(F.substring(F.md5(norm.cast("binary")), 1, 15), 16, 10).cast("long"))


def _line_hash(line: Column) -> Column:
    return _hash(_normal(line))


def _line_hashes(text: Column) -> Column:
    """Per line: hash of the normalised line and its words (0 where blank)."""
    def one(line: Column) -> Column:
        norm = _normal(line)
        words = F.when(norm == "", 0).otherwise(F.length(norm) - F.length(F.translate(norm, " ", "")) + 1)
        return F.struct(_hash(norm).alias("h"), words.cast("int").alias("w"))
    return F.transform(F.split(text, "\n"), one)


def boilerplate(texts: DataFrame, limit: int = LIMIT, min_kept: float = MIN_KEPT) -> DataFrame:
    """Rows ``host, line``: the boilerplate of the distinct texts, which come as one row
    ``host, h, line, n_words, w`` per text and distinct line (w: words of all its places)."""
    flat = common.stored(texts, "lines-texts")
    frequent = common.stored(flat.groupBy("host", "line").agg(F.count("*").alias("n")).filter(F.col("n") > limit)
                             .select("host", "line"), "lines-frequent")
    # all that follows sees the frequent lines of a text only
    f = frequent.select(F.col("host").alias("o_host"), F.col("line").alias("o_line"))
    held = common.stored(flat.join(f, (F.col("line") == F.col("o_line")) & F.col("host").eqNullSafe(F.col("o_host")))
                         .select("host", "h", "n_words", "line", "w"), "lines-held")
    of_text = held.groupBy("host", "h", "n_words").agg(F.min("line").alias("least"), F.sum("w").alias("covered"))
    suspects = common.stored(of_text.filter(F.col("covered") >= min_kept * F.col("n_words")).select("host", "h", "least"),
                             "lines-suspects")
    sizes = suspects.groupBy("host", "least").agg(F.count("*").alias("size"))
    same = lambda a, b, *names: _all_equal(*[F.col(f"{a}.{n}").eqNullSafe(F.col(f"{b}.{n}")) for n in names])
    theirs = common.stored(held.alias("a").join(suspects.alias("b"), same("a", "b", "host", "h"))
                           .select("a.*", "b.least"), "lines-theirs")
    core = (theirs.groupBy("host", "least", "line").agg(F.count("*").alias("n")).alias("a")
            .join(sizes.alias("b"), same("a", "b", "host", "least")).filter(F.col("a.n") >= CORE * F.col("b.size"))
            .select("a.host", "a.least", "a.line"))
    copies = (theirs.alias("a").join(common.stored(core, "lines-core").alias("b"), same("a", "b", "host", "least", "line"))
              .groupBy("a.host", "a.h", "a.least", "a.n_words").agg(F.sum("a.w").alias("covered"))
              .filter(F.col("covered") >= min_kept * F.col("n_words")).select("host", "h", "least"))
    counted = held.alias("a").join(common.stored(copies, "lines-copies").alias("b"), same("a", "b", "host", "h"), "left").select(
        "a.host", "a.line", F.col("b.least").isNotNull().alias("copy"), F.coalesce("b.least", "a.h").alias("document"))
    return (counted.distinct().groupBy("host", "line").agg(F.count("*").alias("n"))
            .filter(F.col("n") > limit).select("host", "line"))


def _all_equal(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def decided(docs: DataFrame, limit: int = LIMIT, min_kept: float = MIN_KEPT) -> DataFrame:
    """One row per document row: ``doc_id, h`` (hash of the text), the base
    measures, ``base_failed``, ``n_removed_words``, ``removed`` (hashes of the
    boilerplate lines) and ``kept``."""
    common.prepare(docs.sparkSession)
    text = common.text_of()
    lines = F.filter(_line_hashes(text), lambda x: x["w"] > 0)
    rows = common.stored(docs.select(
        F.monotonically_increasing_id().alias("rid"), "doc_id", F.col("source").alias("host"),
        F.xxhash64(text).alias("h"), _measures(text).alias("m"), lines.alias("lines")), "lines")
    # a text's lines, each once with the words of all its places
    flat = rows.select("rid", "host", "h", F.col("m.n_words").alias("n_words"), F.explode("lines").alias("x")).groupBy(
        "rid", "host", "h", "n_words", F.col("x.h").alias("line")).agg(F.sum("x.w").alias("w"))
    flat = common.stored(flat, "lines-flat")
    texts = flat.groupBy("host", "h", "line").agg(F.first("n_words").alias("n_words"), F.first("w").alias("w"))
    often = common.stored(boilerplate(texts, limit, min_kept), "lines-often")
    hit = flat.alias("f").join(often.alias("o"), (F.col("f.line") == F.col("o.line"))
                               & F.col("f.host").eqNullSafe(F.col("o.host")))
    lost = hit.groupBy("rid").agg(F.sum("f.w").alias("n_removed_words"), F.collect_list("f.line").alias("removed"))
    n = F.col("m.n_words")
    failed = (n < 20) | (100 * F.col("m.n_repeat_words") > 30 * n)
    gone = F.coalesce("n_removed_words", F.lit(0))
    return (rows.select("rid", "doc_id", "h", "m").join(lost, "rid", "left")
            .select("doc_id", "h", "m.*", failed.alias("base_failed"), gone.cast("long").alias("n_removed_words"),
                    F.coalesce("removed", F.array().cast("array<bigint>")).alias("removed"),
                    (~failed & ((n - gone) >= min_kept * n)).alias("kept")))


def applied(docs: DataFrame, **limits) -> DataFrame:
    """The kept documents with their boilerplate lines taken out (``n_chars``,
    where there is one, follows the text); other columns unchanged."""
    marks = decided(docs, **limits).filter(~F.col("kept") | (F.size("removed") > 0)).dropDuplicates(["doc_id", "h"]).select(
        F.struct("doc_id", "h", "kept", "removed").alias("mark"))
    # the rows as one struct: no column of theirs can clash with the marks
    text = common.text_of(F.col("row.text"))
    joined = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row")).join(
        marks, F.col("row.doc_id").eqNullSafe(F.col("mark.doc_id")) & (F.xxhash64(text) == F.col("mark.h")), "left")
    marked = F.size("mark.removed") > 0
    left = F.array_join(F.filter(F.split(text, "\n"), lambda x: ~F.array_contains(
        F.col("mark.removed"), _line_hash(x))), "\n")
    out = joined.filter(F.coalesce("mark.kept", F.lit(True)))
    columns = [F.when(marked, left).otherwise(F.col("row.text")).alias("text") if c == "text"
               else F.when(marked, F.length(left).cast("long")).otherwise(F.col("row.n_chars")).alias(c) if c == "n_chars"
               else F.col(f"row.`{c}`") for c in docs.columns]
    return out.select(*columns)
