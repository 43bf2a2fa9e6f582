r"""License scans by diagonal voting, in DataFrame functions only.

Words are ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of the text with A-Z lower-cased.
All rolling word k-grams of every document are joined to the positions of the
templates' k-grams (a fixed, small table, so a broadcast). A match votes for
the diagonal ``document position - template position``; votes are combined per
document, template and diagonal before the shuffle.

* Base phrases (2-grams): a diagonal with a vote from each of the phrase's
  2-grams is a place where its words stand consecutively.
* License texts (4-grams): neighbouring diagonals (at most SLACK apart: words
  put in or left out) are merged into a span. It is verified when the votes
  cover at least COVER of the template's words and of the span's.

Each vote compares its leading word as well as its 64-bit hash.

Null text: empty, no words. Rows with equal (doc_id, text) get equal results;
a null doc_id stays null. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SLACK = 8
COVER = 0.6
#: Words of a text k-gram.
K = 4

#: The base phrases and their labels.
PHRASES = [("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license")]
#: Notices of public licenses and their labels.
TEXTS = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files (the Software), to deal in the Software without restriction, including "
            "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
            "copies of the Software, and to permit persons to whom the Software is furnished to do so"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
               "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
               "software distributed under the License is distributed on an AS IS BASIS"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
            "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
            "option) any later version"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
            "that the following conditions are met: Redistributions of source code must retain the above copyright "
            "notice, this list of conditions and the following disclaimer"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
            "hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
            "was not distributed with this file, You can obtain one at"),
]


def words(text: Column) -> Column:
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(low, F.lit(WORD), F.lit(0))


def _pairs(hashes: Column, apart: int) -> Column:
    """Hash of each element with the one ``apart`` places on."""
    n = F.greatest(F.size(hashes) - apart, F.lit(0))
    return F.zip_with(F.slice(hashes, 1, n), F.slice(hashes, apart + 1, n), lambda a, b: F.xxhash64(a, b))


def grams(df: DataFrame, keys: list[str], text: Column) -> DataFrame:
    """One row per word: its position, the word, and the hashes of the 2-gram
    and the K-gram that start there (null at the end)."""
    return (df.select(*keys, words(text).alias("w"))
            .select(*keys, "w", F.transform("w", lambda x: F.xxhash64(x)).alias("one"))
            .select(*keys, "w", _pairs(F.col("one"), 1).alias("two"))
            .select(*keys, "w", "two", _pairs(F.col("two"), K - 2).alias("four"))
            .select(*keys, F.size("w").alias("n"), F.posexplode(F.arrays_zip("w", "two", "four")).alias("pos", "x"))
            .select(*keys, "n", "pos", "x.*"))


def templates(spark: SparkSession) -> DataFrame:
    """Template positions: a fixed table, made by the documents' own rule."""
    rows = [("p", label, text) for label, text in PHRASES] + [("t", label, text) for label, text in TEXTS]
    table = F.array(*[F.struct(F.lit(i).alias("tid"), F.lit(kind).alias("kind"), F.lit(label).alias("label"),
                               F.lit(text).alias("text")) for i, (kind, label, text) in enumerate(rows)])
    flat = spark.range(1).select(F.inline(table))
    return grams(flat, ["tid", "kind", "label"], F.col("text")).filter(
        F.when(F.col("kind") == "p", F.col("two").isNotNull()).otherwise(F.col("four").isNotNull()))


def spans(docs: DataFrame) -> DataFrame:
    """Verified and unverified spans: ``doc_id, h, kind, label, first_word,
    end_word, places, coverage, verified``; of a phrase one row per document
    with all its places."""
    spark = docs.sparkSession
    text = common.text_of()
    d = grams(docs.select("doc_id", F.xxhash64(text).alias("h"), text.alias("t")), ["doc_id", "h"], F.col("t"))
    t = templates(spark).select("tid", "kind", "label", F.col("n").alias("size"), F.col("pos").alias("tpos"),
                                F.col("w").alias("tw"), F.col("two").alias("ttwo"), F.col("four").alias("tfour"))
    votes = (d.filter("two is not null").join(F.broadcast(t), (F.col("two") == F.col("ttwo")) & (F.col("w") == F.col("tw")) & (
        (F.col("kind") == "p") | (F.col("four") == F.col("tfour"))))
        .select("doc_id", "h", "tid", "kind", "label", "size", "tpos", (F.col("pos") - F.col("tpos")).alias("diag")))
    # a diagonal's votes: at most one per template position, so a bounded set
    lines = votes.groupBy("doc_id", "h", "tid", "kind", "label", "size", "diag").agg(F.collect_set("tpos").alias("votes"))
    phrases = (lines.filter((F.col("kind") == "p") & (F.size("votes") == F.col("size") - 1))
               .groupBy("doc_id", "h", "kind", "label")
               .agg(F.min("diag").alias("first_word"), F.max("diag").alias("end_word"), F.count("*").alias("places"))
               .withColumns({"coverage": F.lit(1.0), "verified": F.lit(True)}))
    by = Window.partitionBy("doc_id", "h", "tid").orderBy("diag")
    merged = (lines.filter("kind = 't'")
              .withColumn("new", F.when(F.col("diag") - F.lag("diag").over(by) <= SLACK, 0).otherwise(1))
              .withColumn("span", F.sum("new").over(by))
              .groupBy("doc_id", "h", "tid", "kind", "label", "size", "span")
              .agg(F.min(F.col("diag") + F.array_min("votes")).alias("first_word"),
                   F.max(F.col("diag") + F.array_max("votes") + K).alias("end_word"),
                   F.array_distinct(F.flatten(F.collect_list(F.flatten(F.transform(
                       "votes", lambda v: F.sequence(v, v + K - 1)))))).alias("covered")))
    covered = F.size("covered")
    texts = merged.select(
        "doc_id", "h", "kind", "label", "first_word", "end_word", F.lit(1).cast("long").alias("places"),
        (covered / F.col("size")).alias("coverage"),
        ((covered >= COVER * F.col("size")) & (covered >= COVER * (F.col("end_word") - F.col("first_word")))).alias("verified"))
    return phrases.unionByName(texts)


def scanned(docs: DataFrame) -> DataFrame:
    """One row per document row, with the columns of the contract. ``score``:
    the best coverage of a template (1 for a base phrase)."""
    text = common.text_of()
    is_base, found = F.col("kind") == "p", F.col("verified")
    best = spans(docs).groupBy(F.col("doc_id").alias("__id"), F.col("h").alias("__h")).agg(
        F.sum(F.when(is_base, F.col("places"))).alias("n_base"), F.min(F.when(is_base, F.col("first_word"))).alias("first_word"),
        F.max(F.when(is_base, F.col("end_word"))).alias("last_word"),
        F.array_sort(F.collect_set(F.when(is_base, F.col("label")))).alias("base_labels"),
        F.array_sort(F.collect_set(F.when(found, F.col("label")))).alias("labels"), F.max("coverage").alias("score"))
    rows = docs.select("doc_id", F.xxhash64(text).alias("h"), F.size(words(text)).cast("long").alias("n_words"))
    joined = rows.join(best, rows["doc_id"].eqNullSafe(F.col("__id")) & (rows["h"] == F.col("__h")), "left")
    joined_text = lambda c: F.coalesce(F.array_join(c, ","), F.lit(""))
    return joined.select("doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
                         F.col("first_word").cast("long").alias("first_word"),
                         F.col("last_word").cast("long").alias("last_word"),
                         joined_text("base_labels").alias("base_labels"), joined_text("labels").alias("labels"),
                         F.coalesce("score", F.lit(0.0)).alias("score"))
