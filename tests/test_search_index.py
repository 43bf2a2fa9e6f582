"""The stored index against a plain tf-idf search, and its segments."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from leadspark.operators import enrich as EN
from leadspark.operators import search_index as SI
from leadspark.sources.tables import path_exists

DOCS, QUERIES = "doc_id bigint, text string", "q_id bigint, query string"


def corpus(n=300, seed=1):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(.6)) % 400}" for _ in range(4000)]
    return [(i, " ".join(rng.choices(words, k=int(rng.paretovariate(.8) * 4) % 900))) for i in range(n)]


def plain(docs, queries, k):
    held = {i: Counter(re.findall(r"\w+", (t or "").lower())) for i, t in docs}
    df = Counter(t for c in held.values() for t in c)
    out = set()
    for q, text in queries:
        terms = set(re.findall(r"\w+", (text or "").lower()))
        score = {i: math.fsum(c[t] * math.log(1 + len(docs) / df[t]) for t in terms & c.keys()) for i, c in held.items() if terms & c.keys()}
        best = sorted(score, key=lambda i: (-round(score[i], 9), i))[:k]
        out |= {(q, rank, i, round(score[i], 6)) for rank, i in enumerate(best, 1)}
    return out


def queries(seed=2, n=25):
    rng = random.Random(seed)
    return [(i, " ".join(f"w{int(rng.paretovariate(.6)) % 420}" for _ in range(rng.randrange(0, 40)))) for i in range(n)] + [(99, None), (98, "zzz")]


def rows(df):
    return {(r.q_id, r["rank"], r.doc_id, r.score) for r in df.collect()}


@pytest.mark.parametrize("bound", [SI.MAX_BROADCAST_ROWS, 4])
def test_search_is_exact(spark, tmp_dir, monkeypatch, bound):
    """With broadcast and with the joins beyond its bound."""
    monkeypatch.setattr(SI, "MAX_BROADCAST_ROWS", bound)
    monkeypatch.setattr(SI, "BLOCK", 8)
    docs, asked = corpus() + [(1000, None), (1001, "")], queries()
    index = SI.extend(spark.createDataFrame(docs, DOCS), f"{tmp_dir}/ix")
    got = rows(SI.search(index, spark.createDataFrame(asked, QUERIES), 3))
    assert got == plain(docs, asked, 3)


def test_few_pairs_are_scored(spark, tmp_dir):
    docs, asked = corpus(3000, 5), queries(6)
    table = spark.createDataFrame(asked, QUERIES)
    index = SI.extend(spark.createDataFrame(docs, DOCS), f"{tmp_dir}/ix")
    qt = table.select("q_id", F.explode(EN.token_set("query")).alias("term")).checkpoint()
    pairs = SI.scored(index, qt, 3, "q_id").count()
    assert pairs < len(docs) * len(asked) / 10


def test_extended_by_new_documents_only(spark, tmp_dir):
    path, docs, asked = f"{tmp_dir}/ix", corpus(), queries()
    SI.extend(spark.createDataFrame(docs[:200], DOCS), path)
    first = SI.load(spark, path)
    assert (first.n_docs, first.segments) == (200, [0])
    again = SI.extend(spark.createDataFrame(docs[:200], DOCS), path)
    assert again.segments == [0]  # nothing new, nothing written
    whole = SI.extend(spark.createDataFrame(docs, DOCS), path)
    assert (whole.n_docs, whole.segments) == (300, [0, 1])
    added = spark.read.parquet(f"{path}/documents/segment=1")
    assert {r.doc_id for r in added.collect()} == {i for i, _ in docs[200:]}
    assert rows(SI.search(whole, spark.createDataFrame(asked, QUERIES), 3)) == plain(docs, asked, 3)


def test_unfinished_segment_is_not_seen(spark, tmp_dir):
    path, docs, asked = f"{tmp_dir}/ix", corpus(), queries()
    SI.extend(spark.createDataFrame(docs[:200], DOCS), path)
    # a run died before its manifest row: postings of segment 1 without it
    spark.read.parquet(f"{path}/postings/segment=0").write.parquet(f"{path}/postings/segment=1")
    spark.read.parquet(f"{path}/terms/segment=0").write.partitionBy("bucket").parquet(f"{path}/terms/segment=1")
    table = spark.createDataFrame(asked, QUERIES)
    assert rows(SI.search(SI.load(spark, path), table, 3)) == plain(docs[:200], asked, 3)
    # the repeated run writes that folder anew
    assert rows(SI.search(SI.extend(spark.createDataFrame(docs, DOCS), path), table, 3)) == plain(docs, asked, 3)


def test_no_index_no_hits(spark, tmp_dir):
    index = SI.extend(spark.createDataFrame([], DOCS), f"{tmp_dir}/ix")
    assert index.n_docs == 0 and path_exists(spark, f"{tmp_dir}/ix/manifest")
    assert SI.search(index, spark.createDataFrame([(1, "word")], QUERIES), 3).count() == 0


def test_plan_reads_no_lists_for_bounds(spark, tmp_dir):
    """The bounds come from the largest frequencies alone; no text is read for a search."""
    index = SI.extend(spark.createDataFrame(corpus(50), DOCS), f"{tmp_dir}/ix")
    plan = index.postings.select("segment", "block", "term", "max_tf")._jdf.queryExecution().executedPlan().toString()
    assert "docs" not in plan.split("ReadSchema")[1]


def test_blocks_that_go_on_in_the_next_batch(spark):
    """Postings gathered from batches of any size, with repeated ids, empty texts and characters of several bytes."""
    import pyarrow as pa
    rng = random.Random(9)
    texts = [(i // 7, 1000 - i, [rng.choice(["a", "b", "ü", "漢", "zz", "é1"]) for _ in range(rng.randrange(0, 9))]) for i in range(60)]
    texts += [(b, i, ["zz", "new"]) for b, i, _ in texts[::5]]  # further rows of the same documents
    texts.sort(key=lambda r: r[0])
    want = {}
    for b, i, terms in texts:
        for t in terms:
            want.setdefault((b, t), Counter())[i] += 1
    want = [(b, t, max(c.values()), len(c), sorted(((n, i) for i, n in c.items()), reverse=True))
            for (b, t), c in sorted(want.items(), key=lambda x: (x[0][0], x[0][1].encode()))]
    schema = pa.schema([("block", pa.int64()), ("doc_id", pa.int64()), ("terms", pa.list_(pa.string()))])
    table = pa.Table.from_pylist([dict(zip(schema.names, r)) for r in texts], schema)
    for size in (1, 5, 1000):
        got = [r for out in SI._gather()(iter(table.to_batches(max_chunksize=size))) for r in out.to_pylist()]
        assert [(r["block"], r["term"], r["max_tf"], r["n"], [(d["tf"], d["doc_id"]) for d in r["docs"]]) for r in got] == want


def test_postings_are_not_shuffled_for_many_wanted_terms(spark, tmp_dir, monkeypatch):
    """Few (query, block) pairs but more (query, block, term) than one broadcast takes: the postings stay in place."""
    monkeypatch.setattr(SI, "BLOCK", 4)
    docs = [(i, " ".join(f"w{(i * 7 + j) % 60}" for j in range(50))) for i in range(240)]
    asked = [(q, " ".join(f"w{(q + j) % 60}" for j in range(40))) for q in range(5)]
    index = SI.extend(spark.createDataFrame(docs, DOCS), f"{tmp_dir}/ix")
    monkeypatch.setattr(SI, "MAX_BROADCAST_ROWS", 500)
    qt = spark.createDataFrame(asked, QUERIES).select("q_id", F.explode(EN.token_set("query")).alias("term")).checkpoint()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = SI.scored(index, qt, 3, "q_id")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" not in plan
    assert rows(SI.search(index, spark.createDataFrame(asked, QUERIES), 3)) == plain(docs, asked, 3)
