"""Fill-in-middle, conversation repair and sharding against plain versions."""

import hashlib
import random
import re
import zlib

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadspark.llm import common, fim, repair, sharding

TALK = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()),
                     T.StructField("role", T.StringType()), T.StructField("text", T.StringType()),
                     T.StructField("rid", T.StringType()), T.StructField("block", T.StringType())])


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---- fill in the middle

def _hard_texts():
    rng = random.Random(4)
    made = ["".join(rng.choice("ab .!?\n\té你\U0001f600<>") for _ in range(rng.randrange(200))) for _ in range(120)]
    return made + [None, "", "\n", "\n\n\n", "a", "a\n", "x<P>y\nz", "no<M>", "<S>", "é\n你", "one line " * 400_000,
                   "\n" * 300_000, " ."]


@pytest.mark.parametrize("unit", ["line", "word", "sentence"])
def test_cuts_equal_the_units_pattern(spark, make, unit):
    common.prepare(spark)
    rows = [(i, t, "en", None, None, "h", "s", -1) for i, t in enumerate(_hard_texts())] + [(None, "a\nb\nc", None, None, None, None, None, None)]
    got = {r.doc_id: tuple(r)[1:] for r in fim.transformed(make(rows), unit=unit, rate=90).collect()}
    for doc_id, text, *_ in rows:
        want = brute.fill_in_middle(doc_id, text, unit, 90)
        assert got[doc_id] == want, doc_id


def test_fill_in_middle_rows(spark, edge, repeated, empty, documents):
    for docs in (edge, repeated, documents):
        rows = docs.select("doc_id", "text").collect()
        want = sorted((str(r.doc_id), n, form, p, m, sha(out), sha(r.text or "")) for r in rows
                      for n, form, p, m, out in [brute.fill_in_middle(r.doc_id, r.text)])
        got = sorted((str(r[0]), *r[1:]) for r in map(tuple, fim.digests(docs).collect()))
        assert sorted(map(str, got)) == sorted(map(str, want))
    assert fim.digests(empty).count() == 0


def test_wavelet_matrix_ranks_and_selects():
    rng = np.random.default_rng(3)
    for n in (0, 1, 63, 64, 65, 700, 4096):
        symbols = rng.integers(0, 8, n).astype(np.uint8)
        matrix, places = fim.WaveletMatrix(symbols), np.arange(n + 1)
        for c in range(8):
            assert (matrix.rank(c, places) == np.concatenate([[0], np.cumsum(symbols == c)])).all()
            assert (matrix.select(c, np.arange((symbols == c).sum())) == np.flatnonzero(symbols == c)).all()


def test_restored_needs_only_output_and_form(spark, documents):
    made = fim.transformed(documents).select("doc_id", "output", "form")
    back = made.select("doc_id", fim.restored(F.col("output"), F.col("form")).alias("back"))
    assert back.join(documents, "doc_id").filter("not (back <=> text)").count() == 0
    with pytest.raises(ValueError):
        fim.cuts(F.col("text"), F.lit(1), F.lit(1), "page")


# ---- conversation repair

def _talks():
    rng = random.Random(9)
    rows = []
    for conv in range(150):
        for turn in range(rng.randrange(1, 12)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "", "umpire"])
            text = rng.choice(["Yes.", "No!", "cut off", "", " \n", None, f"All of {turn}.", f"half of {turn}", "ends. \n"])
            rows.append((conv if conv % 10 else conv - 1, turn if rng.random() > .1 else None, role, text, "r", "b"))
    rows += [(None, 1, "user", "Hm.", "r", "b"), (None, 2, "assistant", "Ja.", "r", "b"), (None, None, None, None, None, None)]
    # one whose only row is dropped, one far apart
    dropped = next(i for i in range(10_000, 20_000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    return rows + [(dropped, 0, "user", "Gone.", "r", "b"), (777, 5, "user", "A.", "r", "b"), (777, 5 << 30, "assistant", "B.", "r", "b")]


def _expected(rows):
    held = {r[0]: [] for r in rows}
    for conv, turn, role, text in brute.damage([r[:4] for r in rows]):
        held[conv].append((turn, role, text))
    out = {}
    for conv, x in held.items():
        *numbers, audit, lines = brute.repair(x)
        out[conv] = (*numbers, audit, sha("\n".join(lines)))
    return out


@pytest.mark.parametrize("block", [3, 512])
def test_repair_equals_all_paths(spark, block):
    rows = _talks()
    table = spark.createDataFrame(rows, TALK).repartition(3)
    got = {r[0]: tuple(r)[1:] for r in repair.digests(repair.damaged(table), table, block).collect()}
    assert got == _expected(rows)


def test_repair_given_repeated_empty(spark):
    given = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    rows = [tuple(r) for r in given.collect()]
    twice = given.unionByName(given)
    for table, held in ((given, rows), (twice, rows + rows)):
        got = {r[0]: tuple(r)[1:] for r in repair.digests(repair.damaged(table), table).collect()}
        assert got == _expected(held)
    none = spark.createDataFrame([], TALK)
    assert repair.digests(repair.damaged(none), none).count() == 0


def test_one_very_long_conversation(spark):
    rng = random.Random(2)
    rows = [(1, i, rng.choice(["user", "assistant", "assistant"]), f"Row {i // 2 if i % 50 else 0}" + rng.choice([".", ".", ""]), "", "")
            for i in range(4000)]
    table = spark.createDataFrame(rows, TALK)
    got = repair.digests(table, table, 64).collect()
    *numbers, audit, lines = brute.repair([r[1:4] for r in rows])
    assert [tuple(r)[1:] for r in got] == [(*numbers, audit, sha("\n".join(lines)))]
    out = repair.repaired(table, 64).orderBy("block", "pos", "place").collect()
    assert [f"{r.role}:{r.text}" for r in out] == lines
    assert re.fullmatch("s?(ua)+", "".join(r.role[0] for r in out))


def test_search_is_exact_between_states():
    """Costs and least audits of short blocks, by all paths."""
    rng = random.Random(5)
    for _ in range(300):
        codes = "".join(rng.choice(repair.CODES) for _ in range(rng.randrange(1, 5)))
        ends = tuple(rng.choice([0, 1, 2, 3, 5, repair.NO_PATH]) for _ in range(3)) + (4,)
        for entry in range(4):
            paths, best = [(0, "", 0, entry, 0)], []
            while paths:
                cost, audit, i, state, run = paths.pop()
                if i == len(codes):
                    best.append((cost + ends[state], audit, state))
                    continue
                if run < 4:
                    paths.append((cost + 2, audit + "I", i, repair.NEXT[state], run + 1))
                paths += [(cost + c, audit + e, i + 1, z, 0) for e, c, z in repair.EDITS[codes[i]][state]]
            assert repair.search(codes, entry, ends) == min(best)


# ---- sharding

def test_sharding_keeps_every_row(spark, edge, repeated, empty, documents):
    for docs in (edge, repeated, documents):
        n = docs.count()
        got = sharding.sharded(docs.withColumn("slot", F.lit("x")).withColumn("shard", F.lit("y"))).collect()
        assert sorted(map(str, ((r.doc_id, r.text) for r in got))) == sorted(map(str, map(tuple, docs.select("doc_id", "text").collect())))
        by = {}
        for r in got:
            by.setdefault(r.shard, []).append(r.slot)
        assert sorted(map(len, by.values())) == sorted(sharding.shard_sizes(n, 8))
        assert all(sorted(x) == list(range(len(x))) for x in by.values())
    assert sharding.digests(empty).count() == 0
    columns = {(r.doc_id, r.size, r.text_crc32, r.law, r.grown_shard) for r in sharding.digests(documents).collect()}
    assert columns == {(r.doc_id, len(r.text.encode()) + 1, zlib.crc32(r.text.encode()), "rows", None) for r in documents.collect()}


def test_matrix_margins_and_law(spark):
    parts = spark.range(21).select(F.col("id").alias("leaf"), (F.col("id") * 5 % 7).alias("n"))
    n = {r.leaf: r.n for r in parts.collect()}
    sizes = sharding.shard_sizes(sum(n.values()), 5)
    for seed in range(3):
        matrix = {r.leaf: r.counts for r in sharding.communication_matrix(parts, sizes, seed).collect()}
        assert {k: sum(v) for k, v in matrix.items()} == {k: v for k, v in n.items() if v}
        assert [sum(c) for c in zip(*matrix.values())] == sizes


@pytest.mark.parametrize("marked,drawn,total", [(3, 5, 10), (50, 40, 100), (1000, 5000, 20000), (1, 1, 2), (0, 4, 9), (9, 4, 9),
                                                (4, 0, 9), (4, 9, 9), (0, 0, 0)])
def test_draws_have_the_hypergeometric_law(spark, marked, drawn, total):
    draws = 20_000
    got = spark.range(draws).select(sharding.hypergeometric(
        sharding.uniform(F.lit(3), F.col("id")), *[F.lit(x).cast("long") for x in (marked, drawn, total)]).alias("x"))
    seen = np.array([r.x for r in got.collect()])
    from math import comb
    low, high = max(0, drawn + marked - total), min(drawn, marked)
    assert seen.min() >= low and seen.max() <= high
    law = np.array([comb(marked, k) * comb(total - marked, drawn - k) / comb(total, drawn) for k in range(low, high + 1)])
    apart = np.abs(np.cumsum(np.bincount(seen - low, minlength=len(law))) / draws - np.cumsum(law)).max()
    assert apart < 1.95 / draws ** .5  # Kolmogorov-Smirnov, 0.1 %


def test_shuffle_is_uniform_and_repeatable(spark):
    rows = spark.range(4000, numPartitions=5).withColumnRenamed("id", "doc_id").withColumn("text", F.lit("same text"))
    one, two = ({r.doc_id: (r.shard, r.slot) for r in sharding.sharded(rows, 4, seed=1).collect()} for _ in range(2))
    assert one == two
    other = {r.doc_id: (r.shard, r.slot) for r in sharding.sharded(rows, 4, seed=2).collect()}
    assert one != other
    # neighbours part: a quarter of adjacent ids share a shard, slots don't follow ids
    together = sum(one[i][0] == one[i + 1][0] for i in range(3999)) / 3999
    assert abs(together - .25) < .04
    assert abs(np.corrcoef([i for i in one], [one[i][1] for i in one])[0, 1]) < .06


def test_save_writes_shards(spark, documents, tmp_path):
    sharding.save(sharding.sharded(documents), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == documents.count() and back.select("shard").distinct().count() == 8
