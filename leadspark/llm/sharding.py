r"""Sharding by a hypergeometric communication matrix, in DataFrame functions only.

A uniform shuffle of all rows into shards whose sizes are fixed beforehand
(row counts at most one apart: the law ``rows``), without a global sort:

1. Rows are stored once with a number; a *part* is a run of at most
   ``PART_ROWS`` rows of one input partition.
2. The matrix ``part x shard`` of row counts is drawn exactly as a uniform
   shuffle would produce it: given the parts' sizes and the shards' sizes it has
   the multivariate hypergeometric law. Parts are the leaves of a binary tree;
   each node splits its shard counts between its two children by univariate draws,
   one shard after the other, so a level is one projection over its nodes and
   no task sees the whole matrix.
3. Each part is permuted locally by a hash of the row number; its first rows go to
   the first shard, and so on, as the matrix says.
4. Rows are exchanged, and each shard is permuted again: its rows are numbered in
   the order of a second hash, by a range exchange, so no shard is sorted in one task.

The draws invert the distribution function: weights follow the ratio of
successive probabilities over 12 standard deviations and 30 to either side of the mean (what
lies beyond is below 1e-30, less than the resolution of the uniform numbers).
All randomness is a hash of the seed and of stored numbers, so a task that is run again
gives the same rows.

Null text: no bytes, size 1, checksum 0. Null ids, ties and repeated rows are
rows like any other: each has a slot of its own, and rows of equal texts are not
kept together (a group may be larger than a shard). Texts of any length are one row.
Further columns of the input are carried along unchanged; those named
``shard`` or ``slot`` are replaced. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadspark.operators.grouping import row_number_per_group

from . import common

SHARDS = 8
SEED = 13
#: Rows of a part: bounds what one task sorts in the local permutation.
PART_ROWS = 1 << 20


def uniform(*key: Column) -> Column:
    """A number in (0, 1) of 53 bits, fixed by the key."""
    return (F.shiftrightunsigned(F.xxhash64(*key), 11).cast("double") + 0.5) / F.lit(float(1 << 53))


def hypergeometric(u: Column, marked: Column, drawn: Column, total: Column) -> Column:
    """Number of marked items among ``drawn`` of ``total``, of which ``marked``
    are marked, by inversion at ``u``. Arguments are columns of longs."""
    k, n, t = marked.cast("double"), drawn.cast("double"), total.cast("double")
    mean = F.when(total > 0, n * k / t).otherwise(0.0)
    spread = F.when(total > 1, mean * (1 - k / t) * (t - n) / (t - 1)).otherwise(0.0)
    reach = F.ceil(F.lit(12.0) * F.sqrt(F.greatest(spread, F.lit(0.0)))) + 30
    low = F.greatest(F.lit(0), drawn + marked - total, F.floor(mean) - reach).cast("long")
    high = F.least(drawn, marked, F.ceil(mean) + reach).cast("long")

    def given(x: Column, low: Column, high: Column) -> Column:
        """The draw from struct x of u, k, n, t and the range's ends."""
        def ratio(i: Column) -> Column:
            """Weight of i + 1 over that of i."""
            d = i.cast("double")
            return (x["k"] - d) * (x["n"] - d) / ((d + 1) * (x["t"] - x["k"] - x["n"] + d + 1))

        steps = F.when(low < high, F.sequence(low, high - 1)).otherwise(F.array().cast("array<bigint>"))
        one = F.lit(1.0)
        weights = F.aggregate(
            steps, F.struct(one.alias("w"), one.alias("sum")),
            lambda a, i: F.struct((a["w"] * ratio(i)).alias("w"), (a["sum"] + a["w"] * ratio(i)).alias("sum")),
            lambda a: a["sum"] * x["u"])
        return F.transform(F.array(weights), lambda goal: F.aggregate(
            steps, F.struct(low.alias("at"), one.alias("w"), one.alias("sum")),
            lambda a, i: F.when(a["sum"] >= goal, a).otherwise(F.struct(
                (i + 1).alias("at"), (a["w"] * ratio(i)).alias("w"), (a["sum"] + a["w"] * ratio(i)).alias("sum"))),
            lambda a: a["at"]))[0]

    x = F.struct(u.alias("u"), k.alias("k"), n.alias("n"), t.alias("t"), low.alias("low"), high.alias("high"))
    # an array of one, so that the arguments are worked out once, not at each step
    return F.transform(F.array(x), lambda x: given(x, x["low"], x["high"]))[0]


def _left_counts(counts: Column, left: Column, node: Column, level: int, seed: int) -> Column:
    """Of a node's counts per shard, those that fall to its left child of
    ``left`` rows: shard after shard, from what is left of both."""
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, c: a + c)
    start = F.struct(left.alias("left"), total.alias("total"), F.array().cast("array<bigint>").alias("out"))

    def step(a: Column, i: Column) -> Column:
        c = F.element_at(counts, i)
        u = uniform(F.lit(seed), F.lit(level), node, i)
        return F.transform(F.array(hypergeometric(u, c, a["left"], a["total"])), lambda got: F.struct(
            (a["left"] - got).alias("left"), (a["total"] - c).alias("total"),
            F.concat(a["out"], F.array(got)).alias("out")))[0]

    return F.aggregate(F.sequence(F.lit(1), F.size(counts)), start, step, lambda a: a["out"])


def shard_sizes(rows: int, shards: int) -> list[int]:
    """Row counts at most one apart."""
    return [rows // shards + (i < rows % shards) for i in range(shards)]


def communication_matrix(parts: DataFrame, sizes: list[int], seed: int = SEED) -> DataFrame:
    """Rows ``leaf, counts`` for the parts ``(leaf, n)``, leaves numbered from
    0: ``counts[s]`` rows of the part go to shard s. ``sizes`` are the shards'."""
    leaves = parts.agg(F.max("leaf")).head()[0]
    depth = 0 if leaves is None else int(leaves).bit_length()
    nodes = parts.filter("leaf = 0").select((F.col("leaf") * 0).alias("node"),
                                            F.array(*[F.lit(s).cast("long") for s in sizes]).alias("counts"))
    for level in range(depth):
        # rows below each node's left child
        below = (parts.withColumn("child", F.shiftright("leaf", depth - level - 1)).filter("child % 2 = 0")
                 .groupBy(F.shiftright("child", 1).alias("of")).agg(F.sum("n").alias("left")))
        split = (nodes.join(below, F.col("node") == F.col("of"), "left")
                 .withColumn("left", F.coalesce("left", F.lit(0)))
                 .withColumn("lefts", _left_counts(F.col("counts"), F.col("left"), F.col("node"), level, seed)))
        rights = F.zip_with("counts", "lefts", lambda a, b: a - b)
        nodes = split.select(F.inline(F.array(
            F.struct((F.col("node") * 2).alias("node"), F.col("lefts").alias("counts")),
            F.struct((F.col("node") * 2 + 1).alias("node"), rights.alias("counts")))))
        nodes = nodes.filter(F.aggregate("counts", F.lit(0).cast("long"), lambda a, c: a + c) > 0)
        if level % 4 == 3:
            nodes = common.stored(nodes, "shard-nodes")
    return nodes.withColumnRenamed("node", "leaf")


def assigned(rows: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """``rid, shard, slot`` for a stored table of distinct row numbers ``rid``
    made by ``monotonically_increasing_id``."""
    keys = rows.select("rid", F.shiftright("rid", (PART_ROWS - 1).bit_length()).alias("part"))
    counts = common.stored(keys.groupBy("part").agg(F.count("*").alias("n")), "shard-parts")
    # leaves in the order of the parts; there are as many as input partitions and millions of rows
    parts = row_number_per_group(counts.withColumn("all", F.lit(0)), ["all"], ["part"], "leaf").select(
        (F.col("leaf") - 1).alias("leaf"), "part", "n")
    parts = common.stored(parts, "shard-leaves")
    total = parts.agg(F.sum("n")).head()[0] or 0
    matrix = communication_matrix(parts.select("leaf", "n"), shard_sizes(total, shards), seed)
    ends = F.transform(F.sequence(F.lit(1), F.lit(shards)), lambda i: F.aggregate(
        F.slice("counts", 1, i), F.lit(0).cast("long"), lambda a, c: a + c))
    borders = parts.join(matrix, "leaf").select("part", ends.alias("ends"))
    local = Window.partitionBy("part").orderBy(F.xxhash64(F.lit(seed), F.lit("local"), "rid"), "rid")
    dealt = (keys.withColumn("place", F.row_number().over(local)).join(borders, "part")
             .select("rid", F.size(F.filter("ends", lambda e: e < F.col("place"))).alias("shard")))
    again = F.xxhash64(F.lit(seed), F.lit("again"), "rid")
    numbered = row_number_per_group(dealt.withColumn("key", again), ["shard"], ["key", "rid"], "slot")
    return numbered.select("rid", "shard", (F.col("slot") - 1).alias("slot"))


def sharded(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """The rows of ``docs`` with their ``shard`` and their ``slot`` in it."""
    names = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    rows = common.stored(docs.select(F.monotonically_increasing_id().alias("rid"), F.struct(*[docs[c] for c in names]).alias("row")),
                         "shard-rows")
    at = common.stored(assigned(rows.select("rid"), shards, seed), "shard-slots")
    # the exchange of the rows is the same at every size, not a broadcast of the slots where they are few
    return rows.hint("merge").join(at, "rid").select("row.*", "shard", "slot")


def save(made: DataFrame, path: str) -> None:
    """Write sharded rows as one folder of Parquet files per shard, rows of a
    file in the order of their slots; a shard is written by many tasks."""
    made.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def digests(docs: DataFrame) -> DataFrame:
    """The sharded documents, texts as size and checksum."""
    text = F.encode(common.text_of(), "UTF-8")
    return sharded(docs.select("doc_id", "text")).select(
        "doc_id", (F.octet_length(common.text_of()).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
