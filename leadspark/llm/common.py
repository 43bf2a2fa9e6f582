"""Helpers shared by the operators: stored tables, worker path, components."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from leadspark.session import checkpoint_dir

_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
#: Rows of one Arrow batch: bounds a Python worker's memory by this many texts.
BATCH_ROWS = 2000
#: White space of the word rule ``[^\x20\x09-\x0D]+`` (what bytes.split() uses).
SPACE = r"[\x20\x09-\x0D]"


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package (installed at the same place on
    every node) and bound the Arrow batches."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if REPO not in paths:
        env["PYTHONPATH"] = os.pathsep.join([REPO, *paths])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark


def _written(df: DataFrame, name: str) -> DataFrame:
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"
    # the exchanges of this write are done with when it ends: free their disk then
    before = spark.conf.get(_CLEAN)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    return spark.read.schema(df.schema).parquet(path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared checkpoint folder and reread:
    cuts the lineage and survives lost executors. The schema is given, so an
    empty table rereads as well."""
    return _written(df, name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str | Column = "text") -> Column:
    """The text, empty where null."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column, F.lit(""))


def fold(doc_id: str, parts: int) -> Column:
    """``crc32(doc_id as text) mod parts``; null where doc_id is null."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts


def spread(df: DataFrame) -> DataFrame:
    """Deal a small, CPU-heavy table over the cores that the session has."""
    return df.repartition(max(2 * df.sparkSession.sparkContext.defaultParallelism,
                              int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected edges ``(a, b)`` of longs: one row
    ``(node, root)`` per node that has an edge, root being the smallest node.

    Alternating large-star and small-star steps; each links a node's
    neighbours to its smallest one, so the rounds grow with the logarithm of
    the longest path. Every step is a grouped minimum (combined before the
    shuffle) and a join that adaptive execution splits where a node is hot.
    """
    def links(df: DataFrame) -> DataFrame:
        """Links (larger, smaller node), without loops."""
        return df.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))

    e, mark = _marked(links(edges.select(F.col("a").alias("u"), F.col("b").alias("v"))).distinct(), "edges")
    while mark[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = _written(links(both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))), "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before = mark
        e, mark = _marked(links(small.unionByName(low.select("u", F.col("m").alias("v")))).distinct(), "small")
        if mark == before:
            break
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _marked(e: DataFrame, name: str) -> tuple[DataFrame, tuple[int, int]]:
    """The stored links with their count and order-free hash, taken while they
    are written, to see when they stay."""
    seen = Observation()
    e = _written(e.observe(seen, F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)).alias("x")), name)
    return e, (seen.get["n"], seen.get["x"])
