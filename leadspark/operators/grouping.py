"""Skew-safe per-group ordering primitives.

A tenant may hold a third of all rows, so no operator may sort a whole
tenant inside one task:

* :func:`top_k_per_group` ranks as a two-level tree. The literal bound
  ``k_max`` lets Catalyst plan a partial ``WindowGroupLimit`` *before* each
  shuffle, so every map task sends at most ``k`` rows per bucket. Level 1
  buckets are ``(group, map task mod salts)``: a hot group's partial results
  from many map tasks are merged by ``salts`` reducers instead of one.
  Level 2 ranks the ``<= k * salts`` survivors of each group. The top ``k``
  of a group is always among the per-bucket top ``k``, so this is exact.
* :func:`row_number_per_group` numbers every row of a group in order with a
  range-partitioned global sort plus per-partition offsets; each task sorts
  only its own key range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sizing import is_small

DEFAULT_SALTS = 32


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def top_k_per_group(df: DataFrame, group: list[str], order: list[Column], k, k_max: int,
                    rank_col: str = "rank", salts: int = DEFAULT_SALTS) -> DataFrame:
    """Rows ranked ``1..k`` per group by ``order`` (which must be a total
    order); ``k`` may be a per-row column bounded by the literal ``k_max``."""
    kc = _c(k) if not isinstance(k, int) else F.lit(k)
    # Bucket by the producing task (deterministic for a given input split):
    # each level-1 reducer merges the partial top-k of 1/salts of the tasks.
    salt = F.pmod(F.spark_partition_id(), F.lit(salts))
    d = df.withColumn("_salt", salt)
    w1 = Window.partitionBy(*group, "_salt").orderBy(*order)
    s1 = (d.withColumn("_rn1", F.row_number().over(w1))
          .filter((F.col("_rn1") <= kc) & (F.col("_rn1") <= F.lit(k_max)))
          .drop("_rn1", "_salt"))
    w2 = Window.partitionBy(*group).orderBy(*order)
    return (s1.withColumn(rank_col, F.row_number().over(w2).cast("bigint"))
            .filter((F.col(rank_col) <= kc) & (F.col(rank_col) <= F.lit(k_max))))


def row_number_per_group(df: DataFrame, group: list[str], order: list, name: str = "row_no",
                         partitions: int | None = None) -> DataFrame:
    """``row_number() over (partition by group order by order)`` without a
    single-task group: range-partition on ``group + order`` (a total order),
    sort within partitions, take each row's position in its partition, and
    add the counts of the group's rows in earlier partitions.

    The numbered data is checkpointed (to ``spark.checkpoint.dir``) so the
    positions and the offsets are computed from one materialisation.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [_c(c) for c in group] + [_c(c) for c in order]
    r = (df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
         .withColumn("_pid", F.spark_partition_id())
         .withColumn("_mid", F.monotonically_increasing_id()))
    r = r.checkpoint(eager=True)
    counts = r.groupBy(*group, "_pid").agg(F.count(F.lit(1)).alias("_n"),
                                           F.min("_mid").alias("_mid0"))
    before = Window.partitionBy(*group).orderBy("_pid").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    offsets = offsets.select(*group, "_pid", "_off", "_mid0")
    # (group, partition) pairs number at most groups + partitions.
    if is_small(offsets, 2_000_000):
        offsets = F.broadcast(offsets)
    out = r.join(offsets, [*group, "_pid"])
    return out.withColumn(name, (F.col("_off") + F.col("_mid") - F.col("_mid0") + 1)
                          .cast("bigint")).drop("_pid", "_mid", "_off", "_mid0")


def previous_in_group(df: DataFrame, group: list[str], order: list, id_col: str,
                      prev_name: str = "prev_id") -> DataFrame:
    """``lag(id_col) over (partition by group order by order)`` as a join on
    ``(group, row_no - 1)``: rows are numbered by :func:`row_number_per_group`
    (no single-task group) and the equi-join keys are unique."""
    keys = df.select(*group, *[c for c in order if isinstance(c, str) and c not in group], id_col) \
        if id_col not in order else df.select(*group, *[c for c in order if isinstance(c, str)])
    n = row_number_per_group(keys, group, order, name="_rn")
    prev = n.select(*group, (F.col("_rn") + 1).alias("_rn"), F.col(id_col).alias(prev_name))
    return n.join(prev, [*group, "_rn"], "left").drop("_rn")
