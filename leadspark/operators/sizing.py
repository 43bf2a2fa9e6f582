"""Broadcast guards.

A side is broadcast only when its size is proven: either a bounded count
(:func:`is_small`, which reads at most ``max_rows + 1`` rows) on a frame
whose lineage touches only dimension tables, or a *bound by construction*
(:func:`broadcast_bounded`): a frame with at most one row per row of a
dimension table that was itself proven small. Frames derived from the large
tables are never counted (that would run their whole lineage twice);
without a proof the join is left to the planner, where AQE switches to a
broadcast join only after measuring the materialised side, and splits a
skewed partition otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What one broadcast may take: rows that carry texts are bounded by bytes.
MAX_BROADCAST_BYTES = 64 << 20


def rows_of(row_bytes: int) -> int:
    """Rows of this size that fit one broadcast."""
    return max(1, MAX_BROADCAST_BYTES // row_bytes)


# Tenant-level tables (settings, subscriptions, per-tenant aggregates).
MAX_BROADCAST_TENANTS = 1_000_000


def is_small(df: DataFrame, max_rows: int) -> bool:
    """Bounded size check: scans at most ``max_rows + 1`` rows."""
    return df.limit(max_rows + 1).count() <= max_rows


def maybe_broadcast(df: DataFrame, max_rows: int = MAX_BROADCAST_TENANTS) -> DataFrame:
    """Broadcast ``df`` only when a bounded count proves it small. Use on
    dimension-only lineages."""
    return F.broadcast(df) if is_small(df, max_rows) else df


def broadcast_bounded(df: DataFrame, bound: DataFrame | bool,
                      max_rows: int = MAX_BROADCAST_TENANTS) -> DataFrame:
    """Broadcast ``df`` whose row count is at most that of ``bound`` (by
    construction, e.g. a per-tenant aggregate after an inner join with the
    tenant table) when ``bound`` is proven small. ``bound`` may be the
    result of an earlier check."""
    ok = bound if isinstance(bound, bool) else is_small(bound, max_rows)
    return F.broadcast(df) if ok else df


def spread(df: DataFrame, factor: int = 2) -> DataFrame:
    """Spread a CPU-heavy input over the cluster when its scan yields fewer
    than ``factor`` x default-parallelism partitions (few large files or row
    groups). A scan of a large table already has many more splits than
    cores and is returned unchanged, so no shuffle is added at scale.
    For scans and checkpoints only: counting the partitions of a frame with a
    shuffle would run its stages."""
    if "Exchange" in df._jdf.queryExecution().sparkPlan().toString():
        raise ValueError("spread() takes scans and checkpoints only")
    sc = df.sparkSession.sparkContext
    want = sc.defaultParallelism * factor
    if df.rdd.getNumPartitions() < want:
        return df.repartition(want)
    return df
