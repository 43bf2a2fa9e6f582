"""Sinks (K1-K7): partitioned writes, append with schema reconciliation,
partition-scoped updates, CSV exports.

Nothing here reads a whole table back to rewrite it: appends are appends,
updates overwrite only the tenant partitions they touch, and the daily run adds
rows by flushes (:func:`flush`) that are visible as a whole or not at all.
"""

from __future__ import annotations

import posixpath
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .tables import path_exists


class SchemaMismatch(ValueError):
    pass


def write_partitioned(df: DataFrame, path: str, fmt: str = "parquet",
                      partition_by=("client",), mode: str = "overwrite") -> None:
    """K1: write by tenant; with ``overwrite`` only the partitions present in
    ``df`` are replaced (dynamic partition overwrite)."""
    df.write.mode(mode).option("partitionOverwriteMode", "dynamic").format(fmt).partitionBy(*partition_by).save(path)


def conform(df: DataFrame, schema) -> DataFrame:
    """C3 + F30: the same number of columns as ``schema`` or reject; select
    by name and cast each column to the stored type (the stored schema is
    the master)."""
    if len(df.columns) != len(schema.fields):
        raise SchemaMismatch(
            f"column count differs: {len(df.columns)} new vs {len(schema.fields)} stored")
    have = set(df.columns)
    missing = [f.name for f in schema.fields if f.name not in have]
    if missing:
        raise SchemaMismatch(f"columns missing: {missing}")
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def append(df: DataFrame, path: str, partition_by=("client",), key: list[str] | None = None) -> None:
    """Append to a stored table, reconciled to its schema (new
    table: written as is). With ``key`` rows that are stored already are left
    out, so a run that failed between two appends can be repeated."""
    spark = df.sparkSession
    if path_exists(spark, path):
        stored = spark.read.parquet(path)
        df = conform(df, stored.schema)
        if key:
            df = df.join(stored.select(*key), key, "left_anti").select(*stored.columns)
    df.write.mode("append").partitionBy(*partition_by).parquet(path)


def write_csv(df: DataFrame, path: str, partition_by=("client",), sort_by=None, partitions: int | None = None) -> None:
    """K3 / K7: CSV with a header per tenant folder. With ``sort_by`` rows are
    dealt by ranges of (tenant, order): each file is sorted and holds a range
    of its own, files in name order are in row order, and a large tenant is
    written by many tasks (``partitions``, or as many as adaptive execution
    finds fit)."""
    out = df
    if sort_by:
        keys = [F.col(c) if isinstance(c, str) else c for c in (*partition_by, *sort_by)]
        out = out.repartitionByRange(*([partitions] if partitions else []), *keys).sortWithinPartitions(*keys)
    w = out.write.mode("overwrite").option("header", True)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.csv(path)


def write_costs(costs: DataFrame, path: str) -> None:
    """K4: cost rows under ``client=<c>/period_label=<c>_<from>_<to>``."""
    write_partitioned(costs, path, partition_by=("client", "period_label"))


# --- Flushes: writes that become visible as a whole -------------------------
#
# A flush writes its rows of one or more tables into partitions of its own
# (``run=<flush>.<attempt>``) and then one manifest entry. Readers take the
# partitions that the manifest names, so a run that died between two writes has
# stored nothing, and a repeated one is a new attempt. Nothing stored is read
# to add rows: a run is known by its name, not by the keys of its rows.

MANIFEST = "flushes"
MANIFEST_SCHEMA = "flush string, attempt string, tables array<string>, counter string, last_id bigint"


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """One row per finished flush of the store at ``root``: a few a day."""
    path = posixpath.join(root, MANIFEST)
    if not path_exists(spark, path):
        return spark.createDataFrame([], MANIFEST_SCHEMA)
    return spark.read.schema(MANIFEST_SCHEMA).parquet(path)


def is_flushed(spark: SparkSession, root: str, flush: str) -> bool:
    return not manifest(spark, root).filter(F.col("flush") == flush).isEmpty()


def last_id(spark: SparkSession, root: str, counter: str) -> int | None:
    """The largest number that flushes have given out under ``counter``."""
    return manifest(spark, root).filter(F.col("counter") == counter).agg(F.max("last_id")).first()[0]


def stored(spark: SparkSession, root: str, table: str, schema: StructType | None = None) -> DataFrame | None:
    """The rows of all finished flushes, with their ``run``. The runs are
    partitions, so those of failed attempts are not read. Before the first row:
    an empty table of ``schema``, or None without one."""
    runs = [r.run for r in manifest(spark, root).filter(F.array_contains("tables", table)).select(
        F.concat_ws(".", "flush", "attempt").alias("run")).collect()]
    if not runs:
        return None if schema is None else spark.createDataFrame([], StructType([*schema.fields, StructField("run", StringType())]))
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(posixpath.join(root, table)).filter(F.col("run").isin(runs))


def flush(spark: SparkSession, root: str, name: str, tables: dict[str, DataFrame],
          partition_by: dict[str, tuple[str, ...]] | None = None,
          counter: str | None = None, last: int | None = None) -> bool:
    """Store the rows of ``tables`` under the flush ``name``, all of
    them or none. A flush that is finished is left as it is (False). A
    table that is there already is the master of its columns (C3, F30)."""
    if is_flushed(spark, root, name):
        return False
    attempt = uuid.uuid4().hex
    run = f"{name}.{attempt}"
    counts = {table: Observation() for table in tables}  # a table without rows leaves no files to read
    for table, df in tables.items():
        parts = (partition_by or {}).get(table, ())
        there = stored(spark, root, table)
        if there is not None:
            kept = [f for f in there.schema.fields if f.name != "run"]
            df = conform(df, StructType(kept))
        df = df.withColumn("run", F.lit(run)).observe(counts[table], F.count(F.lit(1)).alias("rows"))
        write_partitioned(df, posixpath.join(root, table), partition_by=(*parts, "run"))
    names = F.array(*[F.lit(t) for t in tables if counts[t].get["rows"]]).cast("array<string>")
    entry = spark.range(1).select(
        F.lit(name).alias("flush"), F.lit(attempt).alias("attempt"), names.alias("tables"),
        F.lit(counter).cast("string").alias("counter"), F.lit(last).cast("bigint").alias("last_id"))
    entry.coalesce(1).write.mode("append").parquet(posixpath.join(root, MANIFEST))
    return True


# A stored history is partitioned by tenant and search month, so that marking a
# few e-mailed searches rewrites a month of a tenant, not all of it; and by the
# run that stored the rows (last).
HISTORY_PARTITIONS = ("client", "search_month")


def with_month(history: DataFrame) -> DataFrame:
    return history.withColumn("search_month", F.date_format("search_date", "yyyy-MM"))


def update_history(history: DataFrame, path: str, touched: DataFrame, update) -> None:
    """K6: rewrite the partitions of the stored ``history`` that ``touched``
    (rows with client and search_date, at most a few per tenant) falls into;
    ``history`` holds each row's ``run``, and ``update`` maps the rows."""
    from ..operators.sizing import maybe_broadcast
    parts = with_month(touched.select("client", "search_date")).select(*HISTORY_PARTITIONS).distinct()
    rows = with_month(history).join(maybe_broadcast(parts.checkpoint(eager=True)), [*HISTORY_PARTITIONS], "left_semi")
    done = update(rows).checkpoint(eager=True)  # the partitions it comes from are overwritten below
    write_partitioned(done, path, partition_by=(*HISTORY_PARTITIONS, "run"))
