"""Sources (S1-S11): typed reads of the engine's tables.

Tenant tables live in one dataset partitioned by ``client`` (Hive-style
``client=<name>/`` folders, S7), so a tenant's files are found by partition
pruning instead of path building. Schemas are fixed (never inferred).
"""

from __future__ import annotations

import posixpath

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas as S
from ..operators import contacts as CT
from ..operators.grouping import row_number_per_group
from ..operators.sizing import maybe_broadcast

CONTACT_FIELDS = ["first_name", "last_name", "company", "position"]
REQUIRED_CONTACT_FIELDS = ["first_name", "last_name", "company"]


class MissingColumns(ValueError):
    pass


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence check through the Hadoop file system of the path (works for
    HDFS/S3/ABFS as well as local paths)."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(hpath))


def tenant_name(path_col) -> "F.Column":
    """tenant = last path component of a tenant folder."""
    c = F.col(path_col) if isinstance(path_col, str) else path_col
    return F.element_at(F.split(F.regexp_replace(c, "/+$", ""), "/"), -1)


def tenant_path(root: str, client: str | None, name: str) -> str:
    """``root/client=<basename(client)>/name`` (or ``root/name``)."""
    if client:
        return posixpath.join(root, f"client={posixpath.basename(client.rstrip('/'))}", name)
    return posixpath.join(root, name)


def read_table(spark: SparkSession, path: str, schema, fmt: str = "parquet",
               client: str | None = None, **options) -> DataFrame:
    """Typed read; ``client`` prunes to one tenant's partition."""
    df = spark.read.schema(schema).options(**options).format(fmt).load(path)
    return df.filter(F.col("client") == client) if client is not None else df


def load_or_create_history(spark: SparkSession, path: str) -> DataFrame:
    """S3: the stored history, or an empty typed one when none exists yet."""
    if path_exists(spark, path):
        return spark.read.schema(S.HISTORY).parquet(path)
    return spark.createDataFrame([], S.HISTORY)


def require_columns(df: DataFrame, required: list[str], ordered: bool = False) -> list[str]:
    """Names of the missing required columns (schema only). With
    ``ordered`` the required columns must also lead, in that order."""
    cols = df.columns
    missing = [c for c in required if c not in cols]
    if not missing and ordered and cols[:len(required)] != required:
        missing = [c for c, have in zip(required, cols[:len(required)]) if c != have]
    return missing


def _file_order(raw: DataFrame, fmt: str) -> DataFrame:
    """``src_row`` in file order: files in path order, rows in file order. A
    Parquet row's place in its file is known; rows of a text format are ordered
    by their split's start and their order in the scan, and numbered."""
    path = F.col("_metadata.file_path")
    if fmt != "parquet":
        rows = raw.select("*", path.alias("_path"), F.col("_metadata.file_block_start").alias("_block"),
                          F.monotonically_increasing_id().alias("_row"))
        return row_number_per_group(rows, [], ["_path", "_block", "_row"], name="src_row").drop("_path", "_block", "_row")
    files = raw.select(path.alias("_f")).distinct()  # one row per file
    numbered = files.withColumn("_file", F.row_number().over(Window.orderBy("_f")).cast("bigint") - 1)
    rows = raw.select("*", path.alias("_path"), F.col("_metadata.row_index").alias("_at"))
    return rows.join(numbered, rows["_path"] == numbered["_f"]).withColumn(
        "src_row", F.shiftleft("_file", 40) + F.col("_at")).drop("_path", "_at", "_file", "_f")


def load_contacts(spark: SparkSession, path: str, fmt: str = "parquet",
                  client: str | None = None, **options) -> DataFrame:
    """Read, check required columns (C1), clean
    and sort by name and company (O1)."""
    raw = spark.read.options(**options).format(fmt).load(path)
    missing = require_columns(raw, REQUIRED_CONTACT_FIELDS)
    if missing:
        raise MissingColumns(f"contacts are missing required columns: {missing}")
    for c in ["position", "url"]:
        if c not in raw.columns:
            raw = raw.withColumn(c, F.lit(None).cast("string"))
    if "client" not in raw.columns:
        raw = raw.withColumn("client", F.lit(client))
    if "src_row" not in raw.columns:
        # File order: position within the landed file (stable across re-reads
        # of the same files, unlike an id assigned per task).
        raw = _file_order(raw, fmt)
    if client is not None:
        raw = raw.filter(F.col("client") == client)
    c = CT.clean(raw.select(*[F.col(f.name).cast(f.dataType) for f in S.CONTACTS.fields]))
    return c.orderBy("client", "first_name", "last_name", "company")


def nan_to_null(c: str):
    """One missing-value marker (NaN in a double becomes NULL)."""
    return F.when(~F.isnan(F.col(c)), F.col(c))


# Raw price list as it lands (dates as text, possibly dirty).
PRICING_RAW = "ord bigint, model string, start_date string, end_date string, " \
              "input_price double, output_price double, search_price double"


def load_prices(spark: SparkSession, path: str, fmt: str = "csv", **options) -> tuple[DataFrame, DataFrame]:
    """Prices with dates parsed leniently (bad -> null, F24) and the
    load checks: C9 empty source, C6 unparseable start dates."""
    opts = {"header": "true", **options} if fmt == "csv" else options
    reader = spark.read.options(**opts).format(fmt)
    if "ord" in reader.load(path).columns:
        return parse_prices(reader.schema(PRICING_RAW).load(path))
    # no order column: the order in the file is the order
    raw = _file_order(reader.schema(PRICING_RAW.split(", ", 1)[1]).load(path), fmt)
    return parse_prices(raw.withColumnRenamed("src_row", "ord"))


def parse_prices(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Typed prices of raw ones, and what is wrong with them. A blank start
    date is no date that failed to parse; both leave a period without a start."""
    blank = F.col("start_date").isNull() | (F.trim("start_date") == "")
    parsed = raw.select(
        "ord", "model",
        F.try_to_timestamp(F.col("start_date")).cast("timestamp_ntz").alias("start_date"),
        F.try_to_timestamp(F.col("end_date")).cast("timestamp_ntz").alias("end_date"),
        *[nan_to_null(c).alias(c) for c in ("input_price", "output_price", "search_price")],
        blank.alias("_blank"))
    checks = parsed.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("start_date").isNull() & ~F.col("_blank")).alias("bad_start"),
        F.count_if(F.col("_blank")).alias("blank_start"))
    issues = checks.select(F.explode(F.array(
        F.when(F.col("n") == 0, F.struct(F.lit("empty_source").alias("check"),
                                         F.lit("pricing").alias("key"),
                                         F.lit("the pricing file is empty").alias("detail"))),
        F.when(F.col("bad_start") > 0, F.struct(
            F.lit("start_date_unparsed").alias("check"), F.lit("pricing").alias("key"),
            F.format_string("%d start dates could not be parsed", F.col("bad_start")).alias("detail"))),
        F.when(F.col("blank_start") > 0, F.struct(
            F.lit("start_date_blank").alias("check"), F.lit("pricing").alias("key"),
            F.format_string("%d start dates are blank", F.col("blank_start")).alias("detail"))),
    )).alias("i")).filter(F.col("i").isNotNull()).select(
        F.lit(None).cast("string").alias("client"), "i.check", "i.key", "i.detail")
    return parsed.drop("_blank"), issues


def load_subscriptions(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    """Typed subscriptions (C9: see :func:`empty_source`)."""
    return spark.read.schema(S.SUBSCRIPTIONS).options(**options).format(fmt).load(path)


def empty_source(df: DataFrame, name: str) -> DataFrame:
    """A check row where a source has no rows."""
    return df.limit(1).agg(F.count(F.lit(1)).alias("n")).filter("n = 0").select(
        F.lit(None).cast("string").alias("client"), F.lit("empty_source").alias("check"), F.lit(name).alias("key"),
        F.lit(f"the {name} source is empty").alias("detail"))


def load_prompts(spark: SparkSession, glob: str) -> DataFrame:
    """Every tenant prompt file as (client, name, body): whole files,
    tenant from the parent folder, name from the file name without its
    extension. Joined by broadcast wherever used (a few rows per tenant)."""
    df = spark.read.text(glob, wholetext=True).select(
        F.col("value").alias("body"), F.col("_metadata.file_path").alias("path"))
    parts = F.split(F.col("path"), "/")
    folder = F.element_at(parts, -2)
    return df.select(
        F.regexp_replace(folder, "^client=", "").alias("client"),
        F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", "").alias("name"), "body")


def prompt_for(names: DataFrame, prompts: DataFrame, defaults: DataFrame) -> DataFrame:
    """Each (client, name) gets the tenant's own prompt text or the
    default text of the same name."""
    own = prompts.select("client", "name", F.col("body").alias("_own"))
    dflt = defaults.select("name", F.col("body").alias("_default"))
    return (names.join(maybe_broadcast(own), ["client", "name"], "left")
            .join(maybe_broadcast(dflt), "name", "left")
            .select("client", "name", F.coalesce("_own", "_default").alias("body"),
                    F.col("_own").isNull().alias("is_default")))


def reload_history(spark: SparkSession, path: str) -> DataFrame:
    """History for viewing, ``search_date`` as a timestamp."""
    h = load_or_create_history(spark, path)
    return h.withColumn("search_date", F.col("search_date").cast("timestamp_ntz"))


def read_spreadsheets(spark: SparkSession, glob: str, schema) -> DataFrame:
    """Many spreadsheet files, one task per file (binaryFile +
    mapInPandas). Needs an Excel reader on the executors; the tenant is the
    parent folder of each file."""
    names = [f.name for f in schema.fields]

    def parse(batches):
        import io

        import pandas as pd
        for b in batches:
            for content, path in zip(b["content"], b["path"]):
                pdf = pd.read_excel(io.BytesIO(content))  # needs openpyxl
                pdf.columns = [str(c).strip().lower().replace(" ", "_") for c in pdf.columns]
                if "client" in names and "client" not in pdf.columns:
                    pdf["client"] = path.rstrip("/").split("/")[-2].replace("client=", "")
                for n in names:
                    if n not in pdf.columns:
                        pdf[n] = None
                yield pdf[names]

    files = spark.read.format("binaryFile").load(glob).select("content", "path")
    return files.mapInPandas(parse, schema)
