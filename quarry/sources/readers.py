"""Sources and sinks S01-S12: delimited text with explicit schemas, scenario result folders.

Schemas are always explicit (inference would read ``inf`` utilisation as
text, and would cost a full extra pass over the files).  Column pruning and
filters reach the CSV / Parquet readers through Catalyst.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.session import checkpoint_dir

KEY_TYPES = {"ENTIDAD": T.IntegerType(), "MUN": T.IntegerType(), "LOC": T.IntegerType(), "MZA": T.IntegerType()}
KEY_STRINGS = ("NOM_ENT", "NOM_MUN", "NOM_LOC", "AGEB")


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A fresh folder under the shared checkpoint directory (never a machine-local temp dir)."""
    return os.path.join(checkpoint_dir(spark), "quarry-io", f"{tag}-{uuid.uuid4().hex}")


# ------------------------------------------------------------------ S01
def census_schema(measures: Sequence[str]) -> T.StructType:
    fields = [T.StructField(k, T.StringType()) for k in ("NOM_ENT",)]
    fields += [T.StructField("ENTIDAD", T.IntegerType()), T.StructField("NOM_MUN", T.StringType()),
               T.StructField("MUN", T.IntegerType()), T.StructField("NOM_LOC", T.StringType()),
               T.StructField("LOC", T.IntegerType()), T.StructField("AGEB", T.StringType()),
               T.StructField("MZA", T.IntegerType())]
    fields += [T.StructField(m, T.StringType()) for m in measures]
    return T.StructType(fields)


def read_census(spark: SparkSession, path: str, measures: Sequence[str], keep: Sequence[str] | None = None,
                sep: str = ",", encoding: str = "UTF-8") -> DataFrame:
    """Census block CSVs (a glob), measures as text, optional column subset."""
    df = (spark.read.schema(census_schema(measures)).option("header", True).option("sep", sep)
          .option("encoding", encoding).csv(path))
    return df.select(*keep) if keep else df


# ------------------------------------------------------------------ S02 / S03 / S04 / S07
STANDARD_CHARSETS = {"iso-8859-1", "us-ascii", "utf-16", "utf-16be", "utf-16le", "utf-32", "utf-8"}


def read_delimited(spark: SparkSession, path: str, schema: T.StructType | str, sep: str = "|",
                   encoding: str = "windows-1252", header: bool = True) -> DataFrame:
    """Delimited text with a separator, encoding and explicit schema.

    Spark 4 accepts a short list of charsets by default; other JVM charsets
    (windows-1252 for the coordinate files) need the legacy charset switch.
    """
    if encoding.lower() not in STANDARD_CHARSETS:
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    return (spark.read.schema(schema).option("header", header).option("sep", sep)
            .option("encoding", encoding).option("positiveInf", "inf").option("negativeInf", "-inf")
            .csv(path))


# ------------------------------------------------------------------ S05
PRODUCTION_SCHEMA = T.StructType([T.StructField("T", T.IntegerType()), T.StructField("plant", T.StringType())] + [
    T.StructField(c, T.DoubleType()) for c in (
        "state", "available", "expansion", "capacity", "production", "init_inventory", "inventory", "switch_cost",
        "layoff_cost", "capex", "costs", "revenues", "ebitda", "depreciation", "nopat", "fcf_wo_nwc", "utilization")])
OBJECTIVE_SCHEMA = T.StructType([T.StructField("objective", T.DoubleType()), T.StructField("step", T.IntegerType())])
MARKET_SCHEMA = T.StructType([T.StructField("T", T.IntegerType()), T.StructField("mun", T.StringType()),
                              T.StructField("plant", T.StringType())] + [
    T.StructField(c, T.DoubleType()) for c in ("sales", "freight", "revenue", "ebitda")])
DEMAND_SCHEMA = T.StructType([T.StructField("T", T.IntegerType()), T.StructField("mun", T.StringType())] + [
    T.StructField(c, T.DoubleType()) for c in (
        "demand", "price", "freight_min", "freight_mean", "freight_median", "freight_max")])
PERIOD_SCHEMA = T.StructType([T.StructField("date", T.IntegerType()), T.StructField("days", T.IntegerType()),
                              T.StructField("T", T.IntegerType())])
RESULT_KINDS = {"production": PRODUCTION_SCHEMA, "objective": OBJECTIVE_SCHEMA, "market": MARKET_SCHEMA,
                "demand": DEMAND_SCHEMA}


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(p)


def file_name() -> Column:
    """The source file's name as it is on disk; the metadata column holds it URL-encoded (a blank as %20)."""
    return F.url_decode(F.regexp_replace(F.col("_metadata.file_name"), r"\+", "%2B"))


def read_scenarios(spark: SparkSession, base: str, kinds: Sequence[str] = tuple(RESULT_KINDS),
                   tag_from: str = "name") -> dict:
    """One DataFrame per result kind over all run files, tagged with the file name.

    A missing result folder gives ``None`` (the shipped data has no market /
    demand folders).  ``periods`` is the period table.
    """
    out: dict[str, DataFrame | None] = {}
    for k in kinds:
        path = os.path.join(base, k)
        if not _exists(spark, path):
            out[k] = None
            continue
        df = (spark.read.schema(RESULT_KINDS[k]).option("header", True).option("positiveInf", "inf")
              .option("pathGlobFilter", "*.csv").csv(path))
        if tag_from == "partition":  # one folder per run (file=<tag>), as written by a partitioned job
            out[k] = df
        else:  # one file per run, tagged by its name
            out[k] = df.withColumn("file", F.regexp_replace(file_name(), r"\.csv$", ""))
    stats = os.path.join(base, "ts_specs", "stats.csv")
    out["periods"] = (spark.read.schema(PERIOD_SCHEMA).option("header", True).csv(stats)
                      if _exists(spark, stats) else None)
    return out


# ------------------------------------------------------------------ S06
def read_by_pattern(spark: SparkSession, folder: str, pattern: str, schema: T.StructType, **opts) -> DataFrame:
    """Stack every file of a folder whose name matches a glob pattern, tagged by file."""
    r = spark.read.schema(schema).option("header", True).option("pathGlobFilter", pattern)
    for k, v in opts.items():
        r = r.option(k, v)
    return r.csv(folder).withColumn("source_file", file_name())


# ------------------------------------------------------------------ S08
def read_two_row_header(spark: SparkSession, path: str, id_name: str = "ENTIDAD", sep: str = ",") -> DataFrame:
    """A sheet whose first two rows are (year, month) headers -> long (id, year, month_str, value).

    The two header rows are the first ones of the first file by name, however the
    sheet is split into files and read in blocks: rows go by file, by where their
    block starts, and by their order within the block.  They are turned into a
    small position map (one row per column) and joined back by position after
    ``posexplode`` of each data row.
    """
    raw = spark.read.option("header", False).option("sep", sep).csv(path)
    cols = raw.columns
    place = ["_file", "_block", "_rid"]  # ids grow along a block, which one task reads in order
    idx = raw.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
                     F.monotonically_increasing_id().alias("_rid"))
    first_two = idx.orderBy(*place).limit(2)  # the header rows: a limit is the feature here
    numbered = first_two.select("*", F.row_number().over(Window.orderBy(*place)).alias("_h"))
    hdr = numbered.select("_h", F.posexplode(F.array(*[F.col(c) for c in cols[1:]])).alias("pos", "v"))
    hmap = hdr.groupBy("pos").agg(F.max(F.when(F.col("_h") == 1, F.col("v"))).alias("year_raw"),
                                  F.max(F.when(F.col("_h") == 2, F.col("v"))).alias("month_str"))
    w = Window.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    hmap = hmap.select("pos", F.last("year_raw", ignorenulls=True).over(w).alias("year"), "month_str")
    body = idx.join(F.broadcast(first_two.select(*place)), place, "left_anti")
    long = body.select(F.col(cols[0]).alias(id_name),
                       F.posexplode(F.array(*[F.col(c) for c in cols[1:]])).alias("pos", "v"))
    return long.join(F.broadcast(hmap), "pos").select(
        id_name, F.expr("try_cast(year AS INT)").alias("year"), "month_str",
        F.expr("try_cast(v AS DOUBLE)").alias("price"))


# ------------------------------------------------------------------ S09
def drop_unnamed(df: DataFrame, marker: str = "Unnamed") -> DataFrame:
    """Drop stray index columns by name."""
    return df.select([c for c in df.columns if marker not in c])


# ------------------------------------------------------------------ S11 / S12
def write_partitioned(df: DataFrame, path: str, key: str, fmt: str = "parquet", mode: str = "overwrite", **opts) -> None:
    """One output folder per key value in a single job (no driver loop)."""
    df.write.mode(mode).partitionBy(key).options(**opts).format(fmt).save(path)


def cached_table(spark: SparkSession, path: str, build, fmt: str = "parquet", **opts) -> DataFrame:
    """Reuse a derived table when it is complete at ``path``, else build, write and read it back.

    Complete means that its write left the commit marker; a folder of a running
    or failed write is built again.
    """
    if not _exists(spark, path.rstrip("/") + "/_SUCCESS"):
        w = build().write.mode("overwrite").format(fmt)
        for k, v in opts.items():
            w = w.option(k, v)
        w.save(path)
    r = spark.read.format(fmt)
    for k, v in opts.items():
        r = r.option(k, v)
    return r.load(path)


def bucketed_table(spark: SparkSession, name: str, build, key: str, buckets: int, path: str | None = None) -> DataFrame:
    """S12 for repeated joins: a table kept in ``buckets`` sorted buckets of ``key``, built when the catalog lacks it.

    Joins and groupings on ``key`` of tables with the same number of buckets need no
    shuffle, however often they are read.  Rows are dealt out by the key once, so
    every bucket is one file.  ``path`` places the files in a shared folder; else
    the session's warehouse holds them.
    """
    if not spark.catalog.tableExists(name):
        w = build().repartition(buckets, key).write.mode("overwrite").format("parquet").bucketBy(buckets, key).sortBy(key)
        (w.option("path", path) if path else w).saveAsTable(name)
    return spark.table(name)
