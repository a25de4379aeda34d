"""Session construction and small execution helpers shared by all operators."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Broadcast ceiling for explicit hints; above it the join is left to AQE
# (sort-merge, converted to broadcast at runtime only if the shuffle output
# really is small).
DEFAULT_BROADCAST_BYTES = 64 * 1024 * 1024


def scale_settings(input_bytes: int, partition_bytes: int = 256 * 1024 * 1024) -> dict[str, str]:
    """Shuffle sizing for a cluster run over ``input_bytes`` of input.

    The initial shuffle partition count gives ~``partition_bytes`` per task
    for a shuffle as large as the input (AQE then coalesces small ones and
    splits skewed ones), so no task has to hold more than it can spill.
    """
    n = max(200, int(input_bytes // partition_bytes))
    return {
        "spark.sql.shuffle.partitions": str(n),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(n),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(partition_bytes),
        "spark.sql.files.maxPartitionBytes": str(min(partition_bytes, 512 * 1024 * 1024)),
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(partition_bytes),
        "spark.sql.autoBroadcastJoinThreshold": str(64 * 1024 * 1024),
    }


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "quarry", input_bytes: int | None = None) -> SparkSession:
    """Session with the settings every operator assumes.

    * UTC session zone (calendar features and date casts are zone-free).
    * AQE with partition coalescing and skew-join splitting, so a hot key
      (one plant or state holding a third of the rows) is split at runtime.
    * ``input_bytes`` (cluster runs): shuffle partitions sized from the input
      (``scale_settings``), e.g. 100 TB -> 400k initial partitions, coalesced by AQE.
    * ANSI mode stays on: operators use ``try_divide`` / ``try_cast`` where the
      reference relied on inf / NaN.
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    b = (b.config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true")
         .config("spark.ui.enabled", "false")
         .config("spark.sql.constraintPropagation.enabled", "false"))
    if input_bytes:
        for k, v in scale_settings(input_bytes).items():
            b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if master and master.startswith("local"):
        # local mode: the driver JVM is the executor; the 1g default heap is too small
        b = b.config("spark.driver.memory", os.environ.get("QUARRY_DRIVER_MEMORY", "8g"))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def tune_optimizer(spark: SparkSession) -> None:
    """Session settings the wide census projections need.

    Also pins the session zone to UTC (epoch seconds of zone-less timestamps).
    Block tables carry ~20 aliased measure expressions; Catalyst's constraint
    propagation enumerates alias substitutions of every IS NOT NULL / range
    constraint and grows exponentially with them (a 100-row join took minutes
    to plan).  Turning it off only drops *inferred* filters; explicit ones are
    still pushed down to the scans.
    """
    spark.conf.set("spark.sql.constraintPropagation.enabled", "false")
    # calendar features use epoch seconds of zone-less timestamps: read them as UTC
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def plan_size_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of the optimized plan (no job is run)."""
    try:
        return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    except Exception:  # pragma: no cover - non-classic sessions
        return 1 << 62


def broadcast_if_small(df: DataFrame, max_bytes: int = DEFAULT_BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only when the optimizer's size estimate is bounded.

    Above the bound the frame is returned unchanged and the join stays a
    shuffle join (AQE may still demote it to broadcast from runtime sizes).
    """
    if plan_size_bytes(df) <= max_bytes:
        return F.broadcast(df)
    return df


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder: the cluster's ``spark.checkpoint.dir`` when set.

    Only a local-mode session without one (tests) gets a fresh folder; on a
    cluster a machine-local folder would not survive executor loss, so the
    setting is required there.
    """
    sc = spark.sparkContext
    cur = sc.getCheckpointDir()
    if cur:
        return cur
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder (HDFS / object store) on a cluster")
        conf = tempfile.mkdtemp(prefix="quarry-ckpt-")
    sc.setCheckpointDir(conf)
    return sc.getCheckpointDir() or conf


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (survives executor loss), never a local one."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")
