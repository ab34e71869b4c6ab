"""The driver's tables seen as observations, and intermediate tables in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wherewhen.functions import timeconv

#: The root that the view's free entities hang off.
EARTH = -399


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. In local mode one of this machine's own will do where it is unset; on a cluster that raises."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="wherewhen-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def settled(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the shared folder and read back: lineage ends there."""
    path = f"{shared_dir(df.sparkSession)}/wherewhen-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as flat observation rows, keyed by numbers: entity and parent (EARTH for none)."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    scale = F.element_at(F.array(*[F.lit(c) for c in (1, 2, 6, 5)]), (F.col("event_id") % 4 + 1).cast("int")).cast("smallint")
    raw = (F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(timeconv.J2000_UNIX_US)) * F.lit(1000)
    half = (F.col("event_id") % 8) * 22.5
    rows = e.select(
        F.col("user_id").alias("entity"),
        F.when((F.col("user_id") >= 10) & (F.col("event_type") != "signup"), F.floor(F.col("user_id") / 10)).otherwise(F.lit(EARTH)).cast("bigint").alias("parent"),
        (F.col("event_id") % 9 + 1).cast("smallint").alias("units_pos"),
        scale.alias("timescale_id"),
        F.when(F.col("event_type") == "purchase", 1).when(F.col("event_type") == "click", 2).otherwise(3).cast("smallint").alias("estimate_type"),
        F.array(F.col("value"), (F.col("event_id") % 1000).cast("double"), F.col("user_id").cast("double")).alias("position"),
        F.array(F.cos(F.radians(half)), F.lit(0.0), F.lit(0.0), F.sin(F.radians(half))).alias("quaternion"),
        timeconv.parts(raw)[0].alias("duration_centuries"),
        timeconv.parts(raw)[1].alias("duration_ns"),
        timeconv.to_tai(raw, scale).alias("epoch_ns"),
        F.col("event_id").alias("row_seq"),
        F.floor(F.col("event_id") / 500).alias("batch_seq"),
        F.col("event_type"),
        F.col("ts").cast("timestamp").alias("ts"),
    )
    return rows


OBSERVATIONS_SQL = """
obs AS (SELECT user_id AS entity,
  CASE WHEN user_id >= 10 AND event_type <> 'signup' THEN user_id // 10 ELSE -399 END AS parent,
  CAST(event_id % 9 + 1 AS SMALLINT) AS units_pos, CAST([1, 2, 6, 5][event_id % 4 + 1] AS SMALLINT) AS timescale_id,
  CAST(CASE event_type WHEN 'purchase' THEN 1 WHEN 'click' THEN 2 ELSE 3 END AS SMALLINT) AS estimate_type,
  value AS x, CAST(event_id % 1000 AS DOUBLE) AS y, CAST(user_id AS DOUBLE) AS z, (event_id % 8) * 22.5 AS half_deg,
  (epoch_us(ts) - 946728000000000) * 1000 AS raw_ns,
  (epoch_us(ts) - 946728000000000) * 1000 + [0, -32184000000, 19000000000, 32000000000][event_id % 4 + 1] AS epoch_ns,
  event_id AS row_seq, event_id // 500 AS batch_seq, event_type, ts FROM events)
"""
