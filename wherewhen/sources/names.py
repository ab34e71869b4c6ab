"""The registry of names: ids with the authority and name that mint them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wherewhen.functions import ident

SCHEMA = "prescribed_id binary, authority string, common_name string, kind smallint"


def unverified(names: DataFrame) -> DataFrame:
    """Rows whose authority and name don't mint their id, or whose kind isn't the id's."""
    a, n, k = F.col("authority"), F.col("common_name"), F.col("kind")
    frames = ident.frames(names.sparkSession).select(F.col("name").alias("_name"), F.col("frame_id").alias("_frame"))
    out = names.join(F.broadcast(frames), (F.lower(a) == "astro") & (n == F.col("_name")), "left")
    minted = F.when(k == ident.ENTITY, ident.mint_entity(a, n)).when(k == ident.ABSTRACT, ident.mint_abstract(a, n)).when(k == ident.ASTRO, F.col("_frame"))
    return out.where(~F.coalesce((minted == F.col("prescribed_id")) & (ident.kind(F.col("prescribed_id")) == k), F.lit(False))).select(names.columns)


def verified(names: DataFrame) -> DataFrame:
    """names, or ValueError if any binding is wrong: all or nothing."""
    if not unverified(names).isEmpty():
        raise ValueError("a name does not mint its id")
    return names


def merge(names: DataFrame, more: DataFrame) -> tuple[DataFrame, int]:
    """(the union, number of ids newly learned); where both know an id, more's spelling wins."""
    verified(more)
    last = more.groupBy("prescribed_id").agg(F.max_by(F.struct(*[c for c in names.columns if c != "prescribed_id"]), F.col("common_name")).alias("_r")).select("prescribed_id", "_r.*")
    fresh = last.join(names.select("prescribed_id"), "prescribed_id", "left_anti").count()
    return names.join(last.select("prescribed_id"), "prescribed_id", "left_anti").select(names.columns).unionByName(last.select(names.columns)), fresh


def exported(names: DataFrame) -> DataFrame:
    """In the order of the ids' bytes."""
    return names.orderBy("prescribed_id")


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)
