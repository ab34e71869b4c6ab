"""Latest states, summaries and retention. Tables have a key, a numeric epoch and row_seq, the order in which rows were stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOUR_NS = 3_600_000_000_000


def latest_epoch(df: DataFrame, epoch: str = "epoch_ns") -> DataFrame:
    """One row, epoch: the largest stored."""
    return df.agg(F.max(epoch).alias("epoch"))


def current_state(df: DataFrame, key: str = "entity", epoch: str = "epoch_ns", rank: Column | None = None, seq: str = "row_seq", ids: DataFrame | None = None, not_before: int | None = None, window_ns: int = HOUR_NS) -> DataFrame:
    """Each key's best whole row: the latest, then the lowest estimate rank, then the first stored.

    Rows before not_before are left out; it is window_ns before the latest epoch of all rows unless given - of
    all, also where ids restricts the keys. One aggregation that combines before its shuffle.
    """
    rank = F.lit(0) if rank is None else rank
    start = latest_epoch(df, epoch).scalar() - F.lit(window_ns) if not_before is None else F.lit(not_before)
    rows = df.where(F.col(epoch) >= start)
    if ids is not None:
        rows = rows.join(ids.select(key).distinct(), key, "left_semi").select(df.columns)
    best = F.max_by(F.struct(*df.columns), F.struct(F.col(epoch), -rank, -F.col(seq)))
    return rows.groupBy(key).agg(best.alias("_row")).select("_row.*")


def current_state_by_position(df: DataFrame, batch: str = "batch_seq", seq: str = "row_seq", **options) -> DataFrame:
    """current_state() for rows without ids: the key is the row's place in its batch."""
    place = F.row_number().over(Window.partitionBy(batch).orderBy(seq)) - 1
    return current_state(df.withColumn("place", place), key="place", seq=seq, **options)


def latest_pose(df: DataFrame, key: str = "entity", epoch: str = "epoch_ns", seq: str = "row_seq") -> DataFrame:
    """Each key's latest row, of equal ones the first stored."""
    return current_state(df, key, epoch, None, seq, not_before=-(1 << 62))


def latest_snapshot(df: DataFrame, batch: str = "batch_seq", key: str = "entity", ids: DataFrame | None = None) -> DataFrame:
    """The rows of the last batch; of some keys, if given."""
    last = df.agg(F.max(batch).alias("_last")).first()["_last"]
    out = df.where(F.col(batch) == F.lit(last))
    return out if ids is None else out.join(ids.select(key).distinct(), key, "left_semi").select(df.columns)


def batch_latest(df: DataFrame, batch: str = "batch_seq", key: str = "entity", epoch: str = "epoch_ns", seq: str = "row_seq") -> DataFrame:
    """For each batch and key the latest row, of equal ones the first stored."""
    best = F.max_by(F.struct(*df.columns), F.struct(F.col(epoch), -F.col(seq)))
    return df.groupBy(batch, key).agg(best.alias("_row")).select("_row.*")


def still_latest(df: DataFrame, key: str = "entity", epoch: str = "epoch_ns") -> DataFrame:
    """All rows at their key's latest epoch, ties too."""
    last = df.groupBy(key).agg(F.max(epoch).alias("_last"))
    return df.join(last, key).where(F.col(epoch) == F.col("_last")).select(df.columns)


def retain(df: DataFrame, window_start: int, key: str = "entity", epoch: str = "epoch_ns") -> DataFrame:
    """Rows from window_start on, and of older ones those at their key's latest epoch."""
    last = df.groupBy(key).agg(F.max(epoch).alias("_last"))
    return df.join(last, key).where((F.col(epoch) >= F.lit(window_start)) | (F.col(epoch) == F.col("_last"))).select(df.columns)


def window_start(df: DataFrame, pinned: Column, epoch: str = "epoch_ns") -> DataFrame:
    """The earliest epoch outside the pinned rows."""
    return df.where(~pinned).agg(F.min(epoch).alias("window_start"))


def oldest_batch(df: DataFrame, batch: str = "batch_seq", epoch: str = "epoch_ns") -> DataFrame:
    """The batch whose latest epoch is the oldest: what eviction drops first."""
    return df.groupBy(batch).agg(F.max(epoch).alias("max_epoch")).orderBy("max_epoch", batch).limit(1)


def batch_stats(df: DataFrame, batch: str = "batch_seq", epoch: str = "epoch_ns", size: Column | None = None) -> DataFrame:
    """Rows, first and last epoch and bytes of every batch."""
    size = F.lit(0) if size is None else size
    return df.groupBy(batch).agg(F.count("*").alias("n_rows"), F.min(epoch).alias("min_epoch"), F.max(epoch).alias("max_epoch"), F.sum(size).cast("bigint").alias("bytes"))


def entity_summary(df: DataFrame, key: str = "entity", epoch: str = "epoch_ns", frame: str = "parent", seq: str = "row_seq") -> DataFrame:
    """Rows, first and last epoch of every key, and its frames in the order first seen, joined by commas."""
    firsts = df.groupBy(key, frame).agg(F.min(seq).alias("_s"), F.count("*").alias("_n"), F.min(epoch).alias("_a"), F.max(epoch).alias("_b"))
    frames = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_s", F.col(frame).cast("string").alias("f")))), lambda x: x["f"]), ",")
    return firsts.groupBy(key).agg(F.sum("_n").alias("n_rows"), F.min("_a").alias("first_epoch"), F.max("_b").alias("last_epoch"), frames.alias("frames"))


def cadence(df: DataFrame, key: str = "entity", epoch: str = "epoch_ns", seq: str = "row_seq") -> DataFrame:
    """Every key's median step between its rows and its last epoch."""
    step = F.col(epoch) - F.lag(epoch).over(Window.partitionBy(key).orderBy(epoch, seq))
    return df.withColumn("_step", step).groupBy(key).agg(F.median("_step").alias("median_step"), F.max(epoch).alias("last_epoch"))


def counts_by(df: DataFrame, *keys: str) -> DataFrame:
    """(keys, n): rows by the keys' values."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def distinct_ids(df: DataFrame, key: str = "entity") -> DataFrame:
    return df.select(key).distinct()


def epoch_window(df: DataFrame, epoch: str = "epoch_ns") -> DataFrame:
    """(first_epoch, last_epoch) of all rows."""
    return df.agg(F.min(epoch).alias("first_epoch"), F.max(epoch).alias("last_epoch"))


def row_bytes(df: DataFrame) -> Column:
    """About how many bytes a row takes: its fixed columns' sizes, and the lengths of its texts, blobs and arrays."""
    fixed = {"boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "float": 4, "date": 4}
    total = F.lit(0).cast("bigint")
    for name, kind in df.dtypes:
        column = F.col(f"`{name}`")
        if kind in ("string", "binary"):
            total = total + F.coalesce(F.octet_length(column), F.lit(0))
        elif kind.startswith("array"):
            total = total + F.coalesce(F.size(column), F.lit(0)).cast("bigint") * 8
        else:
            total = total + F.lit(fixed.get(kind, 8))
    return total
