"""As-of joins: the latest right row at or before each left row, of equal ones the first stored."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _firsts(right: DataFrame, on: str, epoch: str, seq: str, values: list[str]) -> DataFrame:
    """One row for each key and epoch, the first stored, with the values in a struct."""
    return right.groupBy(F.col(on).alias("_on"), F.col(epoch).alias("_epoch")).agg(F.min_by(F.struct(*values), F.col(seq)).alias("_value"))


def asof_join(left: DataFrame, right: DataFrame, left_on: str, right_on: str, left_epoch: str, right_epoch: str, values: dict[str, str], seq: str = "row_seq", bucket_ns: int | None = None, unique: bool = False) -> DataFrame:
    """left with columns values (new name by right column), null where no right row is early enough.

    Both sides are put in one stream by key and epoch; the last right row is carried forward - one shuffle of
    each side, no pairs. With bucket_ns, a key's stream is cut into time buckets that are worked apart, and
    only every bucket's last right row is carried on from bucket to bucket: a hot key then spreads over tasks.
    unique: right has one row for each key and epoch, so none need be chosen.
    """
    named = [F.col(c).alias(n) for c, n in values.items()]
    if unique:
        firsts = right.select(F.col(right_on).alias("_on"), F.col(right_epoch).alias("_epoch"), F.struct(*named).alias("_value"))
    else:
        firsts = _firsts(right.select("*", *named), right_on, right_epoch, seq, list(values.values()))
    bucket = (lambda e: F.floor(e / bucket_ns)) if bucket_ns else (lambda e: F.lit(0).cast("bigint"))
    rows = left.select(F.col(left_on).alias("_on"), F.col(left_epoch).alias("_epoch"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_left"))
    both = rows.unionByName(firsts.withColumn("_side", F.lit(0)), allowMissingColumns=True).withColumn("_bucket", bucket(F.col("_epoch")))
    stream = Window.partitionBy("_on", "_bucket").orderBy("_epoch", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("_found", F.last("_value", ignorenulls=True).over(stream)).where("_side = 1")
    if bucket_ns:
        ends = firsts.withColumn("_bucket", bucket(F.col("_epoch"))).groupBy("_on", "_bucket").agg(F.max_by("_value", "_epoch").alias("_end"))
        needed = found.select("_on", "_bucket").distinct().join(ends, ["_on", "_bucket"], "full")
        before = Window.partitionBy("_on").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
        carry = needed.withColumn("_carry", F.last("_end", ignorenulls=True).over(before)).select("_on", "_bucket", "_carry")
        found = found.join(carry, ["_on", "_bucket"], "left").withColumn("_found", F.coalesce("_found", "_carry"))
    return found.select("_left.*", *[F.col("_found")[n].alias(n) for n in values.values()])


def asof_intervals(left: DataFrame, right: DataFrame, left_on: str, right_on: str, left_epoch: str, right_epoch: str, values: dict[str, str], seq: str = "row_seq") -> DataFrame:
    """The same by validity intervals: an equi-join on the key with a range condition. Good where keys have few right rows."""
    firsts = _firsts(right.select("*", *[F.col(c).alias(n) for c, n in values.items()]), right_on, right_epoch, seq, list(values.values()))
    spans = firsts.withColumn("_until", F.lead("_epoch").over(Window.partitionBy("_on").orderBy("_epoch")))
    hit = (left[left_on] == spans["_on"]) & (left[left_epoch] >= spans["_epoch"]) & (spans["_until"].isNull() | (left[left_epoch] < spans["_until"]))
    return left.join(spans, hit, "left").select(*[left[c] for c in left.columns], *[spans["_value"][n].alias(n) for n in values.values()])


def asof_or_first(left: DataFrame, right: DataFrame, left_on: str, right_on: str, left_epoch: str, right_epoch: str, values: dict[str, str], seq: str = "row_seq") -> DataFrame:
    """As asof_join(), but the key's first right row where none is early enough. A row that is found counts, whatever nulls it holds."""
    marked = right.withColumn("_there", F.lit(True))
    firsts = right.groupBy(F.col(right_on).alias("_first_on")).agg(F.min_by(F.struct(*[F.col(c).alias(n) for c, n in values.items()]), F.struct(right_epoch, seq)).alias("_first"))
    found = asof_join(left, marked, left_on, right_on, left_epoch, right_epoch, values | {"_there": "_hit"}, seq)
    out = found.join(firsts, found[left_on] == firsts["_first_on"], "left")
    return out.select(*left.columns, *[F.when(F.col("_hit"), F.col(n)).otherwise(F.col("_first")[n]).alias(n) for n in values.values()])


def count_at_or_before(left: DataFrame, right: DataFrame, left_on: str, right_on: str, left_epoch: str, right_epoch: str) -> DataFrame:
    """left with n_before: how many right rows of its key are at or before it."""
    rows = left.select(F.col(left_on).alias("_on"), F.col(left_epoch).alias("_epoch"), F.lit(1).alias("_side"), F.lit(0).alias("_n"), F.struct(*left.columns).alias("_left"))
    sums = right.groupBy(F.col(right_on).alias("_on"), F.col(right_epoch).alias("_epoch")).agg(F.count("*").cast("int").alias("_n")).withColumn("_side", F.lit(0))
    stream = Window.partitionBy("_on").orderBy("_epoch", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.unionByName(sums, allowMissingColumns=True).withColumn("n_before", F.sum("_n").over(stream)).where("_side = 1").select("_left.*", "n_before")
