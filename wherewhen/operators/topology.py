"""The forest of frames that rows imply: who hangs off whom, since when.

Rows have child, parent, epoch and seq (stored order). A parent that is no child itself, or that is_root says
so of, ends a chain. An event is a row whose parent differs from the child's row before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_DEPTH = 100


def events(rows: DataFrame, child: str = "entity", parent: str = "parent", epoch: str = "epoch_ns", seq: str = "row_seq", known: DataFrame | None = None) -> DataFrame:
    """(child, parent, epoch, seq, old_parent): changes of parent in epoch order; the first sighting has no old parent.

    known: (child, parent) as of before these rows, from which the first change is told.
    """
    w = Window.partitionBy("child").orderBy("epoch", "seq")
    narrow = rows.select(F.col(child).alias("child"), F.col(parent).alias("parent"), F.col(epoch).alias("epoch"), F.col(seq).alias("seq"))
    out = narrow.withColumn("old_parent", F.lag("parent").over(w)).withColumn("_first", F.row_number().over(w) == 1)
    if known is not None:
        out = out.join(known.select("child", F.col("parent").alias("_known")), "child", "left").withColumn("old_parent", F.when(F.col("_first"), F.col("_known")).otherwise(F.col("old_parent")))
    return out.where(~F.col("parent").eqNullSafe(F.col("old_parent"))).select("child", "parent", "epoch", "seq", "old_parent")


def parent_changes(log: DataFrame) -> DataFrame:
    """Events but the first sightings."""
    return log.where("old_parent IS NOT NULL")


def tree_at(log: DataFrame, epoch: int | None = None) -> DataFrame:
    """(child, parent) at an epoch, or now: each child's latest event, of equal epochs the later logged."""
    seen = log if epoch is None else log.where(F.col("epoch") <= F.lit(epoch))
    return seen.groupBy("child").agg(F.max_by("parent", F.struct("epoch", "seq")).alias("parent"))


def parent_as_logged(log: DataFrame, asked: DataFrame) -> DataFrame:
    """(child, epoch, parent) for asked (child, epoch), by the log's own order: the child's latest edge if it is that old, else the last logged event at or before the epoch."""
    latest = log.groupBy("child").agg(F.max_by(F.struct("epoch", "parent"), F.struct("epoch", "seq")).alias("_top"))
    early = asked.join(log.select("child", F.col("epoch").alias("_e"), F.col("parent").alias("_p"), "seq"), "child").where("_e <= epoch")
    logged = early.groupBy("child", "epoch").agg(F.max_by("_p", "seq").alias("_logged"))
    out = asked.join(latest, "child", "left").join(logged, ["child", "epoch"], "left")
    return out.select("child", "epoch", F.when(F.col("_top.epoch") <= F.col("epoch"), F.col("_top.parent")).otherwise(F.col("_logged")).alias("parent"))


def spans(log: DataFrame) -> DataFrame:
    """(child, parent, since, until): how long each edge holds; of events at one epoch the later logged."""
    last = log.groupBy("child", "epoch").agg(F.max_by("parent", "seq").alias("parent"))
    return last.select("child", "parent", F.col("epoch").alias("since"), F.lead("epoch").over(Window.partitionBy("child").orderBy("epoch")).alias("until"))


def ancestry(asked: DataFrame, edges: DataFrame, is_root, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(child, epoch, depth, ancestor) of every step from child up at its epoch, depth 0 being the child.

    edges: spans(). Chains end at a root or where no edge holds. One join a level, of the frontier alone; a
    chain still open after max_depth levels is a cycle.
    """
    from wherewhen.plans.tables import settled

    edges = settled(edges.select(F.col("child").alias("_c"), F.col("parent").alias("_p"), F.col("since").alias("_since"), F.col("until").alias("_until")), "edges")
    out = step = asked.select("child", "epoch", F.lit(0).alias("depth"), F.col("child").alias("ancestor"))
    for depth in range(1, max_depth + 1):
        open_ = step.where(~is_root(F.col("ancestor")))
        hit = (F.col("ancestor") == F.col("_c")) & (F.col("epoch") >= F.col("_since")) & (F.col("_until").isNull() | (F.col("epoch") < F.col("_until")))
        step = settled(open_.join(edges, hit).select("child", "epoch", F.lit(depth).alias("depth"), F.col("_p").alias("ancestor")), "ancestry")
        if step.isEmpty():
            return out
        out = out.unionByName(step)
    raise ValueError(f"a chain of over {max_depth} steps: a cycle")


def cycle_members(tree: DataFrame) -> DataFrame:
    """(child) of every node on or below a cycle of tree (child, parent): pointer doubling, so rounds grow with the logarithm of the depth."""
    from wherewhen.plans.tables import settled

    hop = settled(tree.select("child", F.col("parent").alias("top")), "hops")
    n = hop.count()
    for _ in range(max(1, n.bit_length()) + 1):
        up = hop.select(F.col("child").alias("top"), F.col("top").alias("_next"))
        hop = settled(hop.join(up, "top").select("child", F.col("_next").alias("top")), "hops")
        if hop.isEmpty():
            break
    return hop.select("child")


def require_acyclic(tree: DataFrame) -> DataFrame:
    """tree, or ValueError if it has a cycle."""
    if not cycle_members(tree).isEmpty():
        raise ValueError("the edges have a cycle")
    return tree


def trim(log: DataFrame, window_start: int) -> DataFrame:
    """Events from window_start on, and each child's latest earlier one, of equal epochs the later logged."""
    early = F.col("epoch") < F.lit(window_start)
    rank = F.row_number().over(Window.partitionBy("child", early).orderBy(F.desc("epoch"), F.desc("seq")))
    return log.withColumn("_rank", F.when(early, rank).otherwise(F.lit(1))).where("_rank = 1").select(log.columns)


def merge_log(log: DataFrame, more: DataFrame) -> DataFrame:
    """The events of more that log lacks, each once, with seq going on from log's; to be appended. Idempotent."""
    key = ["child", "parent", "epoch"]
    fresh = more.groupBy(*key).agg(F.min("seq").alias("_s")).join(log.select(*key).distinct(), key, "left_anti")
    base = log.agg(F.coalesce(F.max("seq") + 1, F.lit(0)).alias("b")).first()["b"]
    return fresh.select(*key, (F.col("_s") + F.lit(base)).alias("seq"))


def roots(tree: DataFrame) -> DataFrame:
    """(root): parents that are no children."""
    return tree.select(F.col("parent").alias("root")).distinct().join(tree.select(F.col("child").alias("root")), "root", "left_anti")


def depth_by_root(tree: DataFrame, is_root) -> DataFrame:
    """(root, n_children, max_depth): for every end of a chain the nodes below it and the longest way up."""
    asked = tree.select("child", F.lit(0).cast("bigint").alias("epoch"))
    edges = tree.select("child", "parent", F.lit(0).cast("bigint").alias("since"), F.lit(None).cast("bigint").alias("until"))
    up = ancestry(asked, edges, is_root)
    top = up.groupBy("child").agg(F.max_by("ancestor", "depth").alias("root"), F.max("depth").alias("depth"))
    return top.groupBy("root").agg(F.count("*").alias("n_children"), F.max("depth").alias("max_depth"))


def refers_to_entities(rows: DataFrame, is_root, frame: str = "parent") -> bool:
    """Whether any row's frame is an entity."""
    return not rows.where(~is_root(F.col(frame))).isEmpty()


def scene(rows: DataFrame, log: DataFrame, epoch: int, key: str = "entity", at: str = "epoch_ns", seq: str = "row_seq") -> DataFrame:
    """The live tree at an epoch with every child's row then - its latest, or its first where all are later."""
    tree = tree_at(log, epoch)
    order = F.struct(F.when(F.col(at) <= F.lit(epoch), 1).otherwise(0), F.when(F.col(at) <= F.lit(epoch), F.col(at)).otherwise(-F.col(at)), -F.col(seq))
    row = rows.groupBy(F.col(key).alias("child")).agg(F.max_by(F.struct(*rows.columns), order).alias("row"))
    return row.join(tree, "child", "left")


def is_any(*values) -> object:
    """A test for a column that is one of some roots."""
    return lambda c: c.isin(*values)


def always(column: Column) -> Column:
    return F.lit(True)
