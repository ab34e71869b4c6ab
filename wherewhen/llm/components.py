"""Connected components of links that stay distributed: least labels spread along links, with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wherewhen.llm.common import settled

MAX_ROUNDS = 100


def components(links: DataFrame, files: int | None = None) -> DataFrame:
    """(id, component) for every id of links (a, b): component is the smallest id that can be reached. Null ends link nothing.

    Every round is written to the shared folder, so no lineage grows and no lost executor costs earlier rounds. files:
    how many each round's table has at most; it has 16 bytes a row.
    """
    ends = links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("a", "b")
    both = settled(ends.union(ends.select("b", "a")).distinct(), "links", files)
    labels = settled(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("component")).withColumnRenamed("a", "id"), "labels", files)
    for _ in range(MAX_ROUNDS):
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("component").alias("near"))
        moved = labels.join(near, labels["id"] == near["a"]).select("id", F.least("component", "near").alias("next"), F.col("component").alias("was"))
        up = moved.select(F.col("id").alias("next"), F.col("next").alias("jump"))
        moved = settled(moved.join(up, "next").select("id", F.least("next", "jump").alias("component"), "was"), "labels", files)
        labels = moved.select("id", "component")
        if moved.where("component <> was").isEmpty():
            return labels
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
