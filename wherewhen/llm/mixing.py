"""Mixing sources to target weights by temperature.

A source's weight is its share of all tokens to the power of an exponent between 0 (all alike) and 1 (as they
are), normalised. The largest exponent that reaches a target entropy is found by bisection; if some source
would then be repeated too often, the exponent is raised, again by bisection, to the smallest that keeps the
limit. Weights times the token budget are the sources' budgets. They are met by reading each source's blocks
- groups of its documents by hash - in a new permutation for every epoch, whole epochs first, then blocks of
one more epoch until the budget is full.

Only block sums are ordered, never documents: a source of any size has about one block for 2**20 tokens, 256
at least, and a document's copies follow from its block.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wherewhen.llm.common import driver_table, settled
from wherewhen.llm.textops import WORD_PATTERN

BLOCK_TOKENS, LEAST_BLOCKS = 1 << 20, 256
#: The driver works on the sources' sums of up to so many sources; sums of more stay where they are, and each step of a
#: bisection is an aggregation over them.
LOCAL_SOURCES = 50_000
#: Up to so many readings of blocks (some 100 bytes each) go to all executors; more are joined by a shuffle.
MAX_BROADCAST_BLOCKS = 300_000
STEPS = 60


def powered(tokens: list[int], exponent: float) -> list[float]:
    """Normalised weights: shares to the power of exponent; a source without tokens has none."""
    total = sum(tokens)
    raised = [(c / total) ** exponent if c else 0.0 for c in tokens]
    return [x / sum(raised) for x in raised]


def entropy(weights: list[float]) -> float:
    return -sum(w * math.log(w) for w in weights if w > 0)


def repeats(tokens: list[int], weights: list[float], budget: float) -> float:
    """How often the most repeated source is read."""
    return max((w * budget / c for c, w in zip(tokens, weights, strict=True) if c), default=0.0)


def search(present: int, least: float, budget: float, at: Callable[[float], tuple[float, float]], entropy_ratio: float, max_repeats: float, total: float) -> float:
    """The exponent for a target entropy (as a share of the largest possible) under a repetition limit.

    present: how many sources have tokens; least: the tokens of the smallest, which is the most repeated; at: for an
    exponent the sum of the raised shares and the entropy of the weights.
    """
    if present < 2:
        return 1.0
    goal = entropy_ratio * math.log(present)

    def bisect(holds_low) -> tuple[float, float]:
        low, high = 0.0, 1.0
        for _ in range(STEPS):
            mid = (low + high) / 2
            low, high = (mid, high) if holds_low(mid) else (low, mid)
        return low, high

    exponent = 1.0 if at(1.0)[1] >= goal else bisect(lambda a: at(a)[1] >= goal)[0]
    fits = lambda a: (least / total) ** a / at(a)[0] * budget / least <= max_repeats
    if fits(exponent) or not fits(1.0):
        return exponent if fits(exponent) else 1.0
    return bisect(lambda a: a <= exponent or not fits(a))[1]


def exponent_for(tokens: list[int], budget: float, entropy_ratio: float, max_repeats: float) -> float:
    """search() over a list of the sources' tokens."""
    present = [c for c in tokens if c]
    total = sum(present)

    def at(a: float) -> tuple[float, float]:
        return sum((c / total) ** a for c in present), entropy(powered(present, a))

    return search(len(present), min(present, default=0), budget, at, entropy_ratio, max_repeats, total)


def shares_of(sums: DataFrame, budget_tokens: int | None, entropy_ratio: float, max_repeats: float, local: int = LOCAL_SOURCES) -> DataFrame:
    """(source, tokens, weight, budget) of every source of sums (source, tokens)."""
    spark = sums.sparkSession
    few = sums.limit(local + 1).collect()
    kind = "source string, tokens long, weight double, budget double"
    if len(few) <= local:
        rows = sorted(((r["source"], int(r["tokens"])) for r in few), key=lambda r: (r[0] is not None, r[0] or ""))
        tokens = [t for _, t in rows]
        budget = float(sum(tokens) if budget_tokens is None else budget_tokens)
        weights = powered(tokens, exponent_for(tokens, budget, entropy_ratio, max_repeats)) if sum(tokens) else [0.0] * len(tokens)
        return F.broadcast(driver_table(spark, {"source": [s for s, _ in rows], "tokens": tokens, "weight": weights, "budget": [w * budget for w in weights]}, kind))
    sums = settled(sums, "sources")
    found = sums.where("tokens > 0").agg(F.count("*").alias("n"), F.min("tokens").alias("least"), F.sum("tokens").alias("total")).first()
    total = float(found["total"] or 0)
    budget = total if budget_tokens is None else float(budget_tokens)
    if not total:
        return sums.select("source", "tokens", F.lit(0.0).alias("weight"), F.lit(0.0).alias("budget"))
    share = F.col("tokens") / F.lit(total)

    def at(a: float) -> tuple[float, float]:
        r = sums.where("tokens > 0").agg(F.sum(F.pow(share, F.lit(a))).alias("z"), F.sum(F.pow(share, F.lit(a)) * F.log(share)).alias("s")).first()
        return r["z"], math.log(r["z"]) - a * r["s"] / r["z"]

    a = search(found["n"], found["least"], budget, at, entropy_ratio, max_repeats, total)
    weight = F.when(F.col("tokens") > 0, F.pow(share, F.lit(a)) / F.lit(at(a)[0])).otherwise(0.0)
    return sums.select("source", "tokens", weight.alias("weight"), (weight * F.lit(budget)).alias("budget"))


def _hash(seed: int, *columns: Column) -> Column:
    """48 bits of an MD5, as a long; the same in any SQL engine that has MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws("/", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("~")) for c in columns])), 1, 12), 16, 10).cast("long")


def plan(blocks: DataFrame, shares: DataFrame, seed: int) -> DataFrame:
    """(source, block, epoch, weight, position) of every block that is read, from (source, block, block_tokens) and shares_of()."""
    times = F.ceil(F.col("budget") / F.col("tokens")).cast("int") - 1
    each = blocks.join(shares, blocks["source"].eqNullSafe(shares["source"])).drop(shares["source"]).where("tokens > 0").withColumn("epoch", F.explode(F.when(times >= 0, F.sequence(F.lit(0), times)).otherwise(F.array().cast("array<int>"))))
    shuffled = Window.partitionBy("source", "epoch").orderBy(_hash(seed, F.col("source"), F.col("epoch"), F.col("block")), "block").rowsBetween(Window.unboundedPreceding, -1)
    placed = each.withColumn("start", F.col("epoch") * F.col("tokens") + F.coalesce(F.sum("block_tokens").over(shuffled), F.lit(0)))
    # a block is read if at least half of it is inside the budget
    read = placed.where(F.col("start") + F.col("block_tokens") / 2 <= F.col("budget"))
    return read.select("source", "block", "epoch", "weight", (F.col("start") / F.col("budget")).alias("position"))


def mix_sources(docs: DataFrame, budget_tokens: int | None = None, entropy_ratio: float = 0.95, max_repeats: float = 4.0, seed: int = 7, keep: bool = False, local: int = LOCAL_SOURCES) -> DataFrame:
    """One row for each reading of a document: doc_id, source, n_tokens, block, epoch, weight, position.

    position, from 0 to 1, is where in the run over its source's budget the document's block stands: sorting
    by it interleaves the sources. A token is a word. budget_tokens: all tokens of docs unless given. Null
    sources are one source of their own; null and empty texts have no tokens and go with their block. Repeated
    rows are read as often as the row itself. Without any token nothing is read. With keep, the rows are those
    of docs itself (all columns), as often as they are read. Up to local sources the bisection runs on the driver,
    over more as aggregations; the result is the same but for rounding in the weights' last digits.
    """
    n_tokens = F.coalesce(F.regexp_count("text", F.lit(WORD_PATTERN)), F.lit(0)).cast("long")
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]) if keep else F.struct(F.col("doc_id").alias("doc_id"))
    rows = docs.select(own.alias("_row"), F.col("source").cast("string").alias("source"), n_tokens.alias("n_tokens"), _hash(seed, F.col("doc_id")).alias("_h"))
    sums = rows.groupBy("source").agg(F.sum("n_tokens").alias("tokens"))
    # sources of more than LEAST_BLOCKS blocks: at most one for each 2**28 tokens of the input
    large = sums.select(F.col("source").alias("_source"), F.ceil(F.col("tokens") / BLOCK_TOKENS).cast("long").alias("_n")).where(F.col("_n") > LEAST_BLOCKS)
    rows = rows.join(F.broadcast(large), rows["source"].eqNullSafe(F.col("_source")), "left").withColumn("block", F.col("_h") % F.coalesce("_n", F.lit(LEAST_BLOCKS).cast("long"))).drop("_h", "_source", "_n")
    blocks = settled(rows.groupBy("source", "block").agg(F.sum("n_tokens").alias("block_tokens")), "blocks")
    shares = shares_of(blocks.groupBy("source").agg(F.sum("block_tokens").alias("tokens")), budget_tokens, entropy_ratio, max_repeats, local)
    read = plan(blocks, shares, seed).withColumnsRenamed({"source": "_s", "block": "_b"})
    # readings are at most the blocks times the epochs begun
    most = blocks.groupBy("source").agg(F.count("*").alias("n")).join(shares.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).where("tokens > 0")
    if (most.agg(F.sum(F.col("n") * F.ceil(F.col("budget") / F.col("tokens"))).alias("m")).first()["m"] or 0) <= MAX_BROADCAST_BLOCKS:
        read = F.broadcast(read)
    out = rows.join(read, rows["source"].eqNullSafe(read["_s"]) & (rows["block"] == read["_b"]))
    if keep:
        return out.select("_row.*")
    return out.select("_row.doc_id", "source", "n_tokens", "block", "epoch", F.round("weight", 9).alias("weight"), F.round("position", 9).alias("position"))
