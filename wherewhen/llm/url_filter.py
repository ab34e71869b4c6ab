"""URL filter: a rule list, and gradient-boosted trees on lexical features for the urls no rule fits.

The trees learn from the urls that a rule does label - a bounded sample of them, the smallest hashes - and
are grown on the driver from feature histograms. They come back as column expressions, so all urls are scored
by Catalyst without Python.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wherewhen.llm.common import settled

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (verdict, host, path): a rule fits the host and its subdomains where the url's path starts with path.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null and for urls without ://."""
    whole = F.coalesce(url, F.lit(""))
    cut = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return F.translate(F.regexp_extract(whole, cut, 1), _UPPER, _LOWER), F.regexp_extract(whole, cut, 2)


def fitting(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; null where none does."""
    rule = verdict = None
    for said, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, said) if verdict is None else verdict.when(fits, said)
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, verdict)


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """Features of the text of a url alone; all doubles, none null."""
    whole = F.coalesce(url, F.lit(""))
    n = F.greatest(F.char_length(whole), F.lit(1))
    chars = F.split(host, "")
    counts = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)) / F.size(chars))
    entropy = F.aggregate(counts, F.lit(0.0), lambda a, p: a - p * F.log2(p))
    found = {
        "length": F.char_length(whole),
        "host_length": F.char_length(host),
        "path_length": F.char_length(path),
        "depth": F.regexp_count(path, F.lit("/[^/]")),
        "labels": F.regexp_count(host, F.lit(r"[^.]+")),
        "digit_ratio": F.regexp_count(whole, F.lit("[0-9]")) / n,
        "hyphens": F.regexp_count(host, F.lit("-")),
        "entropy": F.round(entropy, 9),
        "parameters": F.when(F.instr(whole, "?") > 0, F.regexp_count(F.regexp_extract(whole, r"(?s)\?([^#]*)", 1), F.lit("[^&]+"))).otherwise(0),
        "secure": whole.startswith("https").cast("int"),
    }
    return {k: F.coalesce(v.cast("double"), F.lit(0.0)) for k, v in found.items()}


def suffix(host: Column) -> Column:
    """The last label of the host."""
    return F.regexp_extract(host, r"([^.]*)$", 1)


@dataclass
class Tree:
    feature: int = -1
    cut: float = 0.0
    left: Tree | None = None
    right: Tree | None = None
    value: float = 0.0

    def expression(self, columns: list[Column]) -> Column:
        if self.feature < 0:
            return F.lit(self.value)
        return F.when(columns[self.feature] <= self.cut, self.left.expression(columns)).otherwise(self.right.expression(columns))

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.feature < 0:
            return np.full(len(x), self.value)
        return np.where(x[:, self.feature] <= self.cut, self.left.predict(x), self.right.predict(x))


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 30, depth: int = 3, rate: float = 0.3, least: float = 5.0) -> tuple[float, list[Tree]]:
    """(bias, trees) for the logistic loss; splits are searched over 64 quantiles of each feature."""
    if not len(y):
        return 0.0, []
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, 65)[1:-1], method="lower")) for j in range(x.shape[1])]
    bins = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    p0 = (y.sum() + 1) / (len(y) + 2)
    bias, trees = math.log(p0 / (1 - p0)), []
    score = np.full(len(y), bias)

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, left: int) -> Tree:
        sg, sh = g[rows].sum(), h[rows].sum()
        leaf = Tree(value=round(float(rate * sg / (sh + 1)), 9))
        if not left or len(rows) < 2 * least:
            return leaf
        best = (1e-6, -1, 0)
        for j, c in enumerate(cuts):
            if len(c) == 0:
                continue
            gs = np.cumsum(np.bincount(bins[rows, j], weights=g[rows], minlength=len(c) + 1))[:-1]
            hs = np.cumsum(np.bincount(bins[rows, j], weights=h[rows], minlength=len(c) + 1))[:-1]
            ns = np.cumsum(np.bincount(bins[rows, j], minlength=len(c) + 1))[:-1]
            gain = gs**2 / (hs + 1) + (sg - gs) ** 2 / (sh - hs + 1) - sg**2 / (sh + 1)
            gain[(ns < least) | (len(rows) - ns < least)] = -1
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (float(gain[k]), j, k)
        if best[1] < 0:
            return leaf
        _, j, k = best
        low = bins[rows, j] <= k
        return Tree(j, float(cuts[j][k]), grow(rows[low], g, h, left - 1), grow(rows[~low], g, h, left - 1))

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        tree = grow(np.arange(len(y)), y - p, p * (1 - p), depth)
        trees.append(tree)
        score = score + tree.predict(x)
    return bias, trees


#: Rates of up to so many suffixes go to all executors; those of more are joined by a shuffle.
MAX_BROADCAST_SUFFIXES = 100_000


def suffix_rates(seen: DataFrame) -> tuple[float, DataFrame]:
    """(the share of blocked urls, (suffix, rate) of every suffix) over all labelled urls; a suffix' rate is drawn to the share as if by ten urls."""
    blocked = (F.col("said") == "block").cast("long")
    by = settled(seen.where(F.col("said").isNotNull()).groupBy(suffix(F.col("host")).alias("_suffix")).agg(F.count("*").alias("n"), F.sum(blocked).alias("y")), "suffixes")
    all_ = by.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("y")).first()
    prior = (all_["y"] + 1) / (all_["n"] + 2)
    rates = by.select("_suffix", F.round((F.col("y") + 10 * prior) / (F.col("n") + 10), 9).alias("f_suffix"))
    return prior, F.broadcast(rates) if by.count() <= MAX_BROADCAST_SUFFIXES else rates


def training_sample(featured: DataFrame, names: list[str], most: int) -> tuple[np.ndarray, np.ndarray]:
    """(features, blocked or not) of the most labelled urls with the smallest hashes."""
    found = featured.where(F.col("said").isNotNull()).select(*names, (F.col("said") == "block").cast("double").alias("y"), F.xxhash64("url").alias("h"), "url").orderBy("h", "url").limit(most).drop("h", "url").toPandas()
    return found[names].to_numpy(dtype=np.float64), found["y"].to_numpy(dtype=np.float64)


def url_filter(pages: DataFrame, rules=RULES, max_training: int = 50_000) -> DataFrame:
    """One row for each row of pages: page_id, host, path, rule, verdict and p_block.

    verdict is the longest fitting rule's, else that of the trees (block where p_block > 0.5; p_block is null
    where a rule decides). The trees learn from the max_training labelled urls with the smallest hashes; the rates
    of suffixes come from all labelled urls. Null urls and urls without :// have an empty host and path and go to
    the trees. With no labelled url at all every remaining url is allowed. Repeated rows are judged alike; other
    columns are ignored.
    """
    host, path = parts(F.col("url"))
    seen = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, verdict = fitting(F.col("host"), F.col("path"), rules)
    seen = seen.select("*", rule.alias("rule"), verdict.alias("said"))
    prior, rates = suffix_rates(seen)
    columns = lexical(F.col("url"), F.col("host"), F.col("path"))
    names = [f"f_{k}" for k in columns] + ["f_suffix"]
    rated = seen.withColumn("_own", suffix(F.col("host"))).join(rates, F.col("_own") == F.col("_suffix"), "left")
    featured = rated.select("page_id", "url", "host", "path", "rule", "said", *[c.alias(f"f_{k}") for k, c in columns.items()], F.coalesce("f_suffix", F.lit(float(prior))).alias("f_suffix"))
    x, y = training_sample(featured, names, max_training)
    bias, trees = boost(x, y)
    score = F.lit(bias if len(y) else -1.0)
    for tree in trees:
        score = score + tree.expression([F.col(c) for c in names])
    p = F.when(F.col("said").isNull(), 1 / (1 + F.exp(-score)))
    return featured.withColumn("p_block", p).select("page_id", "host", "path", "rule", F.coalesce("said", F.when(F.col("p_block") > 0.5, "block").otherwise("allow")).alias("verdict"), F.round("p_block", 6).alias("p_block"))
