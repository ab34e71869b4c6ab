"""Quality rules by weak supervision, in DataFrame functions only.

Each rule looks at counts of the text and votes good (1), bad (-1) or abstains (0). A document is good or has one of
several kinds of fault, one for each rule to begin with. Expectation-maximisation on the votes of all documents
estimates how common good documents and each kind of fault are and how often each rule votes bad on them; a document's
verdict is its posterior probability of being good. One class for all bad documents would not do: faults differ, and
rules that agree on a rare one would be outvoted by those that look for others.

EM sees only the number of documents for each combination of votes, of which there are 3 ** len(RULES) at most,
whatever the input's size. The verdicts of the combinations come back as a table of that size, joined by code.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wherewhen.llm.common import settled
from wherewhen.llm.textops import WORD_PATTERN

WINDOW = 8


def let(value: Column, then) -> Column:
    """then(value), with value computed once for each row."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _repeat_words(words: Column) -> Column:
    """Words inside windows of WINDOW words that occur twice or more in the text, by sorting window hashes."""

    def covered(hashes: Column) -> Column:
        def starts(s: Column) -> Column:
            def same(k: Column, by: int) -> Column:
                return F.get(s, k + by)["h"].eqNullSafe(F.get(s, k)["h"])

            twice = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda k: same(k, -1) | same(k, 1))
            at = F.sort_array(F.transform(twice, lambda k: F.get(s, k)["i"]))
            zero = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
            return F.aggregate(at, zero, lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n"), p.alias("last")))["n"]

        ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(ordered, starts))

    hashes = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(w, i, WINDOW)))
    return let(words, lambda w: F.when(F.size(w) <= WINDOW, F.lit(0)).otherwise(let(hashes(w), covered)))


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id with the counts that the rules look at, for every row of docs and its whole text (null: no words)."""
    body = F.coalesce(F.col(text), F.lit(""))
    base = docs.select(F.col("doc_id"), body.alias("_body"), F.regexp_extract_all(body, F.lit(WORD_PATTERN), F.lit(0)).alias("_words"))
    words = F.col("_words")
    lines = F.filter(F.split(F.col("_body"), "\n", -1), lambda x: x.rlike(WORD_PATTERN))
    return base.select(
        "doc_id",
        F.size(words).cast("long").alias("n_words"),
        F.char_length(F.array_join(words, "")).cast("long").alias("word_chars"),
        F.regexp_count(F.col("_body"), F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        _repeat_words(words).cast("long").alias("n_repeat_words"),
        F.regexp_count(F.col("_body"), F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        F.regexp_count(F.col("_body"), F.lit("!")).cast("long").alias("n_shouts"),
        F.regexp_count(F.col("_body"), F.lit("\n")).cast("long").alias("n_breaks"),
        F.regexp_count(F.col("_body"), F.lit(r"\p{L}")).cast("long").alias("n_letters"),
        F.size(F.array_distinct(words)).cast("long").alias("n_distinct"),
        let(words, lambda w: F.size(F.filter(w, lambda x, i: x == F.get(w, i + 1)))).cast("long").alias("n_stutter"),
    )


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def rules() -> dict[str, Column]:
    """The votes by name, over the columns of features()."""
    n, per = F.col("n_words"), lambda c, x: F.col(c) * 100 > x * F.col("n_words")
    return {
        "symbols": _vote(per("n_symbols", 10), ~per("n_symbols", 2)),
        "repeats": _vote(per("n_repeat_words", 20), F.col("n_repeat_words") == 0),
        "same_lines": _vote((F.col("n_dup_lines") >= 3) & (F.col("n_dup_lines") * 10 > (F.col("n_breaks") + 1) * 3), F.col("n_dup_lines") == 0),
        "word_length": _vote((F.col("word_chars") < 2 * n) | (F.col("word_chars") > 15 * n), (F.col("word_chars") >= 3 * n) & (F.col("word_chars") <= 10 * n)),
        "capitals": _vote(F.col("n_upper") * 10 > F.col("word_chars") * 4, F.col("n_upper") * 10 <= F.col("word_chars")),
        "shouts": _vote(per("n_shouts", 25), ~per("n_shouts", 3)),
        "letters": _vote(F.col("n_letters") * 10 < F.col("word_chars") * 9, F.col("n_letters") * 100 >= F.col("word_chars") * 94),
        "variety": _vote((n >= 30) & (F.col("n_distinct") * 100 < F.when(n < 1000, 30).otherwise(12) * n), F.col("n_distinct") * 100 >= 40 * n),
        "stutter": _vote(per("n_stutter", 20), ~per("n_stutter", 8)),
        "length": _vote(n < 10, n >= 30),
    }


#: Before any data a rule is taken to vote bad on so many of the good documents, of those with the fault that it looks
#: for, and of those with another.
ON_GOOD, ON_FAULT, ON_OTHER = 0.03, 0.9, 0.15
#: This counts as if seen in such a share of the votes of a class. It is what tells a rule that fails good documents
#: now and then from a fault that one rule alone sees: the data can't.
PRIOR_SHARE = 0.25
#: The share of good documents before any data.
GOOD_SHARE = 0.8


@dataclass
class Classes:
    """Good documents, class 0, and those of each kind of fault: their shares, and how often each rule that votes on them votes bad."""

    share: np.ndarray
    bad: np.ndarray

    def chances(self, votes: np.ndarray) -> np.ndarray:
        """Of each class, for rows of votes; abstentions say nothing."""
        logs = np.log(self.share) + (votes < 0) @ np.log(self.bad).T + (votes > 0) @ np.log1p(-self.bad).T
        raw = np.exp(logs - logs.max(axis=1, keepdims=True))
        return raw / raw.sum(axis=1, keepdims=True)


def fit(votes: np.ndarray, count: np.ndarray, steps: int = 60, prior_share: float = PRIOR_SHARE) -> Classes:
    """The classes by EM on rows of votes and how many documents have them; without any the prior ones."""
    n, count = votes.shape[1], count.astype(np.float64)
    prior = np.vstack([np.full((1, n), ON_GOOD), np.full((n, n), ON_OTHER) + np.eye(n) * (ON_FAULT - ON_OTHER)])
    found = Classes(np.array([GOOD_SHARE] + [(1 - GOOD_SHARE) / n] * n), prior)
    for _ in range(steps if len(votes) else 0):
        held = found.chances(votes) * count[:, None]
        size = held.sum(axis=0)
        weight = (prior_share * size + 1)[:, None]
        rate = (held.T @ (votes < 0) + prior * weight) / (held.T @ (votes != 0) + weight)
        found = Classes((size + 1) / (count.sum() + n + 1), np.clip(rate, 1e-4, 1 - 1e-4))
    return found


def quality_rules(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row for each row of docs: the counts, base_failed, the posterior p_good and the verdict kept.

    base_failed: fewer than 20 words, or over 30 of 100 words in repeated 8-word windows; such documents are
    not kept. Windows are told apart by 64-bit hashes. Null texts have no words and so fail. An empty table gives an
    empty result. Repeated rows are judged alike, and each counts; columns other than doc_id and text are ignored.
    """
    votes = rules()
    code = sum(((v + 1) * 3**j for j, v in enumerate(votes.values())), F.lit(0))
    seen = settled(features(docs).withColumn("_code", code.cast("int")), "quality-rules")
    counted = seen.groupBy("_code").count().orderBy("_code").collect()  # 3 ** len(votes) rows at most
    cast = np.array([r["_code"] for r in counted], dtype=np.int64)[:, None] // 3 ** np.arange(len(votes)) % 3 - 1
    good = fit(cast, np.array([r["count"] for r in counted])).chances(cast)[:, 0] if counted else []
    listed = " ".join(f"{r['_code']}:{float(p)!r}" for r, p in zip(counted, good, strict=True))
    pair = F.split("_x", ":")
    said = docs.sparkSession.range(1).select(F.explode(F.split(F.lit(listed), " ")).alias("_x")).where("_x <> ''").select(pair[0].cast("int").alias("_code"), pair[1].cast("double").alias("_p"))
    judged = seen.join(F.broadcast(said), "_code")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & (F.col("_p") >= threshold)).alias("kept"), F.round("_p", 6).alias("p_good"))
