"""Quality classifier: perplexity under a Kneser-Ney model of trusted text, against quantiles of trusted documents.

The model learns from a bounded sample of the documents that are labelled good. Of all other labelled good
documents - the model hasn't seen them - each language's quantile of perplexity is taken, and a document is
good if its perplexity isn't above its language's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wherewhen.llm.common import settled, text_size, without
from wherewhen.llm.grams import scored
from wherewhen.llm.kneser_ney import KneserNey

#: A text's perplexity is taken with so many bytes more, of the trusted documents' median perplexity: a few
#: bytes alone say little.
STEADY = 40
#: Most trusted documents that the model learns from; one in two of fewer.
MAX_TRUSTED = 20_000
#: The numbers of up to so many languages go to all executors; those of more are joined by a shuffle.
MAX_BROADCAST_LANGUAGES = 100_000


def perplexities(docs: DataFrame, labels: DataFrame, order: int = 4, max_trusted: int = MAX_TRUSTED) -> DataFrame:
    """doc_id, lang, n_bytes, trained and perplexity (by byte) for every row of docs."""
    good = labels.where("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("_id")).distinct()
    learned = good.where(F.xxhash64("_id") % 2 == 0).orderBy(F.xxhash64(F.lit(1), "_id"), "_id").limit(max_trusted)
    learned = F.broadcast(learned.withColumn("train", F.lit(True)))  # max_trusted ids at most
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8").alias("model_text"))
    rows = rows.join(learned, rows["doc_id"] == learned["_id"], "left").drop("_id").withColumn("n_bytes", F.octet_length("model_text").cast("long"))
    out = scored(rows.withColumn("trained", F.coalesce("train", F.lit(False))), KneserNey(order), "doc_id long, lang string, n_bytes long, trained boolean", text_size(docs))
    return out.select("doc_id", "lang", "n_bytes", "trained", F.when(F.col("n_bytes") > 0, F.pow(F.lit(10.0), -F.col("log10p") / F.col("n_bytes"))).alias("perplexity"))


def classify(docs: DataFrame, labels: DataFrame, quantile: float = 0.99, margin: float = 1.1, order: int = 4, max_trusted: int = MAX_TRUSTED, least: int = 20) -> DataFrame:
    """One row for each row of docs: doc_id, lang, perplexity, threshold, good.

    threshold: margin times the quantile of the perplexities of the language's trusted documents that the
    model hasn't learned from - or of all languages' such documents, where the language is null or has fewer
    than least of them; where there are none at all, none. Any number of languages has its own. Null and empty texts have no perplexity and aren't
    good. Repeated rows are judged alike; a doc_id that is labelled both good and bad is trusted. Empty docs
    give an empty result; without labels every text is good.
    """
    seen = settled(perplexities(docs, labels, order, max_trusted), "perplexities")
    good = labels.where("quality = 1").select(F.col("doc_id").cast("long").alias("_id")).distinct()
    trusted = seen.where("NOT trained AND perplexity IS NOT NULL").join(good, F.col("doc_id") == F.col("_id"), "left_semi")
    rank = F.percentile("perplexity", quantile) * margin
    middle = F.median("perplexity")

    def by_language(value, name: str, of: DataFrame, to: DataFrame) -> DataFrame:
        """to with the column name: value over the language's rows of of, or where these are few over all rows."""
        by = of.where("lang IS NOT NULL").groupBy("lang").agg(value.alias(name), F.count("*").alias("_n")).where(F.col("_n") >= least).select(F.col("lang").alias("_lang"), name)
        by = settled(by, "languages")
        by = F.broadcast(by) if by.count() <= MAX_BROADCAST_LANGUAGES else by
        overall = F.lit(of.agg(value.alias("t")).first()["t"]).cast("double")
        return to.join(by, F.col("lang") == F.col("_lang"), "left").withColumn(name, F.coalesce(name, overall)).drop("_lang")

    n = F.col("n_bytes")
    steady = F.exp((n * F.log("perplexity") + STEADY * F.log(F.coalesce("_middle", F.col("perplexity")))) / (n + STEADY))
    with_middle = lambda df: by_language(middle, "_middle", trusted, df).withColumn("perplexity", steady).drop("_middle")
    seen, steadied = with_middle(seen), with_middle(trusted)
    seen = by_language(rank, "threshold", steadied, seen)
    verdict = F.coalesce(F.col("perplexity") <= F.col("threshold"), F.col("perplexity").isNotNull())
    return seen.select("doc_id", "lang", F.round("perplexity", 6).alias("perplexity"), F.round("threshold", 6).alias("threshold"), verdict.alias("good"))


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of docs, with all their columns, that classify() finds good. Rows are told apart by doc_id; those with a null doc_id stay."""
    return without(docs, classify(docs, labels, **options).where("NOT good").select("doc_id"))
