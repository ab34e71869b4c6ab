import math
import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from wherewhen.llm import quality_classifier
from wherewhen.llm.kneser_ney import discounts
from wherewhen.llm.quality_classifier import classify, keep_good, perplexities


class BruteKneserNey:
    """The definition, with dictionaries."""

    def __init__(self, order, texts):
        self.order, counts = order, Counter()
        for t in texts:
            t = b"\n" * (order - 1) + t
            counts.update(t[i - order + 1 : i + 1] for i in range(order - 1, len(t)))
        self.levels = {}
        for k in range(order, 0, -1):
            d = discounts([sum(c == x for c in counts.values()) for x in (1, 2, 3, 4)])
            total, took = Counter(), defaultdict(float)
            for g, c in counts.items():
                total[g[:-1]] += c
                took[g[:-1]] += d[min(c, 3)]
            self.levels[k] = counts, total, took, d
            counts = Counter(g[1:] for g in counts)

    def log10p(self, text):
        t, out = b"\n" * (self.order - 1) + text, 0.0
        for i in range(self.order - 1, len(t)):
            p = 1 / 256
            for k in range(1, self.order + 1):
                counts, total, took, d = self.levels[k]
                g = t[i - k + 1 : i + 1]
                if total[g[:-1]]:
                    c = counts[g]
                    p = (c - d[min(c, 3)] + took[g[:-1]] * p) / total[g[:-1]]
            out += math.log10(p)
        return out


def test_matches_the_definition(spark):
    rnd = random.Random(9)
    rows = [(i, " ".join(rnd.choice(["the", "of", "Ab", "é", "zz!"]) for _ in range(rnd.randint(1, 30))), "en", f"x{i}") for i in range(80)] + [(90, None, "en", ""), (91, "", None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, train string")
    labels = spark.createDataFrame([(i, 1 if i % 3 else 0, 0) for i in range(0, 80)] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in perplexities(docs, labels).collect()}
    learned = [i for i, r in got.items() if r.trained]
    assert 10 < len(learned) < 50 and all(i % 3 for i in learned)
    model = BruteKneserNey(4, [rows[i][1].encode() for i in learned])
    for i, t, _, _ in rows[:80]:
        assert abs(got[i].perplexity / 10 ** (-model.log10p(t.encode()) / len(t.encode())) - 1) < 1e-9
    assert got[90].perplexity is None and got[91].perplexity is None


def test_held_out_accuracy_and_edges(spark):
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("aeioulnrst") for _ in range(rnd.randint(2, 7)))
    good = [" ".join(word() for _ in range(60)) for _ in range(200)]
    bad = [" ".join(word().upper() + "!!" for _ in range(60)) for _ in range(40)]
    docs = spark.createDataFrame([(i, t, "en" if i % 2 else "de") for i, t in enumerate(good + bad)] + [(900, None, "en"), (901, good[0], None), (None, bad[0], "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(150)] + [(i, 0, 0) for i in range(200, 220)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.good for r in classify(docs, labels).collect()}
    assert sum(got[i] for i in range(200)) >= 198
    assert not any(got[i] for i in range(200, 240))
    assert got[900] is False and got[901] is True
    kept = {r.doc_id for r in keep_good(docs.withColumn("train", F.lit(1)), labels).collect()}
    assert None in kept and 900 not in kept and 201 not in kept
    assert classify(docs.limit(0), labels).collect() == []
    assert all(r.good for r in classify(docs.where("doc_id < 5"), labels.limit(0)).collect())


def test_any_number_of_languages(spark, monkeypatch):
    """Each language has its own threshold, joined by broadcast or by a shuffle."""
    rnd = random.Random(2)
    docs = spark.createDataFrame([(i, " ".join(rnd.choice(["ab", "cd", f"w{i % 40}"]) for _ in range(30)), f"l{i % 40}") for i in range(1600)], "doc_id long, text string, lang string")
    labels = docs.selectExpr("doc_id", "1 AS quality")
    got = sorted(classify(docs, labels, least=5).collect())
    assert len({r.threshold for r in got}) == 40
    monkeypatch.setattr(quality_classifier, "MAX_BROADCAST_LANGUAGES", 3)
    assert sorted(classify(docs.withColumn("threshold", F.lit(1)), labels, least=5).collect()) == got
