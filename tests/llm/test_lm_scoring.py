import math
import random
import re
import zlib
from collections import Counter

from wherewhen.llm import grams
from wherewhen.llm.lm_scoring import lm_scores

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def kt(z, o):
    p = 1.0
    for n, first in ((z, 0), (o, z)):
        for i in range(n):
            p *= (i + 0.5) / (first + i + 1)
    return p


class BruteTree:
    """The definition: weighted probabilities by recursion over all contexts; a bit's chance as a quotient of two of them."""

    def __init__(self, depth):
        self.depth, self.counts = depth, {}

    def bits(self, text):
        data = b"\n" * self.depth + text
        for i in range(self.depth, len(data)):
            for j in range(8):
                yield data[i - self.depth : i][::-1], (1 << j) | (data[i] >> (8 - j)), data[i] >> (7 - j) & 1

    def learn(self, text):
        for context, u, bit in self.bits(text):
            self.counts.setdefault(u, Counter())[context, bit] += 1

    def weighted(self, counts, k=0):
        z, o = (sum(n for (_, b), n in counts.items() if b == bit) for bit in (0, 1))
        if k == self.depth:
            return kt(z, o)
        product = 1.0
        for c in {context[k] for context, _ in counts}:
            product *= self.weighted({x: n for x, n in counts.items() if x[0][k] == c}, k + 1)
        return 0.5 * kt(z, o) + 0.5 * product

    def log10p(self, text):
        total = 0.0
        for context, u, bit in self.bits(text):
            old = self.counts.get(u, Counter())
            total += math.log10(self.weighted(old + Counter({(context, bit): 1})) / self.weighted(old))
        return total


def test_matches_the_definition(spark):
    rnd = random.Random(3)
    texts = [" ".join(rnd.choice(["ab", "Ba", "é", "b,"]) for _ in range(rnd.randint(0, 4))) for _ in range(14)] + [None, "", " \n ", "new words"]
    rows = list(enumerate(texts)) + [(3, "ab again"), (None, "ab none")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    tree, words, canonical = BruteTree(3), Counter(), {}
    for k, (i, t) in enumerate(rows):
        w = WORD.findall((t or "").translate(LOWER))
        canonical[k] = w
        if i is not None and zlib.crc32(str(i).encode()) % 7 != 2:
            tree.learn(" ".join(w).encode() + b"\n")
            words.update([*w, "\n"])
    n, v = sum(words.values()), len(words)
    expected = []
    for k, (i, _) in enumerate(rows):
        tokens = [*canonical[k], "\n"]
        base = sum(math.log10((words[x] + 1) / (n + v + 1)) for x in tokens)
        out = i is None or zlib.crc32(str(i).encode()) % 7 == 2
        expected.append((i, out, len(tokens), sum(words[x] > 0 for x in tokens), n, round(base, 6), round(tree.log10p(" ".join(canonical[k]).encode() + b"\n"), 6)))
    got = [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in lm_scores(df, order=4).collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)
    for r in lm_scores(df, order=4).collect():
        assert abs(r.bits_per_byte + r.score / math.log10(2) / r.n_bytes) < 1e-9


def test_shards_and_columns_make_no_difference(spark, monkeypatch):
    rows = [(i % 50, f"word{i % 9} and text number {i % 31}", "x") for i in range(300)] + [(7, "very long " * 20_000, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, train string").withColumnsRenamed({"train": "key0"})
    few = sorted(map(str, (r[:6] + (round(r.score, 6),) for r in lm_scores(df).collect())))
    monkeypatch.setattr(grams, "SHARDED_BYTES", 1000)
    assert grams.shards_for(300_000) > 100
    assert few == sorted(map(str, (r[:6] + (round(r.score, 6),) for r in lm_scores(df.repartition(5)).collect())))


def test_empty_table(spark):
    assert lm_scores(spark.createDataFrame([], "doc_id long, text string")).collect() == []
