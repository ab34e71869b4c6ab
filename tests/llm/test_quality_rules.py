import random
import re
from collections import Counter

import numpy as np

from wherewhen.llm.quality_rules import Classes, features, fit, quality_rules

W = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = W.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if W.search(line):
            dup += line in seen
            seen.add(line)
    where = {}
    for i in range(len(w) - 7):
        where.setdefault(tuple(w[i : i + 8]), []).append(i)
    hit = {i + k for p in where.values() if len(p) > 1 for i in p for k in range(8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(hit)


def test_counts_match_brute_force(spark):
    rnd = random.Random(5)
    texts = [None, "", " \n\t", "a", "a b c d e f g h", "x\nx\n\nx\n \n \n", "é# *ü|" * 40, "w " * 5000]
    texts += [" ".join(rnd.choice("abcd") for _ in range(rnd.randint(1, 80))) for _ in range(60)]
    texts += ["\n".join(rnd.choice(["one two", "three", " ", "#"]) for _ in range(rnd.randint(1, 20))) for _ in range(30)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in features(df).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(texts[r.doc_id]), texts[r.doc_id]


def test_verdicts(spark):
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("aeioulnrst") for _ in range(rnd.randint(2, 8)))
    clean = [" ".join(word() for _ in range(rnd.randint(40, 200))) + "." for _ in range(80)]
    junk = [" ".join(word().upper() + "!!" for _ in range(80)) for _ in range(10)] + [" ".join(word() + "***" for _ in range(80)) for _ in range(10)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(clean + junk)] + [(1000, None), (1001, "w " * 900)], "doc_id long, text string")
    got = {r.doc_id: r for r in quality_rules(df).collect()}
    assert all(got[i].kept for i in range(80))
    assert not any(got[i].kept for i in range(80, 100))
    assert got[1000].base_failed and got[1001].base_failed and not got[1001].kept
    assert quality_rules(df.limit(0)).collect() == []


def test_em_finds_kinds_of_fault():
    """Two kinds of fault, each seen by two of five rules, and a rule that fails one good document in fifty."""
    rnd, counts = random.Random(1), {}
    kinds = [[0.01, 0.01, 0.01, 0.01, 0.02], [0.9, 0.8, 0.05, 0.05, 0.02], [0.05, 0.05, 0.85, 0.7, 0.02]]
    truth = Counter()
    for _ in range(20000):
        kind = rnd.choices(range(3), (0.8, 0.15, 0.05))[0]
        v = tuple((-1 if rnd.random() < q else 1) if rnd.random() < 0.9 else 0 for q in kinds[kind])
        counts[v] = counts.get(v, 0) + 1
        truth[v, kind == 0] += 1
    votes, n = np.array(list(counts)), np.array(list(counts.values()))
    found = fit(votes, n)
    assert abs(found.share[0] - 0.8) < 0.03 and all(abs(a - b) < 0.03 for a, b in zip(found.bad[0], kinds[0], strict=True))
    p = found.chances(votes)[:, 0]
    # the posterior of one combination by hand
    one = [s * np.prod([q if x < 0 else 1 - q for q, x in zip(row, votes[3], strict=True) if x]) for s, row in zip(found.share, found.bad, strict=True)]
    assert abs(p[3] - one[0] / sum(one)) < 1e-12
    # few more errors than with the true numbers: the prior expects more of a rule on its own fault than these rules do
    best = Classes(np.array([0.8, 0.15, 0.05]), np.array(kinds)).chances(votes)[:, 0]
    wrong, least = (sum(truth[tuple(v), x < 0.5] for v, x in zip(votes.tolist(), q, strict=True)) for q in (p, best))
    assert wrong <= 1.15 * least


def test_labelled_documents(spark):
    """The labels aren't read by the rules: most low-quality documents past the base go, hardly a good one does."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in quality_rules(docs.withColumnsRenamed({"n_chars": "_code", "source": "_p"})).collect()}
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()
    past = {q: [got[r.doc_id].kept for r in labels if r.quality == q and not got[r.doc_id].base_failed] for q in (0, 1)}
    assert sum(past[0]) <= len(past[0]) / 2 and sum(past[1]) >= 0.97 * len(past[1])


def test_repeated_rows(spark):
    df = spark.createDataFrame([(1, "some plain words that stand here as a text " * 2), (1, "some plain words that stand here as a text " * 2), (None, "x")], "doc_id long, text string")
    got = quality_rules(df).collect()
    assert len(got) == 3 and len({(r.kept, r.p_good) for r in got if r.doc_id == 1}) == 1
