import math
from collections import Counter, defaultdict

from wherewhen.llm.mixing import entropy, exponent_for, mix_sources, powered, repeats


def test_exponent_reaches_the_entropy():
    tokens = [1000, 100, 10, 0]
    a = exponent_for(tokens, 1110, 0.9, 1e9)
    assert abs(entropy(powered(tokens, a)) - 0.9 * math.log(3)) < 1e-9
    assert exponent_for([5, 5], 10, 0.9, 4) == 1.0


def test_repetition_limit():
    tokens = [100000, 10]
    a = exponent_for(tokens, 100010, 1.0, 4)
    assert repeats(tokens, powered(tokens, a), 100010) <= 4
    assert repeats(tokens, powered(tokens, a - 1e-6), 100010) > 4


def test_budgets_and_epochs(spark):
    rows = [(i, "w " * (1 + i % 9), "big" if i % 3 else f"s{i % 4}") for i in range(6000)] + [(7000, None, None), (7001, "a b", None), (7002, "", "big")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mix_sources(df, entropy_ratio=0.98).collect()
    total = sum(len((t or "").split()) for _, t, _ in rows)
    by, weight = Counter(), {}
    seen = defaultdict(Counter)
    for r in got:
        by[r.source] += r.n_tokens
        weight[r.source] = r.weight
        seen[r.source][r.doc_id] += 1
    assert abs(sum(weight.values()) - 1) < 1e-6
    for s, w in weight.items():
        if s is not None:
            assert abs(by[s] - w * total) <= 0.01 * total
            assert max(seen[s].values()) - min(seen[s].values()) <= 1
    assert all(0 <= r.position <= 1 for r in got)
    assert sorted(got) == sorted(mix_sources(df.repartition(3), entropy_ratio=0.98).collect())


def test_keep_and_empty(spark):
    df = spark.createDataFrame([(1, "a b", "s", "x"), (2, "c d", "s", "y")], "doc_id long, text string, source string, block string")
    assert sorted(mix_sources(df, keep=True).collect()) == sorted(df.collect())
    assert mix_sources(df.limit(0)).collect() == []
    assert mix_sources(df.selectExpr("doc_id", "'' AS text", "source")).collect() == []


def test_many_sources_without_the_driver(spark):
    rows = [(i, "w " * (1 + i % 9), "big" if i % 3 else f"s{i % 40}") for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for ratio, most in ((0.9, 4.0), (1.0, 2.0)):
        few, many = (sorted(mix_sources(df, entropy_ratio=ratio, max_repeats=most, local=n).collect()) for n in (1000, 3))
        assert len(few) == len(many)
        assert all(a[:5] == b[:5] and abs(a.weight - b.weight) < 2e-9 and abs(a.position - b.position) < 2e-9 for a, b in zip(few, many, strict=True))


def test_clashing_columns_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a b", "s", 7, 1.0)] * 2 + [(2, "w " * 30_000, "t", 8, 2.0)], "doc_id long, text string, source string, block long, weight double")
    got = mix_sources(df.withColumnsRenamed({"block": "_n", "weight": "tokens"}), entropy_ratio=0.0).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in got) == [(1, 2), (1, 2), (2, 30_000)]
