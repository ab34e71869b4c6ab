import random
import re

from pyspark.sql import functions as F

from wherewhen.llm import jaccard_join
from wherewhen.llm.jaccard_join import Regions, jaccard_components, keep_one, shingles

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sets(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    s = [sets(t) for _, t in rows]
    root = {i: i for i, _ in rows}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for x in range(len(rows)):
        for y in range(x):
            a, b = rows[x][0], rows[y][0]
            if a is not None and b is not None and s[x] & s[y] and 100 * len(s[x] & s[y]) >= 75 * len(s[x] | s[y]):
                a, b = sorted((top(a), top(b)))
                root[b] = a
    return sorted(((i, len(x), top(i) if i is not None else None) for (i, _), x in zip(rows, s, strict=True)), key=str)


def corpus(rnd, n):
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(3))
    common = " ".join(word() for _ in range(14))
    rows = []
    for i in range(n):
        kind = rnd.random()
        if kind < 0.45 and rows:
            w = (rnd.choice(rows)[1] or "x").split()
            for _ in range(rnd.randint(0, 4)):
                w[rnd.randrange(len(w))] = word()
            if rnd.random() < 0.4:
                w = w[: max(1, int(len(w) * rnd.uniform(0.7, 1)))]
            text = " ".join(w)
        elif kind < 0.7:
            text = common + " " + " ".join(word() for _ in range(rnd.randint(0, 12)))
        else:
            text = " ".join(word() for _ in range(rnd.randint(1, 90)))
        rows.append((i, text.upper() if rnd.random() < 0.1 else text))
    return rows


def test_matches_brute_force(spark, monkeypatch):
    rnd = random.Random(8)
    rows = corpus(rnd, 500)
    rows += [(600, None), (601, ""), (602, " \n"), (603, "a b"), (604, "A  B"), (605, "b a"), (None, "a b"), (5, rows[400][1]), (606, "long text " * 9000), (607, "long text " * 8000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("component", F.lit("x")).withColumn("n", F.lit(1))
    expected = brute(rows)
    assert sorted(map(tuple, jaccard_components(df).collect()), key=str) == expected
    kept = sorted((r.doc_id for r in keep_one(df).collect()), key=str)
    assert kept == sorted((i for i, _, c in expected if i is None or c == i), key=str)


def test_rounds_of_cells_miss_nothing(spark, monkeypatch):
    """Blocks so small that families take several rounds of pivots, Voronoi cells and windows, and pairs of blocks."""
    rows = corpus(random.Random(12), 220)
    df, rounds = spark.createDataFrame(rows, "doc_id long, text string"), []
    monkeypatch.setattr(jaccard_join, "BLOCK_MEMBERS", 6)
    monkeypatch.setattr(jaccard_join, "BLOCK_BYTES", 8000)
    seen = jaccard_join._blocked
    monkeypatch.setattr(jaccard_join, "_blocked", lambda f, s, labels, leads: rounds.append(leads) or seen(f, s, labels, leads))
    assert sorted(map(tuple, jaccard_components(df).collect()), key=str) == brute(rows)
    assert len(rounds) > 4


def test_without_ids(spark):
    rows = [(None, "one two three four five six"), (None, "one two three four five six"), (None, None), (3, "one two three four five six")]
    assert sorted(map(tuple, jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str) == [(3, 2, 3), (None, 0, None), (None, 2, None), (None, 2, None)]


def test_recursive_regions_miss_nothing():
    rnd = random.Random(5)
    rows = corpus(rnd, 400)
    sets_ = shingles([t.encode() for _, t in rows])
    found = Regions([i for i, _ in rows], sets_, [len(s) for s in sets_], list(range(400)))
    found.join(list(range(400)))
    assert len(found.stars()) == 400 - len({found.top(i) for i in range(400)})
    low = {}
    for i in range(400):
        low.setdefault(found.top(i), i)
    assert sorted(((i, low[found.top(i)]) for i in range(400)), key=str) == [(i, c) for i, _, c in brute(rows)]


def test_empty_table(spark):
    assert jaccard_components(spark.createDataFrame([], "doc_id long, text string")).collect() == []
