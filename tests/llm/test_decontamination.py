import random

from wherewhen.llm import decontamination
from wherewhen.llm.decontamination import Index, contaminated, decontaminate, normal_words, overlap, scan, split_item


def brute(items, texts, threshold, question, answer, n):
    index = Index(items)
    size, out = index.stride, {}
    for i, t in enumerate(texts):
        w = normal_words(t)
        for a in range(0, len(w), size):
            part = w[a : a + 2 * size]
            for k, (_, words) in enumerate(index.items):
                _, local, weight = index.blocks[k // 16]
                number = {int(t): r for r, t in enumerate(local)}
                score = 0.0
                for term in set(part):
                    from wherewhen.llm.textops import Words

                    h = Words([term]).hashes()[0]
                    at = int(index.vocabulary.searchsorted(h))
                    if at < len(index.vocabulary) and index.vocabulary[at] == h and at in number:
                        score += weight[number[at], k % 16]
                q, r = (overlap(x, part, n) for x in split_item(words))
                if score >= threshold - 1e-9 and q >= question and r >= answer:
                    out[i, k] = max(out.get((i, k), 0), round(score, 6))
    return out


def test_wand_finds_what_brute_force_finds():
    rnd = random.Random(4)
    vocabulary = [f"w{i}" for i in range(120)]
    line = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    items = [(i, line(rnd.randint(3, 20)).encode()) for i in range(70)]
    texts = [line(rnd.randint(0, 120)).encode() for _ in range(40)] + [(line(30) + " " + items[k][1].decode().upper() + ", " + line(50)).encode() for k in range(20)]
    for limits in ((0.6, 0.6, 0.6, 4), (0.3, 0.1, 0.0, 1)):
        got = {(i, k): round(s, 6) for i, k, s, _, _ in scan(Index(items), texts, *limits)}
        assert got == brute(items, texts, *limits)
        assert len(got) >= 20


def test_edges(spark):
    items = spark.createDataFrame([(1, "one two three four five six seven eight"), (2, None), (3, ""), (1, "one two three four five six seven eight")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x ONE two, three four five six seven eight! y", "k"), (2, None, "k"), (3, "", "k"), (4, "one two " * 4000, "k"), (None, "one two three four five six seven eight", "k")], "doc_id long, text string, item_id string")
    assert sorted(((r.doc_id, r.item_id) for r in contaminated(docs, items).collect()), key=str) == [(1, 1), (1, 1), (None, 1), (None, 1)]
    assert sorted((r.doc_id for r in decontaminate(docs, items).collect()), key=str) == [2, 3, 4, None]
    assert contaminated(docs.limit(0), items).collect() == [] and contaminated(docs, items.limit(0)).collect() == []


def test_truncated_and_edited_items(spark):
    rnd = random.Random(8)
    words = lambda n: [f"w{rnd.randrange(9000)}" for _ in range(n)]
    long, short = words(59), words(16)
    edited = [*short[:13], "other", *short[14:]]
    texts = [words(30) + long[:45] + words(30), words(30) + edited + words(30), words(90) + long[:20] + words(30)]
    items = spark.createDataFrame([(1, " ".join(long)), (2, " ".join(short))], "item_id long, text string")
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in contaminated(docs, items).collect()) == [(0, 1), (1, 2)]


def test_groups_do_not_change_scores(spark, monkeypatch):
    rnd = random.Random(9)
    line = lambda n: [f"w{int(rnd.random() ** 2 * 300)}" for _ in range(n)]
    items = [line(rnd.randint(8, 40)) for _ in range(30)]
    texts = [line(40) + w[: len(w) * 3 // 4] + line(40) for w in items]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string").coalesce(1)
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    whole = sorted(map(tuple, contaminated(docs, df).collect()))
    monkeypatch.setattr("wherewhen.llm.decontamination.GROUP_ITEMS", 12)
    assert sorted(map(tuple, contaminated(docs, df).collect())) == whole and len(whole) >= 20


def test_scores_match_bm25_by_definition(spark, monkeypatch):
    """All pairs at or above the threshold, with scores worked out from the formula over dictionaries, however the items are grouped."""
    import math
    import random
    from collections import Counter

    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice("abcde") for _ in range(2))
    items = [(i, " ".join(word() for _ in range(rnd.randint(3, 14)))) for i in range(60)]
    texts = [(i, " ".join(word() for _ in range(rnd.randint(0, 90)))) for i in range(40)]
    texts += [(100 + i, " ".join([word(), t, word()])) for i, t in items[::7]]
    split = {i: t.split() for i, t in items}
    df_, mean = Counter(w for t in split.values() for w in set(t)), sum(map(len, split.values())) / len(split)
    weight = {}
    for i, t in split.items():
        raw = {w: math.log(1 + (60 - df_[w] + 0.5) / (df_[w] + 0.5)) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(t) / mean)) for w, n in Counter(t).items()}
        weight[i] = {w: x / sum(raw.values()) for w, x in raw.items()}
    stride, expected = max(map(len, split.values())), {}
    for d, t in texts:
        words = t.split()
        for at in range(0, len(words), stride):
            seen = set(words[at : at + 2 * stride])
            for i, by in weight.items():
                score = sum(x for w, x in by.items() if w in seen)
                if score >= 0.55:
                    expected[d, i] = max(expected.get((d, i), 0.0), score)
    docs, bench = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for groups in (decontamination.GROUP_ITEMS, 7):
        monkeypatch.setattr(decontamination, "GROUP_ITEMS", groups)
        got = {(r.doc_id, r.item_id): r.score for r in decontamination.contaminated(docs, bench, threshold=0.55, question=0.0, answer=0.0).collect()}
        assert got.keys() == expected.keys() and len(got) > 20
        assert all(abs(got[k] - expected[k]) < 2e-6 for k in got)
    monkeypatch.setattr(decontamination, "GROUP_BOUNDS", 40)
    assert len(list(decontamination._groups(bench))) > 5
