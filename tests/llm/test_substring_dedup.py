import hashlib
import random
import time

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from wherewhen.llm.substring_dedup import _repeated, sketch_cells, substring_dedup


def brute(rows, width):
    first = {}
    for i, t in rows:
        w = (t or "").encode().split()
        for k in range(len(w) - width + 1):
            g = tuple(w[k : k + width])
            if i is not None:
                first[g] = min(first.get(g, i), i)
    out = []
    for i, t in rows:
        w = (t or "").encode().split()
        gone = set()
        for k in range(len(w) - width + 1):
            if i is not None and first[tuple(w[k : k + width])] < i:
                gone |= set(range(k, k + width))
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()))
    return sorted(out, key=str)


def test_matches_brute_force(spark):
    rnd = random.Random(1)
    passage = " ".join(f"p{k}" for k in range(40))
    rows = [(i, " ".join(rnd.choice("abc") for _ in range(rnd.randint(0, 60)))) for i in range(60)]
    rows += [(100 + i, f"x{i} {passage} y{i}\t\n z") for i in range(20)]
    rows += [(200, None), (201, ""), (202, " \n"), (None, passage), (105, passage), (300, "é ü " * 3000), (301, "é ü " * 2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("chunk", F.lit("clash")).withColumn("bits", F.lit(1))
    got = sorted(map(tuple, substring_dedup(df, width=5).collect()), key=str)
    assert got == brute(rows, 5)


def test_empty_table(spark):
    assert substring_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_kept_text(spark):
    df = spark.createDataFrame([(1, "a b c d"), (2, "z a b c d q")], "doc_id long, text string")
    assert {r.doc_id: r.kept_text for r in substring_dedup(df, width=4, with_text=True).collect()} == {1: "a b c d", 2: "z q"}


def test_repeated_windows_are_found_by_sorting():
    rnd = np.random.default_rng(1)
    h = rnd.integers(0, 1 << 63, 1_000_000, dtype=np.uint64) * np.uint64(2)
    h[::50] = h[0]
    repeated, rows = np.unique(h[rnd.integers(0, len(h), 1000)]), []
    for shard, a, b, order, _ in sketch_cells(np.unique(h, return_counts=True)[0], 16):
        rows.append((shard, np.packbits(np.isin(np.unique(h, return_counts=True)[0][a:b][order], repeated)).tobytes()))
    answers = pa.table({"kind": [0] * len(rows), "shard": [s for s, _ in rows], "bits": [b for _, b in rows]})

    def least(run):
        took = []
        for _ in range(3):
            begin = time.process_time()
            run()
            took.append(time.process_time() - begin)
        return min(took)

    assert _repeated(h, 16, answers).tolist() == np.flatnonzero(np.isin(h, repeated)).tolist()
    assert len(_repeated(h[:0], 16, answers)) == 0
    assert least(lambda: _repeated(h, 16, answers)) < 8 * least(lambda: np.argsort(h))  # 3 to 4; with np.unique(h) 14 to 16
