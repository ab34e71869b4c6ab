import ctypes
import os
import subprocess
import sys
import tracemalloc

import numpy as np
import pyarrow as pa

from wherewhen.llm import common, textops
from wherewhen.llm.common import driver_table, light_map
from wherewhen.llm.grams import _lists, gram_codes
from wherewhen.llm.jaccard_join import SHARD_ENTRIES, _families
from wherewhen.llm.textops import blocks, pack, ranges, sizes_of
from wherewhen.llm.token_files import TokenFile, encode


def peak(run):
    tracemalloc.start()
    out = run()
    found = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return out, found


def test_hashes_keep_small_tables():
    values = np.arange(1 << 21, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    start = np.array([0, 5, 16380, 16384, 1 << 20])
    textops._POWERS.clear()
    whole = textops.spans_hash(values, start, start + 20)
    assert sum(x.nbytes for pair in textops._POWERS.values() for x in pair) < 1 << 20
    for s, h in zip(start.tolist(), whole.tolist(), strict=True):  # the same by definition, and wherever the span stands
        assert textops.spans_hash(values[s : s + 20], np.array([0]), np.array([20]))[0] == h
        total = sum((int(v) + 1) * pow(textops._BASES[0], i, 1 << 64) for i, v in enumerate(values[s : s + 20]))
        mixed = textops.mix(np.array([(total + 20 * textops._BASES[1]) % (1 << 64)], dtype=np.uint64))
        assert mixed[0] == h


def test_grams_by_definition_in_bounded_memory():
    texts = [b"", b"abcab", b"", b"x", b"ab"]
    code, text = gram_codes(texts, 4)
    expected = []
    for i, t in enumerate(texts):
        padded = b"\n\n\n" + t
        expected += [(int.from_bytes(bytes([padded[k + 2], padded[k + 1], padded[k], padded[k + 3]]), "big"), i) for k in range(len(t))]
    assert list(zip(code.tolist(), text.tolist(), strict=True)) == expected
    many = [bytes(np.random.default_rng(i).integers(97, 105, 2000).astype(np.uint8)) for i in range(500)]
    assert peak(lambda: gram_codes(many, 4))[1] < 34 * 1_000_000  # 42 with arrays of places
    assert peak(lambda: list(_lists(many, 4, np.ones(500, dtype=bool), 16)))[1] < 45 * 1_000_000  # 52


def test_workers_give_memory_back_and_drop_what_other_operators_keep():
    code = """
import numpy as np
from wherewhen.llm import common
def visit(batches):
    held = [np.ones(2000) for _ in range(20000)]  # 320 MB of pieces that malloc keeps
    last = np.ones(2000)
    del held
    yield common._resident(), last
run = common.light_map(visit)([])
before, last = next(run)
list(run)
print(before >> 20, common._resident() >> 20)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
    before, after = map(int, out.stdout.split())
    if hasattr(ctypes.CDLL(None), "malloc_trim"):
        assert before > 300 and after < 250
    dropped = []
    common.keep("one", lambda: dropped.append("one"))
    list(light_map(lambda b: b, "one")([]))
    assert not dropped
    list(light_map(lambda b: b, "two")([]))
    assert dropped == ["one"]


def test_driver_tables_start_no_python_workers(spark):
    for rows in ([], [(None, 1), ("a", None)]):
        df = driver_table(spark, {"s": [r[0] for r in rows], "n": [r[1] for r in rows]}, "s string, n long")
        assert [tuple(r) for r in df.collect()] == rows and df.dtypes == [("s", "string"), ("n", "bigint")]
        assert "PythonRDD" not in df._jdf.queryExecution().toRdd().toDebugString()
    assert pa.table({"b": [b"x"]}).column("b")[0].as_py() == driver_table(spark, {"b": [b"x"]}, "b binary").first()["b"]


def test_a_shard_of_families_fits_beside_other_workers():
    rnd = np.random.default_rng(1)
    rows = []
    for part in range(16):
        n = 3 * SHARD_ENTRIES // 16
        key = np.sort(rnd.integers(0, 1 << 63, n, dtype=np.uint64))
        key[n // 2 :: 3] = key[n // 2]
        key.sort()
        rows.append((pack(np.diff(key, prepend=np.uint64(0))), pack(rnd.integers(0, 9000, n).astype(np.uint64)), (np.arange(9000) + 9000 * part).tobytes(), np.full(9000, 400).tobytes()))
    table = pa.table({c: pa.array(x, pa.binary()) for c, x in zip(("keys", "at", "ids", "sizes"), zip(*rows, strict=True), strict=True)})
    assert peak(lambda: _families(table))[1] < 200 * 1_000_000


def test_token_file_is_encoded_in_bounded_memory():
    ids = np.random.default_rng(2).integers(0, 49_000, 1 << 21).astype("<u4")
    data, held = peak(lambda: encode(np.array([1]), np.array([0, len(ids)]), ids))
    assert (TokenFile(data).tokens(0, len(ids)) == ids).all()
    assert held < 24 * 1_000_000


def test_ranges_without_the_texts():
    texts = ["", None, "ab", "ü" * 9, "x" * 30, "", "abc"]
    column = pa.chunked_array([pa.array(texts[:3]), pa.array(texts[3:])])
    assert sizes_of(column) == [len((t or "").encode()) for t in texts] and sizes_of(pa.array([], pa.string())) == []
    assert list(ranges(sizes_of(column), 20)) == list(blocks([(t or "").encode() for t in texts], 20)) == [(0, 3), (3, 4), (4, 5), (5, 7)]
