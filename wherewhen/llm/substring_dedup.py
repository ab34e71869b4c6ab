"""Substring dedup: count-min prefilter, then exact grouping of the windows estimated repeated.

Words, window hashes and chunks are functions of the rows alone, so every pass over a chunk finds the same
list of its distinct windows and answers about them travel as bits. One lazy plan:

1. texts are dealt into chunks (one shuffle, reused by the later visits);
2. visit 1 sends for each distinct window of a chunk its two cells of the count-min sketch of the window's
   shard (44 bits, sorted and delta coded) - the chunk's partial sketch;
3. each shard adds the partial sketches up and returns a bit per window: estimated to occur twice or more.
   Estimates are never too low, so no repeated window is lost;
4. visit 2 sends 96-bit keys of only those windows, with the smallest doc_id that has them in the chunk;
5. each shard groups the keys exactly and returns a bit: a smaller doc_id has it elsewhere;
6. visit 3 marks the covered words and digests the rest.

The number of shards follows the input, so a shard's sketch has a fixed size and load. A window that stands
in a third of all documents reaches its shard once for each chunk.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wherewhen.llm.common import chunked, text_size
from wherewhen.llm.textops import Words, blocks, mix, pack, shard_of, spans_hash, text_bytes, unpack, windows

CELL_BITS = 22
#: Bytes of a chunk. Chunks and shards both grow with the input and every pair of them exchanges a row, so both are as
#: large as a task can hold.
CHUNK_BYTES = 8 << 20
#: Windows for each shard: four cells a window in either row of the sketch.
SHARD_WINDOWS = 1 << (CELL_BITS - 2)


class _Chunk:
    """A chunk's windows: their hashes, rows and first words; and the rows' numbers, word counts and texts.

    Windows of rows without a doc_id are left out. second() gives the hashes of another family for some windows only.
    """

    def __init__(self, table: pa.Table, width: int):
        self.width, self.texts, ids = width, text_bytes(table.column("text")), table.column("doc_id")
        known = ~np.asarray(ids.is_null().to_numpy(), dtype=bool)
        self.number = np.asarray(ids.fill_null(0).to_numpy(), dtype=np.int64)
        self.parts, parts, counts = [], [], []
        for a, b in blocks(self.texts):
            words = Words(self.texts[a:b])
            h, text, start = windows(words.hashes(0), words.first, width, 0)
            ok = known[text + a]
            h, text, start = h[ok], text[ok], start[ok]
            self.parts.append((words, start))
            parts.append((h, text + a, start - words.first[:-1][text]))
            counts.append(np.diff(words.first))
        if not parts:
            parts, counts = [tuple(np.zeros(0, dtype=k) for k in (np.uint64, np.int64, np.int64))], [np.zeros(0, dtype=np.int64)]
        self.h, self.row, self.pos = (np.concatenate(x) for x in zip(*parts, strict=True))
        self.n_words = np.concatenate(counts)

    def second(self, at: np.ndarray) -> np.ndarray:
        """32 bits of the second family for the windows at (ascending)."""
        out, begin = [], 0
        for words, start in self.parts:
            own = start[at[np.searchsorted(at, begin) : np.searchsorted(at, begin + len(start))] - begin]
            begin += len(start)
            if len(own):
                out.append(spans_hash(words.hashes(2), own, own + self.width, 2).astype(np.uint32))
        return np.concatenate(out) if out else np.zeros(0, dtype=np.uint32)


def runs(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different values of h, ascending, how often each occurs and the order that sorts h.

    Not by np.unique(h): without counts it goes through a hash table, which takes several times as long on hashes.
    """
    order = np.argsort(h)
    ascending = h[order]
    first = np.flatnonzero(np.append(True, ascending[1:] != ascending[:-1])[: len(h)])
    return ascending[first], np.diff(np.append(first, len(h))), order


def sketch_cells(distinct: np.ndarray, shards: int):
    """For each shard that has any: its number, the slice of distinct and the order by sketch cells, with the cells."""
    shard = shard_of(distinct, shards)
    key = mix(distinct ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(64 - 2 * CELL_BITS)
    edge = np.flatnonzero(np.diff(shard)) + 1
    for a, b in zip([0, *edge], [*edge, len(distinct)], strict=True) if len(distinct) else ():
        order = np.argsort(key[a:b], kind="stable")
        yield int(shard[a]), a, b, order, key[a:b][order]


SKETCH_DDL = "shard long, chunk long, many binary, high binary, low binary"


def sketch_rows(table: pa.Table, distinct: np.ndarray, count: np.ndarray, shards: int) -> pa.Table:
    """A chunk's partial sketches, one row for each shard."""
    chunk = table.column("chunk")[0].as_py() if table.num_rows else 0
    rows = []
    for shard, a, b, order, key in sketch_cells(distinct, shards):
        high = (key >> np.uint64(24)).astype(np.int64)
        low = (key & np.uint64(0xFFFFFF)).astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3]
        rows.append((shard, np.packbits(count[a:b][order] > 1).tobytes(), pack(np.diff(high, prepend=0)), low.tobytes()))
    s, m, hi, lo = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.table({"shard": pa.array(s, pa.int64()), "chunk": pa.array([chunk] * len(s), pa.int64()), "many": pa.array(m, pa.binary()), "high": pa.array(hi, pa.binary()), "low": pa.array(lo, pa.binary())})


def least_cells(table: pa.Table) -> tuple[np.ndarray, list[int]]:
    """Adds the partial sketches of one shard up: for every entry of every chunk its least cell, and the chunks' numbers of entries."""
    keys, weight, size = [], [], []
    for many, high, low in zip(*(table.column(c).to_pylist() for c in ("many", "high", "low")), strict=True):
        hi = np.cumsum(unpack(high).astype(np.int64))
        lo = np.zeros((len(hi), 4), dtype=np.uint8)
        lo[:, :3] = np.frombuffer(low, dtype=np.uint8).reshape(-1, 3)
        keys.append((hi << 24) | lo.view("<u4").ravel().astype(np.int64))
        weight.append(np.unpackbits(np.frombuffer(many, dtype=np.uint8), count=len(hi)) + 1)
        size.append(len(hi))
    key, w = np.concatenate(keys), np.concatenate(weight).astype(np.float64)
    cells = (key >> CELL_BITS, key & ((1 << CELL_BITS) - 1))
    return np.minimum(*(np.bincount(c, weights=w, minlength=1 << CELL_BITS)[c] for c in cells)), size


def _sketch(width: int, shards: int):
    def visit(table: pa.Table) -> pa.Table:
        return sketch_rows(table, *np.unique(_Chunk(table, width).h, return_counts=True), shards)

    return visit


def _estimate(table: pa.Table) -> pa.Table:
    """Bits of the windows whose least cell counts two or more."""
    least, size = least_cells(table)
    bits = [np.packbits(x).tobytes() for x in np.split(least >= 2, np.cumsum(size)[:-1])]
    return pa.table({"chunk": table.column("chunk"), "kind": pa.array([0] * len(bits), pa.int32()), "shard": table.column("shard"), "bits": pa.array(bits, pa.binary())})


def _bits(answers: pa.Table, kind: int) -> dict[int, bytes]:
    return {s: b for k, s, b in zip(*(answers.column(c).to_pylist() for c in ("kind", "shard", "bits")), strict=True) if k == kind}


def _repeated(h: np.ndarray, shards: int, answers: pa.Table) -> np.ndarray:
    """Of the windows of a chunk the places of those estimated repeated, ascending."""
    distinct, count, order = runs(h)
    keep, bits = np.zeros(len(distinct), dtype=bool), _bits(answers, 0)
    for shard, a, b, by_cell, _ in sketch_cells(distinct, shards):
        keep[a + by_cell] = np.unpackbits(np.frombuffer(bits[shard], dtype=np.uint8), count=b - a).astype(bool)
    return np.sort(order[np.repeat(keep, count)])


def _groups(chunk: _Chunk, at: np.ndarray):
    """Of the windows at (ascending): their indices by group, the group of equal windows of each, and each group's keys and least doc_id."""
    h, row, number = chunk.h, chunk.row, chunk.number
    h2 = chunk.second(at)
    sort = np.lexsort((number[row[at]], h2, h[at]))
    order, h2 = at[sort], h2[sort]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (h2[1:] != h2[:-1])
    head = order[new]
    return order, np.cumsum(new) - 1, h[head], h2[new], number[row[head]]


def _exact(width: int, shards: int):
    def visit(table: pa.Table, answers: pa.Table) -> pa.Table:
        rows, chunk = [], 0
        if table.num_rows and answers.num_rows:
            chunk, own = table.column("chunk")[0].as_py(), _Chunk(table, width)
            _, _, key, key2, least = _groups(own, _repeated(own.h, shards, answers))
            shard = shard_of(key, shards)
            edge = np.flatnonzero(np.diff(shard)) + 1
            for a, b in zip([0, *edge], [*edge, len(key)], strict=True) if len(key) else ():
                base = int(least[a:b].min())
                rows.append((int(shard[a]), base, key[a:b].tobytes(), key2[a:b].tobytes(), pack((least[a:b] - base).astype(np.uint64))))
        s, base, k, k2, d = zip(*rows, strict=True) if rows else ((), (), (), (), ())
        return pa.table({"shard": pa.array(s, pa.int64()), "chunk": pa.array([chunk] * len(s), pa.int64()), "base": pa.array(base, pa.int64()), "key": pa.array(k, pa.binary()), "key2": pa.array(k2, pa.binary()), "doc": pa.array(d, pa.binary())})

    return visit


def _earlier(table: pa.Table) -> pa.Table:
    """Groups the keys of one shard exactly; bits of the chunk's keys that a smaller doc_id of another chunk has."""
    key = [np.frombuffer(x, dtype=np.uint64) for x in table.column("key").to_pylist()]
    key2 = np.concatenate([np.frombuffer(x, dtype=np.uint32) for x in table.column("key2").to_pylist()])
    doc = np.concatenate([unpack(x).astype(np.int64) + b for x, b in zip(table.column("doc").to_pylist(), table.column("base").to_pylist(), strict=True)])
    size = [len(x) for x in key]
    key = np.concatenate(key)
    order = np.lexsort((doc, key2, key))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (key[order][1:] != key[order][:-1]) | (key2[order][1:] != key2[order][:-1])
    least = doc[order][new][np.cumsum(new) - 1]
    smaller = np.zeros(len(order), dtype=bool)
    smaller[order] = least < doc[order]
    bits = [np.packbits(x).tobytes() for x in np.split(smaller, np.cumsum(size)[:-1])]
    return pa.table({"chunk": table.column("chunk"), "kind": pa.array([1] * len(bits), pa.int32()), "shard": table.column("shard"), "bits": pa.array(bits, pa.binary())})


def _removal(width: int, shards: int, with_text: bool):
    def visit(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _result([], [], [], [], [] if with_text else None)
        own = _Chunk(table, width)
        row, pos, number = own.row, own.pos, own.number
        gone: dict[int, np.ndarray] = {}
        if len(own.h) and answers.num_rows:
            order, group, key, _, least = _groups(own, _repeated(own.h, shards, answers))
            shard, bits = shard_of(key, shards), _bits(answers, 1)
            elsewhere = np.zeros(len(key), dtype=bool)
            edge = np.flatnonzero(np.diff(shard)) + 1
            for a, b in zip([0, *edge], [*edge, len(key)], strict=True) if len(key) else ():
                elsewhere[a:b] = np.unpackbits(np.frombuffer(bits[int(shard[a])], dtype=np.uint8), count=b - a)
            hit = order[elsewhere[group] | (least[group] < number[row[order]])]
            hit = hit[np.argsort(row[hit], kind="stable")]
            edge = np.flatnonzero(np.diff(row[hit])) + 1
            for part in np.split(hit, edge) if len(hit) else ():
                gone[int(row[part[0]])] = pos[part]
        removed, digest, kept = [], [], []
        for i, text in enumerate(own.texts):
            words, n = text.split(), 0
            if i in gone:
                edge = np.zeros(len(words) + 1, dtype=np.int64)
                np.add.at(edge, gone[i], 1)
                np.add.at(edge, gone[i] + width, -1)
                cover = np.cumsum(edge[:-1]) > 0
                n, words = int(cover.sum()), [w for w, c in zip(words, cover.tolist(), strict=True) if not c]
            rest = b" ".join(words)
            removed.append(n)
            digest.append(hashlib.sha256(rest).hexdigest())
            kept.append(rest.decode("utf-8", "replace") if with_text else None)
        return _result(table.column("doc_id"), own.n_words, removed, digest, kept if with_text else None)

    return visit


def _result(doc_id, n_words, removed, digest, kept) -> pa.Table:
    out = {"doc_id": doc_id if isinstance(doc_id, pa.ChunkedArray) else pa.array(doc_id, pa.int64()), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(digest, pa.string())}
    return pa.table(out | ({"kept_text": pa.array(kept, pa.string())} if kept is not None else {}))


def substring_dedup(docs: DataFrame, width: int = 13, with_text: bool = False) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_removed, kept_sha256 (and kept_text where asked for).

    A word goes if a window of width words covers it whose sequence also starts in a row with a smaller
    doc_id. Null texts have no words. Rows with a null doc_id are returned unchanged and are nobody's earlier
    copy. Rows that share a doc_id don't remove each other's words. An empty table gives an empty result;
    columns other than doc_id and text are ignored. Keys have 96 bits: two different windows among n
    candidates are taken for one with a probability of about n * n / 2**97.
    """
    size = text_size(docs)
    shards = max(16, math.ceil(size / 5 / SHARD_WINDOWS))
    texts = chunked(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), size, chunk_bytes=CHUNK_BYTES)
    answer = "chunk long, kind int, shard long, bits binary"
    sketch = texts.groupBy("chunk").applyInArrow(_sketch(width, shards), SKETCH_DDL)
    repeated = sketch.groupBy("shard").applyInArrow(_estimate, answer)
    exact = texts.groupBy("chunk").cogroup(repeated.groupBy("chunk")).applyInArrow(_exact(width, shards), "shard long, chunk long, base long, key binary, key2 binary, doc binary")
    earlier = exact.groupBy("shard").applyInArrow(_earlier, answer)
    out = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    return texts.groupBy("chunk").cogroup(repeated.unionByName(earlier).groupBy("chunk")).applyInArrow(_removal(width, shards, with_text), out)
