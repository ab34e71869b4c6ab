"""Byte n-gram models over whole corpora: sharded counts, and scores that come back as sums for each document.

A model of order n gives log10 p(byte | n - 1 bytes before). A text's score is a sum over its n-grams, so texts
needn't travel: blocks of documents are turned into lists of (n-gram, document, times), dealt by the two bytes
next to the predicted one into shards, each shard in as many salts as the input's size asks for. Shards grow with the
square root of the input from SHARDS on, as do the different n-grams of a shard where all n-grams grow in proportion;
lists are then so many for each block.

1. (shard, salt): what the training documents among the lists count - a partial sum;
2. shard: the sums, and from them the shard's part of the model and its share in a table for contexts of
   under two bytes, which has 256 * 256 entries whatever the corpus;
3. (shard, salt): the lists meet their part of the model; one number for each document of each block;
4. block: the numbers of the shards are added up.

Lists travel once: steps 1 and 3 read the same exchange. What a task holds is bounded by the salts' size and
the number of different n-grams of a shard.
"""

from __future__ import annotations

import math
import struct

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wherewhen.llm.common import light, light_map, light_pair
from wherewhen.llm.textops import pack, sizes_of, unpack

#: Shards of up to SHARDED_BYTES of text; four times the text has twice the shards.
SHARDS, SHARDED_BYTES = 16, 8 << 30
BLOCK_BYTES, BLOCK_DOCS = 4 << 20, 60_000
#: Text bytes whose lists one salt of all shards holds.
SALT_BYTES = 512 << 20
PAD = 10  # before a text its bytes are taken to be newlines


def shards_for(size: int) -> int:
    return SHARDS << max(0, math.ceil(math.log(max(1, size) / SHARDED_BYTES, 4)))


def squeeze(*parts: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(struct.pack("<I", len(parts)) + b"".join(struct.pack("<Q", len(p)) for p in parts) + b"".join(parts))


def unsqueeze(data: bytes) -> list[bytes]:
    data = zstandard.ZstdDecompressor().decompress(data)
    (n,) = struct.unpack_from("<I", data)
    at, out = 4 + 8 * n, []
    for size in struct.unpack_from(f"<{n}Q", data, 4):
        out.append(data[at : at + size])
        at += size
    return out


def gram_codes(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams that predict each byte of each text, and the texts' numbers. The byte before comes first in a
    code, then the one before that, and so on; the predicted byte comes last."""
    pad = bytes([PAD]) * (n - 1)
    buf = np.frombuffer(b"".join(pad + t for t in texts), dtype=np.uint8)
    size = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
    text = np.repeat(np.arange(len(texts)), size)
    if not len(buf):
        return np.zeros(0, dtype=np.uint64), text
    code = np.zeros(len(buf) - n + 1, dtype=np.uint64)  # of the byte at n - 1 and those after it, padding too
    for k in [*range(1, n), 0]:
        code <<= np.uint64(8)
        code |= buf[n - 1 - k : len(buf) - k]
    begin = np.cumsum(size) - size + np.arange(len(texts)) * (n - 1)
    edge = np.zeros(len(code) + 1, dtype=np.int8)  # a text begins, a text ends
    np.add.at(edge, begin, 1)
    np.add.at(edge, begin + size, -1)
    return code[np.cumsum(edge[:-1], dtype=np.int8).view(bool)], text


def _lists(texts: list[bytes], n: int, train: np.ndarray, shards: int):
    """(shard, blob) for every shard: its n-grams, for each the documents that have it and how often."""
    key, text = gram_codes(texts, n)
    key *= np.uint64(max(1, len(texts)))
    key += text.view(np.uint64)
    del text
    key.sort()
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
    key, times = key[first], np.diff(np.append(first, len(key)))
    code, text = key // np.uint64(max(1, len(texts))), (key % np.uint64(max(1, len(texts)))).astype(np.int64)
    del key, first
    head = np.flatnonzero(np.diff(code, prepend=np.uint64(0xFFFFFFFFFFFFFFFF)) != 0) if len(code) else np.zeros(0, dtype=np.int64)
    docs = np.diff(np.append(head, len(code)))
    near = (code[head] >> np.uint64(8 * (n - 2))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)
    shard = (near % np.uint64(shards)).astype(np.int64)
    gap = np.diff(text, prepend=0)
    gap[head] = text[head]
    flags = np.packbits(train).tobytes()
    for s in range(shards):
        own = np.flatnonzero(shard == s)
        row = np.repeat(head[own] - np.concatenate([[0], np.cumsum(docs[own])[:-1]]), docs[own]) + np.arange(docs[own].sum()) if len(own) else np.zeros(0, dtype=np.int64)
        g = gap[row].astype(np.uint16)
        codes = code[head[own]]
        yield s, squeeze(struct.pack("<I", len(texts)), flags, pack(np.diff(codes, prepend=np.uint64(0))), pack(docs[own]), (g & 255).astype(np.uint8).tobytes(), (g >> 8).astype(np.uint8).tobytes(), pack(times[row]))


class Lists:
    """One blob of _lists(): codes, the first pair of each code, the document and the times of each pair."""

    def __init__(self, blob: bytes):
        n, flags, codes, docs, low, high, times = unsqueeze(blob)
        (self.texts,) = struct.unpack("<I", n)
        self.train = np.unpackbits(np.frombuffer(flags, dtype=np.uint8), count=self.texts).astype(bool)
        self.codes = np.cumsum(unpack(codes).astype(np.uint64))
        docs = unpack(docs).astype(np.int64)
        self.code = np.repeat(np.arange(len(docs)), docs)
        gap = np.frombuffer(low, dtype=np.uint8).astype(np.int64) | (np.frombuffer(high, dtype=np.uint8).astype(np.int64) << 8)
        total = np.cumsum(gap)
        first = np.concatenate([[0], np.cumsum(docs)[:-1]]).astype(np.int64) if len(docs) else np.zeros(0, dtype=np.int64)
        self.text = total - np.repeat(total[first] - gap[first], docs) if len(docs) else total
        self.times = unpack(times).astype(np.int64)

    def counts(self) -> np.ndarray:
        """How often the training documents have each code."""
        return np.bincount(self.code, weights=self.times * self.train[self.text], minlength=len(self.codes))

    def sums(self, values: np.ndarray) -> np.ndarray:
        """For each document the sum of its codes' values."""
        return np.bincount(self.text, weights=self.times * values[self.code], minlength=self.texts)


def _add(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    codes, at = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
    count = np.bincount(at, weights=np.concatenate([x for _, x in parts]), minlength=len(codes))
    return codes[count > 0], count[count > 0]


def _emit(n: int, salts: int, extra: list[str], shards: int):
    def run(batches):
        part, run_no = TaskContext.get().partitionId(), 0

        def flush(rows):
            nonlocal run_no
            block, salt = (part << 32) | run_no, (part * 7919 + run_no) % salts
            run_no += 1
            table = pa.Table.from_batches(rows)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.select(extra).schema) as w:
                w.write_table(table.select(extra))
            texts = [x or b"" for x in table.column("model_text").to_pylist()]
            out = list(_lists(texts, n, np.array(table.column("train").fill_null(False).to_pylist(), dtype=bool), shards))
            return pa.record_batch({"shard": pa.array([s for s, _ in out], pa.int32()), "salt": pa.array([salt] * len(out), pa.int32()), "block": pa.array([block] * len(out), pa.int64()), "lists": pa.array([b for _, b in out], pa.binary()), "meta": pa.array([sink.getvalue().to_pybytes() if s == 0 else None for s, _ in out], pa.binary())})

        held, rows, n_docs = 0, [], 0
        for batch in batches:
            size, a = [x + 1 for x in sizes_of(batch.column("model_text"))], 0
            for b, one in enumerate(size):
                if n_docs and (held + one > BLOCK_BYTES or n_docs >= BLOCK_DOCS):
                    if b > a:
                        rows.append(batch.slice(a, b - a))
                    yield flush(rows)
                    held, rows, n_docs, a = 0, [], 0, b
                held += one
                n_docs += 1
            if len(size) > a:
                rows.append(batch.slice(a))
        if rows:
            yield flush(rows)

    return run


def _partial(table: pa.Table) -> pa.Table:
    parts = []
    for blob in table.column("lists"):
        lists = Lists(blob.as_py())
        parts.append(_add([(lists.codes, lists.counts())]))
        if len(parts) >= 16:
            parts = [_add(parts)]
    codes, count = _add(parts)
    return pa.table({"shard": table.column("shard").slice(0, 1), "codes": pa.array([codes.tobytes()], pa.binary()), "counts": pa.array([count.tobytes()], pa.binary())})


def _model(model):
    def run(table: pa.Table) -> pa.Table:
        codes, counts = _add([(np.frombuffer(c, dtype=np.uint64), np.frombuffer(x, dtype=np.float64)) for c, x in zip(table.column("codes").to_pylist(), table.column("counts").to_pylist(), strict=True)])
        own, share = model.shard(codes, counts)
        return pa.table({"shard": table.column("shard").slice(0, 1), "model": pa.array([squeeze(own)], pa.binary()), "share": pa.array([squeeze(share)], pa.binary())})

    return run


def _low(model, shards: int):
    def run(table: pa.Table) -> pa.Table:
        low = squeeze(model.low([unsqueeze(x)[0] for x in table.column("share").to_pylist()]))
        return pa.table({"shard": pa.array(range(shards), pa.int32()), "low": pa.array([low] * shards, pa.binary())})

    return run


def _answer(model):
    def run(lists: pa.Table, parts: pa.Table) -> pa.Table:
        rows = []
        if lists.num_rows:
            scorer = model.scorer(unsqueeze(parts.column("model")[0].as_py())[0], unsqueeze(parts.column("low")[0].as_py())[0])
            known = np.zeros(0, dtype=np.uint64), np.zeros(0)
            for blob in lists.column("lists"):
                own = Lists(blob.as_py())
                at = np.minimum(np.searchsorted(known[0], own.codes), max(0, len(known[0]) - 1))
                new = own.codes[known[0][at] != own.codes] if len(known[0]) else own.codes
                if len(new):
                    codes = np.concatenate([known[0], new])
                    order = np.argsort(codes, kind="stable")
                    known = codes[order], np.concatenate([known[1], scorer(new)])[order]
                rows.append(own.sums(known[1][np.searchsorted(known[0], own.codes)]).tobytes())
        return pa.table({"block": lists.column("block"), "sums": pa.array(rows, pa.binary()), "meta": lists.column("meta")})

    return run


def _total(out_schema: pa.Schema):
    def run(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, dtype=np.float64) for x in table.column("sums").to_pylist())
        meta = next(m for m in table.column("meta").to_pylist() if m is not None)
        with pa.ipc.open_stream(meta) as r:
            return r.read_all().append_column("log10p", pa.array(total, pa.float64())).cast(out_schema)

    return run


def scored(docs: DataFrame, model, extra: str, size: int) -> DataFrame:
    """The columns that extra declares (a DDL string) with log10p, the log10 probability of model_text, for every row.

    docs has those columns, model_text (binary) and train (boolean): whether the model learns from the row. size:
    bytes of all texts. Blocks are told apart by the partition of docs that holds them, so docs has to come from
    a scan and row-wise operations on it. A row with an empty text scores 0.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    shards, salts = shards_for(size), max(1, -(-size // SALT_BYTES)) * 3
    names = _parse_datatype_string(extra).names
    ddl = extra + ", log10p double"
    schema = to_arrow_schema(_parse_datatype_string(ddl))
    lists = docs.select(*names, "model_text", "train").mapInArrow(light_map(_emit(model.order, salts, names, shards)), "shard int, salt int, block long, lists binary, meta binary")
    counts = lists.groupBy("shard", "salt").applyInArrow(light(_partial), "shard int, codes binary, counts binary")
    models = counts.groupBy("shard").applyInArrow(light(_model(model)), "shard int, model binary, share binary")
    low = models.select(F.lit(0).alias("all"), "share").groupBy("all").applyInArrow(light(_low(model, shards)), "shard int, low binary")
    parts = models.select("shard", "model").join(low, "shard").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    sums = lists.groupBy("shard", "salt").cogroup(parts.groupBy("shard", "salt")).applyInArrow(light_pair(_answer(model)), "block long, sums binary, meta binary")
    return sums.groupBy("block").applyInArrow(light(_total(schema)), ddl)
