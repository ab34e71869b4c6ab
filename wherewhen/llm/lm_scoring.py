"""LM scoring: the context-tree model's probability of every text, beside that of a word unigram model.

Both models learn from the same part of the corpus. The byte model is scored as grams.py says. Word counts go
the same way, but by ranges of the words' hashes, of which there are as many as the input's size asks for.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wherewhen.llm.common import text_size
from wherewhen.llm.ctw import ContextTree
from wherewhen.llm.grams import BLOCK_BYTES, BLOCK_DOCS, Lists, scored, squeeze
from wherewhen.llm.textops import WORD_PATTERN, Words, blocks, pack, shard_of

#: The end of a text, as the hash of a token; no word's hash matters at this scale.
END = np.uint64(0xFFFFFFFFFFFFFFFF)
WORD_SHARD_BYTES = 32 << 20


def _word_lists(texts: list[bytes], train: np.ndarray, shards: int):
    """(shard, blob) for every shard: its words' hashes, for each the texts that have it and how often, in the form of Lists."""
    import struct

    hashes, text = [np.full(len(texts), END)], [np.arange(len(texts))]
    for a, b in blocks(texts):
        w = Words(texts[a:b])
        hashes.append(w.hashes())
        text.append(a + np.repeat(np.arange(b - a), np.diff(w.first)))
    code, text = np.concatenate(hashes), np.concatenate(text)
    order = np.lexsort((text, code))
    code, text = code[order], text[order]
    new = np.ones(len(code), dtype=bool)
    new[1:] = (code[1:] != code[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    times, code, text = np.diff(np.append(first, len(code))), code[first], text[first]
    head = np.flatnonzero(np.append(True, code[1:] != code[:-1])) if len(code) else np.zeros(0, dtype=np.int64)
    docs, gap = np.diff(np.append(head, len(code))), np.diff(text, prepend=0)
    gap[head] = text[head]
    edge = np.searchsorted(shard_of(code[head], shards), np.arange(shards + 1))
    flags = np.packbits(train).tobytes()
    for s in range(shards):
        own = slice(int(edge[s]), int(edge[s + 1]))
        lo, hi = (int(head[own][0]), int(head[own][-1] + docs[own][-1])) if own.stop > own.start else (0, 0)
        g = gap[lo:hi].astype(np.uint16)
        yield s, squeeze(struct.pack("<I", len(texts)), flags, pack(np.diff(code[head[own]], prepend=np.uint64(0))), pack(docs[own]), (g & 255).astype(np.uint8).tobytes(), (g >> 8).astype(np.uint8).tobytes(), pack(times[lo:hi]))


def _emit(shards: int):
    def run(batches):
        part, run_no = TaskContext.get().partitionId(), 0

        def flush(ids, texts, train):
            nonlocal run_no
            block = (part << 32) | run_no
            run_no += 1
            out = list(_word_lists(texts, np.array(train, dtype=bool), shards))
            return pa.record_batch({"shard": pa.array([s for s, _ in out], pa.int32()), "block": pa.array([block] * len(out), pa.int64()), "lists": pa.array([b for _, b in out], pa.binary()), "docs": pa.array([np.array(ids, dtype=np.int64).tobytes() if not s else None for s, _ in out], pa.binary())})

        ids, texts, train, held = [], [], [], 0
        for batch in batches:
            for *i, t, k in zip(*(batch.column(c).to_pylist() for c in ("key0", "key1", "model_text", "train")), strict=True):
                if ids and (held + len(t) > BLOCK_BYTES or len(ids) >= BLOCK_DOCS):
                    yield flush(ids, texts, train)
                    ids, texts, train, held = [], [], [], 0
                ids.append(i), texts.append(t), train.append(bool(k))
                held += len(t) + 1
        if ids:
            yield flush(ids, texts, train)

    return run


def _count(table: pa.Table) -> pa.Table:
    """The words of one shard, counted in the training texts; for each block what its texts need of them."""
    lists = [Lists(x) for x in table.column("lists").to_pylist()]
    codes, at = np.unique(np.concatenate([x.codes for x in lists]), return_inverse=True)
    count = np.bincount(at, weights=np.concatenate([x.counts() for x in lists]), minlength=len(codes))
    logs, known = np.log10(count + 1), (count > 0).astype(np.float64)
    rows, begin = [], 0
    for x in lists:
        own = at[begin : begin + len(x.codes)]
        begin += len(x.codes)
        rows.append(np.stack([x.sums(logs[own]), x.sums(known[own]), x.sums(np.ones(len(own)))]).tobytes())
    total = pa.array([float(count.sum())] + [0.0] * (len(rows) - 1)), pa.array([float(known.sum())] + [0.0] * (len(rows) - 1))
    return pa.table({"block": table.column("block"), "sums": pa.array(rows, pa.binary()), "docs": table.column("docs"), "n": total[0], "v": total[1]})


def _total(table: pa.Table) -> pa.Table:
    logs, known, tokens = sum(np.frombuffer(x).reshape(3, -1) for x in table.column("sums").to_pylist())
    keys = np.frombuffer(next(d for d in table.column("docs").to_pylist() if d is not None), dtype=np.int64).reshape(-1, 2)
    return pa.table({"key0": pa.array(keys[:, 0]), "key1": pa.array(keys[:, 1]), "logs": pa.array(logs), "n_known": pa.array(known.astype(np.int64)), "n_tokens": pa.array(tokens.astype(np.int64))})


def canonical(text: Column) -> Column:
    """The text's words, A-Z lower-cased, with one space between, as bytes; null is empty."""
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.encode(F.array_join(F.regexp_extract_all(lower, F.lit(WORD_PATTERN), F.lit(0)), " "), "UTF-8")


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 7 == 2


def lm_scores(docs: DataFrame, order: int = 6) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte.

    Both models learn from the rows that are not held out, which also have a doc_id. score is the context
    tree's log10 probability of the text's words, A-Z lower-cased, with a space between words and a newline as
    the end; base_score that of its tokens under add-one word counts; bits_per_byte the tree's code length for each
    of the n_bytes bytes that it scores. Null and empty texts are an end alone. Rows with a null doc_id are scored,
    held out, and not learned from. Repeated rows count each time. An empty table gives an empty result; columns
    other than doc_id and text are ignored.

    The two models' scores of a row meet by two 64-bit hashes of its doc_id and text, so they do wherever the row is
    read from again; rows that agree in both have the same scores.
    """
    size = text_size(docs)
    shards = max(4, math.ceil(size / WORD_SHARD_BYTES))
    out = F.coalesce(held_out(F.col("doc_id")), F.lit(True))
    key = [F.xxhash64(F.lit(k), F.col("doc_id").cast("long"), F.col("doc_id").isNull(), F.col("text").cast("string")).alias(f"key{k}") for k in (0, 1)]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), out.alias("held_out"), (~out).alias("train"), canonical(F.col("text")).alias("model_text"), *key)
    words = rows.select("key0", "key1", "model_text", "train").mapInArrow(_emit(shards), "shard int, block long, lists binary, docs binary")
    counted = words.groupBy("shard").applyInArrow(_count, "block long, sums binary, docs binary, n double, v double")
    base = counted.groupBy("block").applyInArrow(_total, "key0 long, key1 long, logs double, n_known long, n_tokens long")
    base = base.groupBy("key0", "key1").agg(*[F.first(c).alias(c) for c in ("logs", "n_known", "n_tokens")])
    totals = F.broadcast(counted.groupBy(F.pmod("block", F.lit(1)).alias("all")).agg(F.sum("n").alias("n"), F.sum("v").alias("v")))  # one row
    ended = rows.withColumn("model_text", F.concat("model_text", F.lit(bytearray(b"\n")))).withColumn("n_bytes", F.octet_length("model_text").cast("long"))
    tree = scored(ended, ContextTree(order), "key0 long, key1 long, doc_id long, held_out boolean, n_bytes long", size)
    joined = tree.join(base, ["key0", "key1"]).withColumn("all", F.pmod("key0", F.lit(1))).join(totals, "all")
    base_score = F.col("logs") - F.col("n_tokens") * F.log10(F.col("n") + F.col("v") + 1)
    bits = -F.col("log10p") / math.log10(2) / F.col("n_bytes")
    return joined.select("doc_id", "held_out", "n_tokens", "n_known", F.col("n").cast("long").alias("train_tokens"), base_score.alias("base_score"), F.col("log10p").alias("score"), "n_bytes", bits.alias("bits_per_byte"))
