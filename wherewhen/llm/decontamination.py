"""Benchmark decontamination: test items in a BM25 index, every training passage as a query.

A passage is two strides of words of a document, a stride being as long as the longest item, so any run of
words as long as an item lies inside one passage. An item's score is normalised by its score for itself, so
one threshold fits items of all lengths. Retrieval is block-max WAND, for all passages of a batch at once: the
items stand in blocks, each term has a bound for each block, and only blocks in which a passage's bounds add
up to the threshold are scored exactly. All (passage, item) pairs at or above the threshold are found. A pair
is reported if the passage also overlaps with both parts of the item, the question and the answer, or with enough
of the item as a whole: cut or lightly edited copies may lack the answer.

The index goes to the executors. It is built from GROUP_ITEMS items, GROUP_BYTES bytes and GROUP_BOUNDS bounds at most
(or one item); a larger benchmark is a union over such groups, all with the statistics of the whole benchmark. Texts
aren't shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wherewhen.llm.common import driver_table, light_map, settled, without
from wherewhen.llm.textops import NOT_ALNUM, Words, ranges, sizes_of, text_bytes

GROUP_ITEMS, GROUP_BYTES, BLOCK_ITEMS = 2_000, 4 << 20, 16
#: Bounds, one for each different term and block of an index, 8 bytes each.
GROUP_BOUNDS = 4 << 20
K1, B = 1.2, 0.75


def normal_words(text: bytes) -> list[bytes]:
    """Runs of ASCII digits, letters and non-ASCII bytes, A-Z lower-cased."""
    w = Words([text], lower=True, between=NOT_ALNUM)
    raw = w.buf.tobytes()
    return [raw[a:b] for a, b in zip(w.starts.tolist(), w.ends.tolist(), strict=True)]


def split_item(words: list[bytes]) -> tuple[list[bytes], list[bytes]]:
    """(question, answer): items come without that division, so the answer is the last quarter of the words."""
    cut = len(words) - max(1, len(words) // 4)
    return words[:cut], words[cut:]


def grams(words: list, n: int) -> set:
    n = max(1, min(n, len(words)))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()


def overlap(part: list[bytes], passage: list[bytes], n: int) -> float:
    """The share of part's n-grams (of its own length, if that is less) that the passage has; 1 for no words."""
    n = max(1, min(n, len(part)))
    own = grams(part, n)
    return len(own & grams(passage, n)) / len(own) if own else 1.0


@dataclass
class Statistics:
    """Of a whole benchmark, for an index of some of its items: items with words, their mean and largest length, items by term."""

    items: int
    mean: float
    stride: int
    df: dict[bytes, int]


class Index:
    """BM25 weights of items, normalised by item, and their bounds by term and block. Items without words have no place in it."""

    def __init__(self, items: list[tuple[int, bytes]], whole: Statistics | None = None):
        found = [(i, normal_words(t or b"")) for i, t in items]
        self.items = sorted(((i, w) for i, w in found if w), key=lambda x: (len(x[1]), x[0] is not None, x[0] or 0, x[1]))
        self.stride = max((len(w) for _, w in self.items), default=1)
        n = len(self.items)
        terms = sorted({t for _, w in self.items for t in w})
        spot = Words(terms or [b""], between=np.zeros(256, dtype=bool) | (np.arange(256) == 10))
        h = spot.hashes() if terms else np.zeros(0, dtype=np.uint64)
        order = np.argsort(h)
        self.vocabulary, number = h[order], {terms[k]: i for i, k in enumerate(order.tolist())}
        df = np.zeros(len(terms))
        for _, w in self.items:
            for t in set(w):
                df[number[t]] += 1
        if whole is not None:
            n_all, mean, self.stride = whole.items, whole.mean, whole.stride
            df = np.array([whole.df[terms[k]] for k in order.tolist()], dtype=np.float64)
        else:
            n_all, mean = n, sum(len(w) for _, w in self.items) / max(1, n)
        idf = np.log(1 + (n_all - df + 0.5) / (df + 0.5))
        self.blocks, bound = [], []
        for at in range(0, n, BLOCK_ITEMS):
            part = self.items[at : at + BLOCK_ITEMS]
            local = np.array(sorted({number[t] for _, w in part for t in w}))
            weight = np.zeros((len(local) + 1, len(part)), dtype=np.float64)  # the last row: terms that the block lacks
            for j, (_, w) in enumerate(part):
                ids, tf = np.unique([number[t] for t in w], return_counts=True)
                score = idf[ids] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(w) / mean))
                weight[np.searchsorted(local, ids), j] = score / score.sum()
            self.blocks.append((at, local, weight))
            most = np.zeros(len(terms))
            most[local] = weight[:-1].max(axis=1)
            bound.append(most)
        self.bound = np.stack(bound, axis=1) if bound else np.zeros((0, 0))

    def retrieve(self, passage: np.ndarray, term: np.ndarray, threshold: float):
        """(passage, item number, score) of all pairs at or above threshold. passage and term: distinct pairs, sorted."""
        head = np.flatnonzero(np.diff(passage, prepend=-1))
        tail = np.append(head[1:], len(passage))
        for at in range(0, len(self.blocks), 32):
            bounds = np.add.reduceat(self.bound[term, at : at + 32], head, axis=0) if len(head) else np.zeros((0, 1))
            for k in np.flatnonzero((bounds >= threshold - 1e-9).any(axis=0)):
                first, local, weight = self.blocks[at + k]
                who = np.flatnonzero(bounds[:, k] >= threshold - 1e-9)
                size = tail[who] - head[who]
                row = np.repeat(head[who] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
                place = np.minimum(np.searchsorted(local, term[row]), len(local) - 1)
                place[local[place] != term[row]] = len(local)
                score = np.add.reduceat(weight[place], np.concatenate([[0], np.cumsum(size)[:-1]]), axis=0)
                for p, j in zip(*np.nonzero(score >= threshold - 1e-9), strict=True):
                    yield int(passage[head[who[p]]]), first + int(j), float(score[p, j])


def scan(index: Index, texts: list[bytes], threshold: float, question: float, answer: float, n: int, whole: float | None = None):
    """(text number, item number, score, question overlap, answer overlap): the best passage of each pair of text and item."""
    w = Words(texts, lower=True, between=NOT_ALNUM)
    if not len(index.vocabulary) or not len(w.starts):
        return
    h = w.hashes()
    at = np.minimum(np.searchsorted(index.vocabulary, h), len(index.vocabulary) - 1)
    known = np.flatnonzero(index.vocabulary[at] == h)
    text = np.repeat(np.arange(len(texts)), np.diff(w.first))
    cells = -(-np.diff(w.first) // index.stride)
    base = np.concatenate([[0], np.cumsum(cells)])
    cell = (np.arange(len(h)) - w.first[:-1][text]) // index.stride
    here, own = base[text[known]] + cell[known], cell[known]
    passage = np.concatenate([here, here[own > 0] - 1])
    key = np.unique(passage * len(index.vocabulary) + np.concatenate([at[known], at[known][own > 0]]))
    best: dict[tuple[int, int], tuple] = {}
    raw = w.buf.tobytes()
    for p, item, score in index.retrieve(key // len(index.vocabulary), key % len(index.vocabulary), threshold):
        i = int(np.searchsorted(base, p, side="right")) - 1
        a = int(w.first[i]) + (p - int(base[i])) * index.stride
        b = min(a + 2 * index.stride, int(w.first[i + 1]))
        words = [raw[s:e] for s, e in zip(w.starts[a:b].tolist(), w.ends[a:b].tolist(), strict=True)]
        asked, answered = split_item(index.items[item][1])
        q, r = overlap(asked, words, n), overlap(answered, words, n)
        if q >= question and r >= answer or whole is not None and overlap(index.items[item][1], words, n) >= whole:
            best[i, item] = max(best.get((i, item), (0.0,)), (score, q, r))
    for (i, item), found in sorted(best.items()):
        yield i, item, *found


def _groups(items: DataFrame):
    group, held, terms = [], 0, set()
    for r in items.select(F.col("item_id").cast("long").alias("i"), F.col("text").cast("string").alias("t")).orderBy("i", "t").toLocalIterator():
        t = (r["t"] or "").encode()
        more = terms | set(normal_words(t))
        if group and (len(group) >= GROUP_ITEMS or held + len(t) > GROUP_BYTES or len(more) * (len(group) // BLOCK_ITEMS + 1) > GROUP_BOUNDS):
            yield group
            group, held, more = [], 0, set(normal_words(t))
        terms = more
        group.append((r["i"], t))
        held += len(t)
    yield group


def _terms(batches):
    """The different terms of each item, each with times 1; and a null term with the item's length."""
    for batch in batches:
        found = [w for w in map(normal_words, text_bytes(batch.column("text"))) if w]
        rows = [(t, 1) for w in found for t in set(w)] + [(None, len(w)) for w in found]
        yield pa.record_batch({"term": pa.array([t for t, _ in rows], pa.binary()), "n": pa.array([n for _, n in rows], pa.int64())})


def _indexes(items: DataFrame):
    """An index for each group; where there are several, with the statistics of the whole benchmark."""
    groups = _groups(items)
    group, after = next(groups), next(groups, None)
    if after is None:
        yield Index(group)
        return
    spark = items.sparkSession
    counted = settled(items.select(F.col("text").cast("string").alias("text")).mapInArrow(_terms, "term binary, n long").groupBy("term").agg(F.count("*").alias("items"), F.sum("n").alias("total"), F.max("n").alias("most")), "terms")
    rest = counted.where("term IS NULL").first()
    while group is not None:
        own = driver_table(spark, {"term": sorted({t for _, text in group for t in normal_words(text)})}, "term binary")
        df = {bytes(r["term"]): r["items"] for r in counted.join(F.broadcast(own), "term").collect()}
        yield Index(group, Statistics(rest["items"], rest["total"] / rest["items"], rest["most"], df) if rest else None)
        group, after = after, next(groups, None)


def _scanner(shared, threshold, question, answer, n, whole):
    def run(batches):
        index = shared.value
        for batch in batches:
            out = []
            for a, b in ranges(sizes_of(batch.column("text"))):
                out += [(a + i, *rest) for i, *rest in scan(index, text_bytes(batch.column("text").slice(a, b - a)), threshold, question, answer, n, whole)]
            i, item, score, q, r = zip(*out, strict=True) if out else ((), (), (), (), ())
            yield pa.record_batch({
                "doc_id": batch.column("doc_id").take(pa.array(i, pa.int64())), "item_id": pa.array([index.items[k][0] for k in item], pa.int64()),
                "score": pa.array([round(x, 6) for x in score], pa.float64()), "question_overlap": pa.array([round(x, 6) for x in q], pa.float64()), "answer_overlap": pa.array([round(x, 6) for x in r], pa.float64()),
            })

    return run


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = 0.6, question: float = 0.6, answer: float = 0.6, n: int = 4, whole: float = 0.6) -> DataFrame:
    """One row for each row of docs and item found in it: doc_id, item_id, score, question_overlap, answer_overlap.

    threshold is on the normalised BM25 score; question and answer are the least shares of n-grams found in the
    passage, and whole that of the whole item's, which is enough without the two. Null and empty texts and items match nothing. Repeated rows are reported each; items with one text
    are reported each. Empty tables give an empty result; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for built in _indexes(items):
        index = docs.sparkSession.sparkContext.broadcast(built)
        found = rows.mapInArrow(light_map(_scanner(index, threshold, question, answer, n, whole)), "doc_id long, item_id long, score double, question_overlap double, answer_overlap double")
        out = found if out is None else out.unionByName(found)
    return out


def decontaminate(docs: DataFrame, items: DataFrame, **limits) -> DataFrame:
    """The rows of docs, with all their columns, in which contaminated() finds no item. Rows are told apart by doc_id; those with a null doc_id stay."""
    return without(docs, contaminated(docs, items, **limits).select("doc_id"))
