"""N-gram Jaccard join in metric space.

Jaccard distance d is a metric; two documents link where d <= r = 1/4. Almost all pairs are at distance 1 of each
other, where a Voronoi diagram of sampled pivots separates nothing: every document would be in every window. So the
first regions are cut where distances below 1 can be: documents that link share one of their rarest shingles (the
first |x| - ceil(0.75|x|) + 1 in an order by estimated frequency), and their sizes differ by a third at most. A
region is a shingle and a size class, with a window that replicates the next class into it; its pivot is its lowest
document. Regions with one pivot p are one family F(p). Every pair that may link is in some family.

1. Each document goes to the family that it shares most with. Families - in blocks, each with the pivot - are
   joined, and links make components.
2. Families that still hold several components are taken up whole: distances to the pivot are computed, and by
   the triangle inequality a document x can only link with an outer one y (d(y, p) > r) if d(x, p) >= d(y, p) - r.
   Documents out of that window leave the family.
3. What is left of a family is joined recursively. One that is larger than a block gets pivots from its components;
   its documents are dealt to Voronoi cells by nearest pivot, and a boundary document x is replicated to each cell q
   with d(x, q) <= d(x, nearest) + 2r, so that two documents that link meet in the cell of either. Cells are families
   of the next round. A family whose cells aren't clearly smaller than itself, or hold its documents over and over, is
   joined by pairs of blocks.

Inside a task a join goes on in the same way: pivots, Voronoi cells, windows, and all pairs in small cells. Pairs whose
documents are already connected are not looked at. Results are exact up to collisions of 64-bit hashes.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wherewhen.llm.common import chunked, driver_table, light, light_map, light_pair, narrow_files, settled, text_size, without
from wherewhen.llm.components import components
from wherewhen.llm.grams import squeeze, unsqueeze
from wherewhen.llm.substring_dedup import CHUNK_BYTES, SHARD_WINDOWS, SKETCH_DDL, least_cells, sketch_cells, sketch_rows
from wherewhen.llm.textops import Words, binary_views, blocks, pack, shard_of, spans_hash, text_bytes, unpack, windows

WIDTH = 5
#: d <= RADIUS is 100 * shared >= 75 * either.
RADIUS = 0.25
#: Of a shard of postings, one for each 100 bytes of text; about three times as many come.
SHARD_ENTRIES = 1 << 19
#: What a task joins at once: up to so many documents, and so many bytes of their shingles (or one document).
BLOCK_MEMBERS, BLOCK_BYTES = 2_000, 8 << 20
#: Pivots of a family that is larger than a block.
PIVOTS = 24
#: Times that windows may replicate a family's documents, all in all.
MOST_COPIES = 4
LEAF = 32


def shingles(texts: list[bytes], width: int = WIDTH) -> list[np.ndarray]:
    """For each text the sorted hashes of its different shingles, A-Z lower-cased; texts of fewer words have one, of no words none."""
    out = []
    for a, b in blocks(texts):
        w = Words(texts[a:b], lower=True)
        words = w.hashes()
        h, _, _ = windows(words, w.first, width)
        n = np.diff(w.first)
        short = np.flatnonzero((n > 0) & (n < width))
        whole = dict(zip(short.tolist(), spans_hash(words, w.first[:-1][short], w.first[1:][short], 1), strict=True))
        edge = np.concatenate([[0], np.cumsum(np.maximum(n - width + 1, 0))])
        out += [np.unique(h[edge[i] : edge[i + 1]]) if n[i] >= width else np.array([whole[i]] if i in whole else [], dtype=np.uint64) for i in range(b - a)]
    return out


def links(shared: int, x: int, y: int) -> bool:
    return shared > 0 and 100 * shared >= 75 * (x + y - shared)


def distance(x: np.ndarray, y: np.ndarray, nx: int, ny: int) -> tuple[float, bool]:
    """(Jaccard distance, whether they link) of sets of nx and ny elements; x and y are sorted, without elements of one set alone."""
    if not len(x) or not len(y):
        return 1.0, False
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = len(y) - 1
    shared = int((y[at] == x).sum())
    return 1 - shared / (nx + ny - shared), links(shared, nx, ny)


class Regions:
    """The recursive join of some documents' sets; component: what is connected beforehand."""

    def __init__(self, ids: list[int], sets: list[np.ndarray], sizes: list[int], component: list[int]):
        self.ids, self.sets, self.sizes, self.component = ids, sets, sizes, component
        first = {}
        self.root = [first.setdefault(c, i) for i, c in enumerate(component)]

    def top(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = self.root[self.root[i]]
            i = self.root[i]
        return i

    def measure(self, i: int, j: int) -> float:
        d, near = distance(self.sets[i], self.sets[j], self.sizes[i], self.sizes[j])
        if near and self.top(i) != self.top(j):
            self.root[self.top(i)] = self.top(j)
        return d

    def stars(self) -> list[tuple[int, int]]:
        """Of what is connected now the components that weren't: from the least of each group to the others."""
        groups: dict[int, set[int]] = {}
        for i, c in enumerate(self.component):
            groups.setdefault(self.top(i), set()).add(c)
        return [(min(g), c) for g in groups.values() for c in sorted(g)[1:]]

    def join(self, members: list[int]) -> None:
        """Finds links until all pairs of members are connected, or known not to link."""
        if len({self.top(i) for i in members}) < 2:
            return
        if len(members) <= LEAF:
            self.pairs(members, None)
            return
        by_size = sorted(members, key=lambda i: (self.sizes[i], self.ids[i]))
        count = max(2, min(24, int(math.sqrt(len(members)))))
        pivots = [by_size[int((k + 0.5) * len(by_size) / count)] for k in range(count)]
        d = np.array([[self.measure(i, p) if i != p else 0.0 for p in pivots] for i in members])
        near = d.min(axis=1)
        cells = [np.flatnonzero(d[:, k] <= near + 2 * RADIUS + 1e-12) for k in range(count)]
        if max(len(c) for c in cells) > 0.7 * len(members):
            self.pairs(members, d)  # the windows hold nearly everything; the distances to the pivots still rule pairs out
            return
        for c in cells:
            self.join([members[i] for i in c])

    def pairs(self, members: list[int], d) -> None:
        n = np.array([self.sizes[i] for i in members])
        for k, i in enumerate(members):
            ok = (np.minimum(n, n[k]) * 4 >= np.maximum(n, n[k]) * 3) & (np.arange(len(members)) > k)
            if d is not None:
                ok &= (np.abs(d - d[k]) <= RADIUS + 1e-12).all(axis=1)
            own = self.top(i)
            for j in np.flatnonzero(ok):
                if self.top(members[j]) != own:
                    self.measure(i, members[j])
                    own = self.top(i)


TESTED = np.uint64(1 << 63)


def _tested(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The different shingles of a chunk whose hash's top bit is 0, and in how many of its texts each is."""
    return np.unique(np.concatenate([s[: np.searchsorted(s, TESTED)] for s in sets] or [np.zeros(0, dtype=np.uint64)]), return_counts=True)


def _sketch(shards: int):
    def visit(table: pa.Table) -> pa.Table:
        return sketch_rows(table, *_tested(shingles(text_bytes(table.column("text")))), shards)

    return visit


def _estimate(table: pa.Table) -> pa.Table:
    """The least cell of each shingle, up to 255."""
    least, size = least_cells(table)
    found = [squeeze(np.minimum(x, 255).astype(np.uint8).tobytes()) for x in np.split(least, np.cumsum(size)[:-1])]
    return pa.table({"chunk": table.column("chunk"), "shard": table.column("shard"), "least": pa.array(found, pa.binary())})


def _candidates(shards: int):
    """(doc_id, n) of each text; for those that may link also the set and the rarest shingles that others have too."""

    def visit(table: pa.Table, answers: pa.Table) -> pa.Table:
        sets = shingles(text_bytes(table.column("text"))) if table.num_rows else []
        distinct = _tested(sets)[0]
        often = np.zeros(len(distinct), dtype=np.int64)
        by_shard = dict(zip(answers.column("shard").to_pylist(), answers.column("least").to_pylist(), strict=True)) if len(distinct) else {}
        for shard, a, _, order, _ in sketch_cells(distinct, shards):
            often[a + order] = np.frombuffer(unsqueeze(by_shard[shard])[0], dtype=np.uint8)
        known = [i is not None for i in table.column("doc_id").to_pylist()] if table.num_rows else []
        rest, rare = [], []
        for s, ok in zip(sets, known, strict=True):
            k = len(s) - (75 * len(s) + 99) // 100 + 1
            cut = int(np.searchsorted(s, TESTED))
            times = often[np.searchsorted(distinct, s[:cut])]
            alone = int((times < 2).sum())
            if not ok or not len(s) or alone >= k:
                rest.append(None), rare.append(None)
                continue
            order = np.concatenate([np.argsort(times, kind="stable"), np.arange(cut, len(s))])
            rest.append(np.concatenate([s[:cut][times >= 2], s[cut:]]).tobytes())
            rare.append(s[order[alone:k]].tobytes())
        doc = table.column("doc_id") if table.num_rows else pa.array([], pa.int64())
        return pa.table({"doc_id": doc, "n": pa.array([len(s) for s in sets], pa.int64()), "set": pa.array(rest, pa.binary()), "rare": pa.array(rare, pa.binary())})

    return visit


def _postings(shards: int):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [np.frombuffer(x, dtype=np.uint64) for x in batch.column("rare").to_pylist()]
            doc = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
            ids, sizes = np.array(batch.column("doc_id").to_pylist(), dtype=np.int64), np.array(batch.column("n").to_pylist(), dtype=np.int64)
            key = np.concatenate(keys)
            order = np.argsort(key, kind="stable")
            key, doc = key[order], doc[order]
            edge, rows = np.searchsorted(shard_of(key, shards), np.arange(shards + 1)), []
            for s in range(shards):
                lo, hi = int(edge[s]), int(edge[s + 1])
                if hi > lo:
                    here, at = np.unique(doc[lo:hi], return_inverse=True)
                    rows.append((s, pack(np.diff(key[lo:hi], prepend=np.uint64(0))), pack(at), ids[here].tobytes(), sizes[here].tobytes()))
            out = list(zip(*rows, strict=True)) if rows else [()] * 5
            yield pa.record_batch({"shard": pa.array(out[0], pa.int32()), **{c: pa.array(x, pa.binary()) for c, x in zip(("keys", "at", "ids", "sizes"), out[1:], strict=True)}})

    return run


def _families(table: pa.Table) -> pa.Table:
    """(pivot, member, n, times) from the postings of one shard; n: the size of the member's set."""
    key = np.concatenate([np.cumsum(unpack(k.as_py()).astype(np.uint64)) for k in table.column("keys")])
    order = np.argsort(key, kind="stable")
    new = np.append(True, key[order[1:]] != key[order[:-1]])
    many = np.zeros(len(key), dtype=bool)
    many[order[np.diff(np.append(np.flatnonzero(new), len(key)))[np.cumsum(new) - 1] > 1]] = True
    key, begin, doc, size = key[many], 0, [], []
    del order, new
    for a, i, n in zip(*(table.column(c) for c in ("at", "ids", "sizes")), strict=True):  # only of shingles that several have
        at = unpack(a.as_py())
        at, begin = at[many[begin : begin + len(at)]], begin + len(at)
        doc.append(np.frombuffer(i.as_py(), dtype=np.int64)[at])
        size.append(np.frombuffer(n.as_py(), dtype=np.int64)[at])
    doc, size = np.concatenate(doc), np.concatenate(size)
    grade = np.floor(np.log(size) / math.log(4 / 3) + 1e-9).astype(np.int64)
    # a region is a shingle and a size class; each document stands in its own class and, as the window, in the one below
    order = np.lexsort((doc, grade, key)) if len(key) else np.zeros(0, dtype=np.int64)
    key, doc, grade, size = key[order], doc[order], grade[order], size[order]
    head = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (grade[1:] != grade[:-1]))) if len(key) else np.zeros(0, dtype=np.int64)
    count = np.diff(np.append(head, len(key)))
    pivot = np.repeat(doc[head], count)
    below = np.zeros(len(head), dtype=bool)
    below[1:] = (key[head][1:] == key[head][:-1]) & (grade[head][1:] == grade[head][:-1] + 1)
    lower = np.repeat(np.where(below, np.append(0, doc[head][:-1]) if len(head) else 0, 0), count)
    has = np.repeat(below, count)
    pivot, member, n = np.concatenate([pivot, lower[has]]), np.concatenate([doc, doc[has]]), np.concatenate([size, size[has]])
    order = np.lexsort((n, member, pivot))
    order = order[pivot[order] != member[order]]
    pivot, member, n = pivot[order], member[order], n[order]
    head = np.flatnonzero(np.append(True, (pivot[1:] != pivot[:-1]) | (member[1:] != member[:-1]) | (n[1:] != n[:-1]))[: len(n)])
    return pa.table({"pivot": pa.array(pivot[head]), "member": pa.array(member[head]), "n": pa.array(n[head]), "times": pa.array(np.diff(np.append(head, len(n))).astype(np.int64))})


class _Group:
    """One block (or pair of blocks) of a family: its rows, their sets where Arrow has them, and which of them are pivots."""

    def __init__(self, table: pa.Table):
        self.family = table.column("family")[0].as_py()
        self.ids = table.column("member").to_pylist()
        self.lead = np.flatnonzero(np.array(table.column("lead").to_pylist(), dtype=bool)).tolist()
        self.regions = Regions(self.ids, binary_views(table.column("set")), table.column("n").to_pylist(), table.column("component").to_pylist())

    def result(self, rows: list[tuple]) -> pa.Table:
        """The links found as (a, b), and rows of (center, member, d)."""
        out = [(a, b, None) for a, b in self.regions.stars()]
        a, b, d = (list(x) for x in zip(*out, strict=True)) if out else ([], [], [])
        center, member, far = (list(x) for x in zip(*rows, strict=True)) if rows else ([], [], [])
        n, m = len(a), len(rows)
        return pa.table({"family": pa.array([self.family] * (n + m), pa.int64()), "a": pa.array(a + [None] * m, pa.int64()), "b": pa.array(b + [None] * m, pa.int64()), "center": pa.array([None] * n + center, pa.int64()), "member": pa.array([None] * n + member, pa.int64()), "d": pa.array([None] * n + far, pa.float64())})


OUT = "family long, a long, b long, center long, member long, d double"


def _join(table: pa.Table) -> pa.Table:
    """The links among all rows."""
    group = _Group(table)
    for p in group.lead:
        for i in range(len(group.ids)):
            if i != p:
                group.regions.measure(i, p)
    group.regions.join(list(range(len(group.ids))))
    return group.result([])


def _measure(table: pa.Table) -> pa.Table:
    """The distance of each row to the nearest row of the family's pivot, and the links these make."""
    group = _Group(table)
    own = [i for i in range(len(group.ids)) if i not in set(group.lead)]
    return group.result([(group.ids[group.lead[0]], group.ids[i], min(group.regions.measure(i, p) for p in group.lead)) for i in own] if group.lead else [])


def _cells(table: pa.Table) -> pa.Table:
    """For each row the Voronoi cells that it goes to: that of the nearest pivot, and those in whose window it is."""
    group, rows = _Group(table), []
    for i in sorted(set(range(len(group.ids))) - set(group.lead)):
        far = {}
        for p in group.lead:
            d = group.regions.measure(i, p)
            far[group.ids[p]] = min(d, far.get(group.ids[p], 1.0))
        near = min(far.values())
        rows += [(p, group.ids[i], d) for p, d in far.items() if d <= near + 2 * RADIUS + 1e-12]
    return group.result(rows)


def _blocked(families: DataFrame, sets: DataFrame, labels: DataFrame, leads: DataFrame) -> DataFrame:
    """(family, block, member, component, n, set, lead): families (family, member, n) in blocks of bounded size; leads (family, member): rows that every block of their family gets besides."""
    sizes = families.groupBy("family").agg(F.ceil(F.greatest(F.count("*") / BLOCK_MEMBERS, F.sum("n") * 8 / BLOCK_BYTES)).cast("int").alias("blocks"))
    own = families.select("family", "member").join(sizes, "family").select("family", F.pmod(F.xxhash64("member"), F.col("blocks")).cast("int").alias("block"), "member", F.lit(False).alias("lead"))
    lead = leads.join(sizes, "family").select("family", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "member", F.lit(True).alias("lead"))
    named = own.union(lead).join(labels.withColumnsRenamed({"id": "member"}), "member", "left").select("family", "block", "member", F.coalesce("component", "member").alias("component"), "lead")
    return named.join(sets.withColumnRenamed("doc_id", "member"), "member")


def _links(out: DataFrame) -> DataFrame:
    return out.where("b IS NOT NULL").select("a", "b")


def _recursive(open_: DataFrame, sets: DataFrame, labels: DataFrame, files: int) -> DataFrame:
    """The links among the members of families (family, member, n), as (a, b)."""
    none = driver_table(open_.sparkSession, {"family": [], "member": []}, "family long, member long")

    def sized(cells: DataFrame) -> DataFrame:
        sizes = cells.groupBy("family").agg(F.count("*").alias("members"), (F.sum("n") * 8).alias("bytes"))
        return cells.join(sizes, "family").withColumn("large", (F.col("members") > BLOCK_MEMBERS) | (F.col("bytes") > BLOCK_BYTES))

    todo = settled(sized(open_), "sized", files)
    found, leaves, stuck, large = [], [todo.where("NOT large")], [], todo.where("large")
    while not large.isEmpty():
        named = large.join(labels.select(F.col("id").alias("member"), "component"), "member", "left").withColumn("component", F.coalesce("component", "member"))
        # a pivot is a document of some component, of those whose hashes fall together the one with the least hash
        leads = named.groupBy("family", F.pmod(F.xxhash64("component", "family"), F.lit(PIVOTS)).alias("_spot")).agg(F.min_by("member", F.struct(F.xxhash64("member", "family"), "member")).alias("member")).select("family", "member")
        out = settled(_blocked(large, sets, labels, settled(leads, "pivots", files)).groupBy("family", "block").applyInArrow(light(_cells), OUT), "cells")
        found.append(_links(out))
        cells = out.where("center IS NOT NULL").select("family", "center", "member").distinct().join(large.select("family", "member", "n", F.col("members").alias("_all")), ["family", "member"])
        own = cells.groupBy("family", "center").agg(F.count("*").alias("own"), F.max("_all").alias("_all"))
        tells = own.groupBy("family").agg(((F.max("own") < 0.7 * F.max("_all")) & (F.sum("own") <= MOST_COPIES * F.max("_all"))).alias("split"))
        tells = settled(tells, "splits", files)
        stuck.append(large.join(tells.where("NOT split"), "family", "left_semi"))
        todo = settled(sized(cells.join(tells.where("split"), "family", "left_semi").select(F.xxhash64("family", "center").alias("family"), "member", "n")), "sized", files)
        leaves.append(todo.where("NOT large"))
        large = todo.where("large")
    rows = _blocked(reduce(DataFrame.union, [x.select("family", "member", "n") for x in leaves]), sets, labels, none).withColumn("pair", F.lit("0"))
    if stuck:
        whole = _blocked(reduce(DataFrame.union, [x.select("family", "member", "n") for x in stuck]), sets, labels, none)
        blocks_ = whole.select("family", "block").distinct()
        pair = blocks_.join(blocks_.select("family", F.col("block").alias("other")), "family").where("block <= other")
        pair = pair.select("family", F.concat_ws("-", "block", "other").alias("pair"), F.explode(F.array_distinct(F.array("block", "other"))).alias("block"))
        rows = rows.unionByName(whole.join(pair, ["family", "block"]))
    found.append(_links(settled(rows.groupBy("family", "pair").applyInArrow(light(_join), OUT), "links")))
    return reduce(DataFrame.union, found)


def merged(labels: DataFrame, links: DataFrame, files: int) -> DataFrame:
    """(id, component) after links (a, b) between the components of labels, or documents without one: only what the links join is worked out anew."""
    more = components(links, files)
    moved = labels.join(more.select(F.col("id").alias("component"), F.col("component").alias("_top")), "component", "left").select("id", F.coalesce("_top", "component").alias("component"))
    return settled(moved.unionByName(more.join(labels.select("id"), "id", "left_anti").select("id", "component")), "labels", files)


def linked_components(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((doc_id, n) for every row, (id, component) for every doc_id that links with another)."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = text_size(rows)
    shards, files = max(16, math.ceil(size / 10 / SHARD_WINDOWS)), narrow_files(size)
    texts = chunked(rows, size, chunk_bytes=CHUNK_BYTES)
    sketch = texts.groupBy("chunk").applyInArrow(light(_sketch(shards)), SKETCH_DDL)
    often = sketch.groupBy("shard").applyInArrow(light(_estimate), "chunk long, shard long, least binary")
    seen = settled(texts.groupBy("chunk").cogroup(often.groupBy("chunk")).applyInArrow(light_pair(_candidates(shards)), "doc_id long, n long, set binary, rare binary"), "candidates")
    counts, sets = seen.select("doc_id", "n"), seen.where("set IS NOT NULL").select("doc_id", "n", "set")
    parts = max(16, math.ceil(size / 100 / SHARD_ENTRIES))
    postings = seen.where("set IS NOT NULL").select("doc_id", "n", "rare").mapInArrow(light_map(_postings(parts)), "shard int, keys binary, at binary, ids binary, sizes binary")
    families = postings.groupBy("shard").applyInArrow(light(_families), "pivot long, member long, n long, times long")
    families = settled(families.groupBy("pivot", "member").agg(F.sum("times").alias("times"), F.max("n").alias("n")), "families", files)

    best = families.groupBy("member").agg(F.max_by(F.struct("pivot", "n"), F.struct("times", -F.col("pivot"))).alias("best")).select(F.col("best.pivot").alias("family"), "member", F.col("best.n").alias("n"))
    lead = lambda f: f.select("family", F.col("family").alias("member")).distinct()
    none = driver_table(spark, {"id": [], "component": []}, "id long, component long")
    links_ = _links(settled(_blocked(best, sets, none, lead(best)).groupBy("family", "block").applyInArrow(light(_join), OUT), "links"))
    labels = components(links_, files)

    def mixed() -> DataFrame:
        """The families that hold several components."""
        named = families.join(labels.select(F.col("id").alias("member"), F.col("component").alias("c")), "member", "left").join(labels.select(F.col("id").alias("pivot"), F.col("component").alias("pc")), "pivot", "left")
        own, top = F.coalesce("c", "member"), F.coalesce("pc", "pivot")
        some = named.groupBy("pivot").agg((F.min(own) != F.max(own)).alias("inside"), F.max(own != top).alias("outside")).where("inside OR outside").select("pivot")
        return settled(families.join(some, "pivot").select(F.col("pivot").alias("family"), "member", "n"), "open-families", files)

    open_ = mixed()
    if not open_.isEmpty():
        far = settled(_blocked(open_, sets, labels, lead(open_)).groupBy("family", "block").applyInArrow(light(_measure), OUT), "distances")
        near = _links(far)
        if not near.isEmpty():
            labels = merged(labels, near, files)
            open_ = mixed()
        d = far.where("center IS NOT NULL").select("family", "member", "d")
        outer = d.where(F.col("d") > RADIUS).groupBy("family").agg(F.min("d").alias("edge"))
        window = d.join(outer, "family").where(F.col("d") >= F.col("edge") - RADIUS - 1e-9).select("family", "member").distinct()
        kept = settled(open_.join(window, ["family", "member"]), "windows", files)
        more = _recursive(kept, sets, labels, files)
        if not more.isEmpty():
            labels = merged(labels, more, files)
    return counts, labels


def jaccard_components(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id (the smallest doc_id that links lead to).

    Null texts and texts without words have no shingles and link with nothing. A row with a null doc_id links
    with nothing and has no component. Rows that share a doc_id are one document with several texts: a link of
    one is a link of all. An empty table gives an empty result; columns other than doc_id and text are ignored.
    """
    counts, labels = linked_components(docs)
    return counts.join(labels, counts["doc_id"] == labels["id"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, without those that link to a smaller doc_id. Rows that share a doc_id, or have none, all stay."""
    _, labels = linked_components(docs)
    return without(docs, labels.where("component < id").select(F.col("id").alias("doc_id")))
