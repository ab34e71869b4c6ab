"""Interpolated modified Kneser-Ney models over bytes, in the shards of grams.py.

The highest order has the counts themselves, an order below it for each of its n-grams the number of different
bytes seen before it. Each order takes a discount D1, D2 or D3+ from counts of 1, 2 or more and gives what it
took from a context to the order below; the lowest falls back on all 256 bytes alike. All counts that a shard's
n-grams need are in the shard, down to contexts of two bytes; those of one byte and none have 256 * 256 entries
and come from all shards, as do the counts of counts from which the discounts follow.
"""

from __future__ import annotations

import numpy as np


def discounts(of_counts: np.ndarray) -> np.ndarray:
    """D for counts of 0, 1, 2 and 3 or more, from how many n-grams have the counts 1 to 4; none where there are too few to tell."""
    n1, n2, n3, n4 = (float(x) for x in of_counts)
    if not n1 or not n2:
        return np.array([0.0, 0.5, 0.5, 0.5])
    y = n1 / (n1 + 2 * n2)
    d = [0.0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 2 - 3 * y * n3 / n2]
    return np.array([0.0, *(min(max(x, 0.01), k - 0.01) for k, x in enumerate(d[1:], 1))])


def of_counts(counts: np.ndarray) -> np.ndarray:
    return np.bincount(np.minimum(counts, 5).astype(np.int64), minlength=6)[1:5].astype(np.float64)


class Level:
    """One order: what its n-grams keep of their counts and what their contexts give away, both by the context's total."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray, d: np.ndarray):
        self.grams = grams
        self.contexts, at = np.unique(grams >> np.uint64(8), return_inverse=True)
        total = np.bincount(at, weights=counts, minlength=len(self.contexts))
        took = d[np.minimum(counts, 3).astype(np.int64)]
        self.kept = (counts - took) / total[at] if len(at) else np.zeros(0)
        self.given = np.bincount(at, weights=took, minlength=len(self.contexts)) / np.maximum(total, 1)

    def __call__(self, grams: np.ndarray, below: np.ndarray) -> np.ndarray:
        """Chances of the n-grams' last bytes, given those of the order below."""
        if not len(self.grams):
            return below
        at = np.minimum(np.searchsorted(self.contexts, grams >> np.uint64(8)), len(self.contexts) - 1)
        seen = self.contexts[at] == grams >> np.uint64(8)
        spot = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
        kept = np.where(self.grams[spot] == grams, self.kept[spot], 0.0)
        return np.where(seen, kept + self.given[at] * below, below)


class KneserNey:
    """order: 4 at least. Codes are those of grams.gram_codes(), so an order below drops the byte before the last one of a code."""

    def __init__(self, order: int = 4):
        if order < 4:
            raise ValueError("order is 4 at least")
        self.order = order

    @staticmethod
    def _shorter(grams: np.ndarray) -> np.ndarray:
        return ((grams >> np.uint64(16)) << np.uint64(8)) | (grams & np.uint64(255))

    def _tables(self, codes: np.ndarray, counts: np.ndarray):
        """(n-grams, counts) of the orders from the highest to three."""
        for _ in range(self.order, 2, -1):
            yield codes, counts
            codes, counts = np.unique(self._shorter(codes), return_counts=True)

    def shard(self, codes: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes]:
        found = list(self._tables(codes, counts))
        pairs = np.bincount(self._shorter(found[-1][0]).astype(np.int64), minlength=65536).astype(np.float64)
        share = np.concatenate([pairs, *(of_counts(c) for _, c in found)])
        return np.concatenate([codes, counts.astype(np.uint64)]).astype(np.uint64).tobytes(), share.tobytes()

    def low(self, shares: list[bytes]) -> bytes:
        return sum(np.frombuffer(x) for x in shares).tobytes()

    def scorer(self, model: bytes, low: bytes):
        model, low = np.frombuffer(model, dtype=np.uint64), np.frombuffer(low)
        codes, counts = model[: len(model) // 2], model[len(model) // 2 :].astype(np.float64)
        above = [Level(g, c, discounts(low[65536 + 4 * k : 65540 + 4 * k])) for k, (g, c) in enumerate(self._tables(codes, counts))]
        pairs = np.flatnonzero(low[:65536]).astype(np.uint64)
        two = Level(pairs, low[:65536][pairs.astype(np.int64)], discounts(of_counts(low[:65536][low[:65536] > 0])))
        single, before = np.unique(pairs & np.uint64(255), return_counts=True)
        one = Level(single, before.astype(np.float64), discounts(of_counts(before)))

        def score(grams: np.ndarray) -> np.ndarray:
            byte = grams & np.uint64(255)
            near = (grams >> np.uint64(8 * (self.order - 1))) << np.uint64(8) | byte
            p = two(near, one(byte, np.full(len(grams), 1 / 256)))
            for k in range(len(above) - 1, -1, -1):
                drop = np.uint64(8 * k)
                p = above[k](((grams >> np.uint64(8)) >> drop) << np.uint64(8) | byte, p)
            return np.log10(p)

        return score
