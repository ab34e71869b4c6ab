"""Context-tree weighting over bytes.

A byte is eight binary decisions, each with a context tree of its own: a node is (the k bytes before, the bits
of this byte so far) for every k up to the depth. A node's Krichevsky-Trofimov estimate depends only on its
counts of zeros and ones, so the weighted probability of everything the tree has seen follows from corpus
counts: at the depth it is the estimate, above it half the estimate plus half the product of the children's.
The next bit's probability is the mixture of all depths' estimates with the posterior weights of stopping there.
"""

from __future__ import annotations

import numpy as np

HALF = np.log(0.5)


def lgamma(x: np.ndarray) -> np.ndarray:
    """log of the gamma function for x > 0: Stirling's series eight places on."""
    shift = np.zeros_like(x)
    for i in range(8):
        shift += np.log(x + i)
    z = x + 8
    return (z - 0.5) * np.log(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - shift


def kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov probability of n0 zeros and n1 ones in any order."""
    n0, n1 = n0.astype(np.float64), n1.astype(np.float64)
    return lgamma(n0 + 0.5) + lgamma(n1 + 0.5) - lgamma(n0 + n1 + 1) - 1.1447298858494002


class ContextTree:
    """order - 1 is the depth (3 at least). Codes are those of grams.gram_codes()."""

    def __init__(self, order: int = 5):
        if order < 4:
            raise ValueError("order is 4 at least")
        self.order, self.depth = order, order - 1

    def _nodes(self, codes: np.ndarray, k: int, j: int) -> np.ndarray:
        """The node of depth k that decides bit j of each code's byte."""
        byte = codes & np.uint64(255)
        prefix = np.uint64(1 << j) | (byte >> np.uint64(8 - j))
        return ((codes >> np.uint64(8 * (self.depth - k + 1))) << np.uint64(8)) | prefix

    def shard(self, codes: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes]:
        """Tables of depths 2 to the depth: nodes, weights, chances of a one; and what depth 1 needs."""
        bit = [((codes >> np.uint64(7 - j)) & np.uint64(1)).astype(np.float64) for j in range(8)]
        out, below = [], None
        for k in range(self.depth, 1, -1):
            nodes, at = np.unique(np.concatenate([self._nodes(codes, k, j) for j in range(8)]), return_inverse=True)
            ones = np.bincount(at, weights=np.concatenate([counts * b for b in bit]), minlength=len(nodes))
            zeros = np.bincount(at, weights=np.tile(counts, 8), minlength=len(nodes)) - ones
            own = kt(zeros, ones)
            if below is None:
                whole, weight = own, np.ones(len(nodes))
            else:
                parent = ((below[0] >> np.uint64(16)) << np.uint64(8)) | (below[0] & np.uint64(255))
                whole = HALF + np.logaddexp(own, np.bincount(np.searchsorted(nodes, parent), weights=below[1], minlength=len(nodes)))
                weight = np.exp(HALF + own - whole)
            below = nodes, whole
            out += [np.array([len(nodes)], dtype=np.int64).tobytes(), nodes.tobytes(), weight.tobytes(), ((ones + 0.5) / (zeros + ones + 1)).tobytes()]
        up = (((below[0] >> np.uint64(16)) << np.uint64(8)) | (below[0] & np.uint64(255))).astype(np.int64)
        share = [np.bincount(up, weights=w, minlength=65536) for w in (below[1], zeros, ones)]
        return b"".join(out), np.stack(share).tobytes()

    def low(self, shares: list[bytes]) -> bytes:
        """Weights and chances of depths 1 and 0."""
        product, zeros, ones = sum(np.frombuffer(x).reshape(3, 65536) for x in shares)
        own = kt(zeros, ones)
        whole = HALF + np.logaddexp(own, product)
        tables = [np.exp(HALF + own - whole), (ones + 0.5) / (zeros + ones + 1)]
        product, zeros, ones = (x.reshape(256, 256).sum(axis=0) for x in (whole - 0.0, zeros, ones))
        own = kt(zeros, ones)
        tables += [np.exp(HALF + own - (HALF + np.logaddexp(own, product))), (ones + 0.5) / (zeros + ones + 1)]
        return b"".join(t.tobytes() for t in tables)

    def scorer(self, model: bytes, low: bytes):
        tables, at = {}, 0
        for k in range(self.depth, 1, -1):
            n = int(np.frombuffer(model, np.int64, 1, at)[0])
            tables[k] = [np.frombuffer(model, kind, n, at + 8 + 8 * n * i) for i, kind in enumerate((np.uint64, np.float64, np.float64))]
            at += 8 + 24 * n
        low = np.frombuffer(low)
        first, root = (low[:65536], low[65536:131072]), (low[131072:131328], low[131328:131584])

        def score(codes: np.ndarray) -> np.ndarray:
            total = np.zeros(len(codes))
            for j in range(8):
                one = np.full(len(codes), 0.5)
                for k in range(self.depth, 1, -1):
                    nodes, weight, chance = tables[k]
                    if not len(nodes):
                        continue
                    node = self._nodes(codes, k, j)
                    at = np.minimum(np.searchsorted(nodes, node), len(nodes) - 1)
                    w, p = np.where(nodes[at] == node, weight[at], 0.5), np.where(nodes[at] == node, chance[at], 0.5)
                    one = w * p + (1 - w) * one
                for k, (weight, chance) in ((1, first), (0, root)):
                    at = (self._nodes(codes, k, j) & np.uint64(65535 if k else 255)).astype(np.int64)
                    one = weight[at] * chance[at] + (1 - weight[at]) * one
                bit = ((codes >> np.uint64(7 - j)) & np.uint64(1)).astype(bool)
                total += np.log10(np.where(bit, one, 1 - one))
            return total

        return score
