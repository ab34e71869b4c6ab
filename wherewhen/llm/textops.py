"""Vectorised text primitives shared by the operators of this subpackage.

All functions work on whole UTF-8 texts held in one NumPy byte buffer. A word is a maximal run of bytes
other than 0x20 and 0x09-0x0D, which is what the pattern ``[^\\x20\\x09-\\x0D]+`` matches. Null texts count
as empty. Hashes are 64 bit: polynomials over Z/2^64 taken from prefix sums, then mixed.
"""

from __future__ import annotations

import numpy as np

WORD_PATTERN = r"[^\x20\x09-\x0D]+"

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: All of ASCII but digits and letters.
NOT_ALNUM = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Odd multipliers of the polynomial hashes, one for each independent family.
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)
#: Powers are kept for so many places; farther ones are a product of two.
STEP = 1 << 14
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_MASK = (1 << 64) - 1


def _powers(base: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < STEP."""
    if base not in _POWERS:
        out = []
        for x in (base, pow(base, -1, 1 << 64)):
            run = np.full(STEP, x, dtype=np.uint64)
            run[0] = 1
            out.append(np.multiply.accumulate(run))
        _POWERS[base] = (out[0], out[1])
    return _POWERS[base]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def spans_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, family: int = 0) -> np.ndarray:
    """A 64-bit hash of values[s:e] for every span; equal spans have equal hashes wherever they stand."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    base = _BASES[family]
    up, down = _powers(base)
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    for a in range(0, len(values), STEP):
        part = values[a : a + STEP].astype(np.uint64)
        part += np.uint64(1)
        part *= up[: len(part)]
        part *= np.uint64(pow(base, a, 1 << 64))
        part[:1] += total[a : a + 1]
        np.cumsum(part, out=total[a + 1 : a + 1 + len(part)])
    far = np.array([pow(base, -a, 1 << 64) for a in range(0, len(values) + 1, STEP)], dtype=np.uint64)
    out = (total[ends] - total[starts]) * down[starts % STEP] * far[starts // STEP]
    return mix(out + (ends - starts).astype(np.uint64) * np.uint64(_BASES[(family + 1) % 4]))


class Words:
    """The words of many texts: byte spans, the text each belongs to, and each text's first word.

    ``first[i]:first[i + 1]`` are the words of text i. between says which bytes stand between words. buf has all texts, text
    i from at[i] on; inside says which of its bytes are in words.
    """

    def __init__(self, texts: list[bytes], lower: bool = False, between: np.ndarray = _SPACE):
        self.buf = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
        if lower:
            self.buf = _LOWER[self.buf]
        sizes = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
        at = np.zeros(len(texts) + 1, dtype=np.int64)
        np.cumsum(sizes + 1, out=at[1:])
        inside = ~between[self.buf]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if len(inside) and inside[0]:
            edge = np.concatenate([[0], edge])
        self.starts, self.ends = edge[0::2], edge[1::2]
        self.first = np.searchsorted(self.starts, at)
        self.at, self.inside = at, inside

    def hashes(self, family: int = 0) -> np.ndarray:
        return spans_hash(self.buf, self.starts, self.ends, family)


def ranges(sizes: list[int], size: int = 2_000_000):
    """Ranges of texts with these sizes that have about size bytes each, so that working arrays stay small; every text is whole."""
    begin, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > size:
            yield begin, i
            begin, held = i, 0
        held += n + 1
    if begin < len(sizes):
        yield begin, len(sizes)


def blocks(texts: list[bytes], size: int = 2_000_000):
    """ranges() of texts."""
    return ranges([len(t) for t in texts], size)


def windows(word_hashes: np.ndarray, first: np.ndarray, width: int, family: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all windows of width consecutive words inside one text, their texts and first words."""
    n = np.diff(first)
    count = np.maximum(n - width + 1, 0)
    text = np.repeat(np.arange(len(n)), count)
    begin = np.concatenate([[0], np.cumsum(count)[:-1]]) if len(n) else np.zeros(0, dtype=np.int64)
    start = np.arange(int(count.sum())) - begin[text] + first[:-1][text]
    return spans_hash(word_hashes, start, start + width, family), text, start


def text_bytes(column) -> list[bytes]:
    """The texts of an Arrow string column as bytes; null counts as empty."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def sizes_of(column) -> list[int]:
    """The bytes of each text of an Arrow string column; null counts as empty."""
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).to_pylist()


def binary_views(column, kind=np.uint64) -> list[np.ndarray]:
    """The values of an Arrow binary column (none null) as arrays that share its memory."""
    import pyarrow as pa

    out = []
    for chunk in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        _, at, data = chunk.buffers()
        edge = np.frombuffer(at, dtype=np.int32, count=len(chunk) + 1, offset=4 * chunk.offset) if len(chunk) else np.zeros(1, dtype=np.int32)
        size = np.dtype(kind).itemsize
        out += [np.frombuffer(data, dtype=kind, count=(b - a) // size, offset=a) if b > a else np.zeros(0, dtype=kind) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
    return out


def pack(values: np.ndarray) -> bytes:
    """Unsigned integers in as few bytes each as the largest needs, after one byte that says how many."""
    top = int(values.max()) if len(values) else 0
    for code, kind in enumerate((np.uint8, np.uint16, np.uint32, np.uint64)):
        if top <= np.iinfo(kind).max:
            return bytes([code]) + values.astype(kind).tobytes()
    raise ValueError("not unsigned integers")


def unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype=(np.uint8, np.uint16, np.uint32, np.uint64)[data[0]], offset=1)


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each hash; it ascends with the hash."""
    return ((hashes >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)
