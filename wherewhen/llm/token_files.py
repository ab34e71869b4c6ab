"""Token files with directly addressable codes.

A file holds the token ids of consecutive documents. Every id is split into chunks of 8 bits. Level 0 has the
lowest chunk of all ids, level k the k-th chunk of the ids that need it; a bitmap for each level marks the
entries that continue on the next level, and a rank directory counts the marks before every 512th entry. The
chunk of entry i on the next level thus stands at rank(i), so any token can be read without decoding others.

Layout, little endian: magic ``DACT``, u32 levels, u64 documents, u64 tokens, u64 documents without an id (they
come first); i64 doc ids, u64 first token of each document and the end; for each level u64 entries, the chunks, the bitmap (LSB first), the u64 ranks.
"""

from __future__ import annotations

import json
import math
import re
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wherewhen.llm.common import keep, light_map, settled, shared_dir, text_size
from wherewhen.llm.textops import Words, ranges, sizes_of, text_bytes

MAGIC = b"DACT"
RANK_EVERY = 512
#: Text bytes that are encoded at a time.
BLOCK_BYTES = 2 << 20
#: Words of one generation; two generations have some 150 bytes a word, in every worker.
MAX_CACHED_WORDS = 200_000
_LETTER = np.array([chr(i).isalpha() and i < 128 for i in range(256)])
_PUNCTUATION = np.array([32 < i < 127 and not chr(i).isalnum() for i in range(256)])
#: A word of the lower-case letters of ASCII and Latin-1, in UTF-8.
PLAIN = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")
#: The characters that stand for bytes in a byte-level vocabulary, as far as they are not those of Latin-1.
BYTE_LEVEL = {b: 256 + k for k, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174))}
#: What a tokenizer does before its model that leaves PLAIN words as they are, each a word for the model, and splits
#: letters from punctuation.
PLAIN_NORMALIZERS = ({"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"})
PLAIN_SPLITS = (
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
)


def encode(doc_ids: np.ndarray, starts: np.ndarray, ids: np.ndarray, nulls: int = 0) -> bytes:
    """The bytes of one file. starts: the first token of each document and the number of tokens; nulls: documents without an id."""
    levels, rest = [], ids.astype(np.uint32, copy=False)
    while True:
        more = rest >= 256
        marks = np.packbits(more, bitorder="little")
        count = np.count_nonzero(more[: len(more) // RANK_EVERY * RANK_EVERY].reshape(-1, RANK_EVERY), axis=1)
        ranks = np.append(0, np.cumsum(count))[: -(-len(more) // RANK_EVERY)]
        levels.append((len(rest), rest.astype(np.uint8).tobytes(), marks.tobytes(), ranks.astype("<u8").tobytes()))  # the lowest 8 bits
        if not more.any():
            break
        rest = rest[more]
        rest >>= np.uint32(8)
    head = MAGIC + struct.pack("<IQQQ", len(levels), len(doc_ids), len(ids), nulls) + doc_ids.astype("<i8").tobytes() + starts.astype("<u8").tobytes()
    del rest, more
    return b"".join([head, *(x for n, *parts in levels for x in (struct.pack("<Q", n), *parts))])


class TokenFile:
    """Random access to one file's bytes (or a memory map of it)."""

    def __init__(self, data):
        if bytes(data[:4]) != MAGIC:
            raise ValueError("not a token file")
        levels, n_docs, self.n_tokens, self.nulls = struct.unpack_from("<IQQQ", data, 4)
        at = 32
        self.doc_ids = np.frombuffer(data, "<i8", n_docs, at)
        at += 8 * n_docs
        self.starts = np.frombuffer(data, "<u8", n_docs + 1, at).astype(np.int64)
        at += 8 * (n_docs + 1)
        self.levels = []
        for _ in range(levels):
            (n,) = struct.unpack_from("<Q", data, at)
            chunks = np.frombuffer(data, np.uint8, n, at + 8)
            marks = np.frombuffer(data, np.uint8, (n + 7) // 8, at + 8 + n)
            at += 8 + n + len(marks)
            ranks = np.frombuffer(data, "<u8", -(-n // RANK_EVERY), at).astype(np.int64)
            at += 8 * len(ranks)
            self.levels.append((chunks, marks, ranks))

    def token(self, i: int) -> int:
        """The i-th id; touches one chunk, one bit and at most 512 bits of marks on each level."""
        value = 0
        for k, (chunks, marks, ranks) in enumerate(self.levels):
            value |= int(chunks[i]) << (8 * k)
            if not marks[i >> 3] >> (i & 7) & 1:
                break
            base = i // RANK_EVERY
            bits = np.unpackbits(marks[base * RANK_EVERY // 8 : (i >> 3) + 1], bitorder="little")
            i = int(ranks[base]) + int(bits[: i - base * RANK_EVERY].sum())
        return value

    def tokens(self, a: int, b: int) -> np.ndarray:
        """Ids a to b (exclusive), found through the ranks of a and of the entries that continue."""
        out, shift, where, lo, hi = np.zeros(max(0, b - a), dtype=np.uint32), 0, None, a, b
        for chunks, marks, ranks in self.levels:
            if hi <= lo:
                break
            got = chunks[lo:hi].astype(np.uint32) << np.uint32(shift)
            if where is None:
                out |= got
            else:
                out[where] |= got
            base = lo // RANK_EVERY
            bits = np.unpackbits(marks[base * RANK_EVERY // 8 : (hi + 7) >> 3], bitorder="little")
            skip = lo - base * RANK_EVERY
            mark = bits[skip : skip + hi - lo].astype(bool)
            where = np.flatnonzero(mark) if where is None else where[mark]
            lo = int(ranks[base]) + int(bits[:skip].sum())
            hi, shift = lo + len(where), shift + 8
        return out


def _leaves_plain(tokenizer) -> bool:
    """Whether PLAIN words reach the tokenizer's model as they are, each by itself, and letters are split from punctuation."""
    form = json.loads(tokenizer.to_str())
    steps = [(x or {}).get(name, [x] if x else []) for x, name in ((form["normalizer"], "normalizers"), (form["pre_tokenizer"], "pretokenizers"))]
    added = [t["content"] for t in form["added_tokens"]]
    return all(x in PLAIN_NORMALIZERS for x in steps[0]) and steps[1] == list(PLAIN_SPLITS) and all("<|" in t for t in added)


class WordEncoder:
    """text bytes -> ids as little-endian uint32.

    A text's ids are its words' ids in a row, as the tokenizer drops white space and splits at it. The different words
    of the texts are found by Arrow. New words go to the tokenizer, PLAIN ones straight to its model if all that the tokenizer
    does before leaves them as they are (model), others many at a time: words of letters alone with spaces between,
    where each ends with a token that ends a word, and the rest with a special token of the vocabulary between them. Words stay
    known for two generations of MAX_CACHED_WORDS words. Where the tokenizer is one that lower-cases and splits letters from
    punctuation (parts=True), A-Z are lower-cased first and a full stop or comma after a word's last letter is a word of its own;
    with model, a word also ends before any ASCII punctuation after a letter, but for texts that may hold special tokens.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.known, self.older = Tokenizer.from_file(path), {}, {}
        special = [(i, t.content) for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special and t.content.strip()]
        self.between = max(special, default=None)
        self.opens = b"<|" if special else b""
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.ends = np.zeros(self.tokenizer.get_vocab_size() + 1, dtype=bool)
        for token, i in self.tokenizer.get_vocab().items() if suffix else ():
            self.ends[i] = token.endswith(suffix)
        self.parts = self._ids("The QUICK, fox. a1.").tolist() == self._ids("the quick , fox . a1 .").tolist()
        self.model = self.tokenizer.model if _leaves_plain(self.tokenizer) else None

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")  # without offsets

    def _know(self, words: list[bytes], at: list[int], data: bytes) -> None:
        """The ids of words end at the places at of data."""
        self.known.update(zip(words, [data[4 * a : 4 * b] for a, b in zip([0, *at], at, strict=False)], strict=True))

    def _plain(self, words: list[bytes]) -> None:
        for k in range(0, len(words), 200):
            part = words[k : k + 200]
            found = [self.model.tokenize(w.decode() if w.isascii() else w.decode("latin-1").translate(BYTE_LEVEL)) for w in part]
            self._know(part, np.cumsum([len(x) for x in found]).tolist(), np.array([t.id for x in found for t in x], dtype="<u4").tobytes())

    def _encode(self, words: list[bytes]) -> None:
        if self.model:
            plain, rest = [], []
            for w in words:
                (plain if PLAIN.fullmatch(w) else rest).append(w)
            self._plain(plain)
            words = rest
        texts = [w.decode() for w in words]
        plain = [k for k, t in enumerate(texts) if self.parts and t.isalpha() and t.lower().isalpha()]
        done = set()
        for k in range(0, len(plain), 200):
            part = plain[k : k + 200]
            ids = self._ids(" ".join([texts[i] for i in part]))
            at, data = np.flatnonzero(self.ends[ids]) + 1, ids.tobytes()
            if len(at) == len(part) and at[-1] == len(ids):
                self._know([words[i] for i in part], at.tolist(), data)
                done.update(part)
        joint = [k for k, t in enumerate(texts) if k not in done and self.between and self.between[1] not in t]
        for k in range(0, len(joint), 200):
            part = joint[k : k + 200]
            ids = self._ids("".join(texts[i] + self.between[1] for i in part))
            at, data = np.flatnonzero(ids == self.between[0]), ids.tobytes()
            self.known.update(zip([words[i] for i in part], [data[4 * a : 4 * b] for a, b in zip([0, *(at[:-1] + 1)], at, strict=True)], strict=True))
        for i in set(range(len(words))).difference(joint, done):
            self.known[words[i]] = self._ids(texts[i]).tobytes()

    def _words(self, texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """The different words of texts, which of them each word is, and the first word of each text and the end."""
        special = [bool(self.opens) and self.opens in t for t in texts]
        words = Words([t if x or not self.parts else t.lower() for t, x in zip(texts, special, strict=True)])
        begins = np.zeros(len(words.buf), dtype=bool)
        begins[words.starts] = True
        if self.parts:
            buf = words.buf
            mark = np.flatnonzero(_PUNCTUATION[buf])
            before = buf[mark - 1]  # of the first byte the last, which is a line feed
            after_letter = _LETTER[before]
            if self.model:
                after_letter |= (before >= 0x9F) & (before <= 0xBF) & (before != 0xB7) & (buf[mark - 2] == 0xC3)
            mark = mark[after_letter]
            ends_word = ((buf[mark] == ord(".")) | (buf[mark] == ord(","))) & ~words.inside[mark + 1]
            free = ~np.array(special)[np.searchsorted(words.at, mark, side="right") - 1] if any(special) else True
            cut = mark[ends_word | free if self.model else ends_word]
            begins[cut] = True
            words.first += np.searchsorted(cut, words.at)
        at = np.append(np.flatnonzero(begins[words.inside]), np.count_nonzero(words.inside)).astype(np.int32)
        column = pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(words.buf[words.inside])]).dictionary_encode()
        _, at, data = column.dictionary.buffers()
        at, data = np.frombuffer(at, dtype=np.int32, count=len(column.dictionary) + 1).tolist(), data.to_pybytes() if data else b""
        return [data[a:b] for a, b in zip(at, at[1:], strict=False)], column.indices.to_numpy(), words.first

    def _found(self, words: list[bytes]) -> list[bytes]:
        """The ids of different words."""
        if len(self.known) > MAX_CACHED_WORDS:
            self.known, self.older = {}, self.known
        found = list(map(self.known.get, words))
        new = [i for i, x in enumerate(found) if x is None]
        old = [(words[i], self.older[words[i]]) for i in new if words[i] in self.older]  # never walks through what is known
        self.known.update(old)
        self._encode([words[i] for i in new if words[i] not in self.known])
        for i in new:
            found[i] = self.known[words[i]]
        return found

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        words, which, first = self._words(texts)
        found = self._found(words)
        size = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) >> 2
        begin = np.cumsum(size) - size
        n = size[which]
        end = np.concatenate([[0], np.cumsum(n)])
        ids = np.frombuffer(b"".join(found), dtype="<u4")[np.repeat(begin[which] - end[:-1], n) + np.arange(end[-1])].tobytes()
        at = (4 * end[first]).tolist()
        return [ids[a:b] for a, b in zip(at, at[1:], strict=False)]


_ENCODERS: dict[str, WordEncoder] = {}


def _encoder(path: str) -> WordEncoder:
    """One for each worker process, which many tasks use; it goes when another operator uses the worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    keep("token_files", _ENCODERS.clear)
    return _ENCODERS[path]


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _writer(folder: str, tokenizer: str, end_id: int, file_tokens: int):
    end = np.array([end_id], dtype="<u4").tobytes()

    def write(batches):
        part, run, encode_texts = TaskContext.get().partitionId(), 0, _encoder(tokenizer)
        ids, docs, sizes = bytearray(), [], []

        def flush():
            nonlocal run, ids
            starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
            data = encode(np.array([d or 0 for d in docs], dtype=np.int64), starts, np.frombuffer(ids, dtype="<u4"), docs.count(None))
            uri = f"{folder}/tokens-{part:06d}-{run:06d}.dac"
            system, path = _open(uri)
            own = f"{path}.{uuid.uuid4().hex}"  # a task that runs twice puts the same bytes in the same place
            with system.open_output_stream(own) as out:
                out.write(data)
            system.move(own, path)
            row = pa.record_batch({"part": pa.array([part], pa.int64()), "run": pa.array([run], pa.int64()), "uri": [uri], "n_docs": pa.array([len(docs)], pa.int64()), "n_tokens": pa.array([int(starts[-1])], pa.int64())})
            run, ids = run + 1, bytearray()
            docs.clear(), sizes.clear()
            return row

        held = 0
        for batch in batches:
            numbers = batch.column("doc_id").to_pylist()
            for a, b in ranges(sizes_of(batch.column("text")), BLOCK_BYTES):
                for doc, got in zip(numbers[a:b], encode_texts(text_bytes(batch.column("text").slice(a, b - a))), strict=True):
                    ids += got
                    ids += end
                    docs.append(doc)
                    sizes.append(len(got) // 4 + 1)
                    held += sizes[-1]
                    if held >= file_tokens:
                        yield flush()
                        held = 0
        if docs:
            yield flush()

    return write


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 1, file_tokens: int = 1 << 22) -> DataFrame:
    """Encodes all texts and writes files in ascending doc_id order; returns the manifest (part, run, uri, n_docs, n_tokens).

    Null texts are empty. Rows with a null doc_id come first; rows that share a doc_id are ordered by text. Every task writes files of its own under names that only depend on its rows,
    so a task that is run again replaces them. folder is a URI that executors can write to.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = max(1, math.ceil(text_size(rows) / (8 << 20)))
    ordered = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    system, path = _open(folder)
    system.create_dir(path, recursive=True)
    manifest = ordered.mapInArrow(light_map(_writer(folder, tokenizer, end_id, file_tokens), "token_files"), "part long, run long, uri string, n_docs long, n_tokens long")
    return settled(manifest.repartition(max(4, parts // 64)), "token-manifest")  # not a file for each task


def _read(batches):
    for batch in batches:
        for uri, base in zip(batch.column("uri").to_pylist(), batch.column("base").to_pylist(), strict=True):
            system, path = _open(uri)
            with system.open_input_file(path) as f:
                file = TokenFile(f.read())
            crc, starts = [], file.starts.tolist()
            for a, b in ranges(np.diff(file.starts).tolist(), 1 << 19):
                ids = memoryview(file.tokens(starts[a], starts[b]).astype("<u4", copy=False).tobytes())
                crc += [zlib.crc32(ids[4 * (x - starts[a]) : 4 * (y - starts[a])]) for x, y in zip(starts[a:b], starts[a + 1 : b + 1], strict=True)]
            yield pa.record_batch({"doc_id": pa.array(file.doc_ids, mask=np.arange(len(file.doc_ids)) < file.nulls), "start": pa.array(file.starts[:-1] + base), "n_tokens": pa.array(np.diff(file.starts)), "ids_crc32": pa.array(crc, pa.int64())})


def read_token_files(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files that the manifest lists."""
    before = Window.orderBy("part", "run").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    files = max(1, manifest.count())
    return placed.select("uri", "base").repartition(files).mapInArrow(light_map(_read, "token_files"), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Writes docs as token files in the shared folder and returns what reading them back gives; see write_token_files()."""
    folder = f"{shared_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    return read_token_files(write_token_files(docs, folder, tokenizer, end_id))
