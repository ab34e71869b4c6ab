import random
import tracemalloc
import zlib

import numpy as np
import pytest

from wherewhen.llm.token_files import TokenFile, WordEncoder, encode, token_files

public_tokenizers = pytest.importorskip("public_tokenizers")
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def test_round_trip_and_random_access():
    rnd = np.random.default_rng(3)
    ids = np.concatenate([rnd.integers(0, 300, 3000), rnd.integers(0, 1 << 20, 2000), rnd.integers(0, 1 << 32, 50), [0, 255, 256, 65535, 65536]]).astype(np.uint32)
    rnd.shuffle(ids)
    starts = np.array([0, 10, 10, 4000, len(ids)])
    f = TokenFile(encode(np.array([3, 5, 7, 9]), starts, ids))
    assert f.starts.tolist() == starts.tolist() and f.doc_ids.tolist() == [3, 5, 7, 9]
    assert (f.tokens(0, len(ids)) == ids).all()
    assert all((f.tokens(a, b) == ids[a:b]).all() for a, b in [(0, 0), (10, 10), (511, 513), (700, 3001), (len(ids) - 1, len(ids))])
    assert [f.token(i) for i in range(len(ids))] == ids.tolist()


def test_empty_file():
    f = TokenFile(encode(np.zeros(0, dtype=np.int64), np.zeros(1), np.zeros(0, dtype=np.uint32)))
    assert len(f.tokens(0, 0)) == 0


def test_matches_the_library(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    rnd = random.Random(2)
    odd = ["", None, " \t\n", "It's <|endoftext|>x <|startoftext|> don't", "e\u0301 \u0301 \u00a0a\u2003b ΑΣ Σ", "日本語 x" * 50, "a" * 5000, "9.5%% $$ !!", "it's it 's ' s", "\u0130stanbul \u212b ﬁ ǅ ª straße ΣΑΣ. ñ, co\u0301mo.", "x.y a,b, ..., .,"]
    texts = odd + [" ".join(rnd.choice(["The", "of", "ing,", "ü", "'re", "1234", "\n"]) for _ in range(200)) for _ in range(20)]
    rows = [(i * 3, x) for i, x in enumerate(texts)] + [(6, "twice"), (None, "no id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = token_files(df, TOKENIZER).orderBy("start").collect()
    at = 0
    expected = []
    for i, x in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = t.encode(x or "", add_special_tokens=False).ids + [1]
        expected.append((i, at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        at += len(ids)
    assert [tuple(r) for r in got] == expected


def test_empty_table(spark):
    assert token_files(spark.createDataFrame([], "doc_id long, text string"), TOKENIZER).collect() == []


def test_known_words_are_bounded():
    encoder = WordEncoder(TOKENIZER)
    tracemalloc.start()
    for k in range(40):
        encoder([b" ".join(b"w%s." % format(i, "x").translate({ord(c): "ghijklmnop"[int(c)] for c in "0123456789"}).encode() for i in range(15_000 * k, 15_000 * (k + 1)))])
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 80 * 1_000_000 and b"." in encoder.known and not any(w[-1:] == b"." and len(w) > 1 for w in encoder.known)


def test_ends_of_words_as_the_library():
    from tokenizers import Tokenizer

    t, encoder = Tokenizer.from_file(TOKENIZER), WordEncoder(TOKENIZER)
    texts = ["Fox. fox, a.b c., d.. e.\tf.\x0bg,\x0ch.\x1ci.\u00a0j.\u2003k. \u00e9. e\u0301. 1. x1. .", "a.", ",", "It's. <|endoftext|>. End.", "z,\ny.\r\n"]
    for _ in range(2):  # unknown and known
        got = encoder([x.encode() for x in texts])
        assert [np.frombuffer(g, "<u4").tolist() for g in got] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_new_words_go_straight_to_the_model(monkeypatch):
    encoder = WordEncoder(TOKENIZER)
    monkeypatch.setattr(encoder, "_ids", lambda text: pytest.fail(f"the whole tokenizer for {text!r}"))
    text = " ".join(f"{a}oul{b}nd" for a in "bcdf\u00e9\u00df\u00f1" for b in "gh\u00fc\u00ff")
    assert len(encoder([text.encode(), text.replace("oul", "OUL").encode()])) == 2
    assert len(encoder.known) == 28  # each different word once


def test_cuts_at_punctuation_as_the_library(tmp_path):
    import json

    from tokenizers import Tokenizer

    marks, ends = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", ["", "s", "S", "'re", "\u0301", "\u0338", ".", "5", "\u00e9", "\u00a0", "<|endoftext|>"]
    texts = [f"{a}{m}{e} {m}{a}" for a in ("abc", "Ab", "caf\u00e9", "\u00c9t", "\u00f7", "x7", "e\u0301", "\u03a3") for m in (*marks, "***", ".***", "'s", "'ll.") for e in ends]
    texts += ["".join(texts), " ".join(texts), "\n".join(t for t in texts if "<|" not in t), "a<|endoftext|>.b, c***", "<|ENDOFTEXT|>", "\u00ff\u00df. " + "\u00fc" * 300, "\u0130. \u212a! \ufb01?"]
    plain = json.load(open(TOKENIZER, encoding="utf-8"))
    cased = {**plain, "normalizer": {"type": "NFC"}}
    other = {**plain, "normalizer": {"type": "Sequence", "normalizers": [*plain["normalizer"]["normalizers"], {"type": "Replace", "pattern": {"String": "ab"}, "content": "q"}]}}
    for name, form, direct in (("plain", plain, True), ("cased", cased, True), ("other", other, False)):
        path = tmp_path / f"{name}.json"
        path.write_text(json.dumps(form), encoding="utf-8")
        t, encoder = Tokenizer.from_file(str(path)), WordEncoder(str(path))
        assert (encoder.model is not None) == direct
        expected = [t.encode(x, add_special_tokens=False).ids for x in texts]
        for _ in range(2):  # unknown and known
            assert [np.frombuffer(g, "<u4").tolist() for g in encoder([x.encode() for x in texts])] == expected
        assert [np.frombuffer(encoder([x.encode()])[0], "<u4").tolist() for x in texts] == expected
    assert encoder([]) == [] and encoder([b"", b" \n"]) == [b"", b""]
