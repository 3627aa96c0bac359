import hashlib
import json
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lorespark.llm import bpe as B
from lorespark.llm import token_files as W

WORD, BYTE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
PARTS = ["a", "à", "b", " ", "  ", " \n", "É", "Σ", "ΑΣ ", "İ", "<|endoftext|>", "<|startoftext|>", "<|", "'s", " 's", "'RE", "\x1c", "\x85", "\xa0", "　", "\n", "\r", "\t", "你好", "１", "²", " 12", "á", "🎉", "'re", "​", "ß", "ing", "tion "]


def odd_texts(n=400, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 40))) for _ in range(n)] + ["", " ", "  ", "x" * 5000, "ab" * 3000, "tion" * 4000, "$" * 700]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 3 % 1009, t, "y") for i, t in enumerate(odd_texts())] + [(5000, None, "n"), (2, "again", "r"), (2, "again", "r")]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string")


def tokenizer(path):
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def test_encode_decode(docs):
    t, sha = tokenizer(WORD), lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for r in docs.collect():
        ids = t.encode(r["text"] or "", add_special_tokens=False).ids
        want.append((r["doc_id"], len(ids), sha(" ".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False))))
    assert sorted(map(tuple, B.encode_decode(docs, WORD, 50).collect())) == sorted(want)


def test_every_character():
    """Classes, cases, compositions and the order of marks are the library's, whatever Unicode version Python has."""
    with open(WORD, encoding="utf-8") as f:
        spec = json.load(f)
    b, t = B.WordBpe(spec, B.odd_characters(spec)), tokenizer(WORD)
    encoder = B.Encoder(b, B.Lexicon(B.compile_lexicon({b"the": b.merge("the")})))
    points = [c for c in [*range(0x3400), *range(0xA000, 0xAC10), *range(0xD700, 0xD800), *range(0xE000, 0xE010), *range(0xF8F0, 0x20000), *range(0x2A600, 0x2B900), *range(0xE0000, 0xE0200), 0x4E00, 0xF0000, 0x10FFFD] if not 0xD800 <= c < 0xE000]
    texts = [" ".join(f"a{chr(c)}b {chr(c)}{chr(c)}1 e{chr(c)}\u0301" for c in points[i : i + 16]) for i in range(0, len(points), 16)]
    for at in range(0, len(texts), 1000):
        some = texts[at : at + 1000]
        assert encoder.encode(some) == [x.ids for x in t.encode_batch(some, add_special_tokens=False)]


def test_words_beyond_the_lexicon_are_merged_side_by_side(monkeypatch):
    """Rare words cost no merging one by one, whatever their length below 65 bytes; longer ones have the same ids too."""
    with open(WORD, encoding="utf-8") as f:
        spec = json.load(f)
    rng, b, t = random.Random(5), B.WordBpe(spec, B.odd_characters(spec)), tokenizer(WORD)
    encoder = B.Encoder(b, B.Lexicon(B.compile_lexicon({b"the": b.merge("the")})))
    word = lambda n: "".join(rng.choice("etaoinshrdluéß你 '.1") for _ in range(n))
    texts = [word(n) for n in range(1, 200)] + ["".join(rng.choice("etaoins") for _ in range(n % 64 + 1)) + " the" for n in range(500)]
    want = [x.ids for x in t.encode_batch([*texts, "tion" * 40, "é" * 600], add_special_tokens=False)]
    assert encoder.encode([*texts, "tion" * 40, "é" * 600]) == want
    monkeypatch.setattr(B.WordBpe, "merge", None)
    assert encoder.encode(texts) == want[:-2]


def test_empty(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert B.encode_decode(none, WORD).count() == 0
    assert W.read_documents(spark, W.write_shards(none, str(tmp_path / "w"), BYTE, 2)).count() == 0


def test_lexicon_is_minimal_and_exact():
    words = {w.encode(): [len(w), i] for i, w in enumerate(["walking", "talking", "walked", "talked", "walk", "talk", "é", "king"])}
    x = B.Lexicon(B.compile_lexicon(words))
    assert [x.of(int(i)) for i in x.find(list(words))] == list(words.values())
    assert (x.find([b"wal", b"walkin", b"", b"zz", b"walkings"]) == -1).all()
    assert len(set(x.keys >> 8)) < 20  # "walk" and "talk" share their ends
    assert B.Lexicon(B.compile_lexicon({})).find([b"a"]).tolist() == [-1]


def test_files(spark, docs, tmp_path):
    t = tokenizer(BYTE)
    rows = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()))
    start, want = 0, []
    for i, text in rows:
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, 2], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids)))
        start += len(ids)
    path = W.write_shards(docs, str(tmp_path / "shards"), BYTE, 2, shard_bytes=20_000)
    assert spark.read.parquet(path).count() > 1
    assert sorted(map(tuple, W.read_documents(spark, path).collect())) == sorted(want)


def test_long_white_space(spark, tmp_path):
    t, n = tokenizer(BYTE), 1_200_000
    texts = [" " * n + "a", "a" + " " * n, "x" + "\n \t" * (n // 3) + "\xa0y", " " * (W.LONG_RUN - 1) + "b", " " * W.LONG_RUN + "b", "ab" * n]
    assert [x.tolist() for x in W.TextEncoder(BYTE).encode(texts)] == [t.encode(x, add_special_tokens=False).ids for x in texts]
    df = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string").selectExpr("doc_id", f"concat(repeat(' ', {n}), coalesce(text, '')) text")
    got = {r["doc_id"]: r["n_tokens"] for r in W.read_documents(spark, W.write_shards(df, str(tmp_path / "long"), BYTE, 2)).collect()}
    assert got == {i: len(t.encode(" " * n + x, add_special_tokens=False).ids) + 1 for i, x in ((1, "a"), (2, ""))}


def test_wavelet_matrix():
    rng = np.random.default_rng(1)
    for n, top in ((1, 1), (10, 2), (70_000, 300), (140_001, 50_257), (500, 70_000)):
        ids = np.minimum(rng.zipf(1.4, n), top).astype(np.uint32)
        f = W.TokenFile(W.build(ids, np.array([7]), np.array([n])))
        assert (f.all() == ids).all() and f.doc_ids.tolist() == [7] and f.ends.tolist() == [n]
        for i in {0, n // 2, n - 1}:
            assert f.access(i) == ids[i]
        for token in {0, 1, 2, int(ids[-1]), top, top + 1, 1 << 20}:
            places = np.flatnonzero(ids == token)
            assert f.count(token) == len(places) and f.rank(token, n // 3) == (ids[: n // 3] == token).sum()
            for j in {0, len(places) // 2, len(places) - 1}:
                assert f.select(token, j) == (places[j] if 0 <= j < len(places) else -1)
    with pytest.raises(ValueError):
        W.TokenFile(b"x" * 64)
