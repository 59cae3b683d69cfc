import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cantle.llm import bpe_codec

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def codec():
    with open(PATH, "rb") as f:
        return bpe_codec.SpeculativeBpe(f.read())


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def _texts():
    rng = random.Random(1)
    texts = ["", " ", "  ", " a" * 3, "<|endoftext|>", "a<|endoftext|> b  <|endoftext|>", "a" * 3000, "x  y \n\n  z\t", "\x1c \x85a", "y's we'll 1234567 ñañ 你好世界 🙂🙂🙂"]
    texts += ["".join(rng.choice("abcdef <|>endoftx'sé你🙂\n") for _ in range(rng.randrange(60))) for _ in range(3000)]
    texts += [" ".join("".join(rng.choice(["th", "er", "on", "ing", "e", "a", "le"]) for _ in range(rng.randrange(1, 9))) for _ in range(40)) for _ in range(300)]
    return texts


def test_ids_equal_the_library(codec, library):
    texts = _texts()
    assert codec.encode_many(texts) == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_decoding_equals_the_library(codec, library):
    ids = codec.encode_many(_texts()) + [[50256, 5, 200, 130], [150, 151, 240]]
    assert [codec.decode(x) for x in ids] == [library.decode(x, skip_special_tokens=False) for x in ids]


def _spans(words):
    size = np.array([len(w) for w in words])
    return np.frombuffer(b"".join(words), np.uint8), np.cumsum(size) - size, np.cumsum(size)


def _grouped(owner, token, n):
    return [token[owner == k].tolist() for k in range(n)]


def test_proposals_are_longest_matches_and_need_repairs(codec):
    rng = random.Random(2)
    words = [bytes(rng.choice(b"abcdehilnorst") for _ in range(rng.randrange(1, 90))) for _ in range(2000)]
    got = _grouped(*codec.propose(*_spans(words)), len(words))
    known = {codec.bytes[i]: i for i in codec.token_at[codec.token_at >= 0].tolist()}
    for w, tokens in zip(words[:200], got):
        want, at = [], 0
        while at < len(w):
            n = max(k for k in range(1, len(w) - at + 1) if w[at : at + k] in known)
            want.append(known[w[at : at + n]])
            at += n
        assert tokens == want
    differ = sum(t != codec.merge(w) for w, t in zip(words, got))
    assert 0 < differ < len(words)


def test_merging_of_many_and_of_one_agree(codec):
    rng = random.Random(3)
    words = [bytes(rng.choice(b"aabbcdehilnorst ") for _ in range(rng.randrange(1, 48))) for _ in range(600)]
    assert _grouped(*codec.merge_many(*_spans(words)), len(words)) == [codec.merge(w) for w in words]


def test_table_finds_all_keys():
    rng = np.random.default_rng(4)
    keys = np.unique(rng.integers(0, 1 << 50, 5000))
    table = bpe_codec._Table(keys, np.arange(len(keys), dtype=np.int32))
    assert (table.get(keys) == np.arange(len(keys))).all()
    others = np.setdiff1d(rng.integers(0, 1 << 50, 5000), keys)
    assert (table.get(others) == -1).all()


def test_very_long_texts_through_spark(spark, library):
    rng = random.Random(6)
    texts = ["".join(rng.choice("abcd") for _ in range(60_000)), " ".join(rng.choice(["the", "ing", "er", "qzx"]) * rng.randrange(1, 4) for _ in range(400_000)), "a\n" * 100_000, None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in bpe_codec.round_trip(df, PATH).collect()}
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[i]["n_tokens"] == len(ids) and got[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()


def test_cache_limit_changes_nothing(codec, library, monkeypatch):
    monkeypatch.setattr(bpe_codec, "CACHE_WORDS", 3)
    texts = _texts()[:400]
    out = [x for t in texts for x in codec.encode_many([t])]
    assert out == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_round_trip_frame(spark, library):
    rows = [(1, "hello world", 5), (2, None, 6), (3, "", 7), (3, "", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = sorted(bpe_codec.round_trip(df, PATH, keep_ids=True).collect())
    assert [r["n_tokens"] for r in got] == [2, 0, 0, 0]
    ids = library.encode("hello world").ids
    assert got[0]["ids"] == ids
    assert got[0]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert got[1]["decoded_sha256"] == hashlib.sha256(b"").hexdigest()
    assert bpe_codec.round_trip(df.limit(0), PATH).count() == 0
    back = bpe_codec.decode(bpe_codec.encode(df, PATH), PATH)
    assert sorted(r["decoded"] for r in back.collect()) == ["", "", "", "hello world"]


def test_few_words_are_kept_and_merged_together(codec, library, monkeypatch):
    rng = random.Random(9)
    texts = [" ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(4, 40))) for _ in range(500)) for _ in range(60)]
    rows, merge_many = [], codec.merge_many
    monkeypatch.setattr(codec, "merge_many", lambda buf, start, end: rows.append(len(start)) or merge_many(buf, start, end))
    monkeypatch.setattr(codec, "most", 2000)
    codec._forget()
    for at in range(0, len(texts), 10):
        assert codec.encode_many(texts[at : at + 10]) == [library.encode(t, add_special_tokens=False).ids for t in texts[at : at + 10]]
        assert len(codec.units) + len(codec.cache) <= 2000 + 10 * 500
    codec._forget()
    assert codec.encode_many(texts) == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert max(rows) <= bpe_codec.TOGETHER < sum(rows)
