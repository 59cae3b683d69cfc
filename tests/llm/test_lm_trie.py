import math
import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from cantle.llm import lm_trie as lm


def _tokens(text):
    return (text or "").encode().lower().split() + [None]


class _Plain:
    """The same model with dictionaries and exact probabilities."""

    def __init__(self, texts, order):
        self.order = order
        self.n = [Counter() for _ in range(order + 1)]
        for t in texts:
            w = _tokens(t)
            for k in range(1, order + 1):
                self.n[k].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
        self.total = sum(self.n[1].values())
        self.after = [defaultdict(lambda: [0, 0]) for _ in range(order + 1)]
        for k in range(2, order + 1):
            for g, c in self.n[k].items():
                self.after[k][g[:-1]][0] += c
                self.after[k][g[:-1]][1] += 1

    def p(self, context, w):
        if not context:
            return (self.n[1][(w,)] + 1) / (self.total + len(self.n[1]) + 1)
        lower = self.p(context[1:], w)
        total, kinds = self.after[len(context) + 1].get(context, (0, 0))
        if not total:
            return lower
        return max(self.n[len(context) + 1][(*context, w)] - lm.DISCOUNT, 0) / total + lm.DISCOUNT * kinds / total * lower

    def score(self, text):
        w = _tokens(text)
        return sum(math.log10(self.p(tuple(w[max(0, i - self.order + 1) : i]), w[i])) for i in range(len(w)))


def _rows():
    rng = random.Random(5)
    words = [f"w{int(rng.paretovariate(0.6))}" for _ in range(3000)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 60)))) for i in range(300)]
    return rows + [(None, "Only\there w1"), (7, None), (7, ""), (9, "UNSEEN zzz w1 w2"), (9, "UNSEEN zzz w1 w2")]


@pytest.mark.parametrize("order,shard", [(3, 400), (2, 1_500_000), (4, 900)])
def test_scores_equal_the_plain_model(spark, monkeypatch, order, shard):
    monkeypatch.setattr(lm, "SHARD_TOKENS", shard)
    rows = _rows()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    plain = _Plain([t for i, t in rows if not held(i)], order)
    df = spark.createDataFrame([(i, t, 0.0) for i, t in rows], "doc_id long, text string, score double")
    got = lm.scores(df, lm.train(df, order=order)).collect()
    assert len(got) == len(rows)
    by_id = defaultdict(list)
    for i, t in rows:
        w = _tokens(t)
        base = sum(math.log10((plain.n[1][(x,)] + 1) / (plain.total + len(plain.n[1]) + 1)) for x in w)
        by_id[i].append((held(i), len(w), sum(plain.n[1][(x,)] > 0 for x in w), plain.total, base, plain.score(t)))
    for r in got:
        match = [x for x in by_id[r["doc_id"]] if tuple(r)[1:5] == x[:4] and abs(r["base_score"] - x[4]) < 1e-6]
        assert match
        # eight bits for a probability cost little
        assert min(abs(r["score"] - x[5]) for x in match) < 0.02 * r["n_tokens"] + 0.02


def test_elias_fano_against_a_list():
    rng = np.random.default_rng(1)
    for n, universe in ((0, 10), (1, 1), (300, 310), (500, 10**9), (1000, 40_000), (64, 1 << 40)):
        v = np.sort(rng.choice(universe, n, replace=False) if universe < 10**6 else np.unique(rng.integers(0, universe, n))).astype(np.int64)
        n = len(v)
        bits, low, high, zeros = lm.EliasFano.parts(v, universe)
        ef = lm.EliasFano(n, bits, low, high, zeros)
        ask = np.unique(np.r_[v, rng.integers(0, universe, 400)]).astype(np.uint64)
        assert (ef.rank(ask) == np.searchsorted(v, ask.astype(np.int64))).all()
        place = {int(x): i for i, x in enumerate(v)}
        assert ef.find(ask).tolist() == [place.get(int(x), -1) for x in ask]
        if n:
            i = np.arange(n)
            assert ((((lm._select_one(ef, i) - i).astype(np.uint64) << np.uint64(bits)) | ef.lows(i)) == v.astype(np.uint64)).all()


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert lm.scores(df, lm.train(df)).count() == 0
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    row = lm.scores(one, lm.train(df)).collect()[0]
    assert row["n_known"] == 0 and row["train_tokens"] == 0 and row["score"] == pytest.approx(row["base_score"]) == 0


@pytest.mark.parametrize("top", [50, 10**9, 1 << 62])
def test_pairs_of_any_size_are_told_apart(top):
    """Context and word numbers whose product passes 64 bits must not merge."""
    rng = np.random.default_rng(3)
    a = np.r_[rng.integers(-1, 40, 500), [top, top - 1, top]]
    b = np.r_[rng.integers(-1, 30, 500), [5, min(top, 10**9), 5]]
    before, word, back = lm._distinct(a, b)
    assert list(zip(before.tolist(), word.tolist())) == sorted(set(zip(a.tolist(), b.tolist())))
    assert (before[back] == a).all() and (word[back] == b).all()
    assert [len(x) for x in lm._distinct(a[:0], b[:0])] == [0, 0, 0]


def test_files_of_a_removed_model_are_let_go(spark):
    docs = spark.createDataFrame([(i, f"a b c{i % 3}") for i in range(30)], "doc_id long, text string")
    one, two = lm.train(docs), lm.train(docs)
    same = [x.tolist() for x in one.score([b"a b c1"])]
    assert all(p.startswith(one.root) for p in lm._OPEN)
    assert [x.tolist() for x in two.score([b"a b c1"])] == same
    assert lm._OPEN and all(p.startswith(two.root) for p in lm._OPEN)
    one.remove()
    two.remove()


def test_many_files_are_mapped_without_file_descriptors(tmp_path, monkeypatch):
    """A model of 6 GB has thousands of files; a descriptor an array passes the system's limit."""
    monkeypatch.setattr(lm, "_OPEN", {})
    arrays = {"hash": np.arange(9, dtype=np.uint64), "none": np.zeros(0), "p": np.arange(5, dtype=np.uint8)}
    before = len(os.listdir("/proc/self/fd"))
    for i in range(100):
        lm._write(f"{tmp_path}/1-{i}", arrays)
        got = lm._mapped(f"{tmp_path}/1-{i}")
        assert got.keys() == arrays.keys() and all((got[k] == a).all() and got[k].dtype == a.dtype for k, a in arrays.items())
    assert len(lm._OPEN) == 100
    assert len(os.listdir("/proc/self/fd")) - before <= (0 if lm.UNTRACKED else 100)
