import math
import random
import re
from collections import Counter

import numpy as np

from cantle.llm import ranked_search as rs
from cantle.llm import textbytes as tb

_TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


def _terms(text):
    return _TERM.findall((text or "").translate(_LOWER))


def _brute(docs, items, k=10):
    split = [(i, Counter(_terms(t))) for i, t in docs]
    size = [sum(c.values()) for _, c in split]
    n, total = sum(s > 0 for s in size), sum(size)
    df = Counter(w for _, c in split for w in c)
    out = []
    for item, text in items:
        asked = Counter(_terms(text))
        scored = []
        for (doc, c), s in zip(split, size):
            score = sum(times * rs.weight(n, df[w]) * ((10**9 * c[w]) // (1000 * c[w] + 8 * (25 + 75 * s * n // total))) for w, times in asked.items() if w in c)
            if score > 0:
                scored.append((-score, doc is not None, doc))
        out += [(item, r + 1, d, -s) for r, (s, _, d) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=repr)


def _corpus(rng):
    words = [f"w{i}" for i in range(60)] + ["Äpfel", "straße", "日本語", "ÉTÉ", "été"]
    docs = []
    for i in range(400):
        n = rng.choice([0, 1, 3, 20, 20, 60, 200])
        docs.append((i * 3, " ".join(rng.choice(words[: rng.choice([5, 30, 65])]).upper() if rng.random() < 0.2 else rng.choice(words) for _ in range(n))))
    docs += [(i + 5000, docs[i][1]) for i in range(40)] + docs[:25]  # equal texts, repeated rows
    docs += [(7000, None), (7001, ""), (7002, " .,;-\n\t\x00\x7f"), (7003, "w1" * 3000), (7004, "w3 " * 30000 + "日本語"), (None, "w1 w2 w3"), (None, docs[5][1])]
    return words, docs


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(rs, "BLOCK_DOCS", 32)
    monkeypatch.setattr(rs, "BATCH_TERMS", 150)
    rng = random.Random(5)
    words, docs = _corpus(rng)
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 5, 30])))) for i in range(25)]
    items += [(100, None), (101, ""), (102, "unknown words"), (103, "w1 w1 W1, été"), (3, "w9"), (None, "w4 w5")]
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, block string, place int")
    q = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, item int")
    got = rs.search(d.repartition(5), q)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    want = _brute(docs, items)
    assert len(want) > 200
    assert sorted(map(tuple, got.collect()), key=repr) == want
    assert rs.search(d.limit(0), q).count() == 0
    assert rs.search(d, q.limit(0)).count() == 0
    assert rs.search(d.where("text is null"), q).count() == 0


def test_a_threshold_leaves_low_postings_where_they_are(spark, monkeypatch):
    """Queries of two terms: the heads' sums are high enough to leave postings of low x unfetched, and some are looked up."""
    monkeypatch.setattr(rs, "BLOCK_DOCS", 64)
    rng = random.Random(6)
    filler = [f"f{i}" for i in range(40)]
    # who has much of one term has none or, in a long text, one of the other
    docs = [(i, " ".join(["ab"[i % 2]] * rng.choice([1, 1, 9, 30]) + ["ba"[i % 2]] * rng.choice([0, 0, 1]) + [rng.choice(filler) for _ in range(rng.choice([5, 400]))])) for i in range(600)]
    items = [(0, "a b"), (1, "a"), (2, "b a b")]
    stats = {}
    d = spark.createDataFrame(docs, "doc_id long, text string")
    got = rs.search(d, spark.createDataFrame(items, "item_id long, text string"), k=3, stats=stats)
    assert sorted(map(tuple, got.collect()), key=repr) == _brute(docs, items, 3)
    assert stats["fetched"] < 0.7 * stats["postings"] and 0 < stats["looked_up"] <= stats["candidates"]


def test_terms_of_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(tb, "word_hashes", lambda buf, start, end: np.zeros(len(start), np.uint64))
    terms = rs.Terms([b"ab", b"abc", b"b", b"xy"])
    buf, start = tb.pack([b"abc", b"b", b"zz", b"xy", b"ab"])
    assert terms.find(buf, start, start + np.array([3, 1, 2, 2, 2])).tolist() == [1, 2, -1, 3, 0]


def test_saturation_beyond_64_bits():
    length = np.array([1, 10**9], np.int64)
    n, total = 10**11, 10**14
    want = [10**9 * 3 // (3000 + 8 * (25 + 75 * int(v) * n // total)) for v in length]
    assert rs.saturation(np.array([3, 3]), length, n, total).tolist() == want
    assert math.floor(1000 * math.log(2 * n + 2)) == rs.weight(n, 0)
