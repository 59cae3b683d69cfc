import math
import zlib

import numpy as np
import pytest

from cantle.llm import quality_mil as mil
from cantle.llm import textbytes as tb
from cantle.llm import toxicity as tox

SF = "/root/testdata/sf0.01"


def _tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_word_hashes_depend_on_the_word_alone():
    raws = ["The cat\tthe cat".encode(), "é the\x0bCAT ".encode(), b""]
    buf, begin = tb.pack(raws)
    low = tb.lower(buf)
    start, end = tb.words(low)
    got = [low[a:b].tobytes() for a, b in zip(start, end)]
    assert got == [w for r in raws for w in r.lower().split()]
    h = tb.word_hashes(low, start, end)
    assert len({(w, x) for w, x in zip(got, h.tolist())}) == len(set(got)) == len(set(h.tolist()))


def test_bags_equal_a_plain_count():
    texts = ["A b, b! c", None, "", "b-a b", "x" * 3_000_000 + " y"]
    who, what, many = tox.bags(texts)
    assert np.bincount(who, weights=many, minlength=5).tolist() == [4, 0, 0, 3, 2]
    assert len(set(what[who == 0]) & set(what[who == 3])) == 2


def test_ordinal_fit_orders_grades():
    rng = np.random.default_rng(1)
    n = 600
    dose = rng.integers(0, 4, n)
    texts = [" ".join(["plain"] * 3 + ["vile"] * (d * 3) + [f"w{rng.integers(50)}" for _ in range(20)]) for d in dose]
    row, word, count = tox.bags(texts)
    model = tox.fit(row, word, count, dose)
    assert (np.diff(model.thresholds) > 0).all()
    who, what, many = tox.matched(texts, model)
    above = model.above(np.bincount(who, weights=model.weights[what] * np.log1p(many), minlength=n))
    severity = above.sum(1)
    assert np.corrcoef(severity, dose)[0, 1] > 0.95
    assert (np.diff(above, axis=1) <= 1e-12).all()


def test_severity_grades_rank_toxic_texts():
    texts = ["fine words here"] * 9 + ["vile thing"] * 3 + ["vile vile vile thing"] * 3 + ["vile vile vile vile vile vile thing"] * 3
    row, word, count = tox.bags(texts)
    grade = tox.severity_grades(row, word, count, np.array([0] * 9 + [1] * 9))
    assert grade.tolist() == [0] * 9 + [1] * 3 + [2] * 3 + [3] * 3


def test_toxicity_on_the_tables(spark):
    docs, labels = _tables(spark)
    model = tox.train(docs, labels)
    got = {r["doc_id"]: r for r in tox.severity(docs, model).collect()}
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    assert len(got) == docs.count()
    assert not [i for i, t in truth.items() if t == 0 and got[i]["toxic"]]
    caught = [got[i]["toxic"] for i, t in truth.items() if t == 1]
    assert np.mean(caught) > 0.85
    kept = tox.drop_toxic(docs, labels)
    assert kept.columns == docs.columns
    assert kept.count() == sum(1 - r["toxic"] for r in got.values())


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(1, None, 3), (1, "", 4), (None, "bad", 5), (2, "x", 6)], "doc_id long, text string, grade int")
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 1)], "doc_id long, toxic int")
    model = tox.train(docs, labels)
    rows = tox.severity(docs, model).collect()
    assert len(rows) == 4 and all(r["severity"] < 0.01 and r["toxic"] == 0 for r in rows)
    kept = tox.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and sorted(r["grade"] for r in kept.collect()) == [3, 4, 5, 6]
    assert tox.severity(docs.limit(0), model).count() == 0
    assert tox.train(docs.limit(0), labels).words.size == 0


def test_passages_by_hand():
    who, facts = mil.passages(["a " * 130, "", None, "B."])
    assert who.tolist() == [0, 0, 0, 1, 2, 3]
    assert np.allclose(facts[0, -6], 1 / 64) and np.allclose(facts[0, -5], 63 / 64)
    assert facts[3, -2] == 1 and facts[5, -1] == 1
    assert np.allclose(facts[5, :9], [0, 0.5, 0, 0, 0, 0.5, 0, 0, 0])


def test_gradients_equal_differences():
    rng = np.random.default_rng(3)
    shapes = {"E": (mil.FACTS, mil.HIDDEN), "e": (mil.HIDDEN,), "V": (mil.HIDDEN, mil.GATE), "W": (mil.HIDDEN, mil.GATE), "u": (mil.GATE,), "c": (mil.HIDDEN,), "b": (1,)}
    p = {k: rng.normal(0, 0.3, s) for k, s in shapes.items()}
    x, at, y = rng.normal(size=(11, mil.FACTS)), np.array([0, 3, 4]), np.array([1.0, 0.0, 1.0])

    def loss():
        s = mil._sigmoid(mil._forward(p, x, at)[-1])
        return -(y * np.log(s) + (1 - y) * np.log(1 - s)).mean()

    grads = mil._gradients(p, x, at, y)
    for k in p:
        i = tuple(rng.integers(n) for n in p[k].shape)
        p[k][i] += 1e-5
        up = loss()
        p[k][i] -= 2e-5
        down = loss()
        p[k][i] += 1e-5
        assert grads[k][i] == pytest.approx((up - down) / 2e-5, abs=1e-6)


def test_quality_on_the_tables(spark):
    docs, labels = _tables(spark)
    got = {r["doc_id"]: r for r in mil.scores(docs, mil.train(docs, labels)).collect()}
    assert len(got) == docs.count()
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert {i for i in held} == {i for i in truth if got[i]["held_out"]}
    assert np.mean([got[i]["predicted"] == truth[i] for i in held]) > 0.93
    assert all(r["predicted"] == int(r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in got.values())


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (1, "", 0.5), (None, "bad", 0.5), (2, "x " * 9000, 0.5)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 1)], "doc_id long, quality int")
    rows = mil.scores(docs, mil.train(docs, labels)).collect()
    assert len(rows) == 4 and len({r["score"] for r in rows}) == 1
    assert mil.scores(docs.limit(0), mil.train(docs, labels.limit(0))).count() == 0


def test_toxicity_keeps_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "fine", 3, 7, 0.5), (2, "bad", 4, 8, 0.25)], "doc_id long, text string, grade int, kept_grade int, severity double")
    labels = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    kept = tox.drop_toxic(docs, labels)
    assert kept.columns == docs.columns
    assert sorted(tuple(r) for r in kept.collect()) == [(1, "fine", 3, 7, 0.5), (2, "bad", 4, 8, 0.25)]


def _plain_severity(model, text):
    """One text's expected severity and decision, word by word, without numpy."""
    words = "".join(c if c.isalnum() or ord(c) > 127 else " " for c in (text or "")).translate({i: i + 32 for i in range(65, 91)}).split(" ")
    weight = {}
    for h, w in zip(model.words.tolist(), model.weights.tolist()):
        weight[h] = w
    eta = 0.0
    for w in {x for x in words if x}:
        raw = w.encode()
        h = tb.word_hashes(np.frombuffer(raw + b"\n", np.uint8), np.array([0]), np.array([len(raw)]))
        eta += weight.get(int(h[0]), 0.0) * math.log(1 + words.count(w))
    above = [1 / (1 + math.exp(t - eta)) for t in model.thresholds]
    return sum(above), int(eta != 0 and above[0] >= tox.REJECT)


def _fitted_toxicity(spark):
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(f"w{rng.integers(40)}" for _ in range(15)) + (" vile scum" * int(1 + i % 3) if i % 5 == 0 else ""), int(i % 5 == 0)) for i in range(400)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    return tox.train(docs, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int"))


def test_fitted_toxicity_equals_a_plain_scorer_on_edges(spark):
    model = _fitted_toxicity(spark)
    assert len(model.words)
    texts = [None, "", " \t\n", "vile scum vile", "VILE, scum!", " ".join(f"w{i}" for i in range(15)), "w1 " * 200_000 + "vile", "é vileé scum", "vile scum vile"]
    df = spark.createDataFrame([(i, t, 0.5) for i, t in enumerate(texts)], "doc_id long, text string, severity double")
    got = {r["doc_id"]: r for r in tox.severity(df, model).collect()}
    for i, t in enumerate(texts):
        want, decision = _plain_severity(model, t)
        assert got[i]["severity"] == pytest.approx(want, abs=1e-6) and got[i]["toxic"] == decision
    assert got[3]["toxic"] and got[4]["toxic"] and not got[5]["toxic"] and not got[0]["toxic"]
    assert got[3]["severity"] == got[8]["severity"]


def test_screening_leaves_out_only_words_without_weight(monkeypatch):
    rng = np.random.default_rng(7)
    texts = [" ".join(f"w{rng.integers(300)}" for _ in range(8)) + (" vile" if i % 3 == 0 else "") for i in range(300)]
    grade = np.array([int(i % 3 == 0) for i in range(300)])
    row, word, count = tox.bags(texts)
    monkeypatch.setattr(tox, "PENALTY", 4e-3)
    whole = tox.fit(row, word, count, grade)
    names, col = np.unique(word, return_inverse=True)
    light = np.bincount(col, np.log1p(count)) <= tox.PENALTY * len(texts)
    assert light.any() and not set(names[light]) & set(whole.words)


def test_sample_bound_cuts_rows_not_words(spark, monkeypatch):
    monkeypatch.setattr(tox, "SAMPLE_ROWS", 50)
    docs = spark.createDataFrame([(i % 40, f"text {i} vile" if i % 2 else f"text {i}") for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    assert tox._sample(docs, labels, "doc_id", "text", "toxic").count() == 50
    assert len(tox.train(docs, labels).words)


def _plain_quality(model, text):
    """One text's score, passage by passage and neuron by neuron."""
    p, h, raw = model.weights, [], []
    for facts in mil.passages([text])[1]:
        x = [min(6.0, max(-6.0, (float(f) - float(m)) * float(s))) for f, m, s in zip(facts, model.mean, model.scale)]
        h.append([math.tanh(sum(a * b for a, b in zip(x, p["E"][:, j])) + p["e"][j]) for j in range(mil.HIDDEN)])
        gated = 0.0
        for g in range(mil.GATE):
            t = math.tanh(sum(a * b for a, b in zip(h[-1], p["V"][:, g])))
            gated += p["u"][g] * t / (1 + math.exp(-sum(a * b for a, b in zip(h[-1], p["W"][:, g]))))
        raw.append(gated)
    weight = [math.exp(r) for r in raw]
    z = [sum(w * row[j] for w, row in zip(weight, h)) / sum(weight) for j in range(mil.HIDDEN)]
    return 1 / (1 + math.exp(-(sum(a * b for a, b in zip(z, p["c"])) + p["b"][0])))


def test_fitted_quality_equals_a_plain_scorer_on_edges(spark):
    rng = np.random.default_rng(9)
    rows = [(i, " ".join("".join(rng.choice(list("abcdef" if i % 2 else "AB!?#9"), 5)) for _ in range(20 + 150 * (i % 3)))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = mil.train(docs, spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, quality int"))
    texts = [None, "", "  \n", "abc def fed", "A! B? 9#", "abcde " * 3000, "AB!?# " * 3000 + "abc " * 70, "abc def fed"]
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, predicted int")
    got = {r["doc_id"]: r for r in mil.scores(df, model).collect()}
    for i, t in enumerate(texts):
        assert got[i]["score"] == pytest.approx(_plain_quality(model, t), abs=1e-4)
        assert got[i]["predicted"] == int(got[i]["score"] >= 0.3)
    assert got[3]["score"] == got[7]["score"] and got[3]["score"] > got[4]["score"]
