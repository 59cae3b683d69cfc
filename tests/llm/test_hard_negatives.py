import math
import random

import numpy as np
import pyarrow as pa

from cantle.llm import hard_negatives as hn

_LIMIT = 2**63


def _brute(rows):
    """Plain loops over all rows, in whole numbers."""
    use = []
    for i, x, label in rows:
        if i is None or label is None or x is None or any(v is None or not math.isfinite(v) for v in x):
            continue
        use.append((i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * v) for v in x]))
    out = []
    for n, (i, label, x) in enumerate(use):
        if i % 100:
            continue
        scored = [(-max(-_LIMIT, min(_LIMIT - 1, sum(a * b for a, b in zip(x, y)))), j, other == label) for m, (j, other, y) in enumerate(use) if m != n]
        for p, j, _ in sorted(s for s in scored if s[2])[:5]:
            near = sorted((s, k) for s, k, same in scored if not same and 80 * -p <= 100 * -s <= 100 * -p)[:5]
            out += [(i, j, r + 1, k, -p, -s) for r, (s, k) in enumerate(near)]
    return sorted(out)


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(hn, "BLOCK_BYTES", 500)
    monkeypatch.setattr(hn, "SLICE_SCORES", 64)
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0.3, 1) for _ in range(8)], rng.randrange(3)) for i in range(-150, 420)]
    rows += [(i + 1000, list(rows[i][1]), rows[i][2]) for i in range(60)]  # ties
    rows += [rows[250], rows[250], (100, [0.5, 1.0], 1), (200, [], 2)]  # repeated anchors, short vectors
    rows += [(300, None, 1), (400, [1.0, None], 1), (500, [float("nan")], 1), (600, [float("inf")], 1), (None, [1.0], 1), (700, [1.0], None)]
    rows += [(800, [-3.0] * 8, 9)]  # no row of its label
    df = spark.createDataFrame([(i, x, y, "r", 1) for i, x, y in rows], "vec_id long, embedding array<double>, label int, rank string, row int")
    got = hn.mine(df)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = _brute(rows)
    assert len(want) > 100
    assert sorted(map(tuple, got.collect())) == want
    assert hn.mine(df.limit(0)).count() == 0
    assert hn.mine(df.where("vec_id % 100 <> 0")).count() == 0


def test_huge_components_stay_exact(spark):
    rows = [(100, [2.0**40, 1.0], 1), (1, [2.0**40, 3.0], 1), (2, [2.0**39, 3.0], 2), (3, [1.8 * 2.0**39, 2.0], 2), (4, [1e300, 1.0], 1), (5, [2.0**40, 1.0], 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert sorted(map(tuple, hn.mine(df).collect())) == _brute(rows)


def test_window_is_exact():
    p = np.array([[5, -5, 0, 2**62, -(2**63)]])
    assert hn.window(p, 80, 100).tolist() == [[4, -4, 0, -(-80 * 2**62 // 100), -(80 * 2**63 // 100)]]


def test_matrix_fills_short_vectors():
    got = hn.matrix(pa.array([[0.5, -0.001], [], [1.0]], pa.list_(pa.float64())))
    assert got.tolist() == [[128.0, -1.0], [0.0, 0.0], [256.0, 0.0]]
