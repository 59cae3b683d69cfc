import math
import random

import duckdb
import numpy as np

from cantle.llm import queries
from cantle.llm import topk_blocks as tk


def _brute(rows, k, every):
    """Each usable row is a candidate of all others, whatever its id."""
    q = [(i, [math.floor(64 * v) for v in x]) for i, x in rows if i is not None and x is not None and all(v is not None and math.isfinite(v) for v in x)]
    out = []
    for n, (i, x) in enumerate(q):
        if i % every == 0:
            best = sorted((-sum(a * b for a, b in zip(x, y)), j) for m, (j, y) in enumerate(q) if m != n)[:k]
            out += [(i, r + 1, j, max(-(2**63), min(2**63 - 1, -s))) for r, (s, j) in enumerate(best)]
    return out


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(tk, "BLOCK", 8)
    monkeypatch.setattr(tk, "SPAN_BLOCKS", 4)
    monkeypatch.setattr(tk, "GROUP_QUERIES", 7)
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) for _ in range(12)]) for i in range(-40, 260)]
    rows += [(500 + i, list(rows[i][1])) for i in range(60)] + rows[:30]
    rows += [(900, None), (920, [1.0, None]), (940, [float("nan")]), (960, [float("inf"), 1.0]), (None, [1.0]), (980, []), (1000, [3.0]), (1020, [0.0] * 12)]
    df = spark.createDataFrame([(i, x, "rank") for i, x in rows], "vec_id long, embedding array<double>, rank string")
    got = sorted(map(tuple, tk.top_k(df, 20, 20).collect()))
    assert got == sorted(_brute(rows, 20, 20))
    assert tk.top_k(df.limit(0)).count() == 0
    few = df.where("vec_id in (0, 1, 2)")
    assert sorted(map(tuple, tk.top_k(few, 20, 20).collect())) == sorted(_brute([r for r in rows if r[0] in (0, 1, 2)], 20, 20))


def test_huge_components_stay_exact():
    a = np.array([[1e300, 1.0], [2.0**40, 3.0]])
    b = np.array([[1.0, 1.0], [2.0**20, -1.0]])
    assert tk._products(a, b)[1].tolist() == [2**40 + 3, 2**60 - 3]
    assert tk._products(a, b)[0].tolist() == [2**63 - 1] * 2


def test_blocks_are_pruned_without_loss():
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 4, (30, 8))
    blocks = [(np.arange(i * 16, i * 16 + 16), np.arange(i * 16, i * 16 + 16), np.floor(64 * (c + rng.normal(0, 0.2, (16, 8))))) for i, c in enumerate(centres)]
    every = np.concatenate([m for *_, m in blocks])
    ids = np.arange(0, 480, 20)
    who, names, _, score, scored = tk.search_span(blocks, ids, every[ids], np.full(len(ids), -(2**63)), 5)
    assert scored < 0.5 * len(ids) * len(blocks)
    full = (every[ids] @ every.T).astype(np.int64)
    for q, i in enumerate(ids):
        want = sorted((-full[q, j], j) for j in range(480) if j != i)[:5]
        assert [(-s, j) for j, s in zip(names[who == q], score[who == q])] == want


def test_repeated_ids(spark):
    rows = [(20, [1.0, 0.0]), (20, [9.0, 0.0]), (1, [1.0, 1.0]), (20, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, tk.top_k(df, 20, 20).collect()))
    assert got == sorted(_brute(rows, 20, 20)) and len(got) == 9


def test_spans_that_no_bound_reaches_stay_away(spark, monkeypatch):
    monkeypatch.setattr(tk, "BLOCK", 8)
    monkeypatch.setattr(tk, "SPAN_BLOCKS", 2)
    rng = np.random.default_rng(5)
    rows = [(int(i), (np.eye(8)[i // 40] * 50 + rng.normal(0, 0.1, 8)).tolist()) for i in range(320)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, tk.top_k(df, 5, 20).collect())) == sorted(_brute(rows, 5, 20))
    assert 0 < tk.scored_share(df, 5, 20) < 0.8


def test_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/sf0.001/embeddings.parquet'")
    cols = "query_id, rank, vec_id, score"
    want = sorted(con.execute(f"SELECT {cols} FROM ({tk.ORACLE_SQL})").fetchall())
    assert sorted(tuple(r) for r in queries.QUERIES["op2_topk_blocks"](spark, "/root/testdata/sf0.001").select(*cols.split(", ")).collect()) == want
