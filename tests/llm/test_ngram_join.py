import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from cantle.llm import ngram_join as nj
from cantle.llm import queries


def _set(text):
    w = (text or "").lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def _brute(rows):
    """Per input row (id, text): class id, copy id, links, different links."""
    sets = [_set(t) for _, t in rows]
    n = len(rows)
    link = [[j for j in range(n) if j != i and sets[i] and len(sets[i] & sets[j]) * 5 >= 4 * len(sets[i] | sets[j])] for i in range(n)]
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in link[i]:
            root[find(i)] = find(j)
    key = lambda i: rows[i][0] if rows[i][0] is not None else 1 << 62
    out = []
    for i in range(n):
        group = min((j for j in range(n) if find(j) == find(i)), key=key)
        copy = min((j for j in range(n) if sets[j] == sets[i] and sets[i] or j == i), key=key)
        out.append((rows[i][0], rows[group][0], rows[copy][0], len(link[i]), len({sets[j] for j in link[i]} - {sets[i]})))
    return out


def _rows(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for f in range(12):
        base = [rng.choice(words) for _ in range(rng.randrange(20, 120))]
        for _ in range(rng.randrange(1, 9)):
            part = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                part[rng.randrange(len(part))] = rng.choice(words)
            rows.append(" ".join(part).upper() if rng.random() < 0.2 else "  ".join(part))
    rows += ["", None, " \n", "one", "One", "two three", "two three four five", "two three four five"]
    rows = [(i, t) for i, t in enumerate(rows)] + [(3, rows[3]), (None, rows[5]), (None, "lonely words that no one else has")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,block", [(1, 1024), (2, 3)])
def test_equals_brute_force(spark, monkeypatch, seed, block):
    monkeypatch.setattr(nj, "BLOCK_CLASSES", block)
    rows = _rows(seed)
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, size int")
    got = sorted(map(repr, map(tuple, nj.near_duplicates(df).collect())))
    want = _brute(rows)
    assert got == sorted(map(repr, want))
    kept = nj.first_of_each_group(df)
    assert kept.columns == df.columns
    assert kept.count() == len({(w[1]) if w[3] else ("alone", k) for k, w in enumerate(want)})


def test_rare_and_common_counting_agree(monkeypatch):
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50))).astype(np.uint64) for _ in range(40)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    for limit in (1, 8, 60):
        monkeypatch.setattr(nj, "COMMON", limit)
        got = nj._pair_counts(sets, 0)
        np.fill_diagonal(got, [len(s) for s in sets])
        assert (got == want).all()
        assert (nj._pair_counts(sets, 15) == np.array(want)[:15, 15:]).all()


def test_prefixes_shorten_by_what_is_found():
    assert nj.prefix_length(np.array([0.99] * 50)) == nj.DEPTH
    near = nj.prefix_length(np.array([0.8] * 50))
    assert near == nj.prefix_length(np.zeros(0)) < nj.DEPTH
    assert nj.recall_at(near, np.array([0.8])) >= nj.RECALL > nj.recall_at(near + 1, np.array([0.8]))
    mixed = np.array([0.8] * 5 + [0.99] * 95)
    assert near <= nj.prefix_length(mixed) <= nj.DEPTH and nj.recall_at(nj.prefix_length(mixed), mixed) >= nj.RECALL


def test_common_prefixes():
    x = np.array([[1, 0, 5, 0, 6], [1, 0, 5, 0, 6], [1, 0, 5, 9, 6], [1, 1, 5, 0, 6], [2, 0, 5, 0, 6]], np.uint8)
    assert nj._common(x[:1].repeat(5, 0), x).tolist() == [2, 2, 1, 0, -1]


def test_listing_in_small_slices(monkeypatch):
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 200, 60)).astype(np.uint64) for _ in range(30)]
    want = nj._pair_counts(sets, 0)
    monkeypatch.setattr(nj, "LISTED", 5)
    monkeypatch.setattr(nj, "COLUMNS", 3)
    assert (nj._pair_counts(sets, 0) == want).all()


def test_rows_behind_a_shuffle(spark):
    """Wide rows that adaptive coalescing deals out anew at each reading keep their numbers."""
    rows = [r for r in _rows(5) if r[0] is not None and r[0] != 3]
    df = spark.createDataFrame([(i, t, "x" * 3000) for i, t in rows], "doc_id long, text string, wide string")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "16k")
    try:
        dealt = df.repartition(64, "doc_id")
        got = sorted(map(repr, map(tuple, nj.near_duplicates(dealt).collect())))
        kept = nj.first_of_each_group(dealt).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    want = _brute(rows)
    assert got == sorted(map(repr, want))
    assert sorted(r["doc_id"] for r in kept) == sorted(w[0] for w in want if w[0] == w[1] or not w[3])


def test_very_long_texts(spark):
    words = [f"w{i}" for i in range(60_000)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:59_000], "end"])), (3, " ".join(words[::-1])), (4, " ".join(words).upper())]
    got = sorted(tuple(r) for r in nj.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 1, 1, 2, 1), (2, 1, 2, 2, 1), (3, 3, 3, 0, 0), (4, 1, 1, 2, 1)]


def test_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.01/documents.parquet'")
    cols = "doc_id, class_id, copy_id, n_links, n_distinct_links"
    want = Counter(con.execute(f"SELECT {cols} FROM ({nj.ORACLE_SQL})").fetchall())
    got = Counter(tuple(r) for r in queries.QUERIES["op4_ngram_forest_join"](spark, "/root/testdata/sf0.01").select(*cols.split(", ")).collect())
    assert got == want and sum(n for r, n in want.items() if r[3]) > 100


def test_components_of_a_long_chain(spark):
    order = list(range(200))
    random.Random(3).shuffle(order)
    edges = [(a, b) for a, b in zip(order, order[1:])] + [(500, 501), (501, 502), (502, 500), (7, 7)]
    got = {r["node"]: r["root"] for r in nj.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(200)} | {500: 500, 501: 500, 502: 500}


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert nj.near_duplicates(df).count() == 0 and nj.first_of_each_group(df).count() == 0


def test_prefix_length_follows_from_the_threshold_alone(spark):
    """Near pairs of high similarity alone, from which longer prefixes were inferred, must not lower the recall of others."""
    texts = [" ".join(f"t{k}w{j}" for j in range(200)) for k in range(40)]
    rows = [(2 * i + j, t + " more" * j) for i, t in enumerate(texts) for j in range(2)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row_id", F.col("doc_id"))
    nj.ship(spark)
    classes = nj.materialise(nj._classes(nj._profile(nj._rows(df, "doc_id", "text"))))
    lengths = [r["length"] for r in nj._neighbours(classes).collect()]
    least = nj.prefix_length(np.array([nj.NUM / nj.DEN]))
    assert nj.recall_at(least, np.array([nj.NUM / nj.DEN])) >= nj.RECALL and min(lengths) >= least
    assert nj._links(classes).count() == len(lengths) == 40
