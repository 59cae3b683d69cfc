import numpy as np
import pytest
from pyspark.sql import functions as F

from cantle.llm import mixing

SF = "/root/testdata/sf0.01"
WEIGHTS = {"clean": 0.9, "low": 0.08, "toxic": 0.02}


def _brute(n, p, targets, max_rate):
    """Plain projected gradient with a safe fixed step, many times."""
    w = n / n.sum()
    r = np.ones(len(n))
    for _ in range(40000):
        e = (w * r) @ p - targets
        r = np.clip(r - p @ e, 0, max_rate)
    return r


@pytest.mark.parametrize("weights", [WEIGHTS, {"clean": 0.5, "low": 0.5, "toxic": 0.0}, {"clean": 0.0, "low": 0.0, "toxic": 1.0}])
def test_rates_reach_the_least_squares_minimum(spark, weights):
    rng = np.random.default_rng(4)
    p = rng.dirichlet([0.3, 0.2, 0.1], 300)
    n = rng.integers(0, 900, 300)
    df = spark.createDataFrame([(i, int(n[i]), *map(float, p[i])) for i in range(300)], "doc_id long, n_tokens long, p_clean double, p_low double, p_toxic double")
    fit = mixing.fit_rates(df, weights)
    targets = np.array([weights[d] for d in mixing.DOMAINS])
    want = _brute(n.astype(float), p, targets, mixing.MAX_RATE)
    cost = lambda r: (((n / n.sum() * r) @ p - targets) ** 2).sum()
    got = np.array([x[0] for x in df.orderBy("doc_id").select(fit.rate([F.col(f"p_{d}") for d in mixing.DOMAINS])).collect()])
    assert (got >= 0).all() and (got <= mixing.MAX_RATE).all()
    assert cost(got) <= cost(want) + 1e-6
    assert np.allclose(fit.totals, (n * got) @ p, rtol=1e-6)


def test_tables(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    out = mixing.mix(docs, labels, WEIGHTS)
    rows = {r["doc_id"]: r for r in out.collect()}
    assert len(rows) == docs.count()
    truth = {r["doc_id"]: mixing.DOMAINS[2] if r["toxic"] else mixing.DOMAINS[1] if r["quality"] == 0 else mixing.DOMAINS[0] for r in labels.collect()}
    right = [max(mixing.DOMAINS, key=lambda d: rows[i][f"p_{d}"]) == t for i, t in truth.items()]
    assert np.mean(right) > 0.9
    total = sum(r["n_tokens"] for r in rows.values())
    # soft posteriors put some targets out of reach; the least distance is what counts
    n = np.array([r["n_tokens"] for r in rows.values()], float)
    p = np.array([[r[f"p_{d}"] for d in mixing.DOMAINS] for r in rows.values()])
    targets = np.array([WEIGHTS[d] for d in mixing.DOMAINS])
    cost = lambda r: (((n / n.sum() * r) @ p - targets) ** 2).sum()
    got = np.array([r["rate"] for r in rows.values()])
    assert cost(got) <= cost(_brute(n, p, targets, mixing.MAX_RATE)) + 1e-5 < cost(np.ones(len(n)))
    realised = sum(r["copies"] * r["n_tokens"] for r in rows.values())
    assert realised == pytest.approx(total, rel=0.1)
    assert all(abs(sum(r[f"p_{d}"] for d in mixing.DOMAINS) - 1) < 1e-9 and abs(r["copies"] - r["rate"]) < 1 for r in rows.values())


def test_query_reaches_the_target_of_a_rare_domain(spark, tmp_path):
    from cantle.llm.queries import MIX, op1_soft_mixing

    texts = [(i, "idiot scum moron trash" if i < 6 else f"plain words of text{i % 7}") for i in range(3000)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i < 6)) for i in range(1000)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = op1_soft_mixing(spark, str(tmp_path)).collect()
    reached, whole = sum(r["rate"] * r["n_tokens"] * r["p_toxic"] for r in rows), sum(r["n_tokens"] for r in rows)
    assert reached == pytest.approx(MIX["toxic"] * whole, rel=0.01)
    assert rows[0]["reached_toxic"] == pytest.approx(reached) and rows[0]["target_toxic"] == pytest.approx(MIX["toxic"] * whole)


def test_resample_repeats_rows(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    docs = docs.withColumn("copies", F.lit("x"))
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(docs, labels, WEIGHTS).collect() if r["copies"]}
    got = mixing.resample(docs, labels, WEIGHTS)
    assert got.columns == docs.columns
    assert {r["doc_id"]: r["count"] for r in got.groupBy("doc_id").count().collect()} == copies


def test_edges(spark):
    docs = spark.createDataFrame([(1, None), (1, ""), (None, "a b"), (2, "x " * 5000)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, None), (2, None, 0), (9, 0, 1), (None, 0, 0)], "doc_id long, quality int, toxic int")
    rows = mixing.mix(docs, labels, WEIGHTS).collect()
    assert len(rows) == 4 and {r["n_tokens"] for r in rows} == {0, 2, 5000}
    assert mixing.mix(docs.limit(0), labels, WEIGHTS).count() == 0
    assert mixing.resample(docs.limit(0), labels.limit(0), WEIGHTS).count() == 0


def test_main_path_is_native(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    plan = mixing.resample(docs, labels, WEIGHTS)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "Exchange", "Cartesian"))
