"""Table functions against the column forms."""

import random

import pytest
from pyspark.sql import functions as F

from cantle.functions import rings, tables, tokens


@pytest.fixture
def sequences(spark):
    rng = random.Random(4)
    rows = [(i, [rng.choice([1, 1, 1, 2, 3, 721, 722]) for _ in range(rng.choice([0, 1, 2, 30, 400]))]) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, tokens array<int>").repartition(5)
    df.select("id", F.posexplode("tokens").alias("i", "t"), F.lit("x").alias("n")).repartition(7).createOrReplaceTempView("seq_rows")
    tables.register(spark)
    return df


def test_runs_equal_the_column_form(spark, sequences):
    got = sorted(map(tuple, spark.sql("SELECT * FROM token_runs(TABLE(seq_rows))").collect()))
    parts = sequences.withColumn("tokens", F.filter("tokens", lambda t: t < 720))
    spark.sql("SELECT * FROM seq_rows WHERE t < 720").createOrReplaceTempView("plain_rows")
    plain = sorted((r["id"], r["at"], r["t"], r["n"]) for r in spark.sql("SELECT * FROM token_runs(TABLE(plain_rows))").collect())
    want = sorted((r["id"], r["at"], r["e"]["d"], r["e"]["n"]) for r in parts.select("id", F.posexplode(tokens.runs(F.col("tokens"))).alias("at", "e")).collect())
    assert plain == want and len(got) > len(want) > 100


def test_segments_equal_the_column_form(spark, sequences):
    got = sorted((r["id"], r["segment"]) for r in spark.sql("SELECT id, segment FROM token_segments(TABLE(seq_rows)) ORDER BY id, at").collect())
    want = sorted((r["id"], r["s"]) for r in sequences.select("id", F.explode(tokens.segments(F.col("tokens"))).alias("s")).collect())
    assert got == want and len(want) > 50
    first = spark.sql("SELECT t.id, t.at, r.t = t.segment[0] AS same FROM token_segments(TABLE(seq_rows)) t JOIN seq_rows r ON r.id = t.id AND r.i = t.at").collect()
    assert len(first) == len(got) and all(r["same"] for r in first)


def test_walk_equals_the_column_form(spark):
    rng = random.Random(5)
    rows = [(i, [(rng.randrange(720), rng.randrange(1, 40)) for _ in range(20)]) for i in range(15)]
    df = spark.createDataFrame(rows, "id long, r array<struct<d:int,n:int>>")
    df.select("id", F.posexplode("r").alias("i", "e")).select("id", "i", "e.*").createOrReplaceTempView("run_rows")
    tables.register(spark)
    got = {(r["id"], r["i"]): (r["x"], r["y"]) for r in spark.sql("SELECT * FROM ring_walk(TABLE(run_rows))").collect()}
    for r in df.select("id", rings.walk(F.col("r"), F.lit(0.0), F.lit(0.0)).alias("p")).collect():
        for i, p in enumerate(r["p"][1:21]):
            if i < 19 or abs(p["x"]) + abs(p["y"]) > 1e-9:
                assert got[r["id"], i] == pytest.approx((p["x"], p["y"]), abs=1e-9)
    assert len(got) == 300


def test_edges(spark):
    tables.register(spark)
    spark.createDataFrame([(None, 0, 5), (None, 1, 5), (1, 0, None), (1, 1, 7)], "id long, i int, t int").createOrReplaceTempView("edge_rows")
    assert sorted(map(tuple, spark.sql("SELECT * FROM token_runs(TABLE(edge_rows))").collect()), key=str) == sorted([(None, 0, 5, 2), (1, 0, 7, 1)], key=str)
    assert spark.sql("SELECT * FROM token_segments(TABLE(SELECT * FROM edge_rows WHERE id > 5))").count() == 0
    with pytest.raises(Exception, match="no t"):
        spark.sql("SELECT * FROM token_runs(TABLE(SELECT id, i FROM edge_rows))").collect()


def test_batches_equal_the_functions_of_rows(spark, sequences):
    deal = "PARTITION BY pmod(xxhash64(id), 3) ORDER BY (id, i)"
    spark.sql("SELECT CASE WHEN id = 7 THEN null ELSE id END AS id, i, CASE WHEN i % 11 = 5 THEN null ELSE t END AS t FROM seq_rows").createOrReplaceTempView("odd_rows")
    rows = lambda sql: sorted(map(tuple, spark.sql(sql).collect()), key=str)
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for most in ("7", "10000"):  # runs and sequences that go on from batch to batch
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", most)
            runs = rows(f"SELECT * FROM batch_runs(TABLE(odd_rows) {deal})")
            assert runs == rows("SELECT * FROM token_runs(TABLE(odd_rows))") and len(runs) > 500
            spark.createDataFrame([*runs, (3, 10**6, None, 1)], "id long, i long, d int, n long").repartition(5).createOrReplaceTempView("walk_rows")
            walk = rows(f"SELECT id, i, round(x, 9), round(y, 9) FROM batch_walk(TABLE(walk_rows) {deal})")
            assert walk == rows("SELECT id, i, round(x, 9), round(y, 9) FROM ring_walk(TABLE(walk_rows))") and len(walk) == len(runs)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)
    assert rows(f"SELECT * FROM batch_walk(TABLE(SELECT * FROM walk_rows WHERE id > 1000) {deal})") == []


def test_the_query_has_no_call_of_python_a_row(spark):
    from cantle.plans import registry

    plan = registry.QUERIES["table_functions"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPythonUDTF" not in plan and plan.count("ArrowEvalPythonUDTF") == 2 and "Join" not in plan
