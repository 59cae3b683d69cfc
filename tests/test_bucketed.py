"""Joins and look-ups over tables kept by their key."""

import pytest
from pyspark.sql import functions as F

from cantle.operators import relational as rel
from cantle.sources import tables


@pytest.fixture
def kept(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    raws = spark.createDataFrame([(i, f"o{i}") for i in range(500)], "fid long, osm string")
    preds = spark.createDataFrame([(i % 300, i, f"p{i}") for i in range(1200)], "fid long, ord long, v string")
    targets = spark.createDataFrame([(i, str(i * 7 % 520), "o%d" % (i * 7 % 520) if i % 5 else "other") for i in range(400)], "tid long, key string, name string")
    yield raws, preds, targets
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def _exchanges(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("Exchange hashpartitioning")


def test_look_up_without_an_exchange(kept):
    raws, preds, _ = kept
    own, other = tables.by_key(raws, "fid", 6), tables.by_key(preds, "fid", 6)
    plain = rel.three_way(raws.select("fid"), preds, raws, "fid")
    found = rel.three_way(own.select("fid"), other, own, "fid")
    assert _exchanges(plain) >= 3 and _exchanges(found) == 0
    rows = lambda df: sorted((r["fid"], r["p"]["v"] if r["p"] else None, r["osm"], r["missing"]) for r in df.collect())
    assert rows(found) == rows(plain) and len(rows(found)) == 500


def test_fall_back_and_pairing_deal_out_the_other_side_alone(kept):
    raws, preds, targets = kept
    table = preds.select(F.col("fid").alias("k"), "ord", "v")
    own = tables.by_key(table, "k", 6)
    asked = raws.select(F.col("fid").alias("a"))
    plain = rel.fallback_lookup(asked, ["a"], [table], "v")
    found = rel.fallback_lookup(asked, ["a"], [own], "v")
    assert _exchanges(found) == 1 < _exchanges(plain)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, plain.collect()))
    sources = tables.by_key(raws, "fid")  # as many buckets as shuffles have partitions
    pair = lambda r: rel.pair_by_key(targets, r, "tid", "key", "fid", F.lit(500), "name", "osm")
    assert _exchanges(pair(sources)) == _exchanges(pair(raws)) - 1
    assert sorted(map(tuple, pair(sources).collect())) == sorted(map(tuple, pair(raws).collect()))
