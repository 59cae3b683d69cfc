"""Polygon metrics as columns, held against the numpy kernel."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cantle.functions import planar
from cantle.functions import polygon as pg
from cantle.operators import geometry
from cantle.plans import adapters as ad

SF = "/root/testdata/sf0.001"


def _polygons():
    rng = np.random.default_rng(7)
    out = []
    for n in (3, 4, 5, 9, 17, 40):
        for turn in (False, True):
            t = np.sort(rng.uniform(0, 2 * math.pi, n))
            if np.diff(np.r_[t, t[0] + 2 * math.pi]).max() > 3:
                t = np.linspace(0, 2 * math.pi, n, endpoint=False)
            r = rng.uniform(2, 9, n)
            ring = np.c_[r * np.cos(t), r * np.sin(t)] + rng.uniform(-3, 3, 2)
            out.append([[ring[::-1] if turn else ring]])
    box = lambda x, y, w, h: np.array([(x, y), (x + w, y), (x + w, y + h), (x, y + h)], float)
    out += [[[box(0, 0, 4, 2)]], [[box(2, 1, 4, 4)]], [[box(0, 0, 4, 4)]], [[box(50, 50, 1, 3)]]]
    out += [[[np.array([(0, 0), (6, 0), (6, 2), (2, 2), (2, 6), (0, 6)], float)]]]  # concave
    out += [[[box(-4, -4, 9, 9), box(-1, -1, 3, 3)[::-1]]], [[box(-3, -2, 8, 6), box(-2, -1, 1, 1)]]]  # holes
    return out


def _frame(spark, pairs, move=0.0):
    shape = lambda p: [[[(float(x) + move, float(y) + move) for x, y in r] for r in part] for part in p]
    return spark.createDataFrame([(i, shape(a), shape(b)) for i, (a, b) in enumerate(pairs)], f"k int, a {geometry.PARTS_DDL}, b {geometry.PARTS_DDL}")


def _same(got, want, near, square=False, tied=False):
    for m in pg.METRICS:
        if tied and m.startswith("minimum"):
            continue
        if m == "minimum_rectangle_angle_error_deg":
            # of a square box either side may count as the longer one
            assert abs(got[m] - want[m]) < 1e-5 or square and abs(got[m] + want[m] - 90) < 1e-5, (m, got[m], want[m])
        else:
            assert got[m] == pytest.approx(want[m], abs=near), (m, got[m], want[m])


@pytest.mark.parametrize("move,near", [(0.0, 1e-9), (500000.0, 1e-6)])
def test_metrics_equal_the_kernel(spark, move, near):
    every = _polygons()
    pairs = [(a, b) for a in every for b in every][:: 1 if not move else 7]
    got = geometry.compare_valid(_frame(spark, pairs, move).repartition(4), "k", "a", "b").collect()
    assert len(got) == len(pairs)
    for r in got:
        a, b = pairs[r["k"]]
        moved = [[pg.ring_of(x + move) for x in p[0]] for p in (a, b)]
        square = any(long - short < 1e-6 for _, _, long, short in map(pg.least_box, moved))
        # all boxes of a triangle have one area, so the last bits decide
        _same(r.asDict(), pg.metrics(*moved), near, square, any(len(p[0]) == 3 for p in moved))


def test_stars_equal_the_kernel(spark):
    grown = F.transform("ring", lambda p: F.struct((p["x"] * 1.1).alias("x"), (p["y"] * 0.9 + 1.0).alias("y")))
    pairs = ad.stars(spark, SF).where("id < 40").select("id", geometry.as_parts(F.col("ring")).alias("a"), geometry.as_parts(grown).alias("b"))
    want = {r["id"]: r.asDict() for r in geometry.compare(pairs, "id", "a", "b").collect()}
    got = geometry.compare_valid(pairs, "id", "a", "b")
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
    for r in got.collect():
        for m in pg.METRICS:
            assert r[m] == pytest.approx(want[r["id"]][m], abs=1e-9)


def test_empty_sides_are_infinite(spark):
    box = [[[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)]]]
    df = spark.createDataFrame([(1, None, box), (2, box, []), (3, box, box)], f"k int, a {geometry.PARTS_DDL}, b {geometry.PARTS_DDL}")
    got = {r["k"]: r for r in geometry.compare_valid(df, "k", "a", "b").collect()}
    assert all(got[k][m] == math.inf for k in (1, 2) for m in pg.METRICS)
    assert got[3]["outline_iou"] == 1.0 and got[3]["hausdorff_distance"] == 0.0
    few = geometry.compare_valid(df.where("k = 3"), "k", "a", "b", ["outline_iou"])
    assert few.columns == ["k", "outline_iou"] and few.collect()[0]["outline_iou"] == 1.0


def test_hull_and_box_of_a_rotated_rectangle(spark):
    t = math.radians(20)
    turn = lambda x, y: (x * math.cos(t) - y * math.sin(t), x * math.sin(t) + y * math.cos(t))
    ring = [turn(*p) for p in [(0, 0), (3, 0), (6, 0), (6, 2), (4, 1), (0, 2)]]
    df = spark.createDataFrame([([tuple(map(float, p)) for p in ring],)], "r array<struct<x:double,y:double>>").select(planar.hull(F.col("r")).alias("h")).withColumn("b", planar.least_box(F.col("h")))
    r = df.select("h", "b", planar.box_angle(F.col("b")).alias("angle"), planar.box_ring(F.col("b")).alias("ring")).collect()[0]
    assert sorted([r["b"]["along"], r["b"]["across"]]) == pytest.approx([2, 6]) and r["angle"] == pytest.approx(20) and r["b"]["area"] == pytest.approx(12)
    assert len(r["h"]) <= 5 and abs(pg.signed_area(np.array([(p["x"], p["y"]) for p in r["ring"]]))) == pytest.approx(12)


@pytest.mark.parametrize("move,near", [(0.0, 1e-9), (500000.0, 1e-6)])
def test_stacked_metrics_equal_the_columns(spark, move, near):
    every = _polygons()
    parts = [[every[3][0], [r + 30 for r in every[-1][0]]], [[every[-2][0][0], every[-2][0][1]], [every[-4][0][0] + 90]]]  # several parts
    pairs = [(a, b) for a in every + parts for b in every + parts][::3]
    df = _frame(spark, pairs, move).repartition(4)
    want = {r["k"]: r.asDict() for r in geometry.compare_valid(df, "k", "a", "b").collect()}
    got = geometry.compare_stacked(df, "k", "a", "b").collect()
    assert len(got) == len(pairs)
    for r in got:
        boxes = [pg.least_box([np.concatenate([x + move for q in p for x in q])]) for p in pairs[r["k"]]]
        square = any(long - short < 1e-6 for _, _, long, short in boxes)
        _same(r.asDict(), want[r["k"]], near, square, any(len(p[0][0]) == 3 for p in pairs[r["k"]]))


def test_stacked_metrics_take_many_edges_and_empty_sides(spark):
    t = np.linspace(0, 2 * math.pi, 1500, endpoint=False)
    star = [[np.c_[(5 + np.sin(9 * t) * k) * np.cos(t), (5 + np.cos(7 * t)) * np.sin(t)] for _ in range(1)] for k in (0.5, 1.0)]
    df = _frame(spark, [([star[0]], [star[1]]), ([], [star[0]])]).union(spark.createDataFrame([(2, None, [[[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)]]])], f"k int, a {geometry.PARTS_DDL}, b {geometry.PARTS_DDL}")).coalesce(1)
    got = {r["k"]: r.asDict() for r in geometry.compare_stacked(df, "k", "a", "b").collect()}
    assert all(got[k][m] == math.inf for k in (1, 2) for m in pg.METRICS)
    want = pg.metrics(star[0], star[1])
    assert all(got[0][m] == pytest.approx(want[m], abs=1e-9) for m in pg.METRICS)


def test_a_pair_of_stars_costs_few_milliseconds():
    import time

    import pyarrow as pa

    from cantle.functions import stacked

    t = np.linspace(0, 2 * math.pi, 64, endpoint=False)
    rng = np.random.default_rng(3)
    rows = [[[[{"x": x, "y": y} for x, y in zip(r * np.cos(t), r * np.sin(t), strict=True)]]] for r in rng.uniform(5, 9, (200, 64))]
    column = pa.array(rows)
    before = time.process_time()
    assert np.allclose(stacked.metrics(column, column)["outline_iou"], 1.0)
    assert (time.process_time() - before) / len(rows) < 0.01
