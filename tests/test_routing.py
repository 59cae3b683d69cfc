"""Counters taken while one job writes all sinks of a pair of layers."""

import pytest
from pyspark.sql import functions as F

from cantle import pipeline
from cantle.functions import hashing
from cantle.functions import polygon as pg
from cantle.operators import geometry
from cantle.sources import files
from tests.plain_layer import write_rows
from tests.test_operators import PRJ


def _square(x, y, w, h):
    return [[pg.ring_of([(x, y), (x + w, y), (x + w, y + h), (x, y + h)])]]


def _layers(tmp_path):
    raw = [(f"o{i}", _square(500000 + 30 * i, 3760000, 10 + i % 3, 4)) for i in range(30)]
    raw[7] = ("o7", [])  # no polygon to encode
    target = [("o%d" % i, str(i), _square(500000 + 30 * i, 3760000, 10, 4)) for i in range(20)]
    target += [("o3", "3", _square(0, 0, 1, 1)), ("x", "n/a", _square(0, 0, 1, 1)), ("x", "99", _square(0, 0, 1, 1)), ("other", "21", _square(0, 0, 5, 5))]
    write_rows(str(tmp_path / "raw.shp"), raw, [("osm_id", "C", 20, 0)], PRJ)
    write_rows(str(tmp_path / "target.shp"), target, [("osm_id", "C", 20, 0), ("InBld_FID", "C", 12, 0)], PRJ)
    return str(tmp_path / "raw.shp"), str(tmp_path / "target.shp")


def test_counters_and_sinks_of_one_write(spark, tmp_path):
    part = pipeline.tokenised(spark, *_layers(tmp_path), 5000)
    train = F.col("split") == "train"
    keep = hashing.keeps_sample(F.col("osm_id"), F.col("difficulty"), 1, 0.5)
    sinks = {"train": train & keep, "validation": ~train, "none": F.lit(False)}
    routed, look = pipeline._route(part, "", sinks, {"before": train, "after": train & keep, "never": F.lit(False)})
    files.write_sinks(routed, str(tmp_path), [*sinks, "failures", "unmatched"])
    seen = {k: o.get for k, o in look.items()}
    assert seen["audit"] == {"paired": 20, "invalid": 1, "out_of_range": 1, "duplicate": 1, "mismatch": 1}
    assert seen["lost"] == {"n": 9} and seen["rows"]["failed"] == 1

    good = part.rows.where("error IS NULL").withColumn("keep", keep).withColumn("bucket", geometry.bucket("source_vertex_count")).collect()
    assert seen["rows"]["n|overall"] == len(good) == 19
    for g, rows in {"overall": good, "simple_rectangle": [r for r in good if r["difficulty"] == "simple_rectangle"], "vertices:4": [r for r in good if r["bucket"] == "4"], "complex": [r for r in good if r["difficulty"] == "complex"]}.items():
        assert seen["rows"][f"n|{g}"] == len(rows)
        assert seen["rows"][f"stage|before|{g}"] == sum(r["split"] == "train" for r in rows)
        assert seen["rows"][f"stage|after|{g}"] == sum(r["split"] == "train" and r["keep"] for r in rows)
        assert seen["rows"][f"stage|never|{g}"] == 0
    report = pipeline._group_report(seen["rows"])
    assert set(report) == {g for g in pipeline._groups() if seen["rows"][f"n|{g}"]}
    assert report["overall"]["mean_outline_iou"] == pytest.approx(sum(r["tokenization_metrics"]["outline_iou"] for r in good) / len(good))

    read = lambda name, ddl: files.read_jsonl(spark, str(tmp_path / f"{name}.jsonl"), ddl)
    for name, want in {"train": [r for r in good if r["split"] == "train" and r["keep"]], "validation": [r for r in good if r["split"] != "train"], "none": []}.items():
        got = read(name, files.SAMPLE_DDL).collect()
        assert sorted((r["raw_fid"], r["sample_id"], tuple(r["source_tokens"]), r["source_frame"]) for r in got) == sorted((r["raw_fid"], r["sample_id"], tuple(r["source_tokens"]), r["source_frame"]) for r in want)
    failed = read("failures", "target_fid long, raw_fid long, failure_type string, error string").collect()
    assert sorted((r["target_fid"], r["failure_type"]) for r in failed) == [(7, "preprocessing"), (20, "pairing"), (21, "pairing"), (22, "pairing"), (23, "pairing")]
    assert sorted(r["raw_fid"] for r in read("unmatched", "raw_fid long").collect()) == [20, *range(22, 30)]
    assert not [p for p in tmp_path.iterdir() if p.name.startswith(".sinks")]
    part.release()


def test_a_failed_row_leaves_no_sink(spark, tmp_path):
    bad = spark.range(10).select(F.lit("a").alias("sink"), F.when(F.col("id") == 7, F.raise_error(F.lit("broken"))).otherwise("x").alias("value"))
    with pytest.raises(Exception, match="broken"):
        files.write_sinks(bad, str(tmp_path), ["a"])
    assert not (tmp_path / "a.jsonl").exists()
