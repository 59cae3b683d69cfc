"""The shapefile source and sink: the sink's bytes, failures, pushed filters, windows."""

import glob
import json
import os

import numpy as np
import pytest
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

from cantle.functions import polygon as pg
from cantle.operators.geometry import PARTS_DDL
from cantle.sources import shapefile, shapefile_sink
from tests.plain_layer import write_rows

PRJ = 'PROJCS["x",UNIT["Meter",1.0]]'
FIELDS = [("name", "C", 12, 0), ("n", "N", 8, 0), ("v", "F", 12, 4)]


def _square(x, y, w):
    return [[(x, y), (x + w, y), (x + w, y + w), (x, y + w)]]


def _rows(n):
    hole = [[(0.0, 0.0), (9.0, 0.0), (9.0, 9.0), (0.0, 9.0)], [(2.0, 2.0), (2.0, 4.0), (4.0, 4.0), (4.0, 2.0)]]
    rows = [(f"é{i % 7}" * (i % 5), i if i % 11 else None, i / 7 if i % 13 else None, [_square(10.0 * i, 5.0, 1.0 + i % 3)] + [hole] * (i % 4 == 0) if i % 6 else []) for i in range(n)]
    return rows


def _frame(spark, rows):
    shaped = [(i, *v, [[[(float(x), float(y)) for x, y in r] for r in p] for p in parts]) for i, (*v, parts) in enumerate(rows)]
    return spark.createDataFrame(shaped, f"o int, name string, n long, v double, geom {PARTS_DDL}")


def _plain(path, rows):
    write_rows(str(path), [(*v, [[pg.ring_of(r) for r in p] for p in parts]) for *v, parts in rows], FIELDS, PRJ)


def _bytes(base):
    return {e: open(f"{base}{e}", "rb").read() for e in (".shp", ".shx", ".dbf", ".prj", ".cpg")}


@pytest.mark.parametrize("parts", [1, 8])
def test_sink_writes_the_plain_writers_bytes(spark, tmp_path, monkeypatch, parts):
    monkeypatch.setattr(shapefile_sink, "MOVE_BYTES", 1000)
    rows = _rows(200)
    _plain(tmp_path / "plain.shp", rows)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        n = shapefile_sink.write(_frame(spark, rows).repartition(5), str(tmp_path / "own.shp"), FIELDS, PRJ, "o")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert n == 200
    assert _bytes(tmp_path / "own") == _bytes(tmp_path / "plain")
    assert sorted(os.path.basename(p) for p in glob.glob(str(tmp_path / "own.*"))) == ["own.boxes.json", "own.cpg", "own.dbf", "own.prj", "own.shp", "own.shx"]


def test_empty_layer_and_plain_save(spark, tmp_path):
    _plain(tmp_path / "plain.shp", [])
    assert shapefile_sink.write(_frame(spark, _rows(3)).limit(0), str(tmp_path / "none.shp"), FIELDS, PRJ, "o") == 0
    assert _bytes(tmp_path / "none") == _bytes(tmp_path / "plain")
    assert shapefile.read(spark, str(tmp_path / "none.shp")).count() == 0
    # without the second job the commit itself puts the segments into place
    rows = _rows(30)
    _plain(tmp_path / "plain.shp", rows)
    frame = _frame(spark, rows).orderBy("o").drop("o")
    save = lambda mode: frame.write.format("shapefile").mode(mode).options(fields=json.dumps(FIELDS), prj=PRJ).save(str(tmp_path / "saved.shp"))
    save("append")
    assert _bytes(tmp_path / "saved") == _bytes(tmp_path / "plain")
    with pytest.raises(Exception, match="replaced whole"):
        save("append")
    save("overwrite")
    assert _bytes(tmp_path / "saved") == _bytes(tmp_path / "plain")


def test_a_failed_task_leaves_the_old_layer(spark, tmp_path):
    rows = _rows(40)
    path = str(tmp_path / "l.shp")
    shapefile_sink.write(_frame(spark, rows), path, FIELDS, PRJ, "o")
    old = _bytes(tmp_path / "l")
    broken = _frame(spark, rows).withColumn("n", F.when(F.col("o") == 33, F.raise_error(F.lit("broken row")).cast("long")).otherwise(F.col("n")))
    with pytest.raises(Exception, match="broken row"):
        shapefile_sink.write(broken, path, FIELDS, PRJ, "o")
    assert _bytes(tmp_path / "l") == old
    assert not [p for p in os.listdir(tmp_path) if ".parts" in p]
    with pytest.raises(Exception, match="gone"):
        shapefile_sink.write(_frame(spark, rows), path, [*FIELDS, ("gone", "N", 3, 0)], PRJ, "o")
    assert _bytes(tmp_path / "l") == old


def test_a_committed_replacement_is_finished_by_the_next_reader(spark, tmp_path):
    _plain(tmp_path / "l.shp", _rows(5))
    _plain(tmp_path / "new.shp", _rows(9))
    want = _bytes(tmp_path / "new")
    # the writer ended after the marker and the first move
    for e in (".shx", ".dbf", ".prj", ".cpg"):
        os.replace(tmp_path / f"new{e}", tmp_path / f"l{e}.m1")
    os.replace(tmp_path / "new.shp", tmp_path / "l.shp")
    (tmp_path / "l.commit").write_text('{"mark": ".m1"}')
    assert shapefile.read(spark, str(tmp_path / "l.shp")).count() == 9
    assert _bytes(tmp_path / "l") == want and not (tmp_path / "l.commit").exists()


def _reader(path, columns, filters=(), window=None, records=20):
    source = shapefile.ShapefileSource({"path": str(path), "columns": columns})
    reader = shapefile._Reader(str(path), source.schema(), records, window)
    left = list(reader.pushFilters(list(filters)))
    rows = [r for p in reader.partitions() for r in reader.read(p)]
    return rows, reader.bytes_read, left


def test_filters_are_pushed_and_spare_bytes(spark, tmp_path):
    path = tmp_path / "l.shp"
    _plain(path, _rows(200))
    whole, every, _ = _reader(path, "fid,n,geom")
    assert len(whole) == 200
    rows, some, left = _reader(path, "fid,n,geom", [ds.GreaterThanOrEqual(("fid",), 40), ds.LessThan(("fid",), 60)])
    assert [r[0] for r in rows] == list(range(40, 60)) and not left and some < every / 8
    rows, some, left = _reader(path, "fid,geom", [ds.In(("n",), (7, 150)), ds.IsNotNull(("geom",))])
    assert [r[0] for r in rows] == [7, 150] and len(left) == 1
    _, table, _ = _reader(path, "fid,n")
    index = 8 * 200
    assert some < table + index + 1000  # the .dbf, the offsets and two shapes
    assert [r[0] for r in _reader(path, "fid", [ds.IsNull(("n",)), ds.GreaterThan(("v",), 20.0)])[0]] == [154, 165, 176, 187, 198]
    assert _reader(path, "fid", [ds.EqualTo(("fid",), 500)])[0] == [] and _reader(path, "fid", [ds.IsNull(("fid",))])[0] == []


@pytest.mark.parametrize("where", ["n = 7", "n > 190 AND v < 28.0", "name LIKE 'é3%'", "fid IN (3, 77) AND n IS NOT NULL", "n IS NULL AND fid < 50", "NOT n = 4 AND fid BETWEEN 2 AND 6", "v >= 1.0 OR fid = 0", "n = 5 AND geom IS NOT NULL"])
def test_filtered_scans_equal_plain_filters(spark, tmp_path, where):
    path = str(tmp_path / "l.shp")
    _plain(path, _rows(200))
    want = [r["fid"] for r in spark.createDataFrame([(i, a or None, n, None if v is None else round(v, 4), 1) for i, (a, n, v, _) in enumerate(_rows(200))], "fid long, name string, n long, v double, geom int").where(where).orderBy("fid").collect()]
    found = shapefile.read(spark, path, records=30).where(where)
    assert [r["fid"] for r in found.orderBy("fid").collect()] == want


def test_plan_shows_pushed_filters(spark, tmp_path, capsys):
    path = str(tmp_path / "l.shp")
    _plain(path, _rows(50))
    found = shapefile.read(spark, path, ["fid", "n"]).where("n = 7 AND fid >= 3")
    found.explain("formatted")
    plan = capsys.readouterr().out
    assert "PushedFilters" in plan and "EqualTo(n,7)" in plan and "GreaterThanOrEqual(fid,3)" in plan and ") Filter" not in plan
    assert [tuple(r) for r in found.collect()] == [(7, 7)]


def test_window_uses_the_box_index(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(shapefile, "RECORDS_PER_PARTITION", 25)
    rows = _rows(300)
    path = tmp_path / "l.shp"
    shapefile_sink.write(_frame(spark, rows), str(path), FIELDS, PRJ, "o")
    own, _ = shapefile.box_index(str(tmp_path / "l"))
    assert own in (25, 20_000)  # workers have modules of their own
    _plain(path, rows)  # the layer has changed, so its index no longer counts
    assert shapefile.box_index(str(tmp_path / "l")) == (0, [])
    window = (1995.0, 0.0, 2031.0, 6.0)
    want = [i for i, r in enumerate(rows) if any(p[0][0][0] <= window[2] and p[0][1][0] >= window[0] for p in r[3][:1]) and not (i % 4 == 0 and i % 6 and 9.0 < 0)]
    far = [i for i, r in enumerate(rows) if len(r[3]) == 2 and min(0.0, 10.0 * i) <= window[2] and max(9.0, 10.0 * i + 1 + i % 3) >= window[0]]
    want = sorted(set(want) | set(far))
    rows_of, without, _ = _reader(path, "fid,geom", window=window, records=25)
    assert [r[0] for r in rows_of] == want
    shapefile.index_boxes(spark, str(path), 25)
    assert shapefile.box_index(str(tmp_path / "l"))[0] == 25
    rows_of, with_index, _ = _reader(path, "fid,geom", window=window, records=25)
    assert [r[0] for r in rows_of] == want and with_index < without
    found = shapefile.read(spark, str(path), ["fid", "box"], window=window, records=25).orderBy("fid").collect()
    assert [r["fid"] for r in found] == want and all(r["box"]["x0"] <= window[2] for r in found)


def test_positions_beyond_a_shapefile_are_refused(tmp_path):
    big = [shapefile_sink.Segment(0, "a", 1, 1 << 30, None), shapefile_sink.Segment(1, "b", 1, 1 << 30, None)]
    with pytest.raises(ValueError, match="at most"):
        shapefile_sink.lay_out(str(tmp_path / "l"), str(tmp_path), big, FIELDS, PRJ)


def test_stretches_cover_all_records(monkeypatch):
    monkeypatch.setattr(shapefile_sink, "MOVE_BYTES", 100)
    size = np.array([5, 5, 500, 1, 1, 1, 40])
    cut = list(shapefile_sink._stretches(size))
    assert [a for a, _ in cut] == [0, *[b for _, b in cut][:-1]] and cut[-1][1] == len(size)


def test_a_wide_batch_is_written_a_few_rows_at_a_time(tmp_path, monkeypatch):
    """Ten thousand polygons of 64 points as Python objects took some hundred MB a task."""
    import tracemalloc

    import pyarrow as pa

    class Context:
        partitionId = staticmethod(lambda: 0)

    monkeypatch.setattr(shapefile_sink.TaskContext, "get", lambda: Context)
    ring = [{"x": float(np.cos(a)), "y": float(np.sin(a))} for a in np.arange(64) * (2 * np.pi / 64)]
    kind = pa.list_(pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))))
    one = pa.RecordBatch.from_arrays([pa.array([7], pa.int64()), pa.array([[[ring]]], kind)], names=["id", "geom"])
    wide = pa.Table.from_batches([one] * 4000).combine_chunks().to_batches()[0]
    assert wide.num_rows == 4000
    from pyspark.sql.types import LongType, StructField, StructType

    schema = StructType([StructField("id", LongType()), StructField("geom", shapefile.PARTS)])
    writer = shapefile_sink.SegmentWriter(f"{tmp_path}/l.shp", schema, {"fields": '[["id", "N", 12, 0]]'})
    tracemalloc.start()
    segment = writer.write(iter([wide]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert segment.count == 4000 and os.path.getsize(segment.name + ".shp") == 2 * segment.words
    assert peak < 30e6
