"""ESRI shapefiles: a Python data source for reading. ``shapefile_sink`` writes them.

The public formats: .shp and .shx hold shapes and their offsets, .dbf (dBase III) the attributes, .prj
the coordinate system. Records keep their order; ``fid`` is the record's place. Reading is split
by record ranges (option ``records``: how many a partition); without ``geom`` and ``box`` among the
``columns`` option only the .dbf is read.

Filters on ``fid`` and on attributes are pushed into the scan: ranges of ``fid`` drop whole partitions, and
a record whose attributes fail is left before its shape is read. The option ``window`` (x0,y0,x1,y1) keeps
records whose bounding box meets the window; it is tested on the 32 bytes at a record's head, and
partitions whose boxes, as the layer's box index has them, lie outside are not read at all.
"""

from __future__ import annotations

import contextlib
import json
import os
import re
import struct
import uuid
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from cantle.functions import polygon as pg

RECORDS_PER_PARTITION = 20_000
#: Parts, each a list of rings of points.
PARTS = ArrayType(ArrayType(ArrayType(StructType([StructField("x", DoubleType()), StructField("y", DoubleType())]))))
#: A record's bounding box.
BOX = StructType([StructField(n, DoubleType()) for n in ("x0", "y0", "x1", "y1")])
_REQUIRED = (".shp", ".shx", ".dbf", ".prj")
_EVERY = (*_REQUIRED, ".cpg")


def recover(base: str) -> None:
    """Finish a replacement that was committed: its marker names the new files, which are moved over the old ones."""
    try:
        with open(base + ".commit", encoding="utf-8") as f:
            mark = json.load(f)["mark"]
    except FileNotFoundError:
        return
    for e in _EVERY:
        with contextlib.suppress(FileNotFoundError):  # moved already
            os.replace(base + e + mark, base + e)
    with contextlib.suppress(FileNotFoundError):
        os.remove(base + ".commit")


def family(path: str) -> list[str]:
    """The files of a layer; a missing required one is an error."""
    base = os.path.splitext(path)[0]
    recover(base)
    lost = [base + e for e in _REQUIRED if not os.path.exists(base + e)]
    if lost:
        raise FileNotFoundError(f"incomplete shapefile, missing {', '.join(lost)}")
    return [base + e for e in (*_REQUIRED, ".cpg") if os.path.exists(base + e)]


def check_crs(path: str) -> str:
    """The .prj text, if it names a projected system in metres."""
    prj = os.path.splitext(path)[0] + ".prj"
    if not os.path.exists(prj):
        raise ValueError(f"missing coordinate system file {prj}")
    with open(prj, encoding="utf-8", errors="ignore") as f:
        wkt = f.read()
    units = re.findall(r'(?:LENGTHUNIT|UNIT)\s*\[\s*"([^"]+)"', wkt, re.I)
    if not re.match(r"\s*(PROJCS|PROJCRS)\b", wkt, re.I) or not units or units[-1].lower() not in ("metre", "meter"):
        raise ValueError(f"the coordinate system of {path} must be projected, in metres")
    return wkt


def _dbf_header(path: str) -> tuple[int, int, int, list[tuple[str, str, int, int]]]:
    """(records, header bytes, record bytes, fields as name, kind, width, decimals)."""
    with open(path, "rb") as f:
        n, head, size = struct.unpack("<4xIHH", f.read(12))
        f.seek(32)
        fields = []
        while (raw := f.read(32)) and raw[0] != 0x0D:
            name, kind, width, decimals = struct.unpack("<11sc4xBB", raw[:18])
            fields.append((name.split(b"\0")[0].decode("ascii", "replace"), kind.decode(), width, decimals))
    return n, head, size, fields


def _spark_type(kind: str, decimals: int):
    return StringType() if kind not in "NF" else DoubleType() if decimals or kind == "F" else LongType()


def _value(raw: bytes, kind: str, decimals: int, encoding: str):
    text = raw.decode(encoding, "replace").strip().strip("\0")
    if kind not in "NF":
        return text or None
    try:
        return float(text) if decimals or kind == "F" else int(text)
    except ValueError:
        return None


def _encoding(base: str) -> str:
    if os.path.exists(base + ".cpg"):
        with open(base + ".cpg") as f:
            name = f.read().strip().lower()
        return "utf-8" if name in ("utf-8", "utf8", "65001") else "latin-1"
    return "utf-8"


def _shape(raw: bytes) -> list | None:
    """A record's polygon parts: each clockwise ring opens a part, others are its holes."""
    (kind,) = struct.unpack("<i", raw[:4])
    if kind == 0:
        return None
    if kind not in (5, 15, 25):
        return []
    parts, points = struct.unpack("<2i", raw[36:44])
    starts = [*np.frombuffer(raw, "<i4", parts, 44).tolist(), points]
    xy = np.frombuffer(raw, "<f8", 2 * points, 44 + 4 * parts).reshape(-1, 2)
    found = [pg.ring_of(xy[a:b]) for a, b in zip(starts, starts[1:])]
    found = [r for r in found if len(r) >= 3]
    shells = [[r] for r in found if pg.signed_area(r) < 0]
    for h in (r for r in found if pg.signed_area(r) >= 0):
        home = [s for s in shells if pg.contains(s[0], h[:1])[0] or pg.contains(s[0], h.mean(0)[None])[0]]
        if home:
            min(home, key=lambda s: -pg.signed_area(s[0])).append(h)
        else:
            shells.append([h])
    return [[[(float(x), float(y)) for x, y in r] for r in s] for s in shells]


class _Range(InputPartition):
    def __init__(self, start: int, stop: int):
        self.start, self.stop = start, stop


def _key(v):
    """As Spark orders: NaN above all numbers."""
    return (v != v, v)


#: What a pushed filter asks of a value that is not null.
_TESTS = {
    ds.EqualTo: lambda v, x: _key(v) == _key(x) or v == x,
    ds.GreaterThan: lambda v, x: _key(v) > _key(x),
    ds.GreaterThanOrEqual: lambda v, x: _key(v) >= _key(x),
    ds.LessThan: lambda v, x: _key(v) < _key(x),
    ds.LessThanOrEqual: lambda v, x: _key(v) <= _key(x),
    ds.In: lambda v, x: v in x,
    ds.StringStartsWith: lambda v, x: v.startswith(x),
    ds.StringEndsWith: lambda v, x: v.endswith(x),
    ds.StringContains: lambda v, x: x in v,
}


def _passes(kind: type, v, x) -> bool:
    if kind in (ds.IsNull, ds.IsNotNull):
        return (v is None) == (kind is ds.IsNull)
    return v is not None and bool(_TESTS[kind](v, x))


def box_index(base: str) -> tuple[int, list]:
    """(records a box, boxes) of the layer's box index; (0, []) where there is none or the layer has changed since."""
    try:
        with open(base + ".boxes.json", encoding="utf-8") as f:
            body = json.load(f)
        info = os.stat(base + ".shp")
        return (body["records"], body["boxes"]) if body["shp"] == [info.st_size, info.st_mtime_ns] else (0, [])
    except (OSError, ValueError, KeyError):
        return 0, []


def write_box_index(base: str, records: int, boxes: dict[int, Sequence[float]], count: int) -> None:
    """One box per so many records of the layer; a stretch without shapes has none."""
    info = os.stat(base + ".shp")
    body = {"shp": [info.st_size, info.st_mtime_ns], "records": records, "boxes": [list(boxes[i]) if i in boxes else None for i in range(-(-count // records))]}
    temp = f"{base}.boxes.{uuid.uuid4().hex}"
    with open(temp, "w", encoding="utf-8") as f:
        json.dump(body, f)
    os.replace(temp, base + ".boxes.json")


class _Reader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, records: int = RECORDS_PER_PARTITION, window: Sequence[float] | None = None):
        self.base, self.names = os.path.splitext(path)[0], schema.fieldNames()
        self.records, self.window = records, window
        self.filters: list[tuple[type, str, object]] = []
        self.bytes_read = 0

    def pushFilters(self, filters: Iterable[ds.Filter]) -> Iterator[ds.Filter]:
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name is not None and name not in ("geom", "box") and (type(f) in _TESTS or isinstance(f, ds.IsNull | ds.IsNotNull)):
                self.filters.append((type(f), name, getattr(f, "value", None)))
            else:
                yield f

    def partitions(self):
        n = _dbf_header(self.base + ".dbf")[0]
        low, high = 0, n
        for kind, name, x in self.filters:
            if name == "fid":
                if kind is ds.IsNull:
                    high = 0
                ends = {ds.EqualTo: (x, x), ds.GreaterThan: (x, n), ds.GreaterThanOrEqual: (x, n), ds.LessThan: (0, x), ds.LessThanOrEqual: (0, x)}
                a, b = (min(x), max(x)) if kind is ds.In and x else ends.get(kind, (0, n))
                low, high = max(low, a), min(high, b + 1)
        step, boxes = box_index(self.base) if self.window else (0, [])
        out = []
        for i in range(0, n, self.records):
            start, stop = max(i, low), min(n, i + self.records, high)
            near = not boxes or any(b is not None and _meets(b, self.window) for b in boxes[start // step : -(-stop // step)])
            if start < stop and near:
                out.append(_Range(start, stop))
        return out or [_Range(0, 0)]

    def _take(self, f, at: int, n: int) -> bytes:
        f.seek(at)
        raw = f.read(n)
        self.bytes_read += len(raw)
        return raw

    def read(self, part) -> Iterator[tuple]:
        _, head, size, fields = _dbf_header(self.base + ".dbf")
        at, spots = 1, {}
        for name, kind, width, decimals in fields:
            spots[name] = (at, at + width, kind, decimals)
            at += width
        encoding, count = _encoding(self.base), part.stop - part.start
        asked = [n for n in dict.fromkeys([*(f[1] for f in self.filters), *self.names]) if n in spots or n == "fid"]
        with open(self.base + ".dbf", "rb") as f:
            table = self._take(f, head + size * part.start, size * count)
        shapes = None
        if "geom" in self.names or "box" in self.names or self.window:
            with open(self.base + ".shx", "rb") as f:
                index = np.frombuffer(self._take(f, 100 + 8 * part.start, 8 * count), ">i4").reshape(-1, 2).astype(np.int64) * 2
            shapes = open(self.base + ".shp", "rb")
        try:
            for k in range(count):
                record, row = table[k * size : (k + 1) * size], {"fid": part.start + k}
                for name in asked:
                    if name != "fid":
                        a, b, kind, decimals = spots[name]
                        row[name] = _value(record[a:b], kind, decimals, encoding)
                if not all(_passes(kind, row[name], x) for kind, name, x in self.filters):
                    continue
                if shapes:
                    where, length = int(index[k, 0]) + 8, int(index[k, 1])
                    if "box" in self.names or self.window:
                        box = _box(self._take(shapes, where, min(length, 36)))
                        if self.window and not (box and _meets(box, self.window)):
                            continue
                        row["box"] = box
                    if "geom" in self.names:
                        row["geom"] = _shape(self._take(shapes, where, length))
                yield tuple(row[n] for n in self.names)
        finally:
            if shapes:
                shapes.close()


def _box(head: bytes) -> tuple[float, ...] | None:
    """The bounding box of a record's head, if it has a shape with one."""
    return struct.unpack("<4d", head[4:36]) if len(head) == 36 and struct.unpack("<i", head[:4])[0] in (3, 5, 8, 13, 15, 18, 23, 25, 28, 31) else None


def _meets(a: Sequence[float], b: Sequence[float]) -> bool:
    return a[0] <= b[2] and b[0] <= a[2] and a[1] <= b[3] and b[1] <= a[3]


class ShapefileSource(DataSource):
    """``spark.read.format("shapefile").load(path)``; option ``columns`` is a comma list, ``box`` among it gives bounding boxes."""

    @classmethod
    def name(cls) -> str:
        return "shapefile"

    def schema(self) -> StructType:
        fields = _dbf_header(os.path.splitext(self.options["path"])[0] + ".dbf")[3]
        geom = StructField("geom", PARTS)
        every = [StructField("fid", LongType()), *[StructField(n, _spark_type(k, d)) for n, k, _, d in fields], geom]
        wanted = [c.strip() for c in self.options.get("columns", "").split(",") if c.strip()]
        return StructType([f for f in every if not wanted or f.name in wanted] + [StructField("box", BOX)] * ("box" in wanted))

    def reader(self, schema: StructType):
        window = [float(v) for v in self.options.get("window", "").split(",") if v.strip()]
        return _Reader(self.options["path"], schema, int(self.options.get("records", RECORDS_PER_PARTITION)), window or None)

    def writer(self, schema: StructType, overwrite: bool):
        from cantle.sources.shapefile_sink import SegmentWriter

        if not overwrite and os.path.exists(os.path.splitext(self.options["path"])[0] + ".shp"):
            raise FileExistsError(f"{self.options['path']} is there; a layer can only be replaced whole")
        return SegmentWriter(self.options["path"], schema, self.options)


def read(spark: SparkSession, path: str, columns: Sequence[str] = (), window: Sequence[float] | None = None, records: int = RECORDS_PER_PARTITION) -> DataFrame:
    """A layer in the shared file system as a DataFrame; filters on it are pushed into the scan."""
    family(path)
    spark.dataSource.register(ShapefileSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("shapefile").option("records", records)
    if columns:
        reader = reader.option("columns", ",".join(columns))
    if window:
        reader = reader.option("window", ",".join(map(repr, map(float, window))))
    return reader.load(path)


def index_boxes(spark: SparkSession, path: str, records: int = RECORDS_PER_PARTITION) -> None:
    """Write the box index of a layer that came without one: record heads are read in parallel, a box per stretch comes back."""
    base = os.path.splitext(path)[0]
    heads = read(spark, path, ["fid", "box"], records=records).where("box IS NOT NULL")
    least = [F.min(f"box.{c}").alias(c) for c in ("x0", "y0")] + [F.max(f"box.{c}").alias(c) for c in ("x1", "y1")]
    rows = heads.groupBy((F.col("fid") / records).cast("long").alias("i")).agg(*least).collect()
    write_box_index(base, records, {r["i"]: r[1:] for r in rows}, _dbf_header(base + ".dbf")[0])
