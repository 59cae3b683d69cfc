"""Writing shapefiles from executors, in two phases.

Each task of the write turns its rows into a segment: records as they will stand in the .shp, their
lengths, and the rows of the .dbf. Where a segment lies in the whole depends on all that come before it, so
its record numbers wait. The commit adds up records and lengths over the segments, in the order of
their tasks, creates the whole files with their headers, and lists each segment's place. A second
job puts the segments into place, each task at its own offsets, and returns the boxes for the layer's
index. At last a marker that names the new files is put beside the old ones: from then on the new layer counts, and
whoever finds the marker finishes the replacement. Until then, a failed task leaves the old layer.

The folder must be one that all executors and the driver mount, as for reading.
"""

from __future__ import annotations

import contextlib
import json
import os
import shutil
import struct
import uuid
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from cantle.functions import polygon as pg
from cantle.session import ship
from cantle.sources import shapefile

#: (name, kind, width, decimals) of an attribute.
Attribute = tuple[str, str, int, int]
#: Rows turned into records at a time: as Python objects, a point takes some hundred bytes.
ROWS = 256
#: Bytes of records moved at a time.
MOVE_BYTES = 16 << 20
#: Words of a file, at most: its offsets are 32-bit numbers of 16-bit words.
MOST_WORDS = (1 << 31) - 1
_PLACED = "i long, x0 double, y0 double, x1 double, y1 double"


# -- records --------------------------------------------------------------------------------------
def polygon_record(parts: list[pg.Polygon]) -> bytes:
    """A shape's content: outer rings clockwise, holes the other way, all closed; none without a ring."""
    rings = [pg.orient(r, k != 0) for p in parts for k, r in enumerate(p) if len(r) >= 3]
    if not rings:
        return struct.pack("<i", 0)
    closed = [np.r_[r, r[:1]] for r in rings]
    xy = np.concatenate(closed)
    starts = np.cumsum([0, *map(len, closed)])[:-1]
    return struct.pack("<i4d2i", 5, *xy.min(0), *xy.max(0), len(closed), len(xy)) + starts.astype("<i4").tobytes() + xy.astype("<f8").tobytes()


def attribute_rows(columns: Sequence[Sequence], fields: Sequence[Attribute], count: int) -> bytes:
    """Rows of the .dbf, each of a blank flag and its cells."""
    cells = [[b" "] * count]
    for values, (_, kind, wide, decimals) in zip(columns, fields, strict=True):
        if kind in "NF":
            texts = ("" if v is None else f"{v:.{decimals}f}" if decimals else str(int(v)) for v in values)
            cells.append([t[:wide].rjust(wide).encode() for t in texts])
        else:
            raw = (("" if v is None else str(v)).encode()[:wide] for v in values)
            cells.append([r.decode("utf-8", "ignore").encode().ljust(wide) for r in raw])
    return b"".join(c for row in zip(*cells, strict=True) for c in row)


def _dbf_head(fields: Sequence[Attribute], count: int) -> bytes:
    width = 1 + sum(f[2] for f in fields)
    described = b"".join(struct.pack("<11sc4xBB14x", f[0].encode()[:10], f[1].encode(), f[2], f[3]) for f in fields)
    return struct.pack("<4BIHH", 3, 125, 1, 1, count, 33 + 32 * len(fields), width) + b"\0" * 20 + described + b"\r"


def _shape_head(words: int, box: Sequence[float]) -> bytes:
    return struct.pack(">7i", 9994, 0, 0, 0, 0, 0, words) + struct.pack("<2i8d", 1000, 5, *box, 0, 0, 0, 0)


# -- segments -------------------------------------------------------------------------------------
@dataclass
class Segment(WriterCommitMessage):
    """What a task has written, and later its place."""

    task: int
    name: str
    count: int
    words: int
    box: tuple[float, float, float, float] | None
    first: int = 0
    start: int = 0


class SegmentWriter(DataSourceArrowWriter):
    """Options: ``fields`` (JSON list of attributes), ``prj`` (text of the coordinate system), ``staged`` to leave placing to a second job."""

    def __init__(self, path: str, schema: StructType, options: Mapping[str, str]):
        self.base = os.path.splitext(path)[0]
        self.fields = [tuple(f) for f in json.loads(options["fields"])]
        self.prj, self.staged = options.get("prj", ""), options.get("staged", "false") == "true"
        lost = [f[0] for f in self.fields if f[0] not in schema.fieldNames()]
        if lost or "geom" not in schema.fieldNames():
            raise ValueError(f"a layer needs geom and {', '.join(f[0] for f in self.fields)}; missing {', '.join(lost) or 'geom'}")
        self.folder = options.get("folder") or f"{self.base}.{uuid.uuid4().hex}.parts"
        os.makedirs(self.folder, exist_ok=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Segment:
        from cantle.operators.geometry import parts_of

        name = f"{self.folder}/{uuid.uuid4().hex}"  # each attempt has files of its own
        count = words = 0
        low, high = np.array([np.inf, np.inf]), np.array([-np.inf, -np.inf])
        with open(name + ".shp", "wb") as shp, open(name + ".len", "wb") as lengths, open(name + ".dbf", "wb") as dbf:
            for b in (whole.slice(i, ROWS) for whole in iterator for i in range(0, whole.num_rows, ROWS)):
                bodies = [polygon_record(parts_of(v)) for v in b.column("geom").to_pylist()]
                boxes = np.array([struct.unpack("<4d", r[4:36]) for r in bodies if len(r) > 4]).reshape(-1, 4)
                low, high = np.minimum(low, boxes[:, :2].min(0, initial=np.inf)), np.maximum(high, boxes[:, 2:].max(0, initial=-np.inf))
                size = np.array([len(r) // 2 for r in bodies], np.int64)
                shp.write(b"".join(x for n, r in zip(size.tolist(), bodies, strict=True) for x in (struct.pack(">2i", 0, n), r)))
                lengths.write(size.astype("<i4").tobytes())
                dbf.write(attribute_rows([b.column(f[0]).to_pylist() for f in self.fields], self.fields, b.num_rows))
                count, words = count + b.num_rows, words + int(size.sum()) + 4 * b.num_rows
        return Segment(TaskContext.get().partitionId(), name, count, words, (*low.tolist(), *high.tolist()) if np.isfinite(low).all() else None)

    def commit(self, messages: list[Segment | None]) -> None:
        job = lay_out(self.base, self.folder, [m for m in messages if m is not None], self.fields, self.prj)
        if not self.staged:
            boxes = [place(job, s) for s in job["segments"]]
            publish(job, [b for x in boxes for b in x])

    def abort(self, messages: list[Segment | None]) -> None:
        shutil.rmtree(self.folder, ignore_errors=True)


# -- places ---------------------------------------------------------------------------------------
def lay_out(base: str, folder: str, segments: Sequence[Segment], fields: Sequence[Attribute], prj: str) -> dict:
    """Prefix sums over the segments, and the whole files at their full size with headers; the job's list is left in its folder."""
    ordered = sorted(segments, key=lambda s: s.task)
    count, words = 0, 50
    for s in ordered:
        s.first, s.start = count, words
        count, words = count + s.count, words + s.words
    if words > MOST_WORDS:
        raise ValueError(f"{2 * words} bytes of shapes; a shapefile holds {2 * MOST_WORDS} at most")
    boxes = np.array([s.box for s in ordered if s.box]).reshape(-1, 4)
    box = [*boxes[:, :2].min(0), *boxes[:, 2:].max(0)] if len(boxes) else [0.0] * 4
    width, head = 1 + sum(f[2] for f in fields), 33 + 32 * len(fields)
    mark = f".{os.path.basename(folder)}"
    for e, text, size in ((".shp", _shape_head(words, box), 2 * words), (".shx", _shape_head(50 + 4 * count, box), 100 + 8 * count), (".dbf", _dbf_head(fields, count), head + width * count + 1)):
        with open(base + e + mark, "wb") as f:
            f.write(text)
            f.truncate(size)
            if e == ".dbf":
                f.seek(size - 1)
                f.write(b"\x1a")
    for e, text in ((".prj", prj), (".cpg", "UTF-8")):
        with open(base + e + mark, "w", encoding="utf-8") as f:
            f.write(text)
    job = {"base": base, "folder": folder, "mark": mark, "count": count, "width": width, "head": head, "segments": [vars(s) for s in ordered]}
    with open(f"{folder}/job.json", "w", encoding="utf-8") as f:
        json.dump(job, f)
    return job


def place(job: dict, segment: dict) -> list[tuple]:
    """Put one segment into the whole files; (stretch, box) of its records. A repeated attempt writes the same bytes."""
    size = np.fromfile(segment["name"] + ".len", "<i4").astype(np.int64)
    base, mark, first = job["base"], job["mark"], segment["first"]
    start = segment["start"] + np.cumsum(size + 4) - size - 4
    with open(base + ".shx" + mark, "r+b") as f:
        f.seek(100 + 8 * first)
        f.write(np.c_[start, size].astype(">i4").tobytes())
    with open(segment["name"] + ".dbf", "rb") as cells, open(base + ".dbf" + mark, "r+b") as f:
        f.seek(job["head"] + job["width"] * first)
        shutil.copyfileobj(cells, f, MOVE_BYTES)
    boxes: dict[int, np.ndarray] = {}
    with open(segment["name"] + ".shp", "rb") as own, open(base + ".shp" + mark, "r+b") as f:
        f.seek(2 * segment["start"])
        for a, b in _stretches(size):
            raw = np.frombuffer(own.read(2 * int((size[a:b] + 4).sum())), np.uint8).copy()
            at = 2 * (start[a:b] - start[a])
            number = np.arange(first + a + 1, first + b + 1).astype(">i4").view(np.uint8).reshape(-1, 4)
            raw[at[:, None] + np.arange(4)] = number
            f.write(raw.tobytes())
            shaped = np.flatnonzero(size[a:b] > 2)
            box = raw[(at[shaped] + 12)[:, None] + np.arange(32)].view("<f8") if len(shaped) else np.zeros((0, 4))
            stretch = (first + a + shaped) // shapefile.RECORDS_PER_PARTITION
            for i in np.unique(stretch).tolist():
                own_box = box[stretch == i]
                found = np.r_[own_box[:, :2].min(0), own_box[:, 2:].max(0)]
                boxes[i] = _joined(boxes[i], found) if i in boxes else found
    return [(i, *b.tolist()) for i, b in boxes.items()]


def _stretches(size: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of records of about MOVE_BYTES."""
    ends = np.cumsum(2 * (size + 4))
    a = 0
    while a < len(size):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + MOVE_BYTES, side="right")))
        yield a, b
        a = b


def _joined(a: Sequence[float], b: Sequence[float]) -> np.ndarray:
    return np.r_[np.minimum(a[:2], b[:2]), np.maximum(a[2:], b[2:])]


def publish(job: dict, boxes: Sequence[tuple]) -> int:
    """Make the new files count by one rename of a marker, then move them over the old ones."""
    base = job["base"]
    temp = f"{base}.commit{job['mark']}"
    with open(temp, "w", encoding="utf-8") as f:
        json.dump({"mark": job["mark"]}, f)
    shapefile.recover(base)  # of an earlier writer
    os.replace(temp, base + ".commit")
    shapefile.recover(base)
    merged: dict[int, np.ndarray] = {}
    for i, *b in boxes:
        merged[i] = _joined(merged[i], b) if i in merged else np.array(b)
    shapefile.write_box_index(base, shapefile.RECORDS_PER_PARTITION, {i: b.tolist() for i, b in merged.items()}, job["count"])
    shutil.rmtree(job["folder"], ignore_errors=True)
    return job["count"]


def write(df: DataFrame, path: str, fields: Sequence[Attribute], prj: str, order: str, geom: str = "geom") -> int:
    """A layer from a DataFrame, records in the order of a column; returns how many. The old layer stays until the new one is whole."""
    spark = df.sparkSession
    ship(spark)
    spark.dataSource.register(shapefile.ShapefileSource)
    base = os.path.splitext(path)[0]
    folder = f"{base}.{uuid.uuid4().hex}.parts"
    names = [f[0] for f in fields]
    rows = df.withColumnRenamed(geom, "geom") if geom != "geom" else df
    try:
        rows.orderBy(order).select(*names, "geom").write.format("shapefile").mode("overwrite").options(fields=json.dumps([list(f) for f in fields]), prj=prj, staged="true", folder=folder).save(path)
        with open(f"{folder}/job.json", encoding="utf-8") as f:
            job = json.load(f)
        whole = {k: v for k, v in job.items() if k != "segments"}

        def run(batches):
            for b in batches:
                out = [r for raw in b.column("segment").to_pylist() for r in place(whole, json.loads(raw))]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 5, [pa.int64(), *[pa.float64()] * 4], strict=True)], names=["i", "x0", "y0", "x1", "y1"])

        segments = spark.createDataFrame([(i, json.dumps(s)) for i, s in enumerate(job["segments"])], "i long, segment string")
        dealt = segments.repartitionByRange(max(1, len(job["segments"])), "i")
        boxes = [tuple(r) for r in dealt.mapInArrow(run, _PLACED).collect()] if job["segments"] else []
        return publish(job, boxes)
    finally:
        shapefile.recover(base)  # what was committed goes on, anything else goes
        shutil.rmtree(folder, ignore_errors=True)
        for e in shapefile._EVERY:
            with contextlib.suppress(FileNotFoundError):
                os.remove(f"{base}{e}.{os.path.basename(folder)}")
