"""Table functions over sequences that come as rows, callable from SQL.

Each takes a table with ``id``, the place ``i``, and what stands there, and asks Spark to deal it out by ``id``
in the order of ``i``. So a sequence is never held whole, however long it is: a function keeps a run, a
segment or a point. ``register`` makes ``token_runs``, ``token_segments`` and ``ring_walk`` known to a session, as in

    SELECT * FROM token_runs(TABLE(SELECT id, i, t FROM tokens))

A call of Python a row is slow over many rows. ``batch_runs`` and ``batch_walk`` do the same by numpy over Arrow batches, for ids
of type long. They take many sequences in turn, so the caller deals out buckets of ids, in order of id and place:

    SELECT * FROM batch_runs(TABLE(tokens) PARTITION BY pmod(xxhash64(id), 1024) ORDER BY (id, i))

Edge cases: rows with a null in ``t``, ``d`` or ``n`` are passed over; rows with a null id form a sequence of their own; an
empty table gives an empty result; columns beside those named are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udtf, udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from cantle.constants import DIRECTIONS, SPECIAL, STEP_M
from cantle.session import ship


def _sequence(table: AnalyzeArgument, needed: tuple[str, ...], out: list[T.StructField]) -> AnalyzeResult:
    """The result's schema, behind the table's own kind of id, and how the table is to be dealt out."""
    if not table.isTable:
        raise ValueError("a TABLE argument is needed")
    kinds = {f.name: f.dataType for f in table.dataType.fields}
    if lost := [n for n in ("id", "i", *needed) if n not in kinds]:
        raise ValueError(f"the table has no {', '.join(lost)}")
    return AnalyzeResult(T.StructType([T.StructField("id", kinds["id"]), *out]), partitionBy=[PartitioningColumn("id")], orderBy=[OrderingColumn("i")])


@udtf
class TokenRuns:
    """``id, at, t, n``: equal neighbours as one row, ``at`` being the run's number in its sequence."""

    @staticmethod
    def analyze(table: AnalyzeArgument) -> AnalyzeResult:
        return _sequence(table, ("t",), [T.StructField("at", T.LongType()), T.StructField("t", T.IntegerType()), T.StructField("n", T.LongType())])

    def __init__(self):
        self.run, self.at = None, 0

    def eval(self, row) -> Iterator[tuple]:
        if row["t"] is None:
            return
        if self.run and self.run[1] == row["t"]:
            self.run[2] += 1
            return
        yield from self.terminate()
        self.run = [row["id"], row["t"], 1]

    def terminate(self) -> Iterator[tuple]:
        if self.run:
            yield self.run[0], self.at, self.run[1], self.run[2]
            self.run, self.at = None, self.at + 1


@udtf
class TokenSegments:
    """``id, at, segment``: what stands between special tokens, if it has two tokens at least; ``at`` is the first one's place."""

    @staticmethod
    def analyze(table: AnalyzeArgument) -> AnalyzeResult:
        return _sequence(table, ("t",), [T.StructField("at", T.LongType()), T.StructField("segment", T.ArrayType(T.IntegerType()))])

    def __init__(self):
        self.id, self.at, self.held = None, None, []

    def eval(self, row) -> Iterator[tuple]:
        if row["t"] is None:
            return
        if row["t"] in SPECIAL:
            yield from self.terminate()
            return
        if not self.held:
            self.id, self.at = row["id"], row["i"]
        self.held.append(row["t"])

    def terminate(self) -> Iterator[tuple]:
        if len(self.held) > 1:
            yield self.id, self.at, self.held
        self.held = []


@udtf
class RingWalk:
    """``id, i, x, y``: the point behind each run of ``n`` steps in direction ``d``, from the origin."""

    @staticmethod
    def analyze(table: AnalyzeArgument) -> AnalyzeResult:
        return _sequence(table, ("d", "n"), [T.StructField("i", T.LongType()), T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])

    def __init__(self):
        self.x = self.y = 0.0

    def eval(self, row) -> Iterator[tuple]:
        if row["d"] is None or row["n"] is None:
            return
        angle, length = row["d"] * (2 * math.pi / DIRECTIONS), row["n"] * STEP_M
        self.x += math.cos(angle) * length
        self.y += math.sin(angle) * length
        yield row["id"], row["i"], self.x, self.y


#: Rows of a sequence in a batch from which it is added up by itself.
LONG = 64


def _columns(batch: pa.RecordBatch, names: tuple[str, ...]) -> list[np.ndarray]:
    """Ids, whether they are null, and the named columns; rows with a null in one of ``names``, but for ``i``, are left out."""
    for n in names:
        if n != "i" and batch.column(n).null_count:
            batch = batch.filter(batch.column(n).is_valid())
    ids = batch.column("id")
    bare = ids.is_null().to_numpy(zero_copy_only=False)
    return [ids.fill_null(0).to_numpy(zero_copy_only=False), bare, *[batch.column(n).to_numpy(zero_copy_only=False) for n in names]]


def _starts(ids: np.ndarray, bare: np.ndarray, before: tuple | None) -> np.ndarray:
    """Where a sequence starts; ``before`` is the last id before the batch, and whether that is null."""
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (bare[1:] != bare[:-1])
    new[0] = before is None or (ids[0], bare[0]) != before
    return new


def _ids(ids: np.ndarray, bare: np.ndarray) -> pa.Array:
    return pa.array(ids, pa.int64(), mask=bare)


@arrow_udtf(returnType="id long, at long, t int, n long")
class BatchRuns:
    """``token_runs`` over batches."""

    def __init__(self):
        self.run = None  # the last run, which may go on: id, whether that is null, number, token, length

    def eval(self, batch: pa.RecordBatch) -> Iterator[pa.Table]:
        ids, bare, t = _columns(batch, ("t",))
        if not len(t):
            return
        if self.run:
            i, b, at, last, n = self.run
            ids, bare, t = np.r_[i, ids], np.r_[b, bare], np.r_[last, t]
        new = _starts(ids, bare, None)
        first = np.flatnonzero(new | np.r_[True, t[1:] != t[:-1]])
        size = np.diff(np.r_[first, len(t)])
        # a run's number: runs so far, less those before its sequence
        begins = new[first]
        number = np.arange(len(first))
        number -= number[begins][np.cumsum(begins) - 1]
        if self.run:
            same = np.cumsum(begins) == 1
            number[same] += at
            size[0] += n - 1
        ids, bare, t = ids[first], bare[first], t[first]
        self.run = ids[-1], bare[-1], number[-1], t[-1], size[-1]
        if len(first) > 1:
            yield self._table(ids[:-1], bare[:-1], number[:-1], t[:-1], size[:-1])

    def terminate(self) -> Iterator[pa.Table]:
        if self.run:
            yield self._table(*[np.array([v]) for v in self.run])

    @staticmethod
    def _table(ids, bare, number, t, size) -> pa.Table:
        return pa.table({"id": _ids(ids, bare), "at": pa.array(number, pa.int64()), "t": pa.array(t, pa.int32()), "n": pa.array(size, pa.int64())})


@arrow_udtf(returnType="id long, i long, d int, n long, x double, y double")
class BatchWalk:
    """``ring_walk`` over batches; the steps ``d`` and ``n`` are returned as well, so that nothing need be joined."""

    def __init__(self):
        self.last, self.x, self.y = None, 0.0, 0.0

    def eval(self, batch: pa.RecordBatch) -> Iterator[pa.Table]:
        ids, bare, i, d, n = _columns(batch, ("i", "d", "n"))
        if not len(d):
            return
        new = _starts(ids, bare, self.last)
        angle, length = d * (2 * math.pi / DIRECTIONS), n * STEP_M
        x, y = np.cos(angle) * length, np.sin(angle) * length
        if not new[0]:
            x[0], y[0] = self.x + x[0], self.y + y[0]
        new[0] = True
        self._add_up(new, x, y)
        self.last, self.x, self.y = (ids[-1], bare[-1]), x[-1], y[-1]
        yield pa.table({"id": _ids(ids, bare), "i": pa.array(i, pa.int64()), "d": pa.array(d, pa.int32()), "n": pa.array(n, pa.int64()), "x": pa.array(x), "y": pa.array(y)})

    @staticmethod
    def _add_up(new: np.ndarray, *values: np.ndarray) -> None:
        """Sums along each sequence, one row after another, in place: long sequences by themselves, short ones abreast."""
        first = np.flatnonzero(new)
        size = np.diff(np.r_[first, len(new)])
        for a, k in zip(first[size >= LONG], size[size >= LONG], strict=True):
            for v in values:
                v[a : a + k] = np.cumsum(v[a : a + k])
        first, size = first[size < LONG], size[size < LONG]
        for k in range(1, int(size.max(initial=0))):
            at = first[size > k] + k
            for v in values:
                v[at] += v[at - 1]


def register(spark: SparkSession) -> None:
    """Make the table functions known to the session's SQL."""
    ship(spark)
    for name, function in (("token_runs", TokenRuns), ("token_segments", TokenSegments), ("ring_walk", RingWalk), ("batch_runs", BatchRuns), ("batch_walk", BatchWalk)):
        spark.udtf.register(name, function)
