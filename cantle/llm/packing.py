"""Cost-balanced packing of documents into sequences of a fixed number of tokens.

A document is its token ids and an end id. Its first whole multiples of the sequence length are
sequences of their own; what is left, its tail, is packed with other tails. Tails are taken in groups
of about ``GROUP_TOKENS`` tokens as a task reads them. A group of T tokens fills T // length sequences: its
tails go, longest first, to the sequence of lowest cost that has room, where a piece of n tokens
costs ``linear * n + quadratic * n * n`` (weights, and attention within the piece). A tail that fits
nowhere is cut at the sequence with most room. The few tokens beyond the last whole sequence go on
to the next group; at a task's end they fill sequences of falling powers of two, which need no padding.
So no sequence is ever padded, and a task cuts at most about one tail a sequence.

Nothing is shuffled or collected; a task holds one group. Sequence numbers carry the task's number, so
they are unique, and a repeated task gives the same rows.

Edge cases: a null or empty text is its end id alone; very long texts are encoded whole; equal
lengths keep the order of input; rows of the same id are documents of their own; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cantle.llm import textbytes as tb
from cantle.llm.bpe_codec import _slices, _spec, _texts, load

#: Tokens of tails that are packed together.
GROUP_TOKENS = 1 << 20
#: Cost of a token, and of a token times a token: in a layer of width d the weights take 12 d d products a token,
#: attention 2 d a pair; here d is 1024.
LINEAR, QUADRATIC = 1.0, 1 / 6144


def powers(n: int) -> list[int]:
    """The powers of two that sum up to n, largest first."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def assign(lengths: Sequence[int], room: Sequence[int], linear: float = LINEAR, quadratic: float = QUADRATIC) -> tuple[list[tuple[int, int, int, int, int]], list[tuple[int, int]]]:
    """(tail, its tokens before, tokens, sequence, offset there) of each piece, and (tail, tokens before) of what found no room."""
    size, room = np.asarray(lengths, np.int64), np.array(room, np.int64)
    cost, used = np.zeros(len(room)), np.zeros(len(room), np.int64)
    placed, left = [], []
    for tail in np.argsort(-size, kind="stable").tolist():
        at, n = 0, int(size[tail])
        while n:
            fits = room >= n
            best = int(np.where(fits, cost, np.inf).argmin()) if fits.any() else int(room.argmax()) if len(room) else -1
            if best < 0 or not room[best]:
                left.append((tail, at))
                break
            part = min(n, int(room[best]))
            placed.append((tail, at, part, best, int(used[best])))
            room[best] -= part
            used[best] += part
            cost[best] += linear * part + quadratic * part * part
            at, n = at + part, n - part
    return placed, left


class _Packer:
    """The pieces of one task's documents; ids of tails are kept until their group is packed."""

    def __init__(self, length: int, linear: float, quadratic: float, first: int):
        self.length, self.linear, self.quadratic, self.next = length, linear, quadratic, first
        self.tails: list[tuple] = []  # (document id, tokens of the document, start, ids)
        self.held = 0
        self.out: list[tuple] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        n, whole = len(ids), len(ids) - len(ids) % self.length
        for at in range(0, whole, self.length):
            self._put(doc_id, n, at, ids[at : at + self.length], self.next, 0)
            self.next += 1
        if whole < n:
            self.tails.append((doc_id, n, whole, ids[whole:].copy()))
            self.held += n - whole
            if self.held >= GROUP_TOKENS:
                self._pack([self.length] * (self.held // self.length))

    def end(self) -> None:
        self._pack([self.length] * (self.held // self.length) + powers(self.held % self.length))

    def _pack(self, room: list[int]) -> None:
        placed, left = assign([len(t[3]) for t in self.tails], room, self.linear, self.quadratic)
        for tail, at, n, seq, offset in placed:
            doc_id, tokens, start, ids = self.tails[tail]
            self._put(doc_id, tokens, start + at, ids[at : at + n], self.next + seq, offset)
        self.next += len(room)
        self.tails = [(d, n, start + at, ids[at:]) for d, n, start, ids, at in ((*self.tails[t], at) for t, at in left)]
        self.held = sum(len(t[3]) for t in self.tails)

    def _put(self, doc_id, tokens, start, ids, seq, offset) -> None:
        self.out.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), tokens, seq, offset, ids))

    def taken(self) -> list[tuple]:
        out, self.out = self.out, []
        return out


_FIELDS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def pack(df: DataFrame, path: str, length: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", linear: float = LINEAR, quadratic: float = QUADRATIC, keep_ids: bool = True) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` and, with ``keep_ids``, its ``ids``."""
    spec = _spec(df, path)
    schema = T.StructType([T.StructField(n, T.LongType()) for n in _FIELDS] + ([T.StructField("ids", T.ArrayType(T.IntegerType()))] if keep_ids else []))

    def batch(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(rows), 1024):
            columns = list(zip(*rows[at : at + 1024], strict=True))
            arrays = [pa.array(c, pa.int64()) for c in columns[:-1]] + ([pa.array(columns[-1], pa.list_(pa.int32()))] if keep_ids else [])
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = load(spec.value)
        packer = _Packer(length, linear, quadratic, TaskContext.get().partitionId() << 33)
        end = np.array([end_id], np.int32)
        for b in tb.sliced(batches):
            names = iter(b.column("doc_id").to_pylist())
            for part in _slices(_texts(b.column("text"))):
                for ids in codec.encode_arrays(part):
                    packer.add(next(names), np.concatenate((ids, end)))
                yield from batch(packer.taken())
        packer.end()
        yield from batch(packer.taken())
        codec._forget()  # the worker may go on with other work

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
