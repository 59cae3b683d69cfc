"""Contiguous shards of near-equal byte size, cut on a global prefix sum.

Rows are put in one total order (hash of the text, then id, then input position), so
equal texts stand side by side. Each range partition sums its bytes and rows; the totals,
one row per partition, give every partition its offset, and a streaming pass turns the
offsets into each row's global first byte and row number. Shard ``k`` holds the rows whose
first byte lies in ``[k * total / n, (k + 1) * total / n)``.

A cut that falls inside a group of equal texts moves to the nearer end of that group if the
group is no larger than the largest single row, so every cut stays within one row size of
its target. Larger groups are split at the row.

Edge cases: null text counts as empty (size 1, CRC 0); null ids keep their row and sort
first; repeated rows each take a slot of their own; fewer rows than shards leave shards
empty; an empty table gives an empty result. Columns of the input other than the id, the
text and those in ``carry`` are not read, so clashing names do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cantle.session import materialise, shuffle_width


def text_size(text) -> F.Column:
    """UTF-8 bytes of the text plus one."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def balanced_shards(df: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` and the columns in ``carry``, one row per input row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    kept = [F.col(c).alias(f"carried_{i}") for i, c in enumerate(carry)]
    # one scan of the texts; all that follows works on this narrow table
    narrow = materialise(
        df.select(
            F.col(id_col).alias("doc_id"),
            text_size(F.col(text_col)).alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.xxhash64(text).alias("h"),
            F.monotonically_increasing_id().alias("pos"),
            *kept,
        )
    )
    order = ["h", "doc_id", "pos"]
    placed = materialise(narrow.repartitionByRange(shuffle_width(df.sparkSession), *order).sortWithinPartitions(*order).withColumn("pid", F.spark_partition_id()))
    totals = sorted(tuple(r) for r in placed.groupBy("pid").agg(F.sum("size"), F.count("*"), F.max("size")).collect())
    total, largest = sum(t[1] for t in totals), max((t[3] for t in totals), default=0)
    offsets, at, row = {}, 0, 0
    for pid, nbytes, nrows, _ in totals:
        offsets[pid] = (at, row)
        at, row = at + nbytes, row + nrows

    spans = placed.mapInArrow(_spans(offsets), T.StructType([*placed.schema.fields, T.StructField("start", T.LongType()), T.StructField("nth", T.LongType())]))
    cuts = _settled_cuts(spans, total, largest, n_shards)
    shard = sum(((F.col("start") >= F.lit(c)).cast("int") for c in cuts), F.lit(0))
    sharded = spans.withColumn("shard", shard)
    first = {r["shard"]: r["nth"] for r in sharded.groupBy("shard").agg(F.min("nth").alias("nth")).collect()}
    base = F.array(*[F.lit(first.get(k, 0)).cast("long") for k in range(n_shards)])
    return sharded.select(
        "doc_id",
        "size",
        "text_crc32",
        "shard",
        (F.col("nth") - base[F.col("shard")]).alias("slot"),
        *[F.col(f"carried_{i}").alias(c) for i, c in enumerate(carry)],
    )


def _spans(offsets: dict[int, tuple[int, int]]):
    """A streaming running sum: memory is one Arrow batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = row = None
        for b in batches:
            if not b.num_rows:
                continue
            if at is None:
                at, row = offsets[b.column("pid")[0].as_py()]
            size = b.column("size").to_numpy(zero_copy_only=False)
            ends = at + np.cumsum(size)
            nth = row + np.arange(b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ends - size), pa.array(nth)], names=[*b.schema.names, "start", "nth"])
            at, row = int(ends[-1]), int(nth[-1]) + 1

    return run


def _settled_cuts(spans: DataFrame, total: int, largest: int, n_shards: int) -> list[int]:
    """The first byte of each shard but the first; at most ``n_shards - 1`` rows reach the driver."""
    targets = [-(-total * k // n_shards) for k in range(1, n_shards)]
    if not total:
        return targets
    inside = [((F.col("start") < t) & (F.col("start") + F.col("size") > t)) | (F.col("start") == t) for t in targets]
    at_cut = inside[0]
    for c in inside[1:]:
        at_cut = at_cut | c
    hashes = [r["h"] for r in spans.filter(at_cut).select("h").distinct().collect()] if inside else []
    groups = spans.filter(F.col("h").isin(hashes)).groupBy("h").agg(F.min("start").alias("a"), F.sum("size").alias("n")).collect() if hashes else []
    cuts = []
    for t in targets:
        g = next((g for g in groups if g["a"] < t < g["a"] + g["n"] and g["n"] <= largest), None)
        cuts.append(t if g is None else (g["a"] if t - g["a"] <= g["a"] + g["n"] - t else g["a"] + g["n"]))
    return cuts
