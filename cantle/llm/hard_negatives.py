"""Hard-negative mining by blocked dense products, exact and in two passes.

A component x becomes floor(256 x), a row's score its inner product with the anchor. Anchors are
dealt into blocks of a bounded number of bytes. A block is broadcast, and every task multiplies it
with its candidate rows, one batch after another, in float64 (exact below 2 ** 53; whole numbers of
any size beyond). The first pass keeps per anchor the best rows of its own label, which merge over
tasks into its positives. The second pass is sent these with the block and keeps, per anchor and
positive, the best rows of other labels with ``low * positive <= high * negative <= high *
positive``. Both states are a few rows per anchor, whatever the input; candidates are read where
they lie and never shuffled.

Edge cases: rows with a null id, label or vector, or with null or non-finite components take no part;
a shorter vector counts as if filled with zeros; a row is never its own positive, but another row of
its id may be; equal scores rank by smaller id; fewer rows than asked give fewer rows; an anchor
without positives, or a positive with an empty window (as with any negative score), gives none; each
row of a repeated anchor id is an anchor of its own; scores beyond 64 bits stop at the largest long;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cantle.llm.topk_blocks import _products
from cantle.session import pinned, scratch, ship, tidy

SCALE = 256.0
#: Bytes of a block of anchors, as float64; it bounds what is broadcast.
BLOCK_BYTES = 24 << 20
#: Scores held at a time: anchors of a block times rows of a slice.
SLICE_SCORES = 1 << 21
_LONG = (1 << 63) - 1
_BEST = "anchor long, positive int, score long, vec_id long, row long"


def matrix(column: pa.ListArray) -> np.ndarray:
    """floor(256 x) of each vector, short ones filled with zeros."""
    size = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(size), int(size.max(initial=0))))
    out[np.arange(out.shape[1])[None, :] < size[:, None]] = flat
    return np.floor(SCALE * out)


def _best(who: np.ndarray, score: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """Places of each one's k best, by falling score, then rising id."""
    order = np.lexsort((rows, ids, ~score, who))
    first = np.r_[True, who[order][1:] != who[order][:-1]] if len(order) else np.zeros(0, bool)
    start = np.flatnonzero(first)
    nth = np.arange(len(order)) - np.repeat(start, np.diff(np.r_[start, len(order)]))
    return order[nth < k]


class _State:
    """The k best rows of each slot so far, and the score that a further row has to reach."""

    def __init__(self, slots: int, k: int):
        self.k, self.held = k, [np.zeros(0, np.int64)] * 4
        self.least = np.full(slots, -_LONG - 1, np.int64)

    def add(self, who: np.ndarray, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        if len(who):
            every = [np.r_[a, b] for a, b in zip(self.held, (who, score, ids, rows), strict=True)]
            keep = _best(*every, self.k)
            self.held = [a[keep] for a in every]
            who, score = self.held[:2]
            many = np.bincount(who, minlength=len(self.least))
            full = many >= self.k
            self.least[full] = score[np.cumsum(many)[full] - 1]


def _clean(df: DataFrame, id_col: str, vector_col: str, label_col: str, noisy_every: int, labels: int) -> DataFrame:
    """Numbered usable rows; every ``noisy_every``-th id gets the next label."""
    x, label, name = F.col(vector_col).cast("array<double>"), F.col(label_col).cast("long"), F.col(id_col).cast("long")
    usable = name.isNotNull() & label.isNotNull() & x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    shifted = F.when(name % noisy_every == 0, (label + 1) % labels).otherwise(label)
    return pinned(df.where(usable).select(name.alias("vec_id"), shifted.alias("label"), x.alias("x")), "row")


def _scored(batches: Iterator[pa.RecordBatch], anchors: np.ndarray) -> Iterator[tuple]:
    """(scores of all anchors, ids, labels, rows) of each slice of candidates."""
    rows = max(1, SLICE_SCORES // max(1, len(anchors)))
    for b in batches:
        for at in range(0, b.num_rows, rows):
            s = b.slice(at, rows)
            ids, labels, numbers = (s.column(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "label", "row"))
            yield _products(anchors, matrix(s.column("x"))), ids, labels, numbers


def _positives(block, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, labels, anchors = block.value
        state = _State(len(rows), k)
        for score, ids, own, numbers in _scored(batches, anchors):
            hit = (labels[:, None] == own[None, :]) & (rows[:, None] != numbers[None, :]) & (score >= state.least[:, None])
            a, c = np.nonzero(hit)
            state.add(a, score[a, c], ids[c], numbers[c])
        a, score, ids, numbers = state.held
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (rows[a], np.zeros(len(a), np.int32), score, ids, numbers)], names=["anchor", "positive", "score", "vec_id", "row"])

    return run


def window(positive: np.ndarray, low: int, high: int) -> np.ndarray:
    """The least score with ``low * positive <= high * score``, for any long."""
    return np.array([-(-low * int(p) // high) for p in positive.ravel()], object).clip(-_LONG - 1, _LONG).astype(np.int64).reshape(positive.shape)


def _negatives(block, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, labels, anchors, floor, ceiling = block.value
        states = [_State(len(rows), k) for _ in range(floor.shape[1])]
        for score, ids, own, numbers in _scored(batches, anchors):
            other = labels[:, None] != own[None, :]
            for j, state in enumerate(states):
                hit = other & (score <= ceiling[:, j, None]) & (score >= np.maximum(floor[:, j], state.least)[:, None])
                a, c = np.nonzero(hit)
                state.add(a, score[a, c], ids[c], numbers[c])
        for j, state in enumerate(states):
            a, score, ids, numbers = state.held
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (rows[a], np.full(len(a), j, np.int32), score, ids, numbers)], names=["anchor", "positive", "score", "vec_id", "row"])

    return run


def _merged(found: DataFrame, k: int) -> DataFrame:
    """What the tasks kept, merged: the k best of each anchor and positive, with ``rank`` from 1."""
    rank = F.row_number().over(Window.partitionBy("anchor", "positive").orderBy(F.desc("score"), "vec_id", "row"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def mine(
    df: DataFrame,
    every: int = 100,
    positives: int = 5,
    negatives: int = 5,
    low: int = 80,
    high: int = 100,
    noisy_every: int = 7,
    labels: int = 10,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``; anchors are the rows whose id is divisible by ``every``."""
    spark = df.sparkSession
    ship(spark)
    rows = _clean(df, id_col, vector_col, label_col, noisy_every, labels)
    anchors = rows.where(F.col("vec_id") % every == 0)
    total = anchors.agg(F.count("*"), F.max(F.size("x"))).collect()[0]
    blocks = max(1, -(-(total[0] * (64 + 8 * (total[1] or 0))) // BLOCK_BYTES))
    root = scratch(spark, "hard-negatives")
    for b in range(blocks):
        # a block's anchors, a bounded number of bytes, pass through the driver
        mine_ = anchors.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == b).toArrow()
        who, names, own = (mine_.column(c).to_numpy() for c in ("row", "vec_id", "label"))
        vectors = matrix(mine_.column("x").combine_chunks()) if len(who) else np.zeros((0, 0))
        sent = spark.sparkContext.broadcast((who, own, vectors))
        with tidy(spark):
            best = _merged(rows.mapInArrow(_positives(sent, positives), _BEST), positives).toArrow()
        place = {r: i for i, r in enumerate(who.tolist())}
        score, ids = np.full((len(who), positives), -_LONG - 1, np.int64), np.zeros((len(who), positives), np.int64)
        floor = np.full(score.shape, _LONG, np.int64)  # no score lies in an absent positive's window
        at = np.array([place[r] for r in best.column("anchor").to_pylist()], np.int64), best.column("rank").to_numpy() - 1
        score[at], ids[at] = best.column("score").to_numpy(), best.column("vec_id").to_numpy()
        floor[at] = window(score[at], low, high)
        again = spark.sparkContext.broadcast((who, own, vectors, floor, score))
        pairs = pa.table({"anchor": np.repeat(who, positives), "positive": np.tile(np.arange(positives, dtype=np.int32), len(who)), "anchor_id": np.repeat(names, positives), "positive_id": ids.ravel(), "positive_score": score.ravel()})
        found = _merged(rows.mapInArrow(_negatives(again, negatives), _BEST), negatives).join(spark.createDataFrame(pairs), ["anchor", "positive"])
        out = found.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        with tidy(spark):
            out.write.mode("append").parquet(root)
        sent.destroy()
        again.destroy()
    return spark.read.schema(out.schema).parquet(root)


#: Brute force over all pairs.
ORACLE_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS row, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.row AS anchor, a.vec_id AS anchor_id, b.row, b.vec_id, a.label = b.label AS same,
         CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.row <> b.row
), p AS (
  SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id, row) AS nth FROM s WHERE same
), n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor, p.nth ORDER BY s.score DESC, s.vec_id, s.row) AS rank
  FROM p JOIN s ON p.anchor = s.anchor AND p.nth <= 5 AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score
)
SELECT anchor_id, positive_id, CAST(rank AS INT) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""
