"""Exact top-k inner products by block-at-a-time pruning.

A vector's component c becomes the whole number floor(64 c). Vectors are sorted by id and packed
into blocks of consecutive ids; a block is a forward index (its vectors, whole) and, per term, the
greatest and the least weight in it. A query's bound for a block is the sum of its terms' maxima,
each the larger of weight * greatest and weight * least. Queries take blocks in falling order of
bound, score them whole, and stop when the next bound falls below their k-th score.

Blocks are gathered into spans and queries into groups; each (span, group) is a cell of bounded
size that returns k rows per query at most. A first pass over one span gives every query a score
to beat. Then the blocks' extremes alone meet all groups of queries, many spans at a time (``WIDE_SPANS``), so that a
query is sent once for so many spans; a span's vectors, and the queries again, follow only where a query of
the group has a bound for one of its blocks that reaches that score.

How much is pruned depends on the vectors: blocks of like vectors are skipped, blocks of unrelated
ones have bounds that no k-th score reaches (``scored_share`` measures it).

Edge cases: rows with a null id, a null vector, or null or non-finite components take no part; a
shorter vector counts as if filled with zeros; each row of an id that repeats is a candidate, for the
other rows of its id too, and a query of its own if the id is divisible; equal scores rank by smaller id; fewer
candidates than k give fewer rows; sums beyond 64 bits stop at the largest long; an empty table gives
an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cantle.session import materialise, pinned, ship, shuffle_width

SCALE = 64.0
BLOCK = 256
#: Blocks of a span, queries of a group.
SPAN_BLOCKS, GROUP_QUERIES = 128, 2048
#: Spans whose extremes meet a group of queries together.
WIDE_SPANS = 64
_LONG = (1 << 63) - 1


def quantise(rows: list[list[float]]) -> np.ndarray:
    """floor(64 x) as float64, which holds these whole numbers exactly; short rows are zero-filled."""
    wide = max(map(len, rows), default=0)
    out = np.zeros((len(rows), wide))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return np.floor(SCALE * out)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows; float64 where no sum can pass 2 ** 53, whole numbers beyond."""
    wide = max(a.shape[1], b.shape[1])
    a, b = (np.pad(x, ((0, 0), (0, wide - x.shape[1]))) for x in (a, b))
    if wide * float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) < 2.0**53:
        return (a @ b.T).astype(np.int64)
    x = np.array([[int(v) for v in r] for r in a], object).reshape(a.shape)
    y = np.array([[int(v) for v in r] for r in b], object).reshape(b.shape)
    return np.array([[max(-_LONG - 1, min(_LONG, int(v))) for v in r] for r in x @ y.T], np.int64).reshape(len(a), len(b))


def _merge(score: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> list[np.ndarray]:
    """The k best of each row, by falling score, then rising id."""
    order = np.lexsort((rows, ids, ~score), axis=1)[:, :k]
    return [np.take_along_axis(x, order, 1) for x in (score, ids, rows)]


def _bounds(queries: np.ndarray, top: np.ndarray, low: np.ndarray) -> np.ndarray:
    """What a query can score at most in blocks of these greatest and least weights."""
    bound = np.maximum(queries, 0) @ top.T + np.minimum(queries, 0) @ low.T
    slack = 1e-9 * (np.abs(queries) @ np.maximum(np.abs(top), np.abs(low)).T)  # for sums that float64 rounds
    return bound + np.where(slack > 1e3, slack, 0)


def _even(parts: list[np.ndarray]) -> list[np.ndarray]:
    wide = max(p.shape[1] for p in parts)
    return [np.pad(p, ((0, 0), (0, wide - p.shape[1]))) for p in parts]


Block = tuple[np.ndarray, np.ndarray, np.ndarray]


def search_span(blocks: list[Block], query_rows: np.ndarray, queries: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """(query place, candidate id, candidate row, score) of each query's best in the span that reach ``least``,
    and the number of (query, block) pairs that were scored. A block has rows, ids and vectors."""
    queries, *vectors = _even([queries, *[m for *_, m in blocks]])
    bound = _bounds(queries, np.array([m.max(0) for m in vectors]), np.array([m.min(0) for m in vectors]))
    order = np.argsort(-bound, axis=1, kind="stable")
    n, empty = len(queries), -_LONG - 1
    score, ids, rows = np.full((n, k), empty, np.int64), np.full((n, k), _LONG, np.int64), np.full((n, k), -1, np.int64)
    kth = least.astype(np.float64)
    live, scored = np.arange(n), 0
    for turn in range(len(blocks)):
        live = live[bound[live, order[live, turn]] >= kth[live]]
        if not len(live):
            break
        nth = order[live, turn]
        scored += len(live)
        for b in np.unique(nth):
            who = live[nth == b]
            s = _products(queries[who], vectors[b])
            c, r = (np.broadcast_to(x, s.shape).copy() for x in (blocks[b][1], blocks[b][0]))
            own = r == query_rows[who][:, None]
            s[own], c[own], r[own] = empty, _LONG, -1
            score[who], ids[who], rows[who] = _merge(np.c_[score[who], s], np.c_[ids[who], c], np.c_[rows[who], r], k)
        kth[live] = np.maximum(kth[live], np.where(rows[live, -1] >= 0, score[live, -1].astype(np.float64), -np.inf))
    keep = (rows >= 0) & (score >= least[:, None])
    return np.nonzero(keep)[0], ids[keep], rows[keep], score[keep], scored


def _clean(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Numbered rows without unusable vectors."""
    x = F.col(vector_col).cast("array<double>")
    usable = F.col(id_col).isNotNull() & x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return pinned(df.where(usable).select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x")), "row")


def _packed(vectors: DataFrame) -> DataFrame:
    """Blocks of consecutive ids, with their greatest and least weights: ``pid, seq, rows, ids, matrix, top, low, wide``."""
    names = ["pid", "seq", "rows", "ids", "matrix", "top", "low", "wide"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq, held, pid = 0, [], None

        def block(part):
            m = quantise([x for *_, x in part])
            packs = [np.array([p[i] for p in part], np.int64) for i in (0, 1)] + [m, m.max(0), m.min(0)]
            return pa.RecordBatch.from_arrays([pa.array([pid]), pa.array([seq]), *[pa.array([a.tobytes()], pa.binary()) for a in packs], pa.array([m.shape[1]])], names=names)

        for b in batches:
            if not b.num_rows:
                continue
            pid = b.column("pid")[0].as_py()
            held += zip(*[b.column(c).to_pylist() for c in ("row", "vec_id", "x")], strict=True)
            while len(held) >= BLOCK:
                yield block(held[:BLOCK])
                held, seq = held[BLOCK:], seq + 1
        if held:
            yield block(held)

    spread = vectors.repartitionByRange(shuffle_width(vectors.sparkSession), "vec_id").sortWithinPartitions("vec_id")
    return spread.withColumn("pid", F.spark_partition_id().cast("long")).mapInArrow(run, "pid long, seq long, rows binary, ids binary, matrix binary, top binary, low binary, wide long")


_CELL = "query_row long, query_id long, vec_id long, row long, score long, scored long"


def _asked(queries) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return queries["query_row"].to_numpy(np.int64), quantise([list(x) for x in queries["x"]]), queries["least"].to_numpy(np.int64)


def _answer(blocks, queries, k: int):
    import pandas as pd

    columns = [c.split()[0] for c in _CELL.split(", ")]
    if not len(blocks) or not len(queries):
        return pd.DataFrame({c: [] for c in columns}).astype("int64")
    packs = [(np.frombuffer(r.rows, np.int64), np.frombuffer(r.ids, np.int64), np.frombuffer(r.matrix).reshape(-1, r.wide)) for r in blocks.sort_values(["pid", "seq"]).itertuples(index=False)]
    rows, vectors, least = _asked(queries)
    who, ids, found, score, scored = search_span(packs, rows, vectors, least, k)
    out = pd.DataFrame({"query_row": rows[who], "query_id": queries["query_id"].to_numpy(np.int64)[who], "vec_id": ids, "row": found, "score": score, "scored": 0})
    # the pairs scored, on a row without a candidate
    return pd.concat([out, pd.DataFrame([dict.fromkeys(columns, -1) | {"scored": scored}])])[columns]


def _reached(key, blocks, queries):
    """A row for each span with a block for which some query's bound reaches the score that the query has to beat."""
    import pandas as pd

    found = []
    if len(blocks) and len(queries):
        _, vectors, least = _asked(queries)
        for span, own in blocks.groupby("own"):
            wide, *ends = _even([vectors, *[np.frombuffer(getattr(r, c)).reshape(1, -1) for r in own.itertuples(index=False) for c in ("top", "low")]])
            bound = _bounds(wide, np.concatenate(ends[::2]), np.concatenate(ends[1::2]))
            if (bound >= least.astype(np.float64)[:, None]).any():
                found.append(span)
    return pd.DataFrame({"span": found, "grp": [key[1]] * len(found)}).astype("int32")


def _meet(spans: DataFrame, queries: DataFrame, cells: int, run, ddl: str) -> DataFrame:
    """Each span with each group of queries; both sides carry the cell's key and are dealt out by it."""
    width = max(1, min(2 * cells, 4 * shuffle_width(spans.sparkSession)))
    a, b = (df.repartition(width, "span", "grp").groupBy("span", "grp") for df in (spans, queries))
    return a.cogroup(b).applyInPandas(run, ddl)


def _searched(df: DataFrame, k: int, every: int, id_col: str, vector_col: str) -> tuple[DataFrame, int, int]:
    """The cells' rows, and the numbers of blocks and queries."""
    ship(df.sparkSession)
    vectors = _clean(df, id_col, vector_col)
    blocks = materialise(_packed(vectors))
    counts = dict(sorted((r["pid"], r["n"]) for r in blocks.groupBy("pid").agg(F.count("*").alias("n")).collect()))
    total = sum(counts.values())
    # partitions are in id order, so a running number over (pid, seq) keeps spans contiguous
    before, at = {}, 0
    for pid, n in counts.items():
        before[pid], at = at, at + n
    number = F.lit(0).cast("long")
    if counts:
        number = F.element_at(F.create_map(*[F.lit(x).cast("long") for p in before.items() for x in p]), F.col("pid")) + F.col("seq")
    spans = blocks.withColumn("span", F.floor(number / SPAN_BLOCKS).cast("int"))
    n_spans = max(1, -(-total // SPAN_BLOCKS))

    queries = vectors.where(F.col("vec_id") % every == 0)
    many = queries.count()
    n_groups = max(1, -(-many // GROUP_QUERIES))
    asked = queries.select(F.col("row").alias("query_row"), F.col("vec_id").alias("query_id"), "x", F.pmod(F.xxhash64("row"), F.lit(n_groups)).cast("int").alias("grp"), F.lit(-_LONG - 1).alias("least"))
    groups = F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1)))
    cell = lambda key, a, b: _answer(a, b, k)
    vectors_of = spans.select("span", "pid", "seq", "rows", "ids", "matrix", "wide")
    found = _meet(vectors_of.where("span = 0").withColumn("grp", groups), asked.withColumn("span", F.lit(0)), n_groups, cell, _CELL)
    if n_spans > 1:
        found = materialise(found)
        beat = found.where("row >= 0").groupBy("query_row").agg(F.min("score").alias("low"), F.count("*").alias("n"))
        low = F.when(F.col("n") >= k, F.col("low")).otherwise(F.lit(-_LONG - 1))
        tighter = asked.drop("least").join(beat, "query_row", "left").withColumn("least", F.coalesce(low, F.lit(-_LONG - 1))).drop("low", "n")
        wide = (n_spans - 1) // WIDE_SPANS + 1
        ends = spans.where("span > 0").select(F.col("span").alias("own"), F.floor(F.col("span") / WIDE_SPANS).cast("int").alias("span"), "top", "low").withColumn("grp", groups)
        open_cells = materialise(_meet(ends, tighter.withColumn("span", F.explode(F.sequence(F.lit(0), F.lit(wide - 1)))), wide * n_groups, _reached, "span int, grp int"))
        sent, waiting = vectors_of.join(open_cells, "span"), tighter.join(open_cells, "grp")
        found = found.unionByName(_meet(sent, waiting, (n_spans - 1) * n_groups, cell, _CELL))
    return found, total, many


def top_k(df: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score`` for the rows whose id is divisible by ``every``."""
    found = _searched(df, k, every, id_col, vector_col)[0].where("row >= 0")
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def scored_share(df: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> float:
    """The share of all (query, block) pairs that were scored; the others were pruned by their bounds."""
    found, blocks, queries = _searched(df, k, every, id_col, vector_col)
    return (found.where("row < 0").agg(F.sum("scored")).collect()[0][0] or 0) / max(1, blocks * queries)


#: Brute force over all pairs.
ORACLE_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.id AS query, a.vec_id AS query_id, b.id AS id, b.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.id <> b.id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id, id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM r WHERE rank <= 20
"""
