"""Ranked lexical search in three phases with a uniform threshold, over term-partitioned postings.

One scan splits the whole texts into terms and keeps, per block of documents and term of a query,
the places, frequencies and lengths; it also counts documents and terms. With these counts each
posting becomes its saturation x (at most a million; a term's weight times x is its share of a
score), and the postings are dealt out by term.

1. Heads: the k greatest of every list; their sums per query and document give a lower bound of
   the query's k-th score.
2. Uniform threshold: that bound divided by the number of the query's lists. Whatever lies at or above it
   is fetched from every list, and summed per block of documents. A document that was not fetched
   stays below the bound; the others are known up to what their missing lists can hold at most, and
   those that can reach the k-th sum are candidates.
3. Look-up: the candidates' missing postings are fetched from the lists, which makes scores exact.

Queries are taken in batches of a bounded number of terms, so what is broadcast or sent to the driver
(terms, weights, thresholds, k-th sums) is bounded, too. A block is a bounded number of documents; each
step handles one block, or one block of one list, at a time.

Edge cases: a null or empty text has no terms and is never found; a null or empty query, or one whose
terms stand in no document, finds nothing; only scores above 0 are found; equal scores rank by smaller id,
null ids first, then by place; repeated rows are documents of their own, repeated queries give their rows
again; very long texts are read whole, in a block of their own; empty tables give an empty result; other
columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cantle.llm import textbytes as tb
from cantle.session import _setting, materialise, pinned, remove, scratch, ship, shuffle_width, tidy

#: Documents of a block, and bytes of text from which a block is closed.
BLOCK_DOCS, BLOCK_BYTES = 4096, 16 << 20
#: (query, term) pairs of a batch of queries.
BATCH_TERMS = 100_000
#: Partitions of the postings that a term is dealt to.
SALTS = 8
#: Postings of one term and block in an Arrow batch.
BATCH_LISTS = 512
_LONG = (1 << 63) - 1
_POSTINGS = "block long, term int, many int, terms long, ids array<long>, data binary"
_LISTS = "term int, block long, top int, place binary, x binary"


# -- terms ----------------------------------------------------------------------------------------
def _words(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The lower-cased buffer, and text number, start and end of each of its terms."""
    buf, first = tb.pack(raws)
    buf = tb.lower(buf)
    start, end = tb.words(buf, "letters")
    return buf, np.searchsorted(first, start, side="right") - 1, start, end


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(query, its id, term, occurrences) of each batch of queries."""
    for b in tb.sliced(batches):
        for at, raws in tb.chunks(b.column("text").to_pylist()):
            buf, text, start, end = _words(raws)
            found: dict[tuple[int, bytes], int] = {}
            for t, i, j in zip(text.tolist(), start.tolist(), end.tolist(), strict=True):
                key = (t + at, buf[i:j].tobytes())
                found[key] = found.get(key, 0) + 1
            which = pa.array([t for t, _ in found], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("item").take(which), b.column("item_id").take(which), pa.array([w for _, w in found], pa.binary()), pa.array(found.values(), pa.int64())], names=["item", "item_id", "term", "times"])


class Terms:
    """The terms of a batch of queries by number, found by hash and then by their bytes."""

    def __init__(self, terms: list[bytes]):
        self.buf, self.start = tb.pack(terms)
        self.size = np.fromiter(map(len, terms), np.int64, len(terms))
        hashes = tb.word_hashes(self.buf, self.start, self.start + self.size)
        self.order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[self.order]

    def find(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The number of each term buf[start:end], or -1. Terms of one hash are told apart by bytes."""
        out = np.full(len(start), -1, np.int64)
        h = tb.word_hashes(buf, start, end)
        at = np.searchsorted(self.hashes, h)
        live = np.flatnonzero(self.hashes[np.minimum(at, len(self.hashes) - 1)] == h) if len(self.hashes) else np.zeros(0, np.int64)
        while len(live):
            number = self.order[at[live]]
            same = self._same(buf, start[live], end[live], number)
            out[live[same]] = number[same]
            # a further term of the same hash, if there is one
            at[live] += 1
            more = (out[live] < 0) & (at[live] < len(self.hashes))
            live = live[more]
            live = live[self.hashes[at[live]] == h[live]]
        return out

    def _same(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray, number: np.ndarray) -> np.ndarray:
        size = end - start
        same = size == self.size[number]
        which = np.flatnonzero(same)
        if len(which):
            n = size[which]
            inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            equal = buf[np.repeat(start[which], n) + inner] == self.buf[np.repeat(self.start[number[which]], n) + inner]
            same[which] = np.logical_and.reduceat(equal, np.cumsum(n) - n)
        return same


# -- postings -------------------------------------------------------------------------------------
def _blocks(batches: Iterator[pa.RecordBatch], docs: int, most: int) -> Iterator[tuple[list, list[bytes]]]:
    """(ids, encoded texts) of blocks of consecutive documents."""
    ids, raws, n = [], [], 0
    for b in tb.sliced(batches):
        for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
            raw = (t or "").encode("utf-8", "surrogatepass")
            if ids and (len(ids) >= docs or n + len(raw) > most):
                yield ids, raws
                ids, raws, n = [], [], 0
            ids.append(i)
            raws.append(raw)
            n += len(raw)
    if ids:
        yield ids, raws


def _parts(raws: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """(number of the first, texts) with about a chunk of bytes each."""
    first, n = 0, 0
    for i, raw in enumerate(raws):
        if i > first and n + len(raw) > tb.CHUNK:
            yield first, raws[first:i]
            first, n = i, 0
        n += len(raw)
    yield first, raws[first:]


def _postings(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms: Terms = sent.value
        for nth, (ids, raws) in enumerate(_blocks(batches, BLOCK_DOCS, BLOCK_BYTES)):
            block = (TaskContext.get().partitionId() << 32) + nth
            length = np.zeros(len(ids), np.int64)
            keys, times = [], []
            for first, part in _parts(raws):
                buf, text, start, end = _words(part)
                length[first : first + len(part)] = np.bincount(text, minlength=len(part))
                found = terms.find(buf, start, end)
                hit = found >= 0
                key, count = np.unique(found[hit] * BLOCK_DOCS + text[hit] + first, return_counts=True)
                keys.append(key)
                times.append(count)
            key, times = np.concatenate(keys), np.concatenate(times)
            order = np.argsort(key, kind="stable")
            key, times = key[order], times[order]
            term, place = key // BLOCK_DOCS, key % BLOCK_DOCS
            cells = np.c_[place, times, length[place]].astype("<u4")
            cut = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if len(term) else np.zeros(0, np.int64)
            ends = np.r_[cut, len(term)]
            own = [cells[i:j].tobytes() for i, j in zip(cut, ends[1:], strict=True)]
            many = np.diff(ends)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([block] * (len(cut) + 1)),
                    pa.array([-1, *term[cut].tolist()], pa.int32()),
                    pa.array([int((length > 0).sum()), *many.tolist()], pa.int32()),
                    pa.array([int(length.sum())] + [0] * len(cut), pa.int64()),
                    pa.array([ids] + [None] * len(cut), pa.list_(pa.int64())),
                    pa.array([None, *own], pa.binary()),
                ],
                names=["block", "term", "many", "terms", "ids", "data"],
            )

    return run


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def saturation(times: np.ndarray, length: np.ndarray, n: int, total: int) -> np.ndarray:
    """x of each posting; whole numbers of any size where 64 bits could run over."""
    if 75 * n * int(length.max(initial=0)) < 1 << 63:
        m = 25 + 75 * length * n // total
    else:
        m = 25 + np.array([75 * int(v) * n // total for v in length], np.int64)
    return 10**9 * times // (1000 * times + 8 * m)


def _lists(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, n, total = sent.value
        for b in batches:
            keep = [i for i, t in enumerate(b.column("term").to_pylist()) if weights[t] > 0]
            cells = [np.frombuffer(b.column("data")[i].as_py(), "<u4").reshape(-1, 3).astype(np.int64) for i in keep]
            x = [saturation(c[:, 1], c[:, 2], n, total).astype("<u4") for c in cells]
            at = pa.array(keep, pa.int64())
            columns = [b.column("term").take(at), b.column("block").take(at), pa.array([int(v.max()) for v in x], pa.int32()), pa.array([c[:, 0].astype("<u4").tobytes() for c in cells], pa.binary()), pa.array([v.tobytes() for v in x], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["term", "block", "top", "place", "x"])

    return run


def _unpack(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<u4").astype(np.int64)


# -- phases ---------------------------------------------------------------------------------------
def _heads(k: int):
    """The k greatest postings of each list, as far as this task has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, np.ndarray] = {}
        for b in batches:
            for term, block, place, x in zip(*(b.column(c).to_pylist() for c in ("term", "block", "place", "x")), strict=True):
                x, place = _unpack(x), _unpack(place)
                top = np.argpartition(-x, k - 1)[:k] if len(x) > k else np.arange(len(x))
                rows = np.c_[x[top], np.full(len(top), block), place[top]]
                rows = np.concatenate([best[term], rows]) if term in best else rows
                best[term] = rows[np.argsort(-rows[:, 0], kind="stable")[:k]]
        if best:
            rows = np.concatenate(list(best.values()))
            term = np.repeat(np.array(list(best), np.int32), [len(r) for r in best.values()])
            yield pa.RecordBatch.from_arrays([pa.array(term), *[pa.array(np.ascontiguousarray(rows[:, i])) for i in range(3)]], names=["term", "x", "block", "place"])

    return run


class Plan:
    """A batch of queries by number: terms, weights times occurrences, and thresholds."""

    def __init__(self, item: np.ndarray, term: np.ndarray, times: np.ndarray, weights: np.ndarray, k: int):
        worth = times * weights[term]
        order = np.argsort(item[worth > 0], kind="stable")
        self.k, self.item, self.term, self.worth = k, item[worth > 0][order], term[worth > 0][order], worth[worth > 0][order]
        self.items, self.start = np.unique(self.item, return_index=True)
        self.stop = np.r_[self.start[1:], len(self.item)]
        self.known = len(weights)
        self.need = np.ones(len(weights), np.int64)
        self.least = np.zeros(len(self.items), np.int64)

    def threshold(self, bound: dict[int, int]) -> None:
        """``need``: the least x that is fetched from each list, for a lower bound of each query's k-th score."""
        self.least = np.array([bound.get(i, 0) for i in self.items.tolist()], np.int64)
        lists = self.stop - self.start
        uniform = np.repeat(np.maximum(1, -(-self.least // np.maximum(lists, 1))), lists)
        self.need = np.full(self.known, _LONG, np.int64)
        np.minimum.at(self.need, self.term, -(-uniform // self.worth))

    def rest(self, q: int) -> np.ndarray:
        """What each list of query number q holds at most where nothing was fetched."""
        at = slice(self.start[q], self.stop[q])
        return self.worth[at] * (np.minimum(self.need[self.term[at]], 1_000_001) - 1)


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """The rows of each block; they come sorted by it."""
    rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
    for block, own in groupby(rows, lambda r: r[0]):
        yield block, list(own)


def _fetched(sent):
    """Of each list's block what lies at or above the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        need = sent.value.need
        for b in batches:
            out = []
            for term, block, top, place, x in zip(*(b.column(c).to_pylist() for c in ("term", "block", "top", "place", "x")), strict=True):
                if top >= need[term]:
                    values = np.frombuffer(x, "<u4")
                    keep = values >= need[term]
                    out.append((block, term, place if keep.all() else np.frombuffer(place, "<u4")[keep].tobytes(), x if keep.all() else values[keep].tobytes()))
            yield _rows(out, ["block", "term", "place", "x"], [pa.int64(), pa.int32(), pa.binary(), pa.binary()])

    return run


def _rows(rows: list[tuple], names: list[str], types: list) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=names)


def _candidates(sent):
    """Per query, the documents of each block that can reach the k-th sum known so far: sums and upper bounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan: Plan = sent.value
        rest = [plan.rest(q) for q in range(len(plan.items))]
        for block, rows in _grouped(batches):
            held = {term: (_unpack(place), _unpack(x)) for _, term, place, x in rows}
            size = 1 + max(int(place.max()) for place, _ in held.values())
            for q, item in enumerate(plan.items.tolist()):
                total, spare = np.zeros(size, np.int64), np.full(size, rest[q].sum())
                at = range(plan.start[q], plan.stop[q])
                for nth, i in enumerate(at):
                    got = held.get(int(plan.term[i]))
                    if got is not None:
                        total[got[0]] += plan.worth[i] * got[1]
                        spare[got[0]] -= rest[q][nth]
                seen = np.flatnonzero(total > 0)
                if not len(seen):
                    continue
                kth = -np.partition(-total[seen], plan.k - 1)[plan.k - 1] if len(seen) >= plan.k else 0
                keep = seen[total[seen] + spare[seen] >= max(kth, plan.least[q])]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keep), item)), pa.array(np.full(len(keep), block)), pa.array(keep), pa.array(total[keep]), pa.array(total[keep] + spare[keep])], names=["item", "block", "place", "low", "high"])

    return run


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each list's block the postings at the places asked for."""
    for b in batches:
        out = []
        for term, block, place, x, asked in zip(*(b.column(c).to_pylist() for c in ("term", "block", "place", "x", "asked")), strict=True):
            own = np.frombuffer(place, "<u4")
            keep = np.isin(own, np.array(asked, np.int64))
            if keep.any():
                out.append((block, term, own[keep].tobytes(), np.frombuffer(x, "<u4")[keep].tobytes()))
        yield _rows(out, ["block", "term", "place", "x"], [pa.int64(), pa.int32(), pa.binary(), pa.binary()])


def _exact(sent):
    """Whole scores of the candidates of each block, from the postings at their places."""

    def run(key, postings: pa.Table, asked: pa.Table) -> pa.Table:
        plan: Plan = sent.value
        held = {t: (_unpack(p), _unpack(x)) for t, p, x in zip(*(postings.column(c).to_pylist() for c in ("term", "place", "x")), strict=True)}
        item, place = (asked.column(c).to_numpy() for c in ("item", "place"))
        score = np.zeros(len(item), np.int64)
        number = np.searchsorted(plan.items, item)
        for q in np.unique(number).tolist():
            mine = np.flatnonzero(number == q)
            for i in range(plan.start[q], plan.stop[q]):
                got = held.get(int(plan.term[i]))
                if got is not None:
                    at = np.minimum(np.searchsorted(got[0], place[mine]), len(got[0]) - 1)
                    score[mine] += plan.worth[i] * np.where(got[0][at] == place[mine], got[1][at], 0)
        return pa.table({"item": item, "block": np.full(len(item), key[0].as_py()), "place": place, "score": score})

    return run


def _kth(df: DataFrame, score: str, k: int) -> dict[int, int]:
    """The k-th greatest score of each query that has so many; one row a query."""
    nth = F.row_number().over(Window.partitionBy("item").orderBy(F.desc(score)))
    return {r["item"]: r[score] for r in df.select("item", score).withColumn("nth", nth).where(F.col("nth") <= k).where(F.col("nth") == k).collect()}


def _search(docs: DataFrame, queries: pa.Table, k: int, folder: str, stats: dict | None) -> DataFrame:
    """``item, doc_id, score`` of a batch of queries: k each, and further rows that tie with the k-th."""
    spark = docs.sparkSession
    terms, which = np.unique(np.array(queries.column("term").to_pylist(), object), return_inverse=True)
    item, times = queries.column("item").to_numpy(), queries.column("times").to_numpy()
    words = spark.sparkContext.broadcast(Terms(list(terms)))
    raw, placed = f"{folder}/postings", f"{folder}/lists"
    with tidy(spark):
        docs.mapInArrow(_postings(words), _POSTINGS).write.option("compression", "zstd").parquet(raw)
    postings = spark.read.schema(_POSTINGS).parquet(raw)
    counts = {r["term"]: (r["many"], r["terms"]) for r in postings.groupBy("term").agg(F.sum("many").alias("many"), F.sum("terms").alias("terms")).collect()}
    n, total = counts.pop(-1, (0, 0))
    weights = np.array([weight(n, counts[t][0]) if t in counts else 0 for t in range(len(terms))], np.int64)
    plan = Plan(item, which.astype(np.int64), times, weights, k)

    # the lists, dealt out by term; a block's part of a list is one row
    shares = spark.sparkContext.broadcast((weights, n, total))
    width = shuffle_width(spark)
    with tidy(spark), _setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_LISTS)):
        dealt = postings.where("term >= 0").select("block", "term", "data").mapInArrow(_lists(shares), _LISTS)
        dealt.repartition(width, "term", F.pmod("block", F.lit(SALTS))).sortWithinPartitions("term", "block").write.option("compression", "zstd").parquet(placed)
        lists = spark.read.schema(_LISTS).parquet(placed)

        # 1: heads
        heads = lists.select("term", "block", "place", "x").mapInArrow(_heads(k), "term int, x long, block long, place long")
        nth = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("x")))
        heads = heads.withColumn("nth", nth).where(F.col("nth") <= k).drop("nth")
        pairs = spark.createDataFrame(pa.table({"item": plan.item, "term": plan.term.astype(np.int32), "worth": plan.worth}))
        sums = heads.join(pairs, "term").groupBy("item", "block", "place").agg(F.sum(F.col("worth") * F.col("x")).alias("low"))
        plan.threshold(_kth(sums, "low", k))

        # 2: all that reaches the uniform threshold
        sent = spark.sparkContext.broadcast(plan)
        fetched = lists.mapInArrow(_fetched(sent), "block long, term int, place binary, x binary").repartition(width, "block").sortWithinPartitions("block", "term")
        found = materialise(fetched.mapInArrow(_candidates(sent), "item long, block long, place long, low long, high long"))
        least = _kth(found, "low", k)
        bound = spark.createDataFrame(pa.table({"item": pa.array(list(least), pa.int64()), "least": pa.array(least.values(), pa.int64())}))
        found = found.join(bound, "item", "left").where(F.col("high") >= F.coalesce("least", F.lit(0)))

        # 3: the candidates' missing postings
        open_, whole = found.where("high > low"), found.where("high = low").select("item", "block", "place", F.col("low").alias("score"))
        asked = open_.groupBy("block").agg(F.collect_set(F.col("place").cast("int")).alias("asked"))
        looked = lists.join(asked, "block").select("term", "block", "place", "x", "asked").mapInArrow(_marked, "block long, term int, place binary, x binary")
        exact = looked.groupBy("block").cogroup(open_.select("item", "block", "place").groupBy("block")).applyInArrow(_exact(sent), "item long, block long, place long, score long")
        scores = materialise(whole.unionByName(exact).where("score > 0"))
    if stats is not None:
        stats |= {"postings": sum(c[0] for c in counts.values()), "fetched": fetched.select(F.sum(F.octet_length("x") / 4)).collect()[0][0], "candidates": found.count(), "looked_up": open_.count()}
    tied = F.rank().over(Window.partitionBy("item").orderBy(F.desc("score")))
    best = scores.withColumn("nth", tied).where(F.col("nth") <= k).drop("nth")
    ids = postings.where("term = -1").select("block", "ids")
    return best.join(ids, "block").select("item", F.element_at("ids", (F.col("place") + 1).cast("int")).alias("doc_id"), "score", "block", "place")


def search(docs: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", query_col: str = "text", stats: dict | None = None) -> DataFrame:
    """``item_id, rank, doc_id, score``: each query's k best documents. ``stats`` gets what the phases handled."""
    spark = docs.sparkSession
    ship(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    named = pinned(queries.select(F.col(item_col).alias("item_id"), F.col(query_col).alias("text")), "item")
    kind = named.schema["item_id"].dataType.simpleString()
    split = materialise(named.mapInArrow(_items, f"item long, item_id {kind}, term binary, times long"))
    batches = max(1, -(-split.count() // BATCH_TERMS))
    root = scratch(spark, "ranked-search")
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"), "block", "place")
    names = split.groupBy("item").agg(F.first("item_id").alias("item_id"))
    for b in range(batches):  # one of them even without queries, for the schema
        asked = split.where(F.pmod(F.xxhash64("item"), F.lit(batches)) == b).select("item", "term", "times").toArrow()
        found = _search(texts, asked, k, f"{root}/{b}", stats)
        ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).join(names, "item").select("item_id", "rank", "doc_id", "score")
        with tidy(spark):
            ranked.write.mode("append").parquet(f"{root}/found")
        remove(spark, f"{root}/{b}")
    return spark.read.schema(ranked.schema).parquet(f"{root}/found")


#: Fixed value: the pattern of a term.
_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_SPLIT = "regexp_extract_all(translate({}.text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '" + _TERM + "')"
#: Every document's score for every query.
ORACLE_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, {_SPLIT.format("documents")} AS terms FROM documents
), s AS (
  SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(len(terms)) AS BIGINT) AS l FROM d WHERE len(terms) > 0
), i AS (
  SELECT row_number() OVER () AS item, item_id, {_SPLIT.format("benchmark")} AS terms FROM benchmark
), it AS (
  SELECT item, item_id, term, count(*) AS times FROM (SELECT item, item_id, unnest(terms) AS term FROM i) GROUP BY ALL
), p AS (
  SELECT row, doc_id, n, term, count(*) AS tf FROM (SELECT row, doc_id, len(terms) AS n, unnest(terms) AS term FROM d)
  WHERE term IN (SELECT term FROM it) GROUP BY ALL
), w AS (
  SELECT term, CAST(floor(1000 * ln((2 * s.n + 2) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS weight
  FROM (SELECT term, count(*) AS df FROM p GROUP BY term) CROSS JOIN s
), c AS (
  SELECT it.item, it.item_id, p.row, p.doc_id,
         CAST(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * p.n * s.n) // s.l)))) AS BIGINT) AS score
  FROM it JOIN p USING (term) JOIN w USING (term) CROSS JOIN s GROUP BY ALL
), r AS (
  SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS FIRST, row) AS rank FROM c WHERE score > 0
)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM r WHERE rank <= 10
"""
