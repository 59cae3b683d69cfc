"""N-gram Jaccard self-join by a MinHash LSH forest, verified exactly.

A text's set is its shingles of five lower-cased words (a text of one to four words is one
shingle). Texts with equal sets form a class and go through everything else once.

Forest: each of ``TREES`` trees keys a class by ``DEPTH`` MinHash values of its own. All keys, tree
first, are range-partitioned and sorted: the sorted run of a tree is its prefix trie, and the common
prefix of neighbours tells at which depth they part. Neighbours with a common prefix of the length
in use are linked, so a subtree of any size costs one link a member. The length follows from the
threshold alone: the longest that finds a pair at the very threshold with a chance of ``RECALL``, which is
1 - (1 - s^length)^TREES for a pair of similarity s; pairs above are found with a greater one. No text is looked at for it.

Verification: links are closed into components. A component is cut into blocks of bounded size; each
pair of blocks is a cell, and a cell counts the common shingles of all its pairs in numpy, common
ones by a matrix product, rare ones by listing, a bounded number at a time. Out of a cell come
counts of links and a spanning forest of them, never the pairs. The forests are closed again into the
groups of the result.

Edge cases: null and empty texts have no shingles, no links, and stand alone; repeated rows are
copies in one class; a class's id is its least doc id (null ids count as greatest); ties cannot
matter; an empty table gives an empty result; texts of any length are read whole; extra columns are
never read, or kept by ``first_of_each_group`` under any name. Rows behind a shuffle are written down
with their numbers first, as all later readings must number them alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cantle.llm import textbytes as tb
from cantle.session import materialise, pinned, ship, shuffle_width

WORDS = 5
#: Similarity from which texts are linked, as a fraction.
NUM, DEN = 4, 5
TREES, DEPTH = 32, 8
RECALL = 0.9999
#: Shorter common prefixes are not looked at: this length finds a pair at the threshold but for a chance of 5e-8.
LEAST = 4
#: A block of a component holds about so many classes, and so many shingles, at most.
BLOCK_CLASSES, BLOCK_SHINGLES = 1024, 1_000_000
#: Shingles in more of a cell's texts than this go through the matrix product.
COMMON = 16
#: Pairs listed, and columns of the matrix product, at a time.
LISTED, COLUMNS = 1 << 20, 1024
BITMAP_ROWS = 1 << 18
_NULL_ID = (1 << 63) - 1


def _multipliers() -> np.ndarray:
    return np.random.default_rng(20240229).integers(1, 1 << 63, TREES * DEPTH, np.uint64) * np.uint64(2) + np.uint64(1)


def recall_at(length: int, similarities: np.ndarray, trees: int = TREES) -> float:
    """The mean chance that some tree finds a pair of such a similarity by prefixes of this length."""
    return float((1 - (1 - similarities**length) ** trees).mean())


def prefix_length(similarities: np.ndarray, depth: int = DEPTH, recall: float = RECALL) -> int:
    """The longest prefix that finds such pairs often enough; pairs at the threshold, where none is known."""
    known = similarities if len(similarities) else np.array([NUM / DEN])
    while depth > LEAST and recall_at(depth, known) < recall:
        depth -= 1
    return depth


def shingles(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, shingle hash), sorted, each once per text."""
    buf, begin = tb.pack(raws)
    buf = tb.lower(buf)
    start, end = tb.words(buf)
    h = tb.word_hashes(buf, start, end)
    doc = np.searchsorted(begin, start, "right") - 1
    many = np.bincount(doc, minlength=len(raws))
    full = len(h) - WORDS + 1
    mult = [np.uint64(pow(0x9E3779B97F4A7C15, 2 * k + 1, 1 << 64)) for k in range(WORDS)]
    if full > 0:
        whole = doc[:full] == doc[WORDS - 1 :]
        run = sum((h[k : k + full] * mult[k] for k in range(WORDS)), np.zeros(full, np.uint64))
        owner, value = doc[:full][whole], tb.mix(run[whole])
    else:
        owner, value = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    few = np.flatnonzero((many > 0) & (many < WORDS))
    if len(few):
        base = np.cumsum(many) - many
        short = np.array([np.bitwise_xor.reduce(np.array([tb.mix(h[base[d] + k : base[d] + k + 1] * mult[k] + np.uint64(k))[0] for k in range(many[d])], np.uint64)) for d in few], np.uint64)
        owner, value = np.r_[owner, few], np.r_[value, short]
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    fresh = np.r_[True, (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])] if len(owner) else np.zeros(0, bool)
    return owner[fresh], value[fresh]


def _sketches(raws: list[bytes], mult: np.ndarray) -> tuple[np.ndarray, ...]:
    """Size, two set digests and the signature of each text."""
    n = len(raws)
    owner, value = shingles(raws)
    size = np.bincount(owner, minlength=n)
    k1, k2 = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    sig = np.zeros((n, TREES * DEPTH), ">u2")
    some = np.flatnonzero(size)
    if len(some):
        at = np.searchsorted(owner, some)
        k1[some] = np.add.reduceat(tb.mix(value), at)
        k2[some] = np.add.reduceat(tb.mix(value ^ np.uint64(0xA5A5A5A55A5A5A5A)), at)
        for j, m in enumerate(mult):
            least = np.minimum.reduceat(value * m, at)
            sig[some, j] = ((least * np.uint64(0xFF51AFD7ED558CCD)) >> np.uint64(48)).astype(">u2")
    return size, k1, k2, sig


def _profile(rows: DataFrame) -> DataFrame:
    """One row per text: ids, set size and digests, signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mult = _multipliers()
        for b in tb.sliced(batches):
            parts = [_sketches(raws, mult) for _, raws in tb.chunks(b.column("body").to_pylist())]
            if not parts:
                continue
            size, k1, k2, sig = (np.concatenate(x) for x in zip(*parts, strict=True))
            flat = pa.array([s.tobytes() for s in sig], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("row_id"), b.column("doc_id"), pa.array(size.astype(np.int64)), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), flat], names=["row_id", "doc_id", "size", "k1", "k2", "sig"])

    return rows.mapInArrow(run, "row_id long, doc_id long, size long, k1 long, k2 long, sig binary")


def _classes(profile: DataFrame) -> DataFrame:
    """One row per distinct set: ``cid`` (its digest), first doc and row, copies, signature."""
    first = F.min(F.struct("doc_id", "row_id")).alias("f")
    grouped = profile.where("size > 0").groupBy("k1", "k2").agg(first, F.count("*").alias("copies"), F.first("size").alias("size"), F.first("sig").alias("sig"))
    return grouped.select(F.xxhash64("k1", "k2").alias("cid"), F.col("f.doc_id").alias("first_doc"), F.col("f.row_id").alias("first_row"), "copies", "size", "sig")


def _fixed(rows: np.ndarray) -> pa.Array:
    """Byte rows of one width as a binary column."""
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def _byte_rows(column: pa.Array, width: int) -> np.ndarray:
    """The reverse."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].reshape(-1, width) if len(column) else np.zeros((0, width), np.uint8)


def _common(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Values that the prefixes of two rows of keys have in common; -1 in different trees."""
    same = (x == y).reshape(len(x), -1)
    values = same[:, 1::2] & same[:, 2::2]
    return np.where(same[:, 0], np.where(values.all(1), values.shape[1], values.argmin(1)), -1)


def _neighbours(classes: DataFrame) -> DataFrame:
    """``a, b, length``: neighbours in the sorted tries that share a prefix of the length in use, and the longest that they share in any tree."""
    wide, enough = 1 + 2 * DEPTH, prefix_length(np.array([NUM / DEN]))

    def keys(batches):
        for b in batches:
            sig = _byte_rows(b.column("sig"), TREES * 2 * DEPTH).reshape(-1, TREES, 2 * DEPTH)
            tree = np.broadcast_to(np.arange(TREES, dtype=np.uint8)[None, :, None], (len(sig), TREES, 1))
            rows = np.concatenate([tree, sig], 2).reshape(-1, wide)
            yield pa.RecordBatch.from_arrays([_fixed(rows), pa.array(np.repeat(b.column("cid").to_numpy(), TREES))], names=["key", "cid"])

    def near(batches):
        """Neighbours inside the partition; the first and the last key go out too, to be joined up."""
        names = ["a", "b", "length", "first", "last"]
        first = last = None
        for b in batches:
            if not b.num_rows:
                continue
            key, cid = _byte_rows(b.column("key"), wide), b.column("cid").to_numpy()
            if last is None:
                first = (key[:1].copy(), int(cid[0]))
            else:
                key, cid = np.concatenate([last[0], key]), np.r_[last[1], cid]
            length = _common(key[:-1], key[1:])
            found = np.flatnonzero((length >= enough) & (cid[:-1] != cid[1:]))
            last = (key[-1:].copy(), int(cid[-1]))
            yield pa.RecordBatch.from_arrays([pa.array(cid[found]), pa.array(cid[found + 1]), pa.array(length[found].astype(np.int32)), pa.nulls(len(found), pa.binary()), pa.nulls(len(found), pa.binary())], names=names)
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([first[1]], pa.int64()), pa.array([last[1]], pa.int64()), pa.array([0], pa.int32()), pa.array([first[0].tobytes()], pa.binary()), pa.array([last[0].tobytes()], pa.binary())], names=names)

    tries = classes.select("cid", "sig").mapInArrow(keys, "key binary, cid long")
    spread = tries.repartitionByRange(2 * shuffle_width(classes.sparkSession), "key", "cid").sortWithinPartitions("key", "cid")
    found = materialise(spread.mapInArrow(near, "a long, b long, length int, first binary, last binary"), small=True)
    # one row per partition: its ends
    ends = sorted((bytes(r["first"]), bytes(r["last"]), r["a"], r["b"]) for r in found.where("first is not null").collect())
    seams = []
    for p, q in zip(ends, ends[1:], strict=False):
        length = int(_common(np.frombuffer(p[1], np.uint8)[None], np.frombuffer(q[0], np.uint8)[None])[0])
        if length >= enough and p[3] != q[2]:
            seams.append((p[3], q[2], length))
    edges = found.where("first is null").select("a", "b", "length")
    if seams:
        edges = edges.unionByName(classes.sparkSession.createDataFrame(seams, "a long, b long, length int"))
    return edges.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("length").alias("length"))


def _links(classes: DataFrame) -> DataFrame:
    """Edges between neighbours in the sorted tries that share a long enough prefix."""
    return _neighbours(classes).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of an edge list (a, b); root is the component's least node.

    Alternating stars: every node hangs its larger, then its smaller neighbours under the least
    node it knows, until nothing changes. Both steps are an aggregation and a join.
    """
    edges = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        hung = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = materialise(hung.unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).collect()[0]
        if now == state:
            break
        state = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _pair_counts(sets: list[np.ndarray], split: int) -> np.ndarray:
    """Common shingles of each of the first ``split`` sets with each of the others (split = 0: of all with all)."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    _, what, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    left, right = (split, n - split) if split else (n, n)
    off = split if split else 0
    common = np.zeros((left, right), np.float32)
    dense = np.flatnonzero(df > COMMON)
    number = np.full(len(df), -1)
    number[dense] = np.arange(len(dense))
    for i in range(0, len(dense), COLUMNS):
        pick = (number[what] >= i) & (number[what] < i + COLUMNS)
        m = np.zeros((n, min(COLUMNS, len(dense) - i)), np.float32)
        m[owner[pick], number[what[pick]] - i] = 1
        common += (m[:split] if split else m) @ (m[split:] if split else m).T
    order = np.argsort(what, kind="stable")
    owner = owner[order].astype(np.int32)
    del what, order, number
    start = np.cumsum(df) - df
    flat = common.reshape(-1)
    for d in range(2, COMMON + 1):
        at = start[df == d]
        i, j = np.triu_indices(d, 1)
        step = max(1, LISTED // len(i))
        for k in range(0, len(at), step):
            group = owner[at[k : k + step, None] + np.arange(d)]
            x, y = group[:, i].ravel().astype(np.int64), group[:, j].ravel().astype(np.int64)
            if split:  # owners ascend, so x is the left side
                across = (x < split) & (y >= split)
                where = x[across] * right + y[across] - off
            else:
                where = np.r_[x * right + y, y * right + x]
            flat += np.bincount(where, minlength=len(flat))
    return common


def _cell(rows: list[tuple], lo: int, hi: int) -> list[tuple]:
    """Rows (cid, block, copies, text) of the cell of two blocks -> (cid, links, linked copies, peer)."""
    split = sum(r[1] == lo for r in rows) if lo != hi else 0
    if lo != hi and split in (0, len(rows)):
        return []
    rows = sorted(rows, key=lambda r: (r[1], r[0]))
    owner, value = [], []
    for first, raws in tb.chunks([r[3] for r in rows]):
        o, v = shingles(raws)
        owner.append(o + first)
        value.append(v)
    owner, value = np.concatenate(owner), np.concatenate(value)
    sets = np.split(value, np.searchsorted(owner, np.arange(1, len(rows))))
    size = np.array([len(s) for s in sets], np.int64)
    copies = np.array([r[2] for r in rows], np.int64)
    common = _pair_counts(sets, split)
    a, b = (slice(0, split), slice(split, None)) if split else (slice(None), slice(None))
    linked = common * (NUM + DEN) >= NUM * (size[a][:, None] + size[b][None, :])
    if not split:
        np.fill_diagonal(linked, False)
    links, doubles = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
    links[a] += linked.sum(1)
    doubles[a] += linked @ copies[b]
    if split:
        links[b] += linked.sum(0)
        doubles[b] += copies[a] @ linked
    peer = _forest(linked, split, len(rows))
    return [(rows[i][0], int(links[i]), int(doubles[i]), rows[peer[i]][0] if peer[i] >= 0 else None) for i in range(len(rows)) if links[i]]


def _forest(linked: np.ndarray, split: int, n: int) -> np.ndarray:
    """A parent for each row that is not the root of its tree, breadth first."""
    peer, seen = np.full(n, -1), np.zeros(n, bool)
    for root in range(n):
        if seen[root]:
            continue
        seen[root] = True
        queue = [root]
        while queue:
            i = queue.pop()
            if not split:
                near = np.flatnonzero(linked[i] & ~seen)
            elif i < split:
                near = split + np.flatnonzero(linked[i] & ~seen[split:])
            else:
                near = np.flatnonzero(linked[:, i - split] & ~seen[:split])
            seen[near] = True
            peer[near] = i
            queue.extend(near.tolist())
    return peer


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of equal (comp, lo, hi) of a sorted partition, one cell at a time."""
    names = ["cid", "links", "linked_copies", "peer"]

    def emit(rows):
        cols = list(zip(*rows, strict=True)) if rows else [(), (), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names)

    key, held, out = None, [], []
    for b in batches:
        columns = [b.column(c).to_pylist() for c in ("comp", "lo", "hi", "cid", "block", "copies", "body")]
        for comp, lo, hi, *row in zip(*columns, strict=True):
            if (comp, lo, hi) != key:
                if held:
                    out += _cell(held, *key[1:])
                key, held = (comp, lo, hi), []
            held.append(tuple(row))
        if len(out) > 20000:
            yield emit(out)
            out = []
    if held:
        out += _cell(held, *key[1:])
    yield emit(out)


def _verified(rows: DataFrame, classes: DataFrame, comps: DataFrame) -> DataFrame:
    """Per class with candidates and cell: counts of verified links, and a peer in the forest."""
    sized = comps.join(classes.drop("sig"), comps["node"] == classes["cid"]).select("root", "cid", "first_row", "copies", "size")
    total = sized.groupBy("root").agg(F.count("*").alias("n"), F.sum("size").alias("s"))
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK_CLASSES, F.col("s") / BLOCK_SHINGLES)).cast("int")
    members = sized.join(total.select("root", blocks.alias("blocks")), "root").withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    members = materialise(members)
    # only rows that may be members are shuffled: a bitmap of fixed size tells most others
    slot, bit = F.pmod(F.xxhash64("row_id"), F.lit(BITMAP_ROWS)), F.pmod(F.xxhash64(F.lit(2), F.col("row_id")), F.lit(64)).cast("int")
    ids = members.select(F.col("first_row").alias("row_id"))
    bitmap = ids.groupBy(slot.alias("slot")).agg(F.bit_or(F.expr("shiftleft(1L, cast(pmod(xxhash64(2, row_id), 64) as int))")).alias("bits"))
    texts = rows.select("row_id", "body", slot.alias("slot")).join(F.broadcast(bitmap), "slot")
    texts = texts.where(F.call_function("shiftrightunsigned", F.col("bits"), bit).bitwiseAND(F.lit(1).cast("long")) == 1).select("row_id", "body")
    placed = texts.join(members.withColumnRenamed("first_row", "row_id"), "row_id")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    cells = placed.select(F.col("root").alias("comp"), "cid", "block", "copies", "body", other.alias("other"))
    cells = cells.select("comp", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "cid", "block", "copies", "body")
    width = 4 * shuffle_width(rows.sparkSession)
    run = cells.repartition(width, "comp", "lo", "hi").sortWithinPartitions("comp", "lo", "hi")
    return run.mapInArrow(_cells, "cid long, links long, linked_copies long, peer long")


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` must hold its row numbers in ``row_id``."""
    return docs.select("row_id", F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_ID)).alias("doc_id"), F.col(text_col).alias("body"))


def _joined(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per row: ids, its class's and group's first doc and row, and link counts."""
    ship(docs.sparkSession)
    rows = _rows(docs, id_col, text_col)
    profile = materialise(_profile(rows))
    classes = materialise(_classes(profile))
    comps = components(_links(classes))
    cells = materialise(_verified(rows, classes, comps), small=True)
    counts = cells.groupBy("cid").agg(F.sum("links").alias("links"), F.sum("linked_copies").alias("linked"))
    groups = components(cells.where("peer is not null").select(F.col("cid").alias("a"), F.col("peer").alias("b")))
    grouped = groups.join(classes.select(F.col("cid").alias("node"), "first_doc", "first_row"), "node")
    heads = grouped.groupBy("root").agg(F.min(F.struct("first_doc", "first_row")).alias("h"))
    named = grouped.join(heads, "root").select(F.col("node").alias("cid"), F.col("h.first_doc").alias("group_doc"), F.col("h.first_row").alias("group_row"))
    slim = classes.drop("sig", "size").join(counts, "cid", "left").join(named, "cid", "left")
    # texts without shingles have no class: they do not meet in the join
    own = F.when(F.col("size") > 0, F.xxhash64("k1", "k2")).otherwise(F.xxhash64(F.lit("alone"), F.col("row_id")))
    me = profile.select("row_id", "doc_id", own.alias("cid"), (F.col("size") > 0).alias("worded"))
    return me.join(slim.withColumn("worded", F.lit(True)), ["cid", "worded"], "left").select(
        "row_id",
        "doc_id",
        F.coalesce("first_doc", "doc_id").alias("copy_doc"),
        F.coalesce("group_doc", "first_doc", "doc_id").alias("group_doc"),
        F.coalesce("group_row", "first_row", "row_id").alias("group_row"),
        F.coalesce("links", F.lit(0)).cast("long").alias("class_links"),
        (F.coalesce("linked", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).cast("long").alias("links"),
    )


def _real(c: str):
    return F.when(F.col(c) != _NULL_ID, F.col(c))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``class_id`` is the least doc id of its group of linked texts,
    ``copy_id`` that of the texts with its very set, ``n_links`` the other rows with similarity 0.8
    or more, copies included, and ``n_distinct_links`` the different sets among them."""
    rows = pinned(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "row_id")
    out = _joined(rows, "doc_id", "text")
    return out.select(_real("doc_id").alias("doc_id"), _real("group_doc").alias("class_id"), _real("copy_doc").alias("copy_id"), F.col("links").alias("n_links"), F.col("class_links").alias("n_distinct_links"))


def first_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that have a linked or equal text of lesser id in their group."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    rows = pinned(docs.toDF(*names), "row_id")
    text, key = names[docs.columns.index(text_col)], names[docs.columns.index(id_col)]
    gone = _joined(rows, key, text).where("row_id <> group_row").select("row_id")
    return rows.join(gone, "row_id", "left_anti").select(*[F.col(n).alias(o) for n, o in zip(names, docs.columns, strict=True)])


#: The same by counting the common shingles of all pairs of different sets in DuckDB.
ORACLE_SQL = r"""
WITH RECURSIVE words AS (
  SELECT row_number() OVER () AS row_id, doc_id,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ 	

]+'), lambda w: w <> '') AS ws
  FROM documents
), sets AS (
  SELECT row_id, doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
         ELSE list_sort(list_distinct([array_to_string(ws[i:i + 4], ' ') FOR i IN range(1, len(ws) - 3)])) END AS s
  FROM words
), cls AS (
  SELECT s, len(s) AS n, count(*) AS copies, min(doc_id) AS first_doc, min(row_id) AS c FROM sets WHERE len(s) > 0 GROUP BY s
), posted AS (
  SELECT c, n, unnest(s) AS g FROM cls
), pairs AS (
  SELECT a.c AS a, b.c AS b FROM posted a JOIN posted b ON a.g = b.g AND a.c <> b.c GROUP BY a.c, b.c, a.n, b.n HAVING count(*) * 9 >= 4 * (a.n + b.n)
), reach AS (
  SELECT a, b FROM pairs UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a
), grouped AS (
  SELECT r.a AS c, min(x.first_doc) AS other FROM reach r JOIN cls x ON x.c = r.b GROUP BY r.a
), linked AS (
  SELECT p.a AS c, count(*) AS n_distinct, sum(x.copies) AS n_rows FROM pairs p JOIN cls x ON x.c = p.b GROUP BY p.a
)
SELECT s.doc_id, coalesce(least(cls.first_doc, grouped.other), cls.first_doc, s.doc_id) AS class_id, coalesce(cls.first_doc, s.doc_id) AS copy_id,
       CAST(coalesce(linked.n_rows, 0) + coalesce(cls.copies, 1) - 1 AS BIGINT) AS n_links, CAST(coalesce(linked.n_distinct, 0) AS BIGINT) AS n_distinct_links
FROM sets s LEFT JOIN cls ON s.s = cls.s LEFT JOIN grouped ON grouped.c = cls.c LEFT JOIN linked ON linked.c = cls.c
"""
