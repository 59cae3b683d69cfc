"""Line dedup: an exact set-similarity join over the lines of all texts, in DataFrame functions only.

A line's set is its distinct lower-cased words. Every line with a word takes part. A line goes if any
earlier line (by id, then position) has Jaccard similarity of at least 0.8 with it, equal sets
included.

1. Words of all texts are counted in ``CELLS`` cells by hash. Levels, log2 of a cell's count, are an
   array of fixed size that plans read through a scalar subquery. A word's place in the order is
   (level, hash): any total order of words makes the prefix filter exact, rarity makes it
   selective. As a cell counts at least its words, level 0 means that a word occurs once.
2. Lines with equal sets collapse into one class, by the earliest line (pre-aggregated before the
   shuffle, so a line that fills a third of the table is one row per task). A class keeps the words
   of its prefix (n - ceil(0.8 n) + 1), rarest first, and a signature: 64 bits, or 128 between lines of some length, one turned over by each word.
3. Postings are the prefix words that occur more than once. For a few of each line (its rarest, its most
   frequent and those hot, as in large families of near copies), the line is compared with the first and with
   those just before it among the word's postings; of what passes the length, positional and signature filters each
   line's nearest is verified. This removes most near copies at the cost of a sort, so that the pairs of step 4
   do not grow with the square of a family. Postings of a frequent word are dealt out by a salt of its own, so that
   other words bring other neighbours: nothing is decided here about lines that stay open.
4. Exactly: lines still open meet all earlier classes, gone ones included, that share a prefix word,
   if the same filters allow, once for each run of words in common. Of two similar sets the smaller one needs floor(n / 9) + 1 prefix
   words only. What meets is verified on the words (as hashes of 64 bits); where a line meets more than
   ``FEW``, first the nearest of them, and the others if it stays open.

The signature filter is exact, too: words in common turn over the same bits, and a word of one set alone flips
one, so sets with similarity of at least 0.8 differ in at most (n1 + n2) / 9 bits.

Edge cases: null text stays null and has no lines; an empty text stays, as do lines without words; a
null id orders first; repeated rows are ordered by their place in the input, so the first keeps its
lines; ties do not arise (all positions differ); an empty table gives an empty result; extra columns
are kept and may have any name; lines and texts may have any length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cantle.session import pinned, remove, roomy, scratch, tidy

#: Cells in which words are counted, as a power of two; one byte each.
CELL_BITS = 20
#: Cells of a block while their array is put together, as a power of two.
BLOCK_BITS = 10
#: A word is hot, so that step 3 thins its postings first, from 2 ** HOT_SHARE-th of all words on, but no sooner
#: than from 2 ** HOT_LEAST occurrences and no later than from 2 ** HOT_MOST.
HOT_SHARE, HOT_LEAST, HOT_MOST = 15, 7, 14
#: Words of a prefix, from its first that is not alone and up to its last, that step 3 looks at whatever their counts.
EARLY, LATE = 3, 1
#: Words beyond which a line's signature has 128 bits.
LONG = 32
#: Pairs a line beyond which its nearest is verified before the others.
FEW = 8
#: Occurrences, as a power of two, beyond which a word's postings are dealt out by salt in step 3: each word deals the
#: lines of a family out in its own way, so that a line meets other neighbours by each of its words.
DEAL_BITS = 6
#: Earlier neighbours that a line is compared with in such a part, besides the part's first.
NEIGHBOURS = 6
#: Occurrences, as a power of two, beyond which a word's postings are joined by themselves in step 4.
SALT_BITS = 12
#: Bits of a word's hash behind its level.
HASH_BITS = 57
#: Bits of the hash by which postings meet.
KEY_BITS = 33
#: Rows of a bitmap of ids, each of 64 bits.
BITMAP_ROWS = 1 << 18

LINE = ["row_id", "line_no"]


class _Work:
    """Intermediate tables in the shared folder."""

    def __init__(self, df: DataFrame):
        self.spark = df.sparkSession
        self.root = scratch(self.spark, "line-dedup")

    def keep(self, df: DataFrame, name: str, small: bool = True, by: str | None = None) -> DataFrame:
        """Write a table down and read it from there; many tasks' few rows go into few files."""
        path = f"{self.root}/{name}"
        with tidy(self.spark):
            (df.hint("rebalance") if small else df).write.option("compression", "zstd").partitionBy(*[by] if by else []).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            remove(self.spark, f"{self.root}/{name}")


def _plain(text: Column) -> Column:
    """Lower case, with a space for any white space but line ends."""
    odd = F.contains(text, F.lit("\t")) | F.contains(text, F.lit("\x0b")) | F.contains(text, F.lit("\f")) | F.contains(text, F.lit("\r"))
    return F.lower(F.when(odd, F.translate(text, "\t\x0b\f\r", "    ")).otherwise(text))


def _cell(h: Column) -> Column:
    return h.bitwiseAND(F.lit((1 << CELL_BITS) - 1).cast("long")).cast("int")


def _levels(docs: DataFrame) -> DataFrame:
    """One row: the level of each cell, from the words of all texts, and the number of words."""
    words = docs.select(F.explode(F.split(F.replace(_plain(F.col("body")), F.lit("\n"), F.lit(" ")), " ")).alias("w")).where("w <> ''")
    counts = words.select(_cell(F.xxhash64("w")).alias("cell")).groupBy("cell").agg(F.count("*").alias("n"))
    level = F.floor(F.log2(F.col("n") + F.lit(0.5))).cast("int")
    every = docs.sparkSession.range(1 << CELL_BITS).select(F.col("id").cast("int").alias("cell"), F.lit(0).alias("level"))
    cells = counts.select("cell", level.alias("level"), "n").unionByName(every.withColumn("n", F.lit(0).cast("long"))).groupBy("cell").agg(F.max("level").alias("level"), F.sum("n").alias("n"))
    # in two steps, so that no task sorts more than a block of cells
    packed = F.sort_array(F.collect_list(F.shiftleft("cell", 6).bitwiseOR(F.col("level")))).alias("x")
    blocks = cells.groupBy(F.shiftright("cell", BLOCK_BITS).alias("b")).agg(packed, F.sum("n").alias("n"))
    blocks = blocks.select("b", "n", F.transform("x", lambda v: v.bitwiseAND(F.lit(63)).cast("tinyint")).alias("x"))
    return blocks.agg(F.sort_array(F.collect_list(F.struct("b", "x"))).alias("all"), F.sum("n").alias("total")).select(F.flatten("all.x").alias("levels"), "total")


def _classes(docs: DataFrame, levels: DataFrame) -> DataFrame:
    """One row per distinct set of words: its earliest line, size, signature and prefix."""
    lines = docs.select("row_id", "ord_doc", F.posexplode(F.split(_plain(F.col("body")), "\n")).alias("line_no", "line"))
    table = F.col("levels")

    def ordered(h: Column) -> Column:
        level = F.coalesce(F.get(table, _cell(h)).cast("long"), F.lit(0).cast("long"))  # never null, which sorts faster
        return F.shiftleft(level, HASH_BITS).bitwiseOR(F.shiftrightunsigned(h, 64 - HASH_BITS))

    sets = lines.withColumn("levels", levels.select("levels").scalar()).select("row_id", "ord_doc", "line_no", F.sort_array(F.transform(_hashes(F.col("line")), ordered)).alias("t"))
    n = F.size("t")
    row = F.struct("ord_doc", "row_id", "line_no", n.alias("n"), _parity(F.col("t"), False).alias("sig"), F.when(n > LONG, _parity(F.col("t"), True)).otherwise(0).alias("more"), F.slice("t", F.lit(1), F.floor(n / 5).cast("int") + 1).alias("prefix"))
    whole = sets.select(F.xxhash64("t").alias("k1"), F.xxhash64(F.lit(1), F.col("t")).alias("k2"), row.alias("f"))
    return whole.groupBy("k1", "k2").agg(F.min("f").alias("f")).where("f.n > 0").select("f.*")


def _hashes(line: Column) -> Column:
    """The distinct words of a line, as hashes of 64 bits."""
    return F.array_remove(F.array_distinct(F.transform(F.split(line, " "), lambda w: F.xxhash64(w))), F.xxhash64(F.lit("")))


def _parity(toks: Column, odd: bool) -> Column:
    """64 bits, of which each word (with an odd seventh hash bit) turns over one, by the six below."""
    one = F.lit(1).cast("long")

    def bit(x: Column) -> Column:
        own = F.shiftright(x, 6).bitwiseAND(one) if odd else one
        return F.call_function("shiftleft", own, x.bitwiseAND(F.lit(63).cast("long")).cast("int"))

    return F.aggregate(toks, F.lit(0).cast("long"), lambda acc, x: acc.bitwiseXOR(bit(x)))


def _hot_level(levels: DataFrame) -> int:
    """The level from which a cell's words are hot."""
    total = levels.select("total").collect()[0][0] or 0
    return max(HOT_LEAST, min(HOT_MOST, int(total).bit_length() - 1 - HOT_SHARE))


def _postings(classes: DataFrame, least: int, most: int = 62) -> DataFrame:
    """A row per prefix word with a level from ``least`` to ``most``.

    ``tok`` is the word's level and the top KEY_BITS of its hash: words that share them only meet in vain. ``prev`` is
    the ``tok`` of the word before it, or 0 if there is none that other lines can share.
    """
    word, low, prev = F.col("word"), F.lit(least << HASH_BITS), F.get("prefix", F.col("at") - 1)
    some = classes.where(F.element_at("prefix", -1) >= low)  # the most frequent of the prefix
    every = some.select("*", F.posexplode("prefix").alias("at", "word"))
    kept = every.where((word >= low) & (F.shiftright(word, HASH_BITS) <= most))
    shared = F.when(prev >= F.lit(1 << HASH_BITS), F.shiftrightunsigned(prev, HASH_BITS - KEY_BITS)).otherwise(F.lit(0).cast("long"))
    return kept.withColumn("tok", F.shiftrightunsigned(word, HASH_BITS - KEY_BITS)).withColumn("prev", shared).drop("word", "prefix")


def _apart(a: str, b: str) -> Column:
    """Bits in which the signatures differ: of 64 in all words, or, between long lines, of 64 each in even and odd ones."""
    odd = F.when((F.col(f"{a}.n") > LONG) & (F.col(f"{b}.n") > LONG), F.col(f"{a}.more").bitwiseXOR(F.col(f"{b}.more"))).otherwise(F.lit(0).cast("long"))
    return F.bit_count(F.col(f"{a}.sig").bitwiseXOR(F.col(f"{b}.sig")).bitwiseXOR(odd)) + F.bit_count(odd)


def _may_match(a: str, b: str) -> Column:
    """Length, positional (for the first word in common, places from 0) and signature filters."""
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    common = F.least(na - F.col(f"{a}.at"), nb - F.col(f"{b}.at"))
    return (na * 5 >= nb * 4) & (nb * 5 >= na * 4) & (common * 9 >= (na + nb) * 4) & (_apart(a, b) * 9 <= na + nb)


def _likely(classes: DataFrame, hot: int) -> DataFrame:
    """The postings by which step 3 looks for near copies: a few words at either end of the prefix, and all hot ones."""
    alone = F.size(F.filter("prefix", lambda x: x < F.lit(1 << HASH_BITS)))
    ends = classes.withColumn("early", alone + EARLY).withColumn("late", F.size("prefix") - LATE)
    at = F.col("at")
    return _postings(ends, 1).where((at < F.col("early")) | (at >= F.col("late")) | (F.shiftrightunsigned("tok", KEY_BITS) >= hot)).drop("early", "late")


def _nearest(hot: DataFrame) -> DataFrame:
    """Pairs of a line and an earlier one: the nearest of those that open or go before it among a word's postings."""
    over = F.shiftright("tok", KEY_BITS).cast("int") - DEAL_BITS
    parts = F.call_function("shiftleft", F.lit(1).cast("long"), F.greatest(over, F.lit(0)))
    dealt = hot.select("tok", F.pmod(F.xxhash64("tok", *LINE), parts).alias("salt"), F.struct("ord_doc", *LINE, "n", "sig", "more", "at").alias("me"))
    group = Window.partitionBy("tok", "salt").orderBy("me")  # by ord_doc, then LINE, of which no two are equal
    first = F.first("me").over(group.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    met = dealt.select("me", first.alias("head"), *[F.lag("me", k).over(group).alias(f"last{k}") for k in range(1, NEIGHBOURS + 1)])
    fits = lambda c: F.when(((F.col(f"{c}.row_id") != F.col("me.row_id")) | (F.col(f"{c}.line_no") != F.col("me.line_no"))) & _may_match("me", c), F.struct(_apart("me", c).alias("apart"), f"{c}.row_id", f"{c}.line_no"))
    pairs = met.select(F.col("me.row_id").alias("row_id"), F.col("me.line_no").alias("line_no"), F.least(fits("head"), *[fits(f"last{k}") for k in range(1, NEIGHBOURS + 1)]).alias("best")).where("best IS NOT NULL")
    return pairs.groupBy(*LINE).agg(F.min("best").alias("best")).select(*LINE, F.col("best.row_id").alias("row_a"), F.col("best.line_no").alias("line_a"))


def _meeting(short: DataFrame, long: DataFrame, later: str) -> DataFrame:
    """All pairs that share a prefix word and pass the filters, as the later line, which must be open, and the earlier one.

    Of two similar sets the smaller needs floor(n / 9) + 1 prefix words only. ``later``: "short" or
    "long" where that side must be the later line. With "any" both sides are one table, which is shuffled
    once: tests of one side name the other, too, and so stay in the join.
    """
    c = F.col
    near = short if later == "any" else short.where(c("at") * 9 <= c("n"))
    a, b = near.alias("a"), long.alias("b")
    few = c("a.at") * 9 <= c("a.n") + F.least(c("b.n"), F.lit(0))
    (a1, a2, a3), (b1, b2, b3) = ((c(f"{s}.ord_doc"), c(f"{s}.row_id"), c(f"{s}.line_no")) for s in "ab")
    first = (a1 < b1) | ((a1 == b1) & ((a2 < b2) | ((a2 == b2) & (a3 < b3))))
    other = (a1 != b1) | (a2 != b2) | (a3 != b3)
    # of equal sizes, the earlier line is the smaller set; where only one side may be later, it can be either
    sized = (c("a.n") < c("b.n")) | ((c("a.n") == c("b.n")) & (first if later == "any" else other))
    side = {"any": F.when(first, c("b.open")).otherwise(c("a.open")), "short": ~first, "long": first}[later]
    # words in common that follow each other bring a pair together once: the filters are no stricter at the first of them
    new = (c("a.prev") != c("b.prev")) | (c("a.prev") + F.least(c("b.prev"), F.lit(0)) == 0)
    met = a.join(b, (c("a.tok") == c("b.tok")) & few & sized & side & new & _may_match("a", "b"))
    pair = [F.when(first, y).otherwise(x).alias(n) for n, x, y in (("row_id", a2, b2), ("line_no", a3, b3))]
    return met.select(*pair, F.when(first, a2).otherwise(b2).alias("row_a"), F.when(first, a3).otherwise(b3).alias("line_a"), _apart("a", "b").alias("apart"))


def _bitmap(ids: DataFrame, key: list[str]) -> DataFrame:
    """A set of ids as BITMAP_ROWS rows of 64 bits; it may hold more, never less."""
    slot, bit = F.pmod(F.xxhash64(*key), F.lit(BITMAP_ROWS)), F.pmod(F.xxhash64(F.lit(2), *key), F.lit(64)).cast("int")
    return ids.groupBy(slot.alias("slot")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("bits"))


def _maybe_in(rows: DataFrame, bitmap: DataFrame, key: list[str]) -> DataFrame:
    """``rows`` with ``maybe``: false where the key is certainly not in the bitmap."""
    bit = F.pmod(F.xxhash64(F.lit(2), *key), F.lit(64)).cast("int")
    marked = rows.withColumn("slot", F.pmod(F.xxhash64(*key), F.lit(BITMAP_ROWS))).join(F.broadcast(bitmap), "slot", "left")
    held = F.call_function("shiftrightunsigned", F.coalesce("bits", F.lit(0).cast("long")), bit).bitwiseAND(F.lit(1).cast("long")) == 1
    return marked.withColumn("maybe", held).drop("slot", "bits")


def _without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """``rows`` whose lines are not in ``gone``; only those that the bitmap cannot clear are shuffled."""
    marked = _maybe_in(rows, _bitmap(gone, LINE), LINE)
    unsure = marked.where("maybe").join(gone.select(*LINE), LINE, "left_anti")
    return marked.where("NOT maybe").unionByName(unsure.select(*marked.columns)).drop("maybe")


def _verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The lines of those pairs whose words are similar enough."""
    ids = pairs.select(F.explode(F.array(F.struct(*LINE), F.struct(F.col("row_a").alias("row_id"), F.col("line_a").alias("line_no")))).alias("x")).select("x.*")
    rows = _maybe_in(docs, _bitmap(ids, ["row_id"]), ["row_id"]).where("maybe")
    lines = rows.select("row_id", F.posexplode(F.split("body", "\n")).alias("line_no", "line"))
    named = _maybe_in(lines, _bitmap(ids, LINE), LINE).where("maybe").select(*LINE, _hashes(_plain(F.col("line"))).alias("words"))
    both = pairs.join(named.toDF("row_a", "line_a", "x"), ["row_a", "line_a"]).join(named.toDF(*LINE, "y"), LINE)
    sized = both.select(*LINE, F.size(F.array_intersect("x", "y")).alias("common"), (F.size("x") + F.size("y")).alias("both"))
    return sized.where("common * 9 >= both * 4").select(*LINE).distinct()


def _survivors(docs: DataFrame, work: _Work) -> DataFrame:
    """``row_id, line_no`` of the lines with words that stay."""
    with roomy(docs.sparkSession, CELL_BITS):
        levels = work.keep(_levels(docs), "levels", small=False)
    classes = work.keep(_classes(docs, levels), "classes", small=False)
    near = work.keep(_nearest(_likely(classes, _hot_level(levels))), "near")
    gone = work.keep(_verified(near, docs), "gone-near")
    # lines found so far are closed: they still meet later lines, but need no earlier one
    perhaps = _maybe_in(classes, _bitmap(gone, LINE), LINE)
    told = perhaps.where("maybe").join(gone.withColumn("hit", F.lit(True)), LINE, "left").select(*classes.columns, F.col("hit").isNull().alias("open"))
    marked = perhaps.where("NOT maybe").select(*classes.columns, F.lit(True).alias("open")).unionByName(told)
    vast = F.element_at("prefix", -1) >= F.lit((SALT_BITS + 1) << HASH_BITS)
    classes = work.keep(marked.withColumn("vast", vast), "marked", small=False, by="vast")
    work.drop("classes")
    # words of so many postings that gone lines should not even meet go by themselves
    few, many = _postings(classes.drop("vast"), 1, SALT_BITS), _postings(classes.where("vast").drop("vast"), SALT_BITS + 1)
    live = many.where("open")
    met = _meeting(few, few, "any").unionByName(_meeting(live, many, "short")).unionByName(_meeting(many, live, "long"))
    met = work.keep(met.distinct(), "met")
    # where a line meets many, its nearest first, so that a line in a large group of near copies is not verified with all of them
    best = met.groupBy(*LINE).agg(F.min(F.struct("apart", "row_a", "line_a")).alias("best"), F.count("*").alias("n"))
    best = work.keep(best.select(*LINE, F.col("best.row_a").alias("near_row"), F.col("best.line_a").alias("near_line"), "n").where(F.col("n") > FEW), "best")
    held = _maybe_in(met, _bitmap(best, LINE), LINE)
    many = held.where("maybe").join(best, LINE, "left").select(*LINE, "row_a", "line_a", "n", ((F.col("row_a") == F.col("near_row")) & (F.col("line_a") == F.col("near_line"))).alias("nearest"))
    many = work.keep(many, "many")
    pairs = held.where("NOT maybe").select(*LINE, "row_a", "line_a").unionByName(many.where("n IS NULL OR nearest").select(*LINE, "row_a", "line_a"))
    found = work.keep(_verified(pairs, docs), "gone-met")
    gone = gone.unionByName(found)
    more = work.keep(_without(best.select(*LINE), found), "more")
    if not more.isEmpty():
        rest = work.keep(many.where("NOT nearest").select(*LINE, "row_a", "line_a").join(more, LINE, "left_semi"), "rest")
        gone = gone.unionByName(work.keep(_verified(rest, docs), "gone-rest"))
    kept = work.keep(_without(classes.select(*LINE), gone), "kept")
    work.drop("levels", "marked", "near", "gone-near", "met", "best", "many", "gone-met", "more", "rest", "gone-rest")
    return kept


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counts: bool = False) -> DataFrame:
    """``docs`` with the later of similar lines taken out of the text.

    With ``counts``, columns ``n_lines`` and ``n_removed`` are added (they replace any of these names).
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    text, key = names[docs.columns.index(text_col)], names[docs.columns.index(id_col)]
    rows = pinned(docs.toDF(*names), "row_id")
    work = _Work(docs)
    narrow = rows.select("row_id", F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63)).cast("long")).alias("ord_doc"), F.col(text).alias("body"))
    kept = _survivors(narrow, work)
    worded = lambda line: F.ltrim(line, F.lit(" \t\x0b\f\r")) != ""
    # rows that lose lines: those with more lines with words than are kept
    left = kept.groupBy("row_id").agg(F.count("*").alias("n_kept"))
    fewer = rows.select("row_id", F.size(F.filter(F.split(text, "\n"), worded)).alias("n")).join(left, "row_id", "left").where("n > coalesce(n_kept, 0)")
    changed = work.keep(fewer.select("row_id"), "changed")
    bitmap = _bitmap(changed, ["row_id"])
    marked = _maybe_in(rows, bitmap, ["row_id"])
    stay = _maybe_in(kept, bitmap, ["row_id"]).where("maybe").groupBy("row_id").agg(F.sort_array(F.collect_list("line_no")).alias("kept"))
    parted = marked.where("maybe").join(stay, "row_id", "left").withColumn("parts", F.split(text, "\n"))
    blank = F.filter(F.transform("parts", lambda line, i: F.when(~worded(line), i)), lambda i: i.isNotNull())
    places = parted.withColumn("places", F.sort_array(F.concat(F.coalesce("kept", F.array().cast("array<int>")), blank)))
    cut = places.withColumn("stays", F.transform("places", lambda i: F.get(F.col("parts"), i)))
    total, lost = F.col("n_lines_"), F.col("n_lost_")
    same = marked.where("NOT maybe").select(*names, (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).alias("n_lines_"), F.lit(0).alias("n_lost_"))
    cut = cut.select(*[F.when(F.col(c).isNotNull(), F.array_join("stays", "\n")).alias(c) if c == text else F.col(c) for c in names], F.size("parts").alias("n_lines_"), (F.size("parts") - F.size("stays")).alias("n_lost_"))
    out = same.unionByName(cut)
    new = [F.col(c).alias(o) for c, o in zip(names, docs.columns, strict=True)]
    if not counts:
        return out.select(*new)
    new = [n for n, o in zip(new, docs.columns, strict=True) if o not in ("n_lines", "n_removed")]
    whole = lambda c: F.when(F.col(text).isNull(), 0).otherwise(c).cast("long")
    return out.select(*new, whole(total).alias("n_lines"), whole(lost).alias("n_removed"))


#: The same result by plain set arithmetic in DuckDB, with exact word counts for the order.
ORACLE_SQL = r"""
WITH lines AS (
  SELECT doc_id, i AS line_no, str_split(text, chr(10))[i + 1] AS line
  FROM (SELECT doc_id, text, unnest(range(len(str_split(text, chr(10))))) AS i FROM documents)
), sets AS (
  SELECT doc_id, line_no, line, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(line), '[\s\x0B]+'), lambda w: w <> ''))) AS ws FROM lines
), wide AS (
  SELECT *, len(ws) AS n, row_number() OVER (ORDER BY doc_id, line_no) AS id FROM sets WHERE len(ws) >= 1
), cls AS (
  SELECT ws, n, min(id) AS id FROM wide GROUP BY ws, n
), words AS (
  SELECT id, n, unnest(ws) AS w FROM cls
), freq AS (
  SELECT w, count(*) AS f FROM words GROUP BY w
), placed AS (
  SELECT words.id, words.n, words.w, row_number() OVER (PARTITION BY words.id ORDER BY f, words.w) AS p FROM words JOIN freq USING (w)
), prefix AS (
  SELECT * FROM placed WHERE p <= n - CAST(ceil(n * 0.8 - 1e-9) AS INT) + 1
), pairs AS (
  SELECT DISTINCT a.id AS a, b.id AS b FROM prefix a JOIN prefix b ON a.w = b.w AND a.id < b.id AND a.n * 5 >= b.n * 4 AND b.n * 5 >= a.n * 4
), gone AS (
  SELECT DISTINCT b AS id FROM (
    SELECT b, len(list_intersect(x.ws, y.ws)) AS c, x.n + y.n AS s FROM pairs JOIN cls x ON x.id = a JOIN cls y ON y.id = b
  ) WHERE c * 5 >= (s - c) * 4
), kept AS (
  SELECT w.doc_id, w.line_no FROM wide w WHERE w.id IN (SELECT id FROM cls) AND w.id NOT IN (SELECT id FROM gone)
), verdict AS (
  SELECT s.doc_id, s.line_no, s.line, len(s.ws) < 1 OR k.doc_id IS NOT NULL AS stays
  FROM sets s LEFT JOIN kept k ON s.doc_id = k.doc_id AND s.line_no = k.line_no
)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE stays), '') AS text,
       count(*) AS n_lines, count(*) FILTER (WHERE NOT stays) AS n_removed
FROM verdict GROUP BY doc_id
"""
