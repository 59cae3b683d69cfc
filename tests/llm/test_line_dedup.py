import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from cantle.llm import line_dedup as ld
from cantle.llm import queries


def _brute(rows):
    """(id, text) rows in input order -> texts without later similar lines."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, i))
    seen, out = [], [None] * len(rows)
    for i in order:
        if rows[i][1] is None:
            continue
        left = []
        for line in rows[i][1].split("\n"):
            s = {w for w in line.lower().split() if w}
            if not s:
                left.append(line)
                continue
            if not any(len(s & t) * 5 >= (len(s) + len(t) - len(s & t)) * 4 for t in seen):
                left.append(line)
            seen.append(s)
        out[i] = "\n".join(left)
    return out


def _rows(seed, docs=80, vocab=60, family=40):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(vocab)]
    pool = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 30))) for _ in range(25)]

    def line():
        if rng.random() < 0.5:
            return " ".join(rng.choice(words) for _ in range(rng.randrange(0, 25)))
        part = rng.choice(pool).split()
        for _ in range(rng.randrange(0, 4)):
            part[rng.randrange(len(part))] = rng.choice([*words, f"n{rng.randrange(999)}"])
        return " ".join(part).upper() if rng.random() < 0.1 else " ".join(part)

    rows = [(i, "\n".join(line() for _ in range(rng.randrange(1, 7)))) for i in range(docs)]
    base = [f"f{i}" for i in range(24)]
    for i in range(family):  # a family of near copies, some far from its first member
        part = list(base)
        for _ in range(rng.randrange(0, 5)):
            part[rng.randrange(24)] = f"x{rng.randrange(200)}"
        rows.append((1000 + i, " ".join(part)))
    rows += [(None, "a b c d e f"), (5, None), (5, ""), (7, rows[7][1]), (7, rows[7][1])]
    rng.shuffle(rows)
    return rows


def _check(spark, rows, df):
    got = {r["kept"]: r["text"] for r in ld.dedup_lines(df).collect()}
    want = _brute(rows)
    assert [got[n] for n in range(len(rows))] == want
    return want


@pytest.mark.parametrize("seed,cells,hot,salt", [(1, 12, 2, 12), (2, 10, 0, 1), (3, 11, 30, 12)])
def test_equals_brute_force(spark, monkeypatch, seed, cells, hot, salt):
    monkeypatch.setattr(ld, "CELL_BITS", cells)
    monkeypatch.setattr(ld, "HOT_LEAST", hot)
    monkeypatch.setattr(ld, "HOT_MOST", hot)
    monkeypatch.setattr(ld, "SALT_BITS", salt)
    rows = _rows(seed)
    want = _check(spark, rows, spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, kept int").coalesce(1))
    assert sum(w != t for w, (_, t) in zip(want, rows)) > 30


def test_rows_behind_a_shuffle(spark, tmp_path):
    """Wide rows that adaptive coalescing deals out anew at each reading keep their places."""
    rows = _rows(4, docs=400, family=100)
    df = spark.createDataFrame([(i, t, n, "x" * 500) for n, (i, t) in enumerate(rows)], "doc_id long, text string, kept int, wide string")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "16k")
    try:
        ids = [i for i, _ in rows]
        single = df.where(~F.col("doc_id").isin([i for i in set(ids) if ids.count(i) > 1 and i is not None]))
        single = single.repartition(64, "doc_id")
        got = {r["kept"]: r["text"] for r in ld.dedup_lines(single).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    left = [(n, i, t) for n, (i, t) in enumerate(rows) if n in got]
    want = _brute([(i, t) for _, i, t in left])
    assert [got[n] for n, _, _ in left] == want and len(left) > 450


def test_short_and_long_lines(spark):
    rows = [(1, "same four word line\nTwo words\none"), (2, "Same four word line\ntwo  words\t\nONE\n \n"), (3, "one"), (4, "a b c d"), (5, "a b c d e")]
    long = " ".join(f"w{i}" for i in range(30_000))
    rows += [(6, long), (7, long + " tail"), (8, "\n" * 5000), (9, "x y z\n" * 5000)]
    df = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, kept int").coalesce(1)
    want = _check(spark, rows, df)
    assert want[1] == " \n" and want[2] == "" and want[4] == "" and want[6] == "" and want[7] == rows[7][1]


def test_counts_and_empty(spark):
    df = spark.createDataFrame([(1, "a b c d e\nshort\nA B C D E f", 9), (2, None, 9), (3, "", 9)], "doc_id long, text string, n_removed int")
    got = sorted(tuple(r) for r in ld.dedup_lines(df, counts=True).collect())
    assert got == [(1, "a b c d e\nshort", 3, 1), (2, None, 0, 0), (3, "", 1, 0)]
    assert ld.dedup_lines(df.limit(0)).count() == 0


def test_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    want = Counter(con.execute(f"SELECT doc_id, text, n_lines, n_removed FROM ({ld.ORACLE_SQL})").fetchall())
    got = Counter(tuple(r) for r in queries.QUERIES["op7_line_dedup"](spark, "/root/testdata/sf0.001").select("doc_id", "text", "n_lines", "n_removed").collect())
    assert got == want


def test_any_white_space_parts_words_in_code_and_sql(spark):
    rows = [(1, "a b c d e"), (2, "a\x0bb\tc\x0c\x0bd e\nother line here"), (3, "a\x0bb"), (4, "a b")]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    want = sorted(con.execute(f"SELECT doc_id, text, n_lines, n_removed FROM ({ld.ORACLE_SQL})").fetchall())
    got = ld.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), counts=True)
    assert sorted(tuple(r) for r in got.select("doc_id", "text", "n_lines", "n_removed").collect()) == want
    assert [r[3] for r in want] == [0, 1, 0, 1]


def test_main_path_is_native(spark):
    df = spark.createDataFrame([(1, "a b c d e f g")], "doc_id long, text string")
    plan = ld.dedup_lines(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_a_family_is_not_verified_pair_by_pair(spark, monkeypatch):
    base = [f"f{i}" for i in range(40)]
    rows = [(i, " ".join([*base[:k], f"x{i}", *base[k + 1 :]])) for i, k in enumerate(range(40))]  # no word is hot
    seen, verified = [], ld._verified
    monkeypatch.setattr(ld, "_verified", lambda pairs, docs: seen.append(pairs.count()) or verified(pairs, docs))
    got = {r["doc_id"]: r["text"] for r in ld.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: t if i == 0 else "" for i, t in rows}
    assert sum(seen) <= 2 * len(rows), seen


def test_a_family_without_hot_words_makes_few_pairs(spark, monkeypatch):
    base = [f"f{i}" for i in range(40)]
    rows = [(i, " ".join([*base[: i % 40], f"x{i}", *base[i % 40 + 1 :]])) for i in range(100)]  # each word occurs less than 2 ** HOT_LEAST times
    met, keep = [], ld._Work.keep

    def counted(self, df, name, *args, **named):
        out = keep(self, df, name, *args, **named)
        if name in ("near", "met"):
            met.append(out.count())
        return out

    monkeypatch.setattr(ld._Work, "keep", counted)
    got = {r["doc_id"]: r["text"] for r in ld.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: t if i == 0 else "" for i, t in rows}
    assert sum(met) <= 2 * len(rows), met


@pytest.mark.parametrize("seed,long,few", [(5, 12, 1), (6, 20, 0), (7, 96, 2)])
def test_signatures_of_both_lengths_and_many_meetings(spark, monkeypatch, seed, long, few):
    monkeypatch.setattr(ld, "LONG", long)
    monkeypatch.setattr(ld, "FEW", few)
    rows, rng = _rows(seed), random.Random(seed)
    base = [f"l{i}" for i in range(120)]
    for i in range(30):  # long lines of 85 to 110 words on both sides of the limit
        part = rng.sample(base, rng.randrange(95, 121))[:110]
        rows.append((2000 + i, " ".join(part[: rng.randrange(85, 111)])))
    want = _check(spark, rows, spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, kept int").coalesce(1))
    assert sum(w != t for w, (_, t) in zip(want, rows)) > 30


def test_a_pair_meets_once_for_each_run_of_common_words(spark):
    base = [f"f{i}" for i in range(60)]
    rows = [(i, " ".join([*base[:i], f"x{i}", *base[i + 1 :]])) for i in range(40)]
    docs = spark.createDataFrame(rows, "row_id long, body string").withColumn("ord_doc", F.col("row_id"))
    postings = ld._postings(ld._classes(docs, ld._levels(docs)).withColumn("open", F.lit(True)), 1)
    met = [(r["row_id"], r["row_a"]) for r in ld._meeting(postings, postings, "any").collect()]
    assert set(met) == {(b, a) for b in range(40) for a in range(b)}
    assert len(met) <= 2 * len(set(met)), len(met)
