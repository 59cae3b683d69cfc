import zlib
from collections import Counter

from cantle.llm.sharding import balanced_shards


def _check(rows, got, n):
    assert len(got) == len(rows)
    size = {}
    for r in got:
        size.setdefault(r["shard"], []).append(r)
    total = sum(r["size"] for r in got)
    largest = max((r["size"] for r in got), default=0)
    for k, part in size.items():
        assert 0 <= k < n
        assert sorted(r["slot"] for r in part) == list(range(len(part)))
    for k in range(n):
        assert abs(sum(r["size"] for r in size.get(k, [])) - total / n) <= 2 * largest + 1
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want


def test_balance_slots_and_sizes(spark):
    rows = [(i, f"text ü {i % 7} " * (i % 40)) for i in range(700)] + [(1000 + i, "same copy " * 5) for i in range(300)] + [(None, None), (5, ""), (5, ""), (7, "long " * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = balanced_shards(df, 16).collect()
    _check(rows, got, 16)
    # few groups of equal texts fall apart, and only where they exceed the largest row or must
    again = balanced_shards(df.repartition(7), 16).collect()
    assert Counter((r["doc_id"], r["shard"]) for r in got if r["doc_id"] is not None and r["doc_id"] < 700) == Counter((r["doc_id"], r["shard"]) for r in again if r["doc_id"] is not None and r["doc_id"] < 700)


def test_small_groups_stay_whole(spark):
    rows = [(i, f"pair {i // 3} ") for i in range(600)] + [(9999, "x" * 50)]
    got = balanced_shards(spark.createDataFrame(rows, "doc_id long, text string"), 8).collect()
    _check(rows, got, 8)
    by_text = {}
    for r in got:
        if r["doc_id"] < 600:
            by_text.setdefault(r["doc_id"] // 3, set()).add(r["shard"])
    assert all(len(x) == 1 for x in by_text.values())


def test_small_and_empty(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    _check([(1, "a"), (2, None)], balanced_shards(df, 4).collect(), 4)
    assert balanced_shards(df.limit(0), 4).count() == 0


def test_carried_columns_and_clashing_names(spark):
    df = spark.createDataFrame([(1, "a", 9, 8)], "doc_id long, text string, shard int, start int")
    got = balanced_shards(df, 2, carry=("text", "start")).collect()[0]
    assert got["text"] == "a" and got["start"] == 8 and got["slot"] == 0
