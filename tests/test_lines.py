"""Global line numbers of files that are read in splits."""

import json
import random

import pytest
from pyspark.sql import functions as F

from cantle.constants import EOS
from cantle.operators import bpe
from cantle.operators import relational as rel
from cantle.sources import files, lines


@pytest.fixture
def small_splits(spark):
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "10")
    yield
    for k, v in kept.items():
        spark.conf.set(k, v)


def _folder(tmp_path, name, rows, cuts):
    """Files whose sizes are in no order, with blank lines."""
    folder = tmp_path / name
    folder.mkdir()
    ends = [0, *cuts, len(rows)]
    for k, (a, b) in enumerate(zip(ends, ends[1:])):
        (folder / f"part-{k:05d}.json").write_text("".join(r + "\n" for r in rows[a:b]))
    return str(folder)


def _rows(n):
    rng = random.Random(2)
    return ["" if i % 17 == 5 else json.dumps({"sample_id": f"s{i}", "pad": "x" * rng.randrange(0, 60)}) for i in range(n)]


def test_numbers_run_over_splits_and_files(spark, tmp_path, small_splits):
    rows = _rows(400)
    path = _folder(tmp_path, "f", rows, [3, 3, 250, 260])
    found = lines.line_file(spark, path)
    assert found.blocks.count() > 12 and found.count() == 400
    got = sorted((r["line"], r["value"]) for r in found.numbered().collect())
    assert got == list(enumerate(rows))
    parsed = {r["line"]: r["sample_id"] for r in found.parsed("sample_id string").collect()}
    assert parsed == {i: f"s{i}" for i in range(400) if rows[i]}
    assert sorted((r["line"], r["value"]) for r in found.first(7).collect()) == list(enumerate(rows[:7]))
    places = spark.createDataFrame([(0,), (2,), (3,), (255,), (399,), (4000,), (255,)], "line long")
    assert sorted((r["line"], r["value"]) for r in found.at(places).collect()) == [(i, rows[i]) for i in (0, 2, 3, 255, 399)]
    plan = found.first(3)._jdf.queryExecution().executedPlan().toString()
    assert "part-00000" in plan and "part-00004" not in plan


def test_one_missing_line_misaligns_all_later_ones(spark, tmp_path, small_splits):
    rows = [json.dumps({"sample_id": f"s{i}"}) for i in range(200)]
    a = lines.line_file(spark, _folder(tmp_path, "a", rows, [90])).parsed("sample_id string")
    b = lines.line_file(spark, _folder(tmp_path, "b", rows[:77] + rows[78:], [20, 30])).parsed("sample_id string")
    zipped = rel.zip_by_place(a, b, "line", "sample_id")
    bad = sorted(r["line"] if r["line"] is not None else -1 for r in zipped.where("NOT aligned").select(F.coalesce("a.line", "b.line").alias("line")).collect())
    assert bad == list(range(77, 200))


def test_empty_folder(spark, tmp_path):
    path = _folder(tmp_path, "e", [], [])
    found = lines.line_file(spark, path)
    assert found.count() == 0 and found.numbered().count() == 0 and found.first(3).count() == 0


def test_encoding_keeps_the_order_of_lines(spark, tmp_path, small_splits):
    rng = random.Random(9)
    rows = [json.dumps({"sample_id": f"s{rng.randrange(10**6)}", "source_tokens": [rng.randrange(4) for _ in range(rng.randrange(1, 30))] + [EOS]}) for _ in range(150)]
    path = _folder(tmp_path, "f", rows, [140])
    v = bpe.Vocabulary({1500: (0, 1), 1501: (1, 1, 2)})
    ddl = "sample_id string, source_tokens array<int>"
    before = lines.line_file(spark, path).parsed(ddl)
    out, bad = str(tmp_path / "out.jsonl"), str(tmp_path / "bad.jsonl")
    assert bpe.encode_or_keep(before, v, ["source_tokens"], out, bad, place="line") == 0
    after = lines.line_file(spark, out).parsed(ddl)
    zipped = rel.zip_by_place(before, after, "line", "sample_id")
    assert zipped.where("NOT aligned").count() == 0 and zipped.count() == 150
    audit = rel.lossless_audit(zipped, v.decode_map(), ["source_tokens"]).collect()[0]
    assert tuple(audit) == (150, 0, 0, 0)
    assert bpe.encode_or_keep(before, v, ["source_tokens"], out, bad, limit=9, place="line") == 0
    wanted = [json.loads(r)["sample_id"] for r in rows[:9]]
    assert [r["sample_id"] for r in files.read_jsonl(spark, out, ddl).collect()] == wanted
    # a row that cannot be encoded: the old output stays
    broken = before.withColumn("source_tokens", F.when(F.col("line") == 4, F.lit(None)).otherwise(F.col("source_tokens")))
    assert bpe.encode_or_keep(broken, v, ["source_tokens"], out, bad, place="line") == 1
    assert [r["sample_id"] for r in files.read_jsonl(spark, out, ddl).collect()] == wanted
    assert files.read_jsonl(spark, bad, "sample_id string, line long").collect()[0]["line"] is None
