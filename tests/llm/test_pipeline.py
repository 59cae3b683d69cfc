"""The pipeline's stages against plain versions of their decisions, on a small table."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as cp
from cantle.llm import toxicity as tox
from tests.llm.test_classifiers import _plain_severity as plain_severity
from tests.llm.test_line_dedup import _brute as brute_lines
from tests.llm.test_ngram_join import _brute as brute_near

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    real = spark.read.parquet(f"{SF}/documents.parquet").where("n_chars < 2500")
    extra = spark.createDataFrame([(900001, None, "en", "x", None), (900002, "", "en", "x", 0), (None, "a b c d e f g", "en", "x", 13), (900003, "idiot scum moron trash " * 9, "en", "x", 207)], real.schema)
    copies = real.where("doc_id % 9 = 0").withColumn("doc_id", F.col("doc_id") + 500000)
    return real.unionByName(extra).unionByName(copies).coalesce(1).cache()


def _rows(df):
    return [tuple(r) for r in df.collect()]


def test_names_and_order():
    assert [n for n, _ in cp.STAGES] == ["toxicity", "line_dedup", "near_duplicates", "mixing", "bpe"]


def test_toxicity_keeps_clean_rows(spark, docs):
    kept = cp.drop_toxic(spark, docs, SF)
    assert kept.columns == docs.columns
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    before, after = Counter(r[0] for r in _rows(docs)), Counter(r[0] for r in _rows(kept))
    assert not after - before
    assert all(after[i] == n for i, n in before.items() if labels.get(i) == 0)
    assert after[900001] and after[900002] and after[None]


def test_line_stage_equals_brute_force(spark, docs):
    rows = _rows(docs)
    want = brute_lines([(r[0], r[1]) for r in rows])
    kept = [(r[0], w, *r[2:4], r[4] if w == r[1] else len(w)) for r, w in zip(rows, want) if w is None or w == r[1] or w.strip()]
    assert Counter(_rows(cp.dedup_lines(spark, docs, SF))) == Counter(kept)


def test_near_duplicate_stage_equals_brute_force(spark, docs):
    rows = [(r[0], r[1]) for r in _rows(docs)]
    verdict = brute_near(rows)
    got = cp.near_duplicates(spark, docs, SF)
    alone = sum(w[3] == 0 for w in verdict)
    assert got.count() == alone + len({w[1] for w in verdict if w[3]})
    assert {r[0] for r in _rows(got)} >= {w[1] for w in verdict if w[3]}


def test_mixing_stage_keeps_clean_texts(spark, docs):
    got = Counter(r["doc_id"] for r in cp.mix(spark, docs, SF).collect())
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    clean = [r[0] for r in _rows(docs) if r[0] in labels and labels[r[0]]["quality"] == 1 and labels[r[0]]["toxic"] == 0]
    assert sum(got[i] > 0 for i in clean) > 0.95 * len(clean)


def test_mixing_stage_keeps_every_clean_text(spark, docs):
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    clean = Counter(i for i, *_ in _rows(docs) if i in labels and labels[i]["quality"] == 1 and labels[i]["toxic"] == 0)
    got = Counter(r["doc_id"] for r in cp.mix(spark, docs, SF).collect())
    assert not clean - got


@pytest.mark.parametrize("labelled", [0, 60])
def test_mixing_stage_without_low_rows_keeps_all(spark, tmp_path, labelled):
    texts = spark.createDataFrame([(i, f"good text number {i}", "en", "x", 20) for i in range(400)], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(i, 1, 0) for i in range(labelled)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = Counter(r["doc_id"] for r in cp.mix(spark, texts, str(tmp_path)).collect())
    assert got == Counter(range(400))


def test_encoding_stage_equals_the_library(spark, docs):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = {(r["doc_id"], r["decoded_sha256"]): r for r in cp.encode(spark, docs, SF).collect()}
    for i, text, *_ in _rows(docs):
        r = rows[i, hashlib.sha256((text or "").encode()).hexdigest()]
        assert r["ids"] == library.encode(text or "", add_special_tokens=False).ids


def _plain_kept(spark, rows, schema, sf_dir):
    """The rows that reach the mixing stage, by the plain versions of the first three stages."""
    model = tox.train(spark.createDataFrame(rows, schema), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = [r for r in rows if not plain_severity(model, r[1])[1]]
    rows = [(r[0], w, *r[2:4], r[4] if w == r[1] else len(w)) for r, w in zip(rows, brute_lines([r[:2] for r in rows])) if w is None or w == r[1] or w.strip()]
    verdict = brute_near([r[:2] for r in rows])
    left, seen = [], set()
    for r, w in sorted(zip(rows, verdict), key=lambda x: (x[0][0] is None, x[0][0] or 0)):
        if w[3] and w[1] in seen:
            continue
        seen.add(w[1])
        left.append(r)
    return left


def test_run_equals_plain_stages(spark, tmp_path):
    real = spark.read.parquet(f"{SF}/documents.parquet").where("n_chars < 2500")
    rows = _rows(real) + [(900001, None, "en", "x", None), (900002, "", "en", "x", 0)]
    rows += [(r[0] + 500000, r[1] + " tail", *r[2:]) for r in rows[:20] if r[1] and len(r[1]) > 300]
    spark.createDataFrame(rows, real.schema).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    kept = _plain_kept(spark, rows, real.schema, str(tmp_path))
    assert 50 < len(kept) < len(rows)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    mixed = Counter(r["doc_id"] for r in cp.mix(spark, spark.createDataFrame(kept, real.schema), str(tmp_path)).collect())
    want = Counter()
    for r in kept:
        want[r[0], tuple(library.encode(r[1] or "", add_special_tokens=False).ids), r[4]] += mixed[r[0]]
    got = Counter((r["doc_id"], tuple(r["ids"]), r["n_chars"]) for r in cp.run(spark, str(tmp_path)).collect())
    assert got == +want


def test_stages_take_empty_tables_and_any_names(spark, docs):
    for name, stage in cp.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0, name
    names = ["n_removed", "n_lines", "grade", "kept_grade", "severity", "row_id", "c0", "k0", "copies", "p_clean", "label_id", "u"]
    wide = docs.limit(40).withColumns({n: F.lit(i) for i, n in enumerate(names)})
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, wide, SF)
        assert out.columns == wide.columns, name
        rows = out.collect()
        assert rows and all([r[n] for n in names] == list(range(len(names))) for r in rows), name
    assert {"ids", "grade", "n_removed"} <= set(cp.encode(spark, wide, SF).columns)


def test_stages_take_very_long_texts(spark):
    long = " ".join(f"word{i % 5000}" for i in range(60_000))
    rows = [(1, long, "en", "x", len(long)), (2, long + " end", "en", "x", len(long) + 4), (3, "\n".join(["a b c d e f g"] * 20_000), "en", "x", 280_000 - 1)]
    df = spark.createDataFrame(rows, spark.read.parquet(f"{SF}/documents.parquet").schema).coalesce(1)
    out = df
    for name, stage in cp.STAGES:
        out = stage(spark, out, SF)
    got = {r["doc_id"]: r for r in out.collect()}
    assert set(got) == {1, 3} and got[3]["n_chars"] == 13 and got[1]["n_tokens"] > 60_000
