"""The corpus pipeline: five stages, each reading the table that its predecessor wrote.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last return the
columns of ``documents``. ``run`` writes each stage's result to the shared folder and reads it
back, so a lost executor costs the current stage at most.

toxicity: texts with a probability of at least 0.3 of any toxic grade go.
line_dedup: later lines like an earlier one go; a text that loses all its words goes with them.
near_duplicates: of each group of linked or equal texts the one of least id stays.
mixing: clean texts are kept at least once, low-quality ones thinned, to the target token shares.
bpe: whole texts as token ids, with digests of ids and decoded text.

Edge cases, for every stage: rows with null or empty text pass the filters unchanged, and so do texts without
a known word (toxicity) or without words (lines, groups); repeated rows are scored alike, the first of
them in the input keeps its lines and stays of its group; ties cannot arise, as places in the input
tell equal rows apart; very long texts and lines are read whole; an empty table gives an empty table
with the stage's columns; columns beside ``doc_id`` and ``text`` are kept whatever their names, but for
``n_chars``, which follows the text, and the names that the last stage adds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cantle.llm import bpe_codec, line_dedup, mixing, ngram_join, toxicity
from cantle.llm.queries import _tokenizer
from cantle.session import remove, scratch, tidy

#: Token shares of the mixing stage; toxic texts are gone by then.
WEIGHTS = {"clean": 0.95, "low": 0.05, "toxic": 0.0}
#: Words kept per Python worker in the last stage: by then the executors' heaps are as large as they get.
CACHE_WORDS = 150_000


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, _labels(spark, sf_dir))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    names = [f"k{i}" for i in range(len(docs.columns))]
    text, key = names[docs.columns.index("text")], names[docs.columns.index("doc_id")]
    out = line_dedup.dedup_lines(docs.toDF(*names), key, text, counts=True)
    cut = F.col("n_removed") > 0
    kept = out.where(~F.coalesce(cut & (F.trim(text) == ""), F.lit(False)))
    new = {n: F.when(cut, F.length(text).cast("long")).otherwise(F.col(n)) if o == "n_chars" else F.col(n) for n, o in zip(names, docs.columns, strict=True)}
    return kept.select(*[new[n].alias(o) for n, o in zip(names, docs.columns, strict=True)])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.first_of_each_group(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.resample(docs, _labels(spark, sf_dir), WEIGHTS, keep_clean=True)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe_codec.round_trip(docs, _tokenizer(), keep_ids=True, cache_words=CACHE_WORDS)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("near_duplicates", near_duplicates),
    ("mixing", mix),
    ("bpe", encode),
]

#: The fitted stages have no SQL form; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; a stage's table goes when its successor's is written."""
    root = scratch(spark, "corpus-pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        with tidy(spark):
            out.write.parquet(f"{root}/{k}-{name}")
        docs = spark.read.schema(out.schema).parquet(f"{root}/{k}-{name}")
        if k:
            remove(spark, f"{root}/{k - 1}-{STAGES[k - 1][0]}")
    return docs
