"""One query per operator of this subpackage; each takes (spark, sf_dir)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cantle.llm.hard_negatives import ORACLE_SQL as _NEGATIVES_SQL
from cantle.llm.line_dedup import ORACLE_SQL as _LINES_SQL
from cantle.llm.ngram_join import ORACLE_SQL as _NEAR_SQL
from cantle.llm.ranked_search import ORACLE_SQL as _RANKED_SQL
from cantle.llm.topk_blocks import ORACLE_SQL as _TOPK_SQL
from cantle.session import materialise


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: Token shares of the domains that op1 mixes to.
MIX = {"clean": 0.9, "low": 0.08, "toxic": 0.02}


def op1_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cantle.llm.mixing import mix

    return mix(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"), MIX, max_rate=None)


def op3_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cantle.llm.quality_mil import scores, train

    docs = _read(spark, sf_dir, "documents")
    return scores(docs, train(docs, _read(spark, sf_dir, "labels")))


def op2_topk_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cantle.llm.topk_blocks import top_k

    return top_k(_read(spark, sf_dir, "embeddings"), 20, 20)


def op4_ngram_forest_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cantle.llm.ngram_join import near_duplicates

    return near_duplicates(_read(spark, sf_dir, "documents"))


def op5_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cantle.llm.bpe_codec import round_trip

    return round_trip(_read(spark, sf_dir, "documents").select("doc_id", "text"), _tokenizer())


def op6_toxicity_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cantle.llm.toxicity import severity, train

    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return severity(docs, train(docs, _read(spark, sf_dir, "labels")))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cantle.llm.line_dedup import dedup_lines

    return dedup_lines(_read(spark, sf_dir, "documents").select("doc_id", "text"), counts=True)


def op8_elias_fano_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cantle.llm.lm_trie import scores, train

    docs = _read(spark, sf_dir, "documents")
    model = train(docs)
    out = materialise(scores(docs, model))
    model.remove()
    return out


def op9_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cantle.llm.media_jpeg import digest

    return digest(_read(spark, sf_dir, "documents"))


def op10_byte_prefix_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cantle.llm.sharding import balanced_shards

    shards = balanced_shards(_read(spark, sf_dir, "documents"), 16)
    return shards.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cantle.llm.hard_negatives import mine

    return mine(_read(spark, sf_dir, "embeddings"))


def op12_cost_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cantle.llm.packing import pack

    return pack(_read(spark, sf_dir, "documents"), _tokenizer(), keep_ids=False)


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cantle.llm.ranked_search import search

    return search(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_soft_mixing": op1_soft_mixing,
    "op2_topk_blocks": op2_topk_blocks,
    "op3_quality_mil": op3_quality_mil,
    "op4_ngram_forest_join": op4_ngram_forest_join,
    "op5_bpe_encode_decode": op5_bpe_encode_decode,
    "op6_toxicity_ordinal": op6_toxicity_ordinal,
    "op7_line_dedup": op7_line_dedup,
    "op8_elias_fano_lm": op8_elias_fano_lm,
    "op9_progressive_jpeg": op9_progressive_jpeg,
    "op10_byte_prefix_shards": op10_byte_prefix_shards,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_cost_packing": op12_cost_packing,
    "op13_ranked_search": op13_ranked_search,
}

#: DuckDB SQL for the queries that SQL can express.
ORACLE_SQL: dict[str, str] = {"op2_topk_blocks": _TOPK_SQL, "op4_ngram_forest_join": _NEAR_SQL, "op7_line_dedup": _LINES_SQL, "op11_hard_negatives": _NEGATIVES_SQL, "op13_ranked_search": _RANKED_SQL}
