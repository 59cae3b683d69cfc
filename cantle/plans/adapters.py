"""Views of the benchmark tables in the shapes that the operators expect."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cantle.functions import rings
from cantle.session import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, difficulty (simple where the label says quality 1), size bucket."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    difficulty = F.when(F.col("quality") == 1, "simple_rectangle").otherwise("complex")
    return docs.select("doc_id", "n_chars").join(labels.select("doc_id", "quality"), "doc_id", "left").select("doc_id", "n_chars", difficulty.alias("difficulty"), rings.vertex_bucket(F.col("n_chars") / 400).alias("bucket"))


def order_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One token sequence per order: the quantities in line order."""
    item = F.struct("l_linenumber", "l_partkey", "l_shipdate", F.col("l_quantity").cast("int").alias("q"))
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(item)).alias("s"))
    return lines.select(F.col("l_orderkey").alias("id"), F.transform("s", lambda x: x["q"]).alias("tokens"))


def event_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One token sequence per user: event kinds in time order."""
    kinds = ["click", "error", "purchase", "signup", "view"]
    code = sum((F.when(F.col("event_type") == k, i).otherwise(0) for i, k in enumerate(kinds)), F.lit(0)).cast("int")
    item = F.struct("ts", "event_id", code.alias("c"))
    users = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(item)).alias("s"))
    return users.select(F.col("user_id").alias("id"), F.transform("s", lambda x: x["c"]).alias("tokens"))


def pair_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as targets that name customers, some keys broken by rule."""
    o = F.col("o_orderkey")
    key = F.when(o % 97 == 0, "x").when(o % 89 == 0, "-1").otherwise(F.col("o_custkey").cast("string"))
    name = F.when(o % 83 == 0, "other").otherwise(F.col("o_custkey").cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", key.alias("key"), name.alias("name"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order sequences as targets; predictions unchanged, one shorter, or with another last token."""
    t, n = F.col("tokens"), F.size("tokens")
    short = F.slice(t, F.lit(1), F.greatest(n - 1, F.lit(0)))
    pred = F.when(F.col("id") % 3 == 0, t).when(F.col("id") % 3 == 1, short).otherwise(F.concat(short, F.array(F.lit(51))))
    return order_sequences(spark, sf_dir).select("id", t.alias("target"), pred.alias("pred"))


def stars(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """A star-shaped ring per embedding, with a vertex for each of its 64 components; ``dealt`` out over all cores while rows are small."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    e = F.transform("embedding", lambda x, i: F.struct((F.lit(5.0) + 20.0 * F.abs(x.cast("double"))).alias("r"), (i * F.lit(2 * math.pi / 64)).alias("a")))
    ring = F.transform(e, lambda v: F.struct((v["r"] * F.cos(v["a"])).alias("x"), (v["r"] * F.sin(v["a"])).alias("y")))
    return (spread(rows) if dealt else rows).select(F.col("vec_id").alias("id"), ring.alias("ring"))


def box(x0: Column, y0: Column, w: Column, h: Column) -> Column:
    """A rectangle as a ring."""
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    return F.array(point(x0, y0), point(x0 + w, y0), point(x0 + w, y0 + h), point(x0, y0 + h))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rectangles from line items, and the same shrunk by the discount."""
    li = table(spark, sf_dir, "lineitem")
    x, w, h = F.col("l_partkey") % 1000, F.col("l_quantity"), F.lit(1.0) + F.col("l_linenumber")
    scale = F.lit(1.0) - F.col("l_discount")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", x.cast("double").alias("x0"), w.alias("w"), h.alias("h"), (w * scale).alias("w2"), (h * scale).alias("h2"))
