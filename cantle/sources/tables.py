"""Tables kept by a key, so that joins and groups on it need no shuffle."""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession

from cantle.session import shuffle_width


def by_key(df: DataFrame, key: str, buckets: int | None = None) -> DataFrame:
    """``df`` written once as a bucketed, sorted table in the warehouse, and read back.

    One task writes a bucket, so it is one file. Tables with the same number of buckets join on their keys
    without an exchange, and a group by the key needs none; against another side only that side is dealt out.
    The table is dropped when the driver's Python ends.
    """
    spark, name = df.sparkSession, f"cantle_{uuid.uuid4().hex}"
    n = buckets or shuffle_width(spark)
    df.repartition(n, key).write.bucketBy(n, key).sortBy(key).saveAsTable(name)
    atexit.register(_drop, spark, name)
    return spark.table(name)


def _drop(spark: SparkSession, name: str) -> None:
    with contextlib.suppress(Exception):  # the JVM may have ended before
        spark.sql(f"DROP TABLE IF EXISTS {name}")
