"""Small session helpers shared by every subpackage."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_PACKAGE = Path(__file__).resolve().parent


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is whatever ``spark.checkpoint.dir`` names. Only where that is unset (tests, a
    laptop) a folder below the warehouse is set for the session.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named is None:
        if sc.getCheckpointDir() is None:
            warehouse = spark.conf.get("spark.sql.warehouse.dir").removeprefix("file:")
            sc.setCheckpointDir(os.path.join(warehouse, "_shared"))
        named = sc.getCheckpointDir()
    elif sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def materialise(df: DataFrame, small: bool = False) -> DataFrame:
    """Cut the lineage by a reliable checkpoint in the shared folder.

    ``small``: many tasks give few rows, which are gathered into files of the advisory size first.
    """
    shared_dir(df.sparkSession)
    with tidy(df.sparkSession):
        return (df.hint("rebalance") if small else df).checkpoint(eager=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path below the shared folder; it is removed when the driver's Python ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_sweep, spark, path)
    return path


def _sweep(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the JVM may have ended before
        remove(spark, path)


def pinned(df: DataFrame, name: str) -> DataFrame:
    """``df`` with a row number in ``name`` that is the same however often the rows are read.

    Numbers over files hold, as each reading splits the files alike. Behind a shuffle, or anything else that
    may deal rows out anew, the rows are written to the shared folder with their numbers.
    """
    numbered = df.withColumn(name, F.monotonically_increasing_id())
    plans, steady = [df._jdf.queryExecution().optimizedPlan()], {"LogicalRelation", "Relation", "LocalRelation", "Project", "Filter"}
    while plans:
        plan = plans.pop()
        if plan.nodeName().split(" ")[0] not in steady or not plan.deterministic():
            path = scratch(df.sparkSession, "pinned")
            with tidy(df.sparkSession):
                numbered.write.option("compression", "zstd").parquet(path)
            return df.sparkSession.read.schema(numbered.schema).parquet(path)
        children = plan.children()
        plans += [children.apply(i) for i in range(children.size())]
    return numbered


def trim() -> None:
    """Give memory that a fit has freed back to the system, where the C library can."""
    gc.collect()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate data, wherever it lies."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextlib.contextmanager
def _setting(spark: SparkSession, key: str, value: str):
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def tidy(spark: SparkSession):
    """Shuffle files of what runs in here go when it ends, not when the driver happens to collect garbage."""
    return _setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def roomy(spark: SparkSession, bits: int):
    """Aggregates over up to 2 ** bits short keys stay in generated code."""
    return _setting(spark, "spark.sql.codegen.aggregate.fastHashMap.capacityBit", str(bits))


def ship(spark: SparkSession) -> None:
    """Make this package importable on the Python workers.

    Nothing happens where the workers find it anyway; otherwise a zip goes to them once
    per application through Spark's own file server.
    """
    sc = spark.sparkContext
    roots = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    if any(r and (Path(r) / _PACKAGE.name / "__init__.py").exists() for r in roots):
        return
    if getattr(sc, "_cantle_shipped", False):
        return
    target = Path(tempfile.mkdtemp()) / f"{_PACKAGE.name}.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in _PACKAGE.rglob("*.py"):
            z.write(p, p.relative_to(_PACKAGE.parent))
    sc.addPyFile(str(target))
    sc._cantle_shipped = True


def shuffle_width(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt out evenly over all cores, some parts a core: for Python stages that take milliseconds a row, behind
    a scan of few files or an exchange that was coalesced by its bytes."""
    return df.repartition(max(4 * df.sparkSession.sparkContext.defaultParallelism, shuffle_width(df.sparkSession)))
