"""Places of lines: global line numbers of text files that Spark reads in splits, without a sort.

A line's number is the lines before its file, plus those before its split in the file, plus its place in the
split. The first two come from an index with a row per split, by prefix sums over counted lines; the last from
the row numbers of the scan, which runs through a split in order. Files count in the order of their
names, as a writer of ordered rows names them. All lines count, blank ones too.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cantle.session import materialise


@dataclass
class LineFile:
    """A file or folder of lines and its index: ``file, block, first, lines, before``, a row per split."""

    spark: SparkSession
    path: str
    blocks: DataFrame

    def numbered(self) -> DataFrame:
        """``line`` (from 0) and ``value`` of each line."""
        rows = _rows(self.spark, self.path).join(self.blocks.select("file", "block", "first", "before"), ["file", "block"])
        return rows.select((F.col("before") + F.col("id") - F.col("first")).alias("line"), "value")

    def parsed(self, ddl: str) -> DataFrame:
        """``line`` and the fields of the JSON object in it; blank lines have a number, but no row."""
        rows = self.numbered().where(F.trim("value") != "").select("line", F.from_json("value", ddl).alias("v"))
        return rows.select("line", "v.*")

    def count(self) -> int:
        return self.blocks.agg(F.coalesce(F.sum("lines"), F.lit(0))).collect()[0][0]

    def first(self, n: int) -> DataFrame:
        """The first n lines; only the files that hold them are read."""
        return self._within(F.col("before") < n).where(F.col("line") < n)

    def at(self, places: DataFrame, column: str = "line") -> DataFrame:
        """The lines that ``places`` names; only the files that hold any are read."""
        wanted = places.select(F.col(column).cast("long").alias("line")).distinct()
        ends = F.col("before") + F.col("lines")
        held = self.blocks.join(wanted, (F.col("line") >= F.col("before")) & (F.col("line") < ends), "left_semi") if wanted.count() <= 10_000 else self.blocks
        return self._within(F.lit(True), held).join(wanted, "line", "left_semi")

    def _within(self, condition: Column, blocks: DataFrame | None = None) -> DataFrame:
        files = [r["file"] for r in (self.blocks if blocks is None else blocks).where(condition & (F.col("lines") > 0)).select("file").distinct().collect()]
        # a filter on the file's name drops files before they are read; it also deals splits out anew, so each one's
        # first row number is taken from this scan
        rows = _rows(self.spark, self.path, files)
        own = rows.groupBy("file", "block").agg(F.min("id").alias("first"))
        placed = rows.join(own, ["file", "block"]).join(self.blocks.select("file", "block", "before"), ["file", "block"])
        return placed.select((F.col("before") + F.col("id") - F.col("first")).alias("line"), "value")


def _rows(spark: SparkSession, path: str, files: list[str] | None = None) -> DataFrame:
    """Lines with their file, the start of their split, and a number that grows along the scan."""
    text = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    text = text if files is None else text.where(F.col("file").isin(files))
    return text.withColumn("id", F.monotonically_increasing_id())


def line_file(spark: SparkSession, path: str) -> LineFile:
    """Count the lines of all splits, once."""
    per = _rows(spark, path).groupBy("file", "block").agg(F.min("id").alias("first"), F.count("*").alias("lines"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    inside = per.withColumn("inside", F.coalesce(F.sum("lines").over(earlier), F.lit(0)))
    # a row per file
    ahead = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    whole = per.groupBy("file").agg(F.sum("lines").alias("n")).withColumn("ahead", F.coalesce(F.sum("n").over(ahead), F.lit(0)))
    blocks = inside.join(whole.select("file", "ahead"), "file").select("file", "block", "first", "lines", (F.col("ahead") + F.col("inside")).alias("before"))
    return LineFile(spark, path, materialise(blocks, small=True))


def in_order(df: DataFrame, place: str = "line") -> DataFrame:
    """Rows as they are to be written, so that their lines come in the order of ``place``, which is left out."""
    return df.orderBy(place).drop(place)
