"""Joins, samples, grouped statistics and audits over column-parameterised DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cantle.constants import PAD
from cantle.functions import hashing, tokens
from cantle.sources.files import write_report


# -- pairing -------------------------------------------------------------------------------------
def pair_by_key(targets: DataFrame, raws: DataFrame, target_id: str, key: str, raw_id: str, n_raw: Column, target_name: str, raw_name: str) -> DataFrame:
    """Validated one-to-one join: each target row with its ``outcome``.

    Checks in order: the key is a number (``invalid``), names an existing row (``out_of_range``),
    was not used by an earlier target (``duplicate``), and names agree (``mismatch``), else
    ``paired``. A key is used up by its first target even if that fails later.
    """
    # whole numbers as they are; a fraction is cut off
    number = F.coalesce(F.expr(f"try_cast({key} AS bigint)"), F.expr(f"try_cast(try_cast({key} AS double) AS bigint)"))
    checked = targets.withColumn("fk", number).withColumn("early", F.when(F.col("fk").isNull(), "invalid").when((F.col("fk") < 0) | (F.col("fk") >= n_raw), "out_of_range"))
    # the first target of a key by an aggregate: a key with very many targets, or very many bad keys, meet in no window
    first = checked.where("early IS NULL").groupBy("fk").agg(F.min(target_id).alias("first_"))
    checked = checked.join(first, "fk", "left").withColumn("nth", F.when(F.col("early").isNull() & (F.col(target_id) != F.col("first_")), 2))
    named = raws.select(F.col(raw_id).cast("long").alias("fk"), F.col(raw_name).alias("raw_name_"))
    joined = checked.join(named, "fk", "left")
    outcome = F.coalesce(
        F.col("early"),
        F.when(F.col("nth") > 1, "duplicate"),
        F.when(F.coalesce(F.col(target_name), F.col("raw_name_")) != F.coalesce(F.col("raw_name_"), F.col("fk").cast("string")), "mismatch"),
        F.lit("paired"),
    )
    return joined.select(F.col(target_id), F.col("fk"), outcome.alias("outcome"))


def unmatched(raws: DataFrame, audit: DataFrame, raw_id: str) -> DataFrame:
    """Raw rows that no valid key names; a row whose pair failed later counts as matched."""
    used = audit.where(~F.col("outcome").isin("invalid", "out_of_range")).select(F.col("fk").alias(raw_id))
    return raws.join(used, raw_id, "left_anti")


def fallback_lookup(rows: DataFrame, keys: Sequence[str], tables: Sequence[DataFrame], value: str) -> DataFrame:
    """``rows`` with the first hit among lookup tables (k, order, value); the last row of a key wins."""
    hits = []
    for i, (key, table) in enumerate(zip(keys, tables, strict=True)):
        last = table.groupBy(F.col("k").alias(f"k{i}")).agg(F.max_by(value, "ord").alias(f"v{i}"))
        rows = rows.join(last, rows[key] == last[f"k{i}"], "left").drop(f"k{i}")
        hits.append(F.col(f"v{i}"))
    return rows.withColumn(value, F.coalesce(*hits)).drop(*[f"v{i}" for i in range(len(hits))])


def three_way(requested: DataFrame, predictions: DataFrame, raws: DataFrame, key: str) -> DataFrame:
    """Requested ids with prediction and raw row; of equal ids the last prediction (by ``ord``) counts."""
    last = predictions.groupBy(key).agg(F.max_by(F.struct(*[c for c in predictions.columns if c not in (key, "ord")]), "ord").alias("p"))
    found = requested.select(key).distinct().join(last, key, "left").join(raws, key, "left")
    return found.withColumn("missing", F.col("p").isNull())


def zip_by_place(left: DataFrame, right: DataFrame, place: str, sample: str) -> DataFrame:
    """Full outer join by line number; ``aligned`` is false for a missing side or another sample."""
    a, b = left.alias("a"), right.alias("b")
    joined = a.join(b, F.col(f"a.{place}") == F.col(f"b.{place}"), "full_outer")
    same = F.coalesce(F.col(f"a.{sample}") == F.col(f"b.{sample}"), F.lit(False))
    return joined.withColumn("aligned", same)


def lossless_audit(zipped: DataFrame, atoms: Column, fields: Sequence[str]) -> DataFrame:
    """Rows, round-trip failures (per field), invalid tokens, and misaligned rows of a zipped pair of files."""
    lost = sum((F.sum(F.when(F.col("aligned") & (tokens.bpe_decode(F.col(f"b.{f}"), atoms) != F.col(f"a.{f}")), 1).otherwise(0)) for f in fields), F.lit(0))
    bad = sum((F.sum(F.when(F.col("aligned"), tokens.invalid_tokens(F.col(f"b.{f}"), atoms)).otherwise(0)) for f in fields), F.lit(0))
    return zipped.agg(
        F.count_if("aligned").alias("n_rows"),
        F.coalesce(lost, F.lit(0)).cast("long").alias("roundtrip_failures"),
        F.coalesce(bad, F.lit(0)).cast("long").alias("invalid_token_count"),
        F.count_if(~F.col("aligned")).alias("row_alignment_failures"),
    )


def leakage(train: DataFrame, validation: DataFrame, key: str) -> DataFrame:
    """Ids on both sides; must be empty."""
    return train.select(key).intersect(validation.select(key))


# -- sampling ------------------------------------------------------------------------------------
def hash_sample(df: DataFrame, key: str, count: int, namespace: str, ties: Sequence[str] = ()) -> DataFrame:
    """The ``count`` rows of least hash, in that order; a TakeOrdered, no full sort."""
    if count <= 0:
        raise ValueError("count must be positive")
    scored = df.withColumn("hash16", hashing.hash_prefix(F.col(key), namespace))
    return scored.orderBy("hash16", F.col(key).cast("string"), *ties).limit(count)


def best_per_group(df: DataFrame, group: Sequence[str], score: str, rank: str) -> DataFrame:
    """The row of highest score in each group; of equals the one of least rank."""
    nth = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc(score), rank))
    return df.withColumn("nth_", nth).where("nth_ = 1").drop("nth_")


def best_row(df: DataFrame, score: str, order: str) -> DataFrame:
    """The row of highest score; the first of equals."""
    return df.orderBy(F.desc_nulls_last(score), order).limit(1)


# -- grouped statistics --------------------------------------------------------------------------
def overlapping_groups(difficulty: Column, bucket: Column) -> Column:
    """The three groups that a row counts in."""
    return F.array(F.lit("overall"), difficulty, F.concat(F.lit("vertices:"), bucket))


def group_statistics(df: DataFrame, groups: Column, metrics: Sequence[str]) -> DataFrame:
    """Rows and finite-only means per group: a metric's denominator counts its own finite values."""
    exploded = df.select(F.explode(groups).alias("grp"), *metrics)
    finite = {m: F.when(F.abs(F.col(m)) < float("inf"), F.col(m)) for m in metrics}
    return exploded.groupBy("grp").agg(F.count("*").alias("n"), *[F.avg(c).alias(f"mean_{m}") for m, c in finite.items()])


def evaluation_report(df: DataFrame, groups: Column, metrics: Sequence[str], pred_ok: str, target_ok: str, iou: str) -> DataFrame:
    """Counts and rates of invalid predictions and references, finite means, and the IoU over valid references."""
    exploded = df.select(F.explode(groups).alias("grp"), pred_ok, target_ok, *metrics)
    n, bad, lost = F.count("*"), F.count_if(~F.col(pred_ok)), F.count_if(~F.col(target_ok))
    finite = [F.avg(F.when(F.abs(F.col(m)) < float("inf"), F.col(m))).alias(m) for m in metrics]
    both = F.col(pred_ok) & F.col(target_ok)
    total = F.sum(F.when(both, F.col(iou)).otherwise(0.0))
    return exploded.groupBy("grp").agg(
        n.alias("sample_count"),
        bad.alias("invalid_geometry_count"),
        (bad / n).alias("invalid_geometry_rate"),
        lost.alias("invalid_reference_count"),
        (lost / n).alias("invalid_reference_rate"),
        *finite,
        F.try_divide(total, F.count_if(F.col(target_ok))).alias("all_sample_outline_iou"),
    )


def checks(spark, rows: Sequence[tuple[str, int, int]]) -> DataFrame:
    """(name, expected, actual, ok) from numbers."""
    return spark.createDataFrame([(n, int(a), int(b)) for n, a, b in rows], "name string, expected long, actual long").withColumn("ok", F.col("expected") == F.col("actual"))


def stage_counts(df: DataFrame, stages: Column, groups: Column) -> DataFrame:
    """``stage, grp, n``: rows per stage and group; a row counts in each of its stages and groups."""
    pairs = df.select(F.explode(stages).alias("stage"), groups.alias("g")).select("stage", F.explode("g").alias("grp"))
    return pairs.groupBy("stage", "grp").agg(F.count("*").alias("n"))


def stage_statistics(df: DataFrame, stages: Column, groups: Column) -> dict[str, dict[str, int]]:
    """The same as a dictionary; stages and groups are few."""
    out: dict[str, dict[str, int]] = {}
    for r in stage_counts(df, stages, groups).collect():
        out.setdefault(r["stage"], {})[r["grp"]] = r["n"]
    return out


def best_checkpoint(log: DataFrame, score: str = "greedy_exact_match_rate") -> DataFrame:
    """The row of highest score among test rows, else among training rows; the earliest epoch of equals."""
    scored = log.where(F.col(score) >= 0).withColumn("kind_", F.when(F.col("split") == "test", 0).when(F.col("split") == "train", 1))
    return scored.where("kind_ IS NOT NULL").orderBy("kind_", F.desc(score), "epoch").limit(1).drop("kind_")


def greedy_rates(df: DataFrame, pred: str, target: str) -> DataFrame:
    """Rows, exact matches, their rate, and matching places over the longer lengths."""
    a, b = F.col(pred), F.col(target)
    same = F.count_if(a == b)
    hits, places = F.sum(tokens.positional_matches(a, b)), F.sum(F.greatest(F.size(a), F.size(b)))
    return df.agg(F.count("*").alias("sample_count"), same.alias("exact_match_count"), F.try_divide(same, F.count("*")).alias("greedy_exact_match_rate"), F.try_divide(hits, places).alias("token_accuracy"))


def exact_rate(df: DataFrame, pred: str, target: str) -> DataFrame:
    """Share of rows that are equal but for padding at the end; a row without one of its sides is an error."""
    a, b = (F.when(F.col(x).isNull(), F.raise_error(F.lit(f"a row has no {x}")).cast("array<int>")).otherwise(F.col(x)) for x in (pred, target))
    return df.agg(F.avg((tokens.strip_pad(a) == tokens.strip_pad(b)).cast("int")).alias("exact_match_rate"))


def teacher_forced_accuracy(df: DataFrame, predicted: str, labels: str, pad: int = PAD) -> DataFrame:
    """Right tokens over all label tokens but padding, over all rows at once."""
    real = F.filter(F.arrays_zip(F.col(predicted).alias("p"), F.col(labels).alias("l")), lambda x: x["l"] != pad)
    right = F.size(F.filter(real, lambda x: x["p"] == x["l"]))
    correct, total = F.sum(right), F.sum(F.size(real))
    return df.agg(correct.alias("correct"), total.alias("total"), F.try_divide(correct, total).alias("token_accuracy"))


def average_loss(df: DataFrame, loss: str) -> DataFrame:
    """The mean of the completed steps' losses; 0 without any."""
    return df.agg((F.coalesce(F.sum(loss), F.lit(0.0)) / F.greatest(F.count(loss), F.lit(1))).alias("average_loss"))


class NonFinite(ValueError):
    """A value that is no finite number."""


def require_finite(df: DataFrame, columns: Sequence[str], stage: str, report: str | None = None, context: dict | None = None) -> None:
    """Raise where a column holds NaN or an infinity, after writing what is known beside the run's outputs."""
    bad = df.agg(*[F.count_if(~(F.abs(F.col(c)) < float("inf"))).alias(c) for c in columns]).collect()[0].asDict()
    bad = {k: n for k, n in bad.items() if n}
    if bad:
        if report:
            write_report(report, {**(context or {}), "failure_stage": stage, "rows": bad}, allow_nan=False)
        raise NonFinite(f"values that are not finite in {stage}: {bad}")


def gate_checks(rows: Sequence[tuple[str, DataFrame, DataFrame]]) -> DataFrame:
    """(name, expected, actual, ok) from pairs of one-value frames."""
    out = None
    for name, expected, actual in rows:
        want = expected.toDF("expected").select(F.lit(name).alias("name"), F.col("expected").cast("long"))
        one = want.join(actual.toDF("actual").select(F.lit(name).alias("name"), F.col("actual").cast("long")), "name")
        out = one if out is None else out.unionByName(one)
    return out.withColumn("ok", F.col("expected").eqNullSafe(F.col("actual")))


def require(checks: DataFrame) -> None:
    """Raise with the names of failed checks."""
    failed = [f"{r['name']}: expected {r['expected']}, got {r['actual']}" for r in checks.where("NOT ok").collect()]
    if failed:
        raise ValueError("; ".join(sorted(failed)))


# -- token corpora -------------------------------------------------------------------------------
def segment_weights(df: DataFrame, sequence: Column, position: Column, weight: Column | None = None) -> DataFrame:
    """Distinct trainable segments with total weight and first place, for the vocabulary trainer."""
    weight = F.lit(1) if weight is None else weight
    parts = df.where(weight > 0).select(weight.cast("long").alias("w"), position.alias("pos"), F.posexplode(tokens.segments(sequence)).alias("at", "segment"))
    return parts.groupBy("segment").agg(F.sum("w").alias("weight"), F.min(F.struct("pos", "at")).alias("first"))


def pair_counts(df: DataFrame, sequence: Column, weight: Column | None = None) -> DataFrame:
    """Weighted counts of overlapping neighbours."""
    weight = F.lit(1) if weight is None else weight
    pairs = df.select(weight.cast("long").alias("w"), F.explode(tokens.adjacent_pairs(sequence)).alias("p"))
    return pairs.groupBy(F.col("p.l").alias("l"), F.col("p.r").alias("r")).agg(F.sum("w").alias("n"))


def best_pair(df: DataFrame, sequence: Column, position: Column, weight: Column | None = None) -> DataFrame:
    """The most frequent pair of neighbours; of equal counts the one first seen, by position, then place."""
    weight = F.lit(1) if weight is None else weight
    pairs = df.select(weight.cast("long").alias("w"), position.alias("pos"), F.posexplode(tokens.adjacent_pairs(sequence)).alias("at", "p"))
    counts = pairs.groupBy(F.col("p.l").alias("l"), F.col("p.r").alias("r")).agg(F.sum("w").alias("n"), F.min(F.struct("pos", "at")).alias("first"))
    return counts.orderBy(F.desc("n"), "first").limit(1).drop("first")
