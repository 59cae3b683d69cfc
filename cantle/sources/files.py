"""JSON-lines tables, reports, fingerprints and manifests."""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cantle.functions.codec import FRAME_DDL

METRICS_DDL = "struct<outline_iou:double,mean_boundary_distance:double,perimeter_relative_error:double,area_relative_error:double>"
SAMPLE_DDL = f"sample_id string, raw_fid long, target_fid long, osm_id string, scale int, split string, difficulty string, source_tokens array<int>, target_tokens array<int>, source_frame {FRAME_DDL}, source_vertex_count int, target_vertex_count int, tokenization_metrics {METRICS_DDL}"
PREDICTION_DDL = f"raw_fid long, osm_id string, scale int, source_frame {FRAME_DDL}, difficulty string, source_vertex_count int, pred_tokens array<int>, target_tokens array<int>"


def read_jsonl(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """Rows of a JSON-lines file or folder; blank lines are skipped."""
    return spark.read.schema(ddl).json(path)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    df = read_jsonl(spark, path, PREDICTION_DDL)
    return df.withColumns({"difficulty": F.coalesce("difficulty", F.lit("unknown")), "source_vertex_count": F.coalesce("source_vertex_count", F.lit(0))})


def fid_filter(spark: SparkSession, path: str | None) -> DataFrame | None:
    """The ids of an id list; no path, no filter."""
    return None if path is None else read_jsonl(spark, path, "raw_fid long").select("raw_fid").distinct()


def local_path(path: str) -> str:
    """A path of the mounted file system, given with or without its scheme; one of another store is an error."""
    if "://" in path and not path.startswith("file:"):
        raise ValueError(f"{path} does not lie in a mounted folder")
    return "/" + path.removeprefix("file:").lstrip("/")


def _hadoop(spark: SparkSession, path: str):
    made = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return made, made.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_jsonl(df: DataFrame, path: str) -> None:
    """A folder of JSON lines that replaces the old one only when it is whole; the old one is moved aside
    first and comes back if the new one cannot be put in place."""
    temp, aside = f"{path}.{uuid.uuid4().hex}", f"{path}.{uuid.uuid4().hex}.old"
    spark = df.sparkSession
    (new, fs), (old, _), (kept, _) = (_hadoop(spark, p) for p in (temp, path, aside))
    try:
        df.write.option("ignoreNullFields", "false").json(temp)
        had = fs.exists(old)
        if had and not fs.rename(old, kept):
            raise OSError(f"cannot move {path} aside")
        if not fs.rename(new, old):
            if had:
                fs.rename(kept, old)
            raise OSError(f"cannot move {temp} to {path}")
        fs.delete(kept, True)
    finally:
        fs.delete(new, True)


def write_sinks(routed: DataFrame, folder: str, sinks: Sequence[str]) -> None:
    """One job writes the lines ``value`` by ``sink``; each sink is then the folder ``<sink>.jsonl``, empty if it got no line."""
    spark, temp = routed.sparkSession, os.path.join(folder, f".sinks-{uuid.uuid4().hex}")
    routed.write.partitionBy("sink").text(temp)
    for sink in sinks:
        (made, fs), (target, _) = _hadoop(spark, f"{temp}/sink={sink}"), _hadoop(spark, os.path.join(folder, f"{sink}.jsonl"))
        if not (fs.rename(made, target) if fs.exists(made) else fs.mkdirs(target)):
            raise OSError(f"cannot move {made} to {target}")
    made, fs = _hadoop(spark, temp)
    fs.delete(made, True)


def replace(source: str, target: str) -> None:
    """Move a file or folder over another one, which is put aside until the move is done."""
    aside = f"{target}.{uuid.uuid4().hex}.old"
    had = os.path.exists(target)
    if had:
        os.replace(target, aside)
    try:
        os.replace(source, target)
    except OSError:
        if had:
            os.replace(aside, target)
        raise
    if os.path.isdir(aside):
        shutil.rmtree(aside)
    elif had:
        os.remove(aside)


def append_metrics(rows: DataFrame, path: str) -> None:
    """More lines of a metrics log, a folder of JSON lines."""
    rows.write.mode("append").option("ignoreNullFields", "false").json(path)


def write_report(path: str, report: Mapping, allow_nan: bool = True) -> None:
    """A JSON file, put in place whole."""
    temp = f"{path}.{uuid.uuid4().hex}.tmp"
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    try:
        with open(temp, "w", encoding="utf-8") as f:
            json.dump(report, f, ensure_ascii=False, indent=2, allow_nan=allow_nan)
        os.replace(temp, path)
    finally:
        if os.path.exists(temp):
            os.remove(temp)


#: Files up to this size are hashed whole by a task; the driver streams larger ones.
WHOLE_BYTES = 256 << 20


def parts(spark: SparkSession, path: str) -> DataFrame:
    """``name, bytes, sha256, lines`` of a file, or of each data file below a folder, hashed by the executors on any file system."""
    root, fs = _hadoop(spark, path)
    base = fs.makeQualified(root).toString()
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    # without the content's column only lengths are read
    small = found.where(F.col("length") <= WHOLE_BYTES)
    plain = F.decode("content", "ISO-8859-1")
    lines = (F.length(plain) - F.length(F.replace(plain, F.lit("\n"), F.lit("")))).cast("long")
    name = F.regexp_replace(F.substring("path", F.lit(len(base) + 1), F.length("path")), "^/+", "")
    return small.select(name.alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), lines.alias("lines"))


def _streamed(path: str) -> dict:
    h, size, lines = hashlib.sha256(), 0, 0
    with open(local_path(path), "rb") as f:
        while block := f.read(1 << 20):
            h.update(block)
            size += len(block)
            lines += block.count(b"\n")
    return {"bytes": size, "sha256": h.hexdigest(), "lines": lines}


def fingerprint(spark: SparkSession, path: str) -> dict:
    """Bytes and sha256, and lines for line files. A folder's digest is that of its parts' names and digests, which are listed, too;
    empty parts do not count."""
    root, fs = _hadoop(spark, path)
    whole, every = fs.getFileStatus(root).isFile(), {}
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    for r in found.where(F.col("length") > WHOLE_BYTES).collect():
        every[r["path"].removeprefix(fs.makeQualified(root).toString()).lstrip("/")] = _streamed(r["path"])
    every |= {r["name"]: {"bytes": r["bytes"], "sha256": r["sha256"], "lines": r["lines"]} for r in parts(spark, path).collect()}
    if whole:
        (out,) = every.values() or [{"bytes": 0, "sha256": hashlib.sha256(b"").hexdigest(), "lines": 0}]
    else:
        tree = "".join(f"{n} {every[n]['sha256']}\n" for n in sorted(every))
        out = {"bytes": sum(v["bytes"] for v in every.values()), "sha256": hashlib.sha256(tree.encode()).hexdigest(), "lines": sum(v["lines"] for v in every.values())}
        out["parts"] = {n: every[n]["sha256"] for n in sorted(every)}
    if not path.endswith((".jsonl", ".txt")):
        del out["lines"]
    return out


def write_manifest(spark: SparkSession, path: str, config: Mapping, inputs: Sequence[str], outputs: Sequence[str], extra: Mapping = {}) -> dict:  # noqa: B006
    body = {"config": dict(config), "inputs": {p: fingerprint(spark, p) for p in inputs}, "outputs": {p: fingerprint(spark, p) for p in outputs}, **extra}
    write_report(path, body)
    return body


def _recorded(path: str) -> dict:
    try:
        with open(path, encoding="utf-8") as f:
            return json.load(f)
    except (OSError, ValueError):
        return {}


def manifest_is_current(spark: SparkSession, path: str, config: Mapping, inputs: Sequence[str]) -> bool:
    """Same settings, and every input and output as recorded; anything unreadable is stale."""
    try:
        body = _recorded(path)
        same = body["config"] == json.loads(json.dumps(config)) and sorted(body["inputs"]) == sorted(inputs)
        return same and all(fingerprint(spark, p) == {**v} for k in ("inputs", "outputs") for p, v in body[k].items())
    except Exception:  # a missing file, in any file system
        return False


def refresh_parts(spark: SparkSession, source: str, target: str, manifest: str, make: Callable[[DataFrame], DataFrame]) -> dict[str, list[str]]:
    """Keep ``target`` in step with the data files of the folder ``source``: only new and changed ones are made anew.

    ``make`` turns rows ``part, value`` (a file's name and its lines) into rows that keep ``part``, by which ``target``
    is partitioned. Parts whose file has gone are removed. The manifest is put down last, so whatever
    breaks off is done again.
    """
    before = _recorded(manifest).get("parts", {})
    now = {r["name"]: r["sha256"] for r in parts(spark, source).collect()}
    changed, gone = sorted(n for n, h in now.items() if before.get(n) != h), sorted(set(before) - set(now))
    if changed:
        lines = spark.read.text([f"{source}/{n}" for n in changed])
        named = lines.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("part"), "value")
        make(named).write.partitionBy("part").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(target)
    for name in gone:
        where, fs = _hadoop(spark, f"{target}/part={name}")
        fs.delete(where, True)
    write_report(manifest, {"parts": now})
    return {"made": changed, "removed": gone, "kept": sorted(set(now) - set(changed))}


def config_hash(config: Mapping) -> str:
    return hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest()
