"""The preparation, evaluation and inference jobs, and their command line.

``prepare``: pair two layers, encode, split, sample, learn a vocabulary, re-encode, audit, pass gates,
record. ``prepare-all``: both cities at all scales, from layers in degrees. ``train``: the sequence model.
``predict``: greedy predictions.
``evaluate``: grouped report of a prediction file. ``infer``: polygons for unmatched sources.
``decode``: a prediction file as a layer. ``project``: a layer in degrees to UTM.
"""

from __future__ import annotations

import argparse
import dataclasses
import json
import os
import shutil
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from cantle import constants as c
from cantle.functions import hashing, rings, seq2seq, tokens
from cantle.functions import polygon as pg
from cantle.operators import bpe, geometry, inference, training
from cantle.operators import relational as rel
from cantle.sources import files, lines, shapefile, shapefile_sink


@dataclass(frozen=True)
class Layout:
    """Where the outputs of one scale lie."""

    root: str
    scale: int

    def at(self, name: str) -> str:
        return os.path.join(self.root, f"scale{self.scale}", name)


def need_disk(path: str, gigabytes: float) -> None:
    free = shutil.disk_usage(path).free / 1e9
    if free < gigabytes:
        raise OSError(f"{free:.1f} GB free below {path}, {gigabytes} GB needed")


def paired(spark: SparkSession, raw_path: str, target_path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pairs, audit, raw layer): the validated join on ``InBld_FID``."""
    for p in (raw_path, target_path):
        shapefile.check_crs(p)
    raw, target = shapefile.read(spark, raw_path), shapefile.read(spark, target_path)
    if "InBld_FID" not in target.columns:
        raise ValueError(f"{target_path} has no InBld_FID")
    if "osm_id" not in raw.columns:
        raw = raw.withColumn("osm_id", F.col("fid").cast("string"))
    if "osm_id" not in target.columns:
        target = target.withColumn("osm_id", F.lit(None).cast("string"))
    raw = raw.withColumn("osm_id", F.coalesce(F.col("osm_id").cast("string"), F.col("fid").cast("string")))
    n = F.lit(shapefile._dbf_header(os.path.splitext(raw_path)[0] + ".dbf")[0])
    keys = target.select(F.col("fid").alias("target_fid"), F.col("InBld_FID").cast("string").alias("key"), F.col("osm_id").cast("string").alias("name"))
    audit = rel.pair_by_key(keys, raw, "target_fid", "key", "fid", n, "name", "osm_id")
    good = audit.where("outcome = 'paired'").select("target_fid", F.col("fk").alias("raw_fid"))
    sources = raw.select(F.col("fid").alias("raw_fid"), "osm_id", F.col("geom").alias("raw"))
    pairs = good.join(sources, "raw_fid").join(target.select(F.col("fid").alias("target_fid"), F.col("geom").alias("target")), "target_fid")
    return pairs, audit, raw


@dataclass
class Samples:
    """Token rows of a pair of layers, what no target names, and the outcome of each target."""

    rows: DataFrame  # every pair, with an error or tokens
    lost: DataFrame
    audit: DataFrame  # persisted: ids and outcomes

    def release(self) -> None:
        self.audit.unpersist()


SAMPLE_COLUMNS = ["sample_id", "raw_fid", "target_fid", "osm_id", "scale", "split", "difficulty", "source_tokens", "target_tokens", "source_frame", "source_vertex_count", "target_vertex_count", "tokenization_metrics"]


def tokenised(spark: SparkSession, raw_path: str, target_path: str, scale: int, prefix: str = "pair", seed: int = c.SEED, split: str | None = None) -> Samples:
    pairs, audit, raw = paired(spark, raw_path, target_path)
    audit = audit.persist()
    named = F.when(F.lit(split).isNotNull(), F.lit(split)).otherwise(hashing.split_of(F.col("osm_id"), seed))
    rows = geometry.prepare_pairs(pairs, scale).withColumns({"scale": F.lit(scale), "split": named, "sample_id": F.concat_ws(":", F.lit(prefix), "raw_fid", F.lit(scale))})
    lost = rel.unmatched(raw.select(F.col("fid").alias("raw_fid"), "osm_id"), audit, "raw_fid").withColumn("scale", F.lit(scale))
    return Samples(rows, lost, audit)


OUTCOMES = ("paired", "invalid", "out_of_range", "duplicate", "mismatch")
BUCKETS = ("4", "5-8", "9-16", "17+")


def _groups() -> dict[str, Column]:
    """The condition of each group that a row counts in; a row that failed is in none."""
    ok, bucket = F.col("error").isNull(), geometry.bucket("source_vertex_count")
    kinds = {k: ok & (F.col("difficulty") == k) for k in ("simple_rectangle", "complex")}
    return {"overall": ok} | kinds | {f"vertices:{b}": ok & (bucket == b) for b in BUCKETS}


def _route(part: Samples, prefix: str, sinks: dict[str, Column], stages: dict[str, Column]) -> tuple[DataFrame, dict[str, Observation]]:
    """All that a pair of layers gives as lines for sinks, and the counters that are taken on the way.

    Counters are observed behind the last shuffle, in the very tasks that write: those count once each, even if an
    executor is lost and tasks are repeated.
    """
    line = lambda columns: F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    groups = _groups()
    seen = [F.count_if(F.col("error").isNotNull()).alias("failed")]
    seen += [F.count_if(c).alias(f"n|{g}") for g, c in groups.items()]
    seen += [F.count_if(c & s).alias(f"stage|{n}|{g}") for g, c in groups.items() for n, s in stages.items()]
    for m in pg.LIGHT:
        value = F.col(f"tokenization_metrics.{m}")
        for g, c in groups.items():
            finite = F.when(c & (F.abs(value) < float("inf")), value)
            seen += [F.sum(finite).alias(f"sum|{g}|{m}"), F.count(finite).alias(f"count|{g}|{m}")]
    look = {k: Observation(f"{prefix}{k}") for k in ("rows", "audit", "lost")}
    rows, ok = part.rows.observe(look["rows"], *seen), F.col("error").isNull()
    to = F.array_compact(F.array(*[F.when(ok & c, F.lit(n)) for n, c in sinks.items()], F.when(~ok, F.lit(f"{prefix}failures"))))
    failure = lambda raw, kind, error: line(["target_fid", raw.alias("raw_fid"), F.lit(kind).alias("failure_type"), error.alias("error")])
    out = rows.select(F.explode(to).alias("sink"), F.when(ok, line(SAMPLE_COLUMNS)).otherwise(failure(F.col("raw_fid"), "preprocessing", F.col("error"))).alias("value"))
    audit = part.audit.observe(look["audit"], *[F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES])
    unpaired = audit.where("outcome <> 'paired'").select(F.lit(f"{prefix}failures").alias("sink"), failure(F.col("fk"), "pairing", F.col("outcome")).alias("value"))
    lost = part.lost.observe(look["lost"], F.count("*").alias("n")).select(F.lit(f"{prefix}unmatched").alias("sink"), line(part.lost.columns).alias("value"))
    return out.unionByName(unpaired).unionByName(lost), look


def _group_report(seen: dict) -> dict[str, dict]:
    """Rows and finite means of each group that has rows."""
    out = {}
    for g in _groups():
        if n := seen[f"n|{g}"]:
            means = {f"mean_{m}": seen[f"sum|{g}|{m}"] / seen[f"count|{g}|{m}"] if seen[f"count|{g}|{m}"] else None for m in pg.LIGHT}
            out[g] = {"grp": g, "n": n} | means
    return out


def export_unmatched(spark: SparkSession, raw_path: str, ids: DataFrame, output: str, scale: int) -> int:
    """Source tokens and frames of the sources that ``ids`` (raw_fid, osm_id) names, without targets.

    Ids outside the layer and rows without geometry are left out. Any other row that cannot be encoded
    fails the export, and the old file stays.
    """
    shapefile.check_crs(raw_path)
    layer = shapefile.read(spark, raw_path, ["fid", "geom"]).toDF("raw_fid", "raw").where(F.size("raw") > 0)
    rows = geometry.encode_sources(ids.select("raw_fid", "osm_id").join(layer, "raw_fid"), scale)
    named = rows.withColumns({"scale": F.lit(scale), "sample_id": F.concat_ws(":", F.lit("unmatched"), "raw_fid", F.lit(scale))})
    files.write_jsonl(named.select("sample_id", "raw_fid", "osm_id", "scale", "source_tokens", "source_frame", "source_vertex_count"), output)
    return files.read_jsonl(spark, output, "raw_fid long").count()


def prepare(spark: SparkSession, raw_path: str, target_path: str, root: str, scale: int, seed: int = c.SEED, fraction: float = c.RECTANGLE_FRACTION, split: str | None = None, bpe_rows: int = c.BPE_ROWS, vocab_size: int = c.BPE_SIZE, force: bool = False, expected_unmatched: int | None = None, test: tuple[str, str] | None = None) -> dict:
    """All outputs of one scale; nothing is redone while the manifest is current.

    ``test``: raw and target layer of a second city, encoded with the vocabulary of the first. Everything is
    made in a folder of its own and has to pass the gates before any old output is replaced; only the
    lists of failures are put in place either way.
    """
    out = Layout(root, scale)
    inputs = [f for p in (raw_path, target_path, *(test or ())) for f in shapefile.family(p)]
    config = {"scale": scale, "seed": seed, "fraction": fraction, "split": split, "bpe_rows": bpe_rows, "vocab_size": vocab_size, "expected_unmatched": expected_unmatched}
    manifest = out.at("manifest.json")
    if not force and files.manifest_is_current(spark, manifest, config, inputs):
        with open(manifest, encoding="utf-8") as f:
            return json.load(f)
    work = Layout(os.path.join(root, f".work-{uuid.uuid4().hex}"), scale)
    os.makedirs(work.at(""))
    os.makedirs(out.at(""), exist_ok=True)
    try:
        report, gates = _prepare_into(spark, work, raw_path, target_path, test, config)
        for name in os.listdir(work.at("")):
            if name.endswith("failures.jsonl"):
                files.replace(work.at(name), out.at(name))
        rel.require(rel.checks(spark, gates))
        made = sorted(os.listdir(work.at("")))
        for name in made:
            files.replace(work.at(name), out.at(name))
    finally:
        shutil.rmtree(work.root, ignore_errors=True)
    made = [n for n in sorted(os.listdir(out.at(""))) if n.endswith(("l", ".txt")) and n in {*made, "failures.jsonl", "test.failures.jsonl"}]
    return files.write_manifest(spark, manifest, config, inputs, [out.at(n) for n in made], {"scale": scale, **report})


def _prepare_into(spark: SparkSession, work: Layout, raw_path: str, target_path: str, test: tuple[str, str] | None, config: dict) -> tuple[dict, list[tuple[str, int, int]]]:
    """Write all outputs below ``work``; the report, and the gates as (name, expected, actual)."""
    scale, split, fraction, seed = config["scale"], config["split"], config["fraction"], config["seed"]
    keep = hashing.keeps_sample(F.col("osm_id"), F.col("difficulty"), seed, fraction)
    train, validation = F.col("split") == "train", F.col("split") == "validation"
    stages = {"train_before_filter": train, "train_after_filter": train & keep, "validation": validation}
    sinks = {"all": F.lit(True)} if split else {"train": train & keep, "validation": validation}
    cities = {"": (tokenised(spark, raw_path, target_path, scale, "pair", seed, split), sinks)}
    if test:
        cities["test."] = (tokenised(spark, *test, scale, "test", seed, "test"), {"test": F.lit(True)})
    seen = {}
    for prefix, (part, own) in cities.items():
        # one job per city: it writes all sinks and takes all counters
        lines_of, look = _route(part, prefix, own, stages)
        files.write_sinks(lines_of, work.at(""), [*own, f"{prefix}failures", f"{prefix}unmatched"])
        seen[prefix] = {k: o.get for k, o in look.items()}
        part.release()
    names = [n for _, own in cities.values() for n in own]
    exported = export_unmatched(spark, raw_path, files.read_jsonl(spark, work.at("unmatched.jsonl"), "raw_fid long, osm_id string"), work.at("unmatched.source.jsonl"), scale)

    atomic = files.read_jsonl(spark, work.at("all.jsonl" if split else "train.jsonl"), files.SAMPLE_DDL)
    chosen = rel.hash_sample(atomic, "osm_id", config["bpe_rows"], "bpe", ["raw_fid"])
    ordered = chosen.withColumn("place", F.concat("hash16", F.lpad(F.col("raw_fid").cast("string"), 20, "0")))
    vocab = bpe.train_from(ordered, ["source_tokens", "target_tokens"], "place", config["vocab_size"])
    vocab.save(work.at("vocab.txt"))
    hard = rel.hash_sample(atomic.where("difficulty = 'complex'"), "osm_id", c.DIAGNOSTIC_ROWS, "diagnostic", ["raw_fid"]).drop("hash16")
    files.write_jsonl(hard, work.at("diagnostic.jsonl"))

    audits, gates = {}, []
    for name in (*names, "diagnostic"):
        before = lines.line_file(spark, work.at(f"{name}.jsonl")).parsed(files.SAMPLE_DDL)
        broken = bpe.encode_or_keep(before, vocab, ["source_tokens", "target_tokens"], work.at(f"{name}.bpe.jsonl"), work.at(f"{name}.bpe.failures.jsonl"), place="line")
        gates.append((f"{name} rows that cannot be encoded", 0, broken))
        if broken:
            continue
        after = lines.line_file(spark, work.at(f"{name}.bpe.jsonl")).parsed(files.SAMPLE_DDL)
        zipped = rel.zip_by_place(before, after, "line", "sample_id")
        audits[name] = found = rel.lossless_audit(zipped, vocab.decode_map(), ["source_tokens", "target_tokens"]).collect()[0].asDict()
        coded, rows = after.count(), before.count()
        gates += [(f"{name} rows", rows, coded), (f"{name} audit rows", coded, found["n_rows"])]
        gates += [(f"{name} {k}", 0, found[k]) for k in ("roundtrip_failures", "invalid_token_count", "row_alignment_failures")]

    rows = seen[""]["rows"]
    split_stats = {n: found for n in stages if (found := {g: rows[f"stage|{n}|{g}"] for g in _groups() if rows[f"stage|{n}|{g}"]})}
    stats = _group_report(rows)
    counters = {"unmatched": seen[""]["lost"]["n"], "unmatched_exported": exported}
    for prefix, found in seen.items():
        failed = {"pairing": sum(found["audit"][o] for o in OUTCOMES[1:]), "preprocessing": found["rows"]["failed"]}
        counters |= {f"{prefix}paired": found["rows"]["n|overall"]} | {f"{prefix}{k}_failures": n for k, n in failed.items()}
        gates += [(f"{prefix}{k} failures", 0, n) for k, n in failed.items()]
    before, after = (split_stats.get(k, {}) for k in ("train_before_filter", "train_after_filter"))
    counters |= {f"{n}_written": a["n_rows"] for n, a in audits.items()}
    counters |= {k: stats.get(k, {}).get("n", 0) for k in ("simple_rectangle", "complex")}
    counters["rectangles_dropped"] = before.get("simple_rectangle", 0) - after.get("simple_rectangle", 0)
    rectangles = before.get("simple_rectangle", 0)
    if not split:
        written = {n: files.read_jsonl(spark, work.at(f"{n}.jsonl"), "osm_id string, split string") for n in names}
        gates.append(("ids in training and validation", 0, rel.leakage(written["train"], written["validation"], "osm_id").count()))
        gates += [(f"rows of another split in {n}", 0, df.where(F.col("split") != n).count()) for n, df in written.items()]
        if rectangles >= 100:
            gates.append(("rectangles kept beyond 0.02 of their share", 0, int(abs(after.get("simple_rectangle", 0) / rectangles - fraction) > 0.02)))
    gates.append(("diagnostic rows of all complex ones", min(c.DIAGNOSTIC_ROWS, atomic.where("difficulty = 'complex'").count()), hard.count()))
    if config["expected_unmatched"] is not None:
        gates.append(("unmatched sources", config["expected_unmatched"], counters["unmatched"]))
    outcomes = {o: n for o, n in seen[""]["audit"].items() if n}
    return {"outcomes": outcomes, "counters": counters, "split_stats": split_stats, "groups": stats, "audits": audits, "vocabulary": len(vocab.atoms)}, gates


def utm_prj(epsg: int) -> str:
    """The WKT of a northern UTM zone in metres."""
    zone = c.EPSG[epsg]
    degrees = 'GEOGCS["GCS_WGS_1984",DATUM["D_WGS_1984",SPHEROID["WGS_1984",6378137.0,298.257223563]],PRIMEM["Greenwich",0.0],UNIT["Degree",0.0174532925199433]]'
    numbers = {"False_Easting": 500000.0, "False_Northing": 0.0, "Central_Meridian": 6.0 * zone - 183.0, "Scale_Factor": 0.9996, "Latitude_Of_Origin": 0.0}
    return f'PROJCS["WGS_1984_UTM_Zone_{zone}N",{degrees},PROJECTION["Transverse_Mercator"],' + "".join(f'PARAMETER["{k}",{v}],' for k, v in numbers.items()) + 'UNIT["Meter",1.0]]'


def prepare_all(spark: SparkSession, cities: dict, root: str, force: bool = False, min_free_gb: float = 20.0, expected_unmatched: dict | None = None, **options) -> dict:
    """Both cities at all scales: layers to UTM (kept while inputs and outputs are as recorded), then ``prepare``.

    ``cities``: {"main": {"raw": path, "targets": {scale: path}, "epsg": code}, "test": {...}}.
    """
    os.makedirs(root, exist_ok=True)
    need_disk(root, min_free_gb)
    layers = {}
    for city, spec in cities.items():
        for name, source in {"raw": spec["raw"], **{f"target_{k}": v for k, v in spec["targets"].items()}}.items():
            layers[city, name] = (source, os.path.join(root, "projected", city, f"{name}.shp"), int(spec["epsg"]))
    if missing := sorted(source for source, _, _ in layers.values() if not os.path.exists(source)):
        raise FileNotFoundError(f"missing layers: {', '.join(missing)}")
    projection = {}
    for (city, name), (source, output, epsg) in layers.items():
        record = os.path.join(root, "projected", "audits", f"{city}_{name}.json")
        if force or not files.manifest_is_current(spark, record, {"epsg": epsg}, shapefile.family(source)):
            os.makedirs(os.path.dirname(output), exist_ok=True)
            project(spark, source, output, epsg, utm_prj(epsg))
            files.write_manifest(spark, record, {"epsg": epsg}, shapefile.family(source), shapefile.family(output))
        projection[f"{city}_{name}"] = output
    at = lambda city, name: layers[city, name][1]
    reports = {}
    for scale in cities["main"]["targets"]:
        pair = (at("test", "raw"), at("test", f"target_{scale}")) if "test" in cities else None
        wanted = (expected_unmatched or {}).get(scale)
        reports[str(scale)] = prepare(spark, at("main", "raw"), at("main", f"target_{scale}"), root, int(scale), force=force, expected_unmatched=wanted, test=pair, **options)
    body = {"projection": projection, "scales": reports}
    files.write_report(os.path.join(root, "manifest.json"), body)
    return body


def predict(spark: SparkSession, dataset: str, weights: str, output: str, shape: seq2seq.Shape, max_len: int = 1024, limit: int | None = None) -> int:
    """Greedy predictions of a whole dataset, in its order and without a filter on length."""
    rows = lines.line_file(spark, dataset).parsed(files.SAMPLE_DDL)
    rows = rows.orderBy("line").limit(limit) if limit else rows
    found = inference.greedy_predictions(rows, seq2seq.load(weights), shape, max_len)
    named = found.withColumns({"target_tokens": tokens.strip_pad(F.coalesce("target_tokens", F.array().cast("array<int>"))), "difficulty": F.coalesce("difficulty", F.lit("unknown")), "source_vertex_count": F.coalesce("source_vertex_count", F.lit(0))})
    files.write_jsonl(lines.in_order(named.select("line", "raw_fid", "osm_id", "scale", "source_frame", "difficulty", "source_vertex_count", "pred_tokens", "target_tokens")), output)
    written = files.read_jsonl(spark, output, "raw_fid long").count()
    if not written:
        raise ValueError(f"{dataset} has no rows")
    return written


def auto_evaluate(spark: SparkSession, run_dir: str, datasets: dict[str, str], vocab_path: str, shape: seq2seq.Shape, prj: str, max_len: int = 512) -> dict:
    """Predictions, rates and layers of the best checkpoint that the metrics log of a run names.

    The best row is the test row with the highest exact rate, else such a training row. Weights are
    ``checkpoint_epoch_<n>.npz`` beside the log; without log or weights nothing is done.
    """
    log = os.path.join(run_dir, "metrics.jsonl")
    if not os.path.exists(log):
        return {}
    best = rel.best_checkpoint(files.read_jsonl(spark, log, "split string, epoch int, greedy_exact_match_rate double")).collect()
    weights = os.path.join(run_dir, f"checkpoint_epoch_{best[0]['epoch']}.npz") if best else ""
    if not os.path.exists(weights):
        return {}
    body = {"epoch": best[0]["epoch"], "split": best[0]["split"], "datasets": {}}
    for label, dataset in datasets.items():
        preds = os.path.join(run_dir, "auto_eval", f"preds_{label}.jsonl")
        predict(spark, dataset, weights, preds, shape, max_len)
        rates = rel.greedy_rates(files.read_predictions(spark, preds), "pred_tokens", "target_tokens").collect()[0].asDict()
        layer = os.path.join(run_dir, "auto_eval", f"pred_{label}.shp")
        body["datasets"][label] = rates | {"polygons": decode_predictions(spark, preds, vocab_path, layer, prj)}
    files.write_report(os.path.join(run_dir, "auto_eval", "report.json"), body)
    return body


def test_dataset_path(path: str) -> str:
    """The test dataset that belongs to a training dataset."""
    parts = path.replace("\\", "/").split("/")
    if "train" not in parts[1:-1]:
        raise ValueError(f"{path} does not lie in a folder train")
    at = parts.index("train", 1)
    return "/".join([*parts[:at], "test", *parts[at + 1 :]])


def vocabulary_path(root: str, dataset: str | None = None, scale: int | None = None) -> str:
    """The vocabulary of a scale, which a dataset's path can name."""
    if scale is None:
        named = [s for s in (5000, 10000) if f"scale{s}" in (dataset or "").replace(f"scale{s}0", "")]
        if not named:
            raise ValueError(f"{dataset} names no scale")
        scale = named[0]
    return Layout(root, 10000 if scale == 10000 else 5000).at("vocab.txt")


def evaluate(spark: SparkSession, predictions: str, vocab_path: str, output: str) -> dict:
    """The grouped report: token metrics on vocabulary ids, geometry on decoded polygons."""
    vocab = bpe.Vocabulary.load(vocab_path)
    preds = files.read_predictions(spark, predictions).withColumn("key", F.monotonically_increasing_id()).persist()
    scored = geometry.score_predictions(preds, vocab, "key")
    named = tokens.token_metrics(F.col("pred_tokens"), F.col("target_tokens"))
    rows = preds.join(scored, "key").withColumns(named)
    groups = rel.overlapping_groups(F.col("difficulty"), geometry.bucket("source_vertex_count"))
    metrics = [*named, *pg.METRICS]
    report = rel.evaluation_report(rows.withColumn("g", groups), F.col("g"), metrics, "pred_ok", "target_ok", "outline_iou")
    found = {r["grp"]: {k: v for k, v in r.asDict().items() if k != "grp" and v is not None} for r in report.collect()}
    body = {"prediction_path": predictions, "vocab_path": vocab_path, "groups": dict(sorted(found.items()))}
    files.write_report(output, body)
    preds.unpersist()
    return body


def evaluate_unmatched(spark: SparkSession, raw_path: str, pred_path: str, ids: str, output: str, failures: str | None = None) -> dict:
    """Predictions without reference, against their sources; a missing prediction counts as invalid."""
    import pandas as pd

    names = ["valid_geometry", "vertex_compression_ratio", "area_ratio", "perimeter_ratio", "minimum_rectangle_iou", "minimum_rectangle_angle_error_deg"]
    raw = shapefile.read(spark, raw_path, ["fid", "geom"]).toDF("raw_fid", "raw")
    pred = shapefile.read(spark, pred_path, ["fid", "raw_fid", "geom"]).select("raw_fid", F.col("fid").alias("ord"), F.col("geom").alias("pred"))
    found = rel.three_way(files.fid_filter(spark, ids), pred, raw, "raw_fid")

    def run(batches):
        for b in batches:
            out = []
            for r in b.to_dict("records"):
                source, guess = pg.clean(geometry.parts_of(r["raw"])), pg.clean(geometry.parts_of(r["pred"]))
                m = pg.unmatched_metrics(source, guess) if source else {"valid_geometry": 0.0}
                out.append({"missing": r["missing"]} | dict.fromkeys(names) | (m if not r["missing"] else {}))
            yield pd.DataFrame(out, columns=["missing", *names])

    rows = found.select("missing", "raw", F.col("p.pred").alias("pred")).mapInPandas(run, "missing boolean, " + ", ".join(f"{n} double" for n in names))
    means = [F.avg(F.when(F.abs(F.col(n)) < float("inf"), F.col(n))).alias(n) for n in names[1:]]
    total = rows.agg(F.count("*").alias("requested"), F.count_if("missing").alias("missing_predictions"), F.sum(F.coalesce("valid_geometry", F.lit(0.0))).alias("valid"), *means).collect()[0]
    kinds = {}
    if failures and os.path.exists(failures):
        messages = files.read_jsonl(spark, failures, "error string")
        kinds = {r["k"]: r["count"] for r in messages.groupBy(rings.failure_category(F.coalesce("error", F.lit(""))).alias("k")).count().collect()}
    body = {
        "requested": total["requested"],
        "matched_predictions": total["requested"] - total["missing_predictions"],
        "missing_predictions": total["missing_predictions"],
        "failure_categories": kinds,
        "metrics": {n: total[n] for n in names[1:] if total[n] is not None} | {"valid_geometry": (total["valid"] or 0.0) / max(total["requested"], 1)},
    }
    files.write_report(output, body)
    return body


def infer(spark: SparkSession, raw_path: str, weights: str, vocab_path: str, output: str, scale: int, shape: seq2seq.Shape, ids: str | None = None, limit: int | None = None, max_len: int = 1024, beams: int = 5) -> dict:
    """Polygons for the chosen sources of a layer, written as a layer; failures beside it."""
    layer = geometry.records(shapefile.read(spark, raw_path))
    wanted = files.fid_filter(spark, ids)
    if wanted is not None:
        layer = layer.join(F.broadcast(wanted.withColumnRenamed("raw_fid", "fid")) if wanted.count() < 1_000_000 else wanted.withColumnRenamed("raw_fid", "fid"), "fid", "left_semi")
    layer = layer.orderBy("fid").limit(limit) if limit else layer
    cands = inference.candidates(layer, seq2seq.load(weights), shape, bpe.Vocabulary.load(vocab_path), scale, max_len, beams).persist()
    best = inference.best_candidates(cands, scale)
    removed = F.when(F.col("raw_vertices") > 0, (F.col("raw_vertices") - F.col("vertices")) / F.col("raw_vertices")).otherwise(0.0)
    best = best.select("raw_fid", F.lit(scale).alias("scale"), removed.alias("vtx_cmp"), F.col("area_ratio").alias("area_rat"), "beam_rank", "geom")
    fields = [("raw_fid", "N", 12, 0), ("scale", "N", 8, 0), ("vtx_cmp", "F", 12, 6), ("area_rat", "F", 12, 6), ("beam_rank", "N", 8, 0)]
    written = shapefile_sink.write(best, output, fields, shapefile.check_crs(raw_path), "raw_fid")
    failed = inference.failures(cands).withColumn("scale", F.lit(scale))
    files.write_jsonl(failed, os.path.splitext(output)[0] + ".failures.jsonl")
    out = {"written": written, "failed": failed.count(), "output": output}
    cands.unpersist()
    return out


def decode_predictions(spark: SparkSession, predictions: str, vocab_path: str, output: str, prj: str) -> int:
    """A prediction file as a layer; rows that spell no polygon are left out."""
    import pandas as pd

    vocab = spark.sparkContext.broadcast(bpe.Vocabulary.load(vocab_path))

    def run(batches):
        for b in batches:
            out = []
            for r in b.to_dict("records"):
                p = geometry._decoded(r["pred_tokens"], geometry.codec.Frame.of(r["source_frame"]), vocab.value)
                if p:
                    out.append({"raw_fid": r["raw_fid"], "osm_id": r["osm_id"], "scale": r["scale"], "geom": [[[{"x": x, "y": y} for x, y in ring.tolist()] for ring in p]]})
            yield pd.DataFrame(out, columns=["raw_fid", "osm_id", "scale", "geom"])

    rows = files.read_predictions(spark, predictions).mapInPandas(run, f"raw_fid long, osm_id string, scale int, geom {geometry.PARTS_DDL}")
    return shapefile_sink.write(rows, output, [("raw_fid", "N", 12, 0), ("osm_id", "C", 40, 0), ("scale", "N", 8, 0)], prj, "raw_fid")


def project(spark: SparkSession, path: str, output: str, epsg: int, prj: str) -> int:
    """A layer in degrees as a layer in UTM metres, attributes kept."""
    zone = c.EPSG[epsg]
    df = shapefile.read(spark, path)

    def turned(p):
        east, north = rings.utm(p["x"], p["y"], zone)
        return F.struct(east.alias("x"), north.alias("y"))

    geom = F.transform("geom", lambda part: F.transform(part, lambda ring: F.transform(ring, turned)))
    fields = shapefile._dbf_header(os.path.splitext(path)[0] + ".dbf")[3]
    return shapefile_sink.write(df.withColumn("geom", geom), output, fields, prj, "fid")


def parse_args(argv=None) -> argparse.Namespace:
    """Options of a command; ``--config`` gives defaults from a JSON file, unknown keys are an error."""
    p = argparse.ArgumentParser(prog="cantle")
    sub = p.add_subparsers(dest="command", required=True)
    common = {
        "prepare": [("raw", str), ("target", str), ("root", str), ("scale", int), ("split", str), ("bpe-rows", int), ("vocab-size", int), ("seed", int), ("min-free-gb", float)],
        "evaluate": [("predictions", str), ("vocab", str), ("output", str)],
        "infer": [("raw", str), ("weights", str), ("vocab", str), ("output", str), ("scale", int), ("ids", str), ("limit", int), ("max-len", int), ("beams", int)],
        "decode": [("predictions", str), ("vocab", str), ("output", str), ("prj", str)],
        "prepare-all": [("cities", str), ("root", str), ("bpe-rows", int), ("vocab-size", int), ("seed", int), ("min-free-gb", float)],
        "train": [("dataset", str), ("run-dir", str), ("test", str), ("resume", str)] + [(f.name.replace("_", "-"), type(f.default) if f.default is not None else int) for f in dataclasses.fields(training.Plan)],
        "predict": [("dataset", str), ("weights", str), ("output", str), ("max-len", int), ("limit", int)],
        "project": [("input", str), ("output", str), ("epsg", int), ("prj", str)],
    }
    model = [(f"shape-{f.name.replace('_', '-')}", int) for f in dataclasses.fields(seq2seq.Shape) if isinstance(f.default, int) and not isinstance(f.default, bool)]
    for name in ("infer", "train", "predict"):
        common[name] += model
    for name, options in common.items():
        s = sub.add_parser(name)
        s.add_argument("--config")
        for o, kind in options:
            s.add_argument(f"--{o}", type=kind)
        if name.startswith("prepare"):
            s.add_argument("--force", action="store_true")
    args = p.parse_args(argv)
    if args.config:
        with open(args.config, encoding="utf-8") as f:
            body = json.load(f)
        # an experiment may wait for the marker files of others
        if waiting := [m for m in body.get("requires", []) if not os.path.exists(m)]:
            raise FileNotFoundError(f"{args.config} waits for {', '.join(waiting)}")
        config = {k.replace("-", "_"): v for k, v in body.items() if k not in ("command", "name", "requires")}
        if unknown := set(config) - set(vars(args)):
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
        for k, v in config.items():
            if getattr(args, k) is None or getattr(args, k) is False:  # a 0 was given
                setattr(args, k, v)
    return args


def main(argv=None) -> int:
    args = parse_args(argv)
    given = {k: v for k, v in vars(args).items() if v is not None and k not in ("command", "config")}
    shape = seq2seq.Shape(**{k.removeprefix("shape_"): given.pop(k) for k in list(given) if k.startswith("shape_")})
    spark = SparkSession.builder.appName(f"cantle-{args.command}").getOrCreate()
    if args.command == "prepare":
        need_disk(os.path.dirname(os.path.abspath(given["root"])), given.pop("min_free_gb", 20.0))
        body = prepare(spark, given.pop("raw"), given.pop("target"), given.pop("root"), given.pop("scale"), **given)
    elif args.command == "prepare-all":
        with open(given.pop("cities"), encoding="utf-8") as f:
            cities = json.load(f)
        expected = cities.pop("expected_unmatched", None)
        body = prepare_all(spark, cities, given.pop("root"), expected_unmatched=expected, **given)
    elif args.command == "train":
        fixed = {k: given.pop(k, None) for k in ("dataset", "run_dir", "test", "resume")}
        body = {"checkpoint": training.train(spark, fixed["dataset"], fixed["run_dir"], shape, training.Plan(**given), fixed["test"], fixed["resume"])}
    elif args.command == "predict":
        body = {"written": predict(spark, args.dataset, args.weights, args.output, shape, args.max_len or 1024, args.limit)}
    elif args.command == "evaluate":
        body = evaluate(spark, args.predictions, args.vocab, args.output)
    elif args.command == "infer":
        body = infer(spark, args.raw, args.weights, args.vocab, args.output, args.scale, shape, args.ids, args.limit, args.max_len or 1024, args.beams or 5)
    else:
        with open(args.prj, encoding="utf-8") as f:
            prj = f.read()
        body = {"written": decode_predictions(spark, args.predictions, args.vocab, args.output, prj) if args.command == "decode" else project(spark, args.input, args.output, args.epsg, prj)}
    print(json.dumps(body, default=str))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
