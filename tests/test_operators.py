import json
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cantle import constants as c
from cantle import pipeline
from cantle.functions import codec, hashing, polygon as pg, rings, seq2seq, tokens
from cantle.operators import bpe, geometry
from cantle.operators import relational as rel
from cantle.plans import adapters as ad
from cantle.plans import registry
from cantle.sources import files, shapefile
from tests.plain_layer import write_rows

PRJ = 'PROJCS["WGS_1984_UTM_Zone_11N",GEOGCS["GCS",DATUM["D",SPHEROID["S",6378137.0,298.257223563]],PRIMEM["Greenwich",0.0],UNIT["Degree",0.0174532925199433]],PROJECTION["Transverse_Mercator"],UNIT["Meter",1.0]]'


def test_hash_fractions(spark):
    df = spark.range(1000)
    got = {r["id"]: r["f"] for r in df.select("id", hashing.stable_fraction(F.col("id"), "split").alias("f")).where("id in (0, 123)").collect()}
    assert got == {0: 0.12470184984860667, 123: 0.7212610897205936}
    kept = df.where(hashing.keeps_sample(F.col("id"), F.lit("simple_rectangle"))).count()
    assert kept == 92 and df.where(hashing.split_of(F.col("id")) == "train").count() == 809
    with pytest.raises(ValueError):
        hashing.split_of(F.col("id"), train_fraction=1.0)


def test_token_columns(spark):
    df = spark.createDataFrame([([1, 3, 722], [1, 2, 722])], "a array<int>, b array<int>")
    m = df.select(*[v.alias(k) for k, v in tokens.token_metrics(F.col("a"), F.col("b")).items()]).collect()[0]
    assert m["greedy_exact"] == 0 and m["token_edit_similarity"] == pytest.approx(2 / 3) and m["eos_position_error"] == 0
    strip = spark.createDataFrame([([1, 720, 2, 722, 720, 720],)], "a array<int>").select(tokens.strip_pad(F.col("a")).alias("s")).collect()[0]["s"]
    assert strip == [1, 720, 2, 722]
    buckets = spark.createDataFrame([(4,), (8,), (16,), (17,)], "n int").select(rings.vertex_bucket(F.col("n")).alias("b")).collect()
    assert [r["b"] for r in buckets] == ["4", "5-8", "9-16", "17+"]


def test_bpe_encode_native_equals_kernel(spark):
    v = bpe.Vocabulary({1500: (1, 1), 1501: (1, 1, 2), 1502: (2, 3)})
    rows = [([725, 723, 1, 1, 722],), ([1, 1, 2, 3, 1, 721, 1],), ([],)]
    df = spark.createDataFrame(rows, "t array<int>")
    by_atoms = F.create_map(*[x for i, a in v.atoms.items() for x in (F.lit(",".join(map(str, a))), F.lit(i))])
    got = [r["e"] for r in df.select(tokens.bpe_encode(F.col("t"), by_atoms, 3).alias("e")).collect()]
    assert got == [v.encode(t) for (t,) in rows] == [[725, 723, 1500, 722], [1501, 3, 1, 721, 1], []]
    bad = spark.createDataFrame([([800, 1500, 1999, 5],)], "t array<int>").select(tokens.invalid_tokens(F.col("t"), v.decode_map()).alias("n")).collect()[0]["n"]
    assert bad == 2


def test_pairing_outcomes(spark):
    raws = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "fid long, osm string")
    targets = spark.createDataFrame([(0, "0", "a"), (1, "0", "a"), (2, "x", "a"), (3, "9", "a"), (4, "1", "other"), (5, "2.7", None), (6, None, "a")], "tid long, key string, name string")
    audit = rel.pair_by_key(targets, raws, "tid", "key", "fid", F.lit(3), "name", "osm")
    got = {r["tid"]: r["outcome"] for r in audit.collect()}
    assert got == {0: "paired", 1: "duplicate", 2: "invalid", 3: "out_of_range", 4: "mismatch", 5: "paired", 6: "invalid"}
    assert rel.unmatched(raws, audit, "fid").count() == 0


def test_all_or_nothing(spark, tmp_path):
    v, out, bad = bpe.Vocabulary({1500: (1, 1)}), str(tmp_path / "o"), str(tmp_path / "f")
    df = spark.createDataFrame([([1, 1],), ([2],)], "t array<int>")
    assert bpe.encode_or_keep(df, v, ["t"], out, bad) == 0
    before = sorted(r["t"] for r in spark.read.json(out).collect())
    assert bpe.encode_or_keep(spark.createDataFrame([([1],), (None,)], "t array<int>"), v, ["t"], out, bad) == 1
    assert sorted(r["t"] for r in spark.read.json(out).collect()) == before == [[2], [1500]]


def test_gates(spark):
    one, two = spark.range(3).agg(F.count("*")), spark.range(4).agg(F.count("*"))
    rel.require(rel.gate_checks([("same", one, one)]))
    with pytest.raises(ValueError, match="rows: expected 3, got 4"):
        rel.require(rel.gate_checks([("rows", one, two)]))


def test_manifest(spark, tmp_path):
    src, out = tmp_path / "a.dbf", tmp_path / "o.jsonl"
    src.write_bytes(b"x")
    out.write_text("{}\n")
    m = str(tmp_path / "m.json")
    body = files.write_manifest(spark, m, {"seed": 1}, [str(src)], [str(out)])
    assert body["outputs"][str(out)]["lines"] == 1
    assert files.manifest_is_current(spark, m, {"seed": 1}, [str(src)])
    assert not files.manifest_is_current(spark, m, {"seed": 2}, [str(src)])
    src.write_bytes(b"y")
    assert not files.manifest_is_current(spark, m, {"seed": 1}, [str(src)])
    with pytest.raises(ValueError):
        files.write_report(str(tmp_path / "r.json"), {"x": float("nan")}, allow_nan=False)


def _layer(path, rows, fields, prj=PRJ):
    write_rows(str(path), [(*v, [[pg.ring_of(r) for r in p] for p in parts]) for *v, parts in rows], fields, prj)


def test_shapefile_round_trip(spark, tmp_path):
    hole = [[(0, 0), (9, 0), (9, 9), (0, 9)], [(2, 2), (2, 4), (4, 4), (4, 2)]]
    _layer(tmp_path / "l.shp", [("é", 7, 1.5, [hole]), (None, None, None, []), ("b", 2, 0.25, [[[(20, 20), (21, 20), (21, 21)]], hole])], [("name", "C", 20, 0), ("n", "N", 12, 0), ("v", "F", 12, 6)])
    rows = shapefile.read(spark, str(tmp_path / "l.shp")).orderBy("fid").collect()
    assert [(r["fid"], r["name"], r["n"], r["v"]) for r in rows] == [(0, "é", 7, 1.5), (1, None, None, None), (2, "b", 2, 0.25)]
    assert [len(p) for p in rows[2]["geom"]] == [1, 2] and len(rows[0]["geom"][0][1]) == 4 and not rows[1]["geom"]
    assert shapefile.read(spark, str(tmp_path / "l.shp"), ["fid", "n"]).columns == ["fid", "n"]
    with pytest.raises(ValueError):
        (tmp_path / "l.prj").write_text('GEOGCS["x",UNIT["Degree",0.017]]')
        shapefile.check_crs(str(tmp_path / "l.shp"))
    (tmp_path / "l.shx").unlink()
    with pytest.raises(FileNotFoundError):
        shapefile.read(spark, str(tmp_path / "l.shp"))


def _square(x, y, w, h):
    return [[(x, y), (x + w, y), (x + w, y + h), (x, y + h)]]


def test_prepare_evaluate_infer(spark, tmp_path):
    raw = [(str(i), [_square(500000 + 30 * i, 3760000, 10 + i % 3, 4)]) for i in range(12)] + [("u", [[[(500900, 3760000), (500910, 3760000), (500910, 3760004), (500905, 3760006), (500900, 3760004)]]])]
    target = [(str(i), i, [_square(500000 + 30 * i, 3760000, 10, 4)]) for i in range(12)]
    _layer(tmp_path / "raw.shp", raw, [("osm_id", "C", 20, 0)])
    _layer(tmp_path / "target.shp", target, [("osm_id", "C", 20, 0), ("InBld_FID", "N", 12, 0)])
    body = pipeline.prepare(spark, str(tmp_path / "raw.shp"), str(tmp_path / "target.shp"), str(tmp_path / "out"), 5000, split="test", vocab_size=1520)
    assert body["outcomes"] == {"paired": 12} and body["audits"]["all"] == {"n_rows": 12, "roundtrip_failures": 0, "invalid_token_count": 0, "row_alignment_failures": 0}
    assert body["groups"]["overall"]["mean_outline_iou"] > 0.98
    again = pipeline.prepare(spark, str(tmp_path / "raw.shp"), str(tmp_path / "target.shp"), str(tmp_path / "out"), 5000, split="test", vocab_size=1520)
    assert again == json.loads(json.dumps(body, default=str))
    out = pipeline.Layout(str(tmp_path / "out"), 5000)
    assert [r["raw_fid"] for r in files.fid_filter(spark, out.at("unmatched.jsonl")).collect()] == [12]

    coded = files.read_jsonl(spark, out.at("all.bpe.jsonl"), files.SAMPLE_DDL)
    wrong = F.when(F.col("raw_fid") == 0, F.array(F.lit(723), F.lit(722))).otherwise(F.col("target_tokens"))
    files.write_jsonl(coded.withColumn("pred_tokens", wrong).select("raw_fid", "osm_id", "scale", "source_frame", "difficulty", "source_vertex_count", "pred_tokens", "target_tokens"), str(tmp_path / "p.jsonl"))
    report = pipeline.evaluate(spark, str(tmp_path / "p.jsonl"), out.at("vocab.txt"), str(tmp_path / "r.json"))["groups"]
    assert report["overall"]["sample_count"] == 12 and report["overall"]["invalid_geometry_count"] == 1
    assert report["overall"]["outline_iou"] == pytest.approx(1) and report["overall"]["all_sample_outline_iou"] == pytest.approx(11 / 12)
    assert pipeline.decode_predictions(spark, str(tmp_path / "p.jsonl"), out.at("vocab.txt"), str(tmp_path / "p.shp"), PRJ) == 11
    files.write_jsonl(spark.createDataFrame([(0,), (1,)], "raw_fid long"), str(tmp_path / "ids.jsonl"))
    un = pipeline.evaluate_unmatched(spark, str(tmp_path / "raw.shp"), str(tmp_path / "p.shp"), str(tmp_path / "ids.jsonl"), str(tmp_path / "u.json"))
    assert un["missing_predictions"] == 1 and un["metrics"]["valid_geometry"] == 0.5

    shape = seq2seq.Shape(vocab=1600, width=16, heads=2, layers=1, inner=16)
    seq2seq.save(str(tmp_path / "w.npz"), seq2seq.random_weights(shape))
    done = pipeline.infer(spark, str(tmp_path / "raw.shp"), str(tmp_path / "w.npz"), out.at("vocab.txt"), str(tmp_path / "i.shp"), 5000, shape, max_len=8, beams=2, limit=3)
    assert done["written"] + done["failed"] == 3


def test_projection(spark, tmp_path):
    _layer(tmp_path / "g.shp", [(5, [_square(-118.25, 34.05, 0.0001, 0.0001)])], [("n", "N", 8, 0)])
    assert pipeline.project(spark, str(tmp_path / "g.shp"), str(tmp_path / "m.shp"), 32611, PRJ) == 1
    row = shapefile.read(spark, str(tmp_path / "m.shp")).collect()[0]
    p = row["geom"][0][0][0]
    assert row["n"] == 5 and abs(p["x"] - 384629.4) < 20 and abs(p["y"] - 3768404.6) < 20


def test_model_decoding():
    shape = seq2seq.Shape(vocab=760, width=16, heads=2, layers=2, inner=32)
    model = seq2seq.Model(seq2seq.random_weights(shape, 3), shape)
    rows = [[725, 723, 5, 6, 722], [725, 723, 9, 722]]
    both = model.greedy(seq2seq.padded(rows), 12)
    for r, row in zip(rows, both):
        alone = model.greedy(np.array([r]), 12)[0]
        cut = row[: len(alone)]
        assert (cut == alone).all() and (row[len(alone) :] == c.PAD).all()
    best = model.beam(rows[0], 8, beams=3)
    assert len(best) == 3 and best[0][1] >= best[1][1]
    assert not {c.PAD, c.BOS, c.SCALE_5000, c.SCALE_10000} & set(best[0][0][1:])
    wide = model.beam(rows[0], 6, beams=1, penalty=0)
    assert wide[0][1] <= 0


def test_model_steps_equal_the_whole_pass():
    shape = seq2seq.Shape(vocab=760, width=16, heads=2, layers=2, inner=32)
    model = seq2seq.Model(seq2seq.random_weights(shape, 3), shape)
    memory, pad = model.encode(seq2seq.padded([[725, 723, 5, 6, 722], [725, 723, 9, 722]]))
    rows = np.random.default_rng(1).integers(0, 700, (2, 40))
    kept = model.start(memory, pad, 2, 40)
    for n in range(1, 41):
        if n == 21:  # go on with the second row and a copy of it
            kept.take([1, 1])
            rows, memory, pad = rows[[1, 1]], memory[[1, 1]], pad[[1, 1]]
            kept.across, kept.pad = [tuple(a[[1, 1]] for a in pair) for pair in kept.across], kept.pad[[1, 1]]
        assert np.allclose(model.step(kept, rows[:, n - 1]), model.logits(memory, pad, rows[:, :n])[:, -1])


def test_beam_query_covers_the_whole_table(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").where("vec_id < 5").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {(r["raw_fid"], r["beam_rank"]): r for r in registry.QUERIES["seq2seq_beam"](spark, str(tmp_path)).collect()}
    sources = ad.stars(spark, str(tmp_path)).collect()
    assert len(sources) > 2 and set(got) == {(r["id"], k) for r in sources for k in range(5)}
    model = seq2seq.Model(*registry._small_model())
    for r in sources:
        tokens_, _ = codec.source_tokens([pg.clean([[np.array([[p["x"], p["y"]] for p in r["ring"]])]])], 5000)
        for rank, (_, score) in enumerate(model.beam(tokens_, 1024, 5)):
            assert got[r["id"], rank]["model_score"] == pytest.approx(score, abs=1e-5)


def test_greedy_query_returns_whole_predictions(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").where("l_orderkey < 12").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r["id"]: r for r in registry.QUERIES["seq2seq_greedy"](spark, str(tmp_path)).collect()}
    model = seq2seq.Model(*registry._small_model())
    sources = {r["id"]: r["tokens"] for r in ad.order_sequences(spark, str(tmp_path)).collect()}
    assert set(got) == set(sources) and sources
    for i, source in sources.items():
        memory, pad = model.encode(np.array([source]))
        row = [c.BOS]
        while len(row) < 128 and row[-1] != c.EOS:
            row.append(int(model.logits(memory, pad, np.array([row]))[0, -1].argmax()))
        assert got[i]["pred_tokens"] == ",".join(map(str, row[1:])) and got[i]["n_pred"] == len(row) - 1


def test_command_line(tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"name": "x", "vocab": "v", "output": "o"}))
    args = pipeline.parse_args(["evaluate", "--predictions", "p", "--output", "mine", "--config", str(tmp_path / "c.json")])
    assert (args.vocab, args.output) == ("v", "mine")
    (tmp_path / "c.json").write_text(json.dumps({"nonsense": 1}))
    with pytest.raises(ValueError):
        pipeline.parse_args(["evaluate", "--config", str(tmp_path / "c.json")])


def _plain_beam(model, source, max_len, beams, penalty, min_len):
    """Hypotheses as plain lists, whole decoding at each step."""
    memory, pad = model.encode(np.array([source]))
    held = [([c.BOS], 0.0)]
    rate = lambda h: h[1] / max(1, len(h[0]) - 1) ** penalty
    for n in range(1, max_len):
        if all(t[-1] == c.EOS for t, _ in held):
            break
        pool = [h for h in held if h[0][-1] == c.EOS]
        for t, s in held:
            if t[-1] != c.EOS:
                x = model.logits(memory, pad, np.array([t]))[0, -1]
                x[[c.PAD, c.BOS, c.SCALE_5000, c.SCALE_10000]] = -np.inf
                if n < min_len:
                    x[c.EOS] = -np.inf
                p = x - x.max() - np.log(np.exp(x - x.max()).sum())
                pool += [([*t, int(k)], s + p[k]) for k in np.argsort(-p, kind="stable")[:beams]]
        held = sorted(pool, key=rate, reverse=True)[:beams]
    return [(t, rate((t, s))) for t, s in held]


def test_beam_equals_a_plain_search():
    shape = seq2seq.Shape(vocab=760, width=16, heads=2, layers=2, inner=32)
    for seed, lift in enumerate([0.0, 3.0, 6.0]):
        weights = seq2seq.random_weights(shape, seed)
        weights["output.bias"][c.EOS] = lift
        model = seq2seq.Model(weights, shape)
        got, want = model.beam([725, 723, 5, 6, 722], 12, 4, 0.8, 3), _plain_beam(model, [725, 723, 5, 6, 722], 12, 4, 0.8, 3)
        assert [t for t, _ in got] == [t for t, _ in want]
        assert np.allclose([s for _, s in got], [s for _, s in want])


def _two_cities(tmp_path, extra=1):
    """(raw, target) layers of two cities in degrees, squares of about ten metres."""
    wgs = 'GEOGCS["GCS_WGS_1984",DATUM["D_WGS_1984",SPHEROID["WGS_1984",6378137.0,298.257223563]],PRIMEM["Greenwich",0.0],UNIT["Degree",0.0174532925199433]]'
    cities = {}
    for city, lon, lat, epsg in (("main", -118.25, 34.05, 32611), ("test", -74.0, 40.7, 32618)):
        square = lambda i: [[[(lon + i * 4e-4 + x, lat + y) for x, y in ((0, 0), (1e-4, 0), (1e-4, 1e-4), (0, 1e-4))]]]  # noqa: B023,E731
        raw = str(tmp_path / city / "raw.shp")
        (tmp_path / city).mkdir(exist_ok=True)
        _layer(raw, [(str(i), square(i)) for i in range(8 + extra)], [("osm_id", "C", 20, 0)], wgs)
        targets = {}
        for scale in (5000, 10000):
            targets[scale] = str(tmp_path / city / f"target_{scale}.shp")
            _layer(targets[scale], [(str(i), i, square(i)) for i in range(8)], [("osm_id", "C", 20, 0), ("InBld_FID", "N", 12, 0)], wgs)
        cities[city] = {"raw": raw, "targets": targets, "epsg": epsg}
    return cities


def test_prepare_all(spark, tmp_path):
    cities, root = _two_cities(tmp_path), str(tmp_path / "out")
    body = pipeline.prepare_all(spark, cities, root, min_free_gb=0.0, expected_unmatched={5000: 1}, vocab_size=1510)
    assert set(body["scales"]) == {"5000", "10000"} and len(body["projection"]) == 6
    report = body["scales"]["5000"]
    assert report["counters"]["paired"] == 8 and report["counters"]["test.paired"] == 8
    assert report["counters"]["unmatched"] == report["counters"]["unmatched_exported"] == 1
    out = pipeline.Layout(root, 5000)
    source = spark.read.json(out.at("unmatched.source.jsonl")).collect()
    assert [(r["sample_id"], r["raw_fid"], r["osm_id"], r["source_tokens"][:2]) for r in source] == [("unmatched:8:5000", 8, "8", [725, 723])]
    assert "target_tokens" not in source[0] and source[0]["source_frame"]["longest_edge_m"] > 5
    assert files.read_jsonl(spark, out.at("test.bpe.jsonl"), files.SAMPLE_DDL).count() == 8
    split = report["split_stats"]
    assert split["train_before_filter"]["overall"] + split.get("validation", {}).get("overall", 0) == 8
    assert report["counters"]["train_written"] + report["counters"]["validation_written"] + report["counters"]["rectangles_dropped"] == 8
    before = {p: os.stat(p).st_mtime_ns for p in body["projection"].values()}
    again = pipeline.prepare_all(spark, cities, root, min_free_gb=0.0, expected_unmatched={5000: 1}, vocab_size=1510)
    assert again["scales"] == json.loads(json.dumps(body["scales"])) and before == {p: os.stat(p).st_mtime_ns for p in before}
    with pytest.raises(FileNotFoundError, match="absent"):
        pipeline.prepare_all(spark, {"main": cities["main"] | {"raw": "absent.shp"}}, root, min_free_gb=0.0)
    with pytest.raises(OSError):
        pipeline.prepare_all(spark, cities, root, min_free_gb=1e9)


def test_gates_keep_old_outputs(spark, tmp_path):
    cities, root = _two_cities(tmp_path), str(tmp_path / "out")
    main = {"main": cities["main"]}
    pipeline.prepare_all(spark, main, root, min_free_gb=0.0, vocab_size=1510)
    out = pipeline.Layout(root, 5000)
    old = files.fingerprint(spark, out.at("train.jsonl"))
    with pytest.raises(ValueError, match="unmatched sources: expected 7, got 1"):
        pipeline.prepare_all(spark, main, root, min_free_gb=0.0, expected_unmatched={5000: 7}, vocab_size=1505)
    assert files.fingerprint(spark, out.at("train.jsonl")) == old and not [n for n in os.listdir(root) if n.startswith(".work")]
    raw, target = (os.path.join(root, "projected", "main", n) for n in ("raw.shp", "target_5000.shp"))
    rows = [(*v, parts) for *v, parts in [("0", 99, [_square(500000, 3760000, 10, 4)]), ("1", 1, [_square(500000, 3760000, 10, 4)])]]
    _layer(target, rows, [("osm_id", "C", 20, 0), ("InBld_FID", "N", 12, 0)])
    with pytest.raises(ValueError, match="pairing failures: expected 0, got 1"):
        pipeline.prepare(spark, raw, target, root, 5000, vocab_size=1510)
    assert files.fingerprint(spark, out.at("train.jsonl")) == old
    assert [r["error"] for r in spark.read.json(out.at("failures.jsonl")).collect()] == ["out_of_range"]


def test_failed_export_keeps_the_old_file(spark, tmp_path, monkeypatch):
    raw = str(tmp_path / "raw.shp")
    _layer(raw, [("a", [_square(500000, 3760000, 10, 4)]), ("b", []), ("c", [_square(500040, 3760000, 9, 4)])], [("osm_id", "C", 20, 0)])
    ids = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c"), (7, "z")], "raw_fid long, osm_id string")
    output = str(tmp_path / "u.jsonl")
    assert pipeline.export_unmatched(spark, raw, ids, output, 5000) == 2
    before = files.fingerprint(spark, output)
    monkeypatch.setattr(pipeline.geometry, "encode_sources", lambda df, scale: df.withColumn("source_tokens", F.raise_error(F.lit("no"))).withColumns({"source_frame": F.lit(None), "source_vertex_count": F.lit(0)}))
    with pytest.raises(Exception, match="no"):
        pipeline.export_unmatched(spark, raw, ids, output, 5000)
    assert files.fingerprint(spark, output) == before and sorted(n for n in os.listdir(tmp_path) if n.startswith("u.jsonl")) == ["u.jsonl"]


def test_auto_evaluation(spark, tmp_path):
    raw = [(str(i), [_square(500000 + 30 * i, 3760000, 10, 4)]) for i in range(4)]
    _layer(tmp_path / "raw.shp", raw, [("osm_id", "C", 20, 0)])
    _layer(tmp_path / "target.shp", [(n, i, p) for i, (n, p) in enumerate(raw)], [("osm_id", "C", 20, 0), ("InBld_FID", "N", 12, 0)])
    pipeline.prepare(spark, str(tmp_path / "raw.shp"), str(tmp_path / "target.shp"), str(tmp_path / "out"), 5000, split="test", vocab_size=1510)
    out = pipeline.Layout(str(tmp_path / "out"), 5000)
    shape = seq2seq.Shape(vocab=1600, width=16, heads=2, layers=1, inner=16)
    run = str(tmp_path / "run")
    assert pipeline.auto_evaluate(spark, run, {"test": out.at("all.bpe.jsonl")}, out.at("vocab.txt"), shape, PRJ) == {}
    os.makedirs(run)
    with open(os.path.join(run, "metrics.jsonl"), "w") as f:
        f.writelines(json.dumps(r) + "\n" for r in [{"split": "train", "epoch": 1, "greedy_exact_match_rate": 0.9}, {"split": "test", "epoch": 2, "greedy_exact_match_rate": 0.5}, {"split": "test", "epoch": 3, "greedy_exact_match_rate": 0.5}])
    seq2seq.save(os.path.join(run, "checkpoint_epoch_2.npz"), seq2seq.random_weights(shape))
    body = pipeline.auto_evaluate(spark, run, {"test": out.at("all.bpe.jsonl")}, out.at("vocab.txt"), shape, PRJ, max_len=12)
    assert body["epoch"] == 2 and body["datasets"]["test"]["sample_count"] == 4
    preds = files.read_predictions(spark, os.path.join(run, "auto_eval", "preds_test.jsonl"))
    assert sorted(r["raw_fid"] for r in preds.collect()) == [0, 1, 2, 3]
    log = spark.createDataFrame([("train", 4, 0.3), ("train", 5, 0.4), ("test", 6, None)], "split string, epoch int, greedy_exact_match_rate double")
    assert rel.best_checkpoint(log).collect()[0]["epoch"] == 5


def test_rates_and_guards(spark, tmp_path):
    df = spark.createDataFrame([([1, 2, 720], [1, 2], 0.5), ([1, 3], [1, 2], None), ([4], [4, 720, 720], 1.5)], "p array<int>, t array<int>, loss double")
    assert rel.exact_rate(df, "p", "t").collect()[0][0] == pytest.approx(2 / 3)
    with pytest.raises(Exception, match="a row has no t"):
        rel.exact_rate(df.withColumn("t", F.lit(None).cast("array<int>")), "p", "t").collect()
    forced = spark.createDataFrame([([1, 2, 9], [1, 2, 720]), ([1, 3], [1, 2])], "p array<int>, l array<int>")
    assert tuple(rel.teacher_forced_accuracy(forced, "p", "l").collect()[0]) == (3, 4, 0.75)
    assert rel.average_loss(df, "loss").collect()[0][0] == 1.0 and rel.average_loss(df.limit(0), "loss").collect()[0][0] == 0.0
    rel.require_finite(df, ["loss"], "step")
    bad = spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),)], "loss double")
    report = str(tmp_path / "failure.json")
    with pytest.raises(rel.NonFinite):
        rel.require_finite(bad, ["loss"], "backward", report, {"epoch": 3})
    assert json.load(open(report)) == {"epoch": 3, "failure_stage": "backward", "rows": {"loss": 2}}


def test_paths_and_accessors(tmp_path):
    assert pipeline.test_dataset_path("/a/train/x.jsonl") == "/a/test/x.jsonl"
    with pytest.raises(ValueError):
        pipeline.test_dataset_path("/a/val/x.jsonl")
    assert pipeline.vocabulary_path("/r", "/d/scale10000/train.jsonl").endswith("scale10000/vocab.txt")
    assert pipeline.vocabulary_path("/r", "/d/scale5000/train.jsonl") == pipeline.vocabulary_path("/r", scale=5000)
    with pytest.raises(ValueError):
        pipeline.vocabulary_path("/r", "/d/train.jsonl")
    v = bpe.Vocabulary({1501: (1, 2, 3), 1500: (1, 2)}, 1500, 6000, 10)
    assert v.composite_ids == [1500, 1501] and v.lengths() == {1501: 3, 1500: 2} and v.length(1501) == 3 and v.length(7) == 1
    (tmp_path / "v.txt").write_text("# start_id=1500\n1500\t1 2\n")
    short = bpe.Vocabulary.load(str(tmp_path / "v.txt"))
    assert short.atoms == {1500: (1, 2)} and short.size == 6000 and short.max_atoms == 10


def test_long_keys_pair_exactly(spark):
    targets = spark.createDataFrame([(1, "9007199254740993", "a"), (2, "7.9", "b"), (3, "x", "c"), (4, None, "d"), (5, "7", "b")], "tid long, key string, name string")
    raws = spark.createDataFrame([(9007199254740993, "a"), (9007199254740992, "no"), (7, "b")], "rid long, raw_name string")
    got = {r["tid"]: (r["fk"], r["outcome"]) for r in rel.pair_by_key(targets, raws, "tid", "key", "rid", F.lit(1 << 60), "name", "raw_name").collect()}
    assert got == {1: (9007199254740993, "paired"), 2: (7, "paired"), 3: (None, "invalid"), 4: (None, "invalid"), 5: (7, "duplicate")}


def test_limit_takes_the_first_rows(spark, tmp_path):
    v = bpe.Vocabulary({1500: (1, 2)}, 1500, 6000, 10)
    df = spark.createDataFrame([(i, [1, 2, i]) for i in range(9, -1, -1)], "line int, t array<int>").repartition(3)
    out, bad = str(tmp_path / "o.jsonl"), str(tmp_path / "bad.jsonl")
    assert bpe.encode_or_keep(df, v, ["t"], out, bad, limit=3, place="line") == 0
    assert sorted(r["t"] for r in spark.read.json(out).collect()) == [[1500, 0], [1500, 1], [1500, 2]]
    broken = df.withColumn("t", F.when(F.col("line") == 4, F.array(F.lit(1), F.lit(None))).otherwise(F.col("t")))
    assert bpe.encode_or_keep(broken, v, ["t"], out, bad) == 1
    assert [r["line"] for r in spark.read.json(bad).collect()] == [4] and spark.read.json(out).count() == 3


def test_experiments_wait_for_markers(tmp_path):
    marker, config = tmp_path / "done", tmp_path / "c.json"
    config.write_text(json.dumps({"name": "x", "requires": [str(marker)], "output": "o"}))
    with pytest.raises(FileNotFoundError, match="waits for"):
        pipeline.parse_args(["evaluate", "--config", str(config)])
    marker.write_text("")
    assert pipeline.parse_args(["evaluate", "--config", str(config)]).output == "o"


def test_records_without_polygons_are_left_out(spark, tmp_path):
    rows = [(7, [_square(0, 0, 4, 4)]), (8, []), (None, [[[(0, 0), (1, 0), (2, 0)]]]), (None, [_square(9, 9, 2, 2)])]
    _layer(tmp_path / "l.shp", rows, [("RAW_FID", "N", 12, 0)])
    got = geometry.records(shapefile.read(spark, str(tmp_path / "l.shp"))).collect()
    assert sorted((r["fid"], len(r["geom"][0][0])) for r in got) == [(3, 4), (7, 4)]


def test_equal_sources_are_decoded_once_and_in_many_tasks(spark):
    from cantle.operators import inference

    shape = seq2seq.Shape(vocab=760, width=16, heads=2, layers=1, inner=32)
    weights = seq2seq.random_weights(shape, 3)
    sources = [[5, 6, 7], [9], [5, 6, 7], [8, 8]]
    rows = spark.createDataFrame([(i, sources[i % 4]) for i in range(400)], "id long, source_tokens array<int>").coalesce(1)
    out = inference.greedy_predictions(rows, weights, shape, 12)
    assert out.rdd.getNumPartitions() > 1
    model = seq2seq.Model(weights, shape)
    want = [[int(t) for t in model.greedy(np.array([s]), 12)[0][1:] if t != c.PAD] for s in sources]
    assert {r["id"]: r["pred_tokens"] for r in out.collect()} == {i: want[i % 4] for i in range(400)}


def test_greatest_values_as_a_stable_sort_has_them():
    rng = np.random.default_rng(4)
    for x in (rng.normal(size=(5, 90)), rng.integers(0, 3, (5, 90)).astype(float), np.where(rng.random((4, 9)) < 0.8, -np.inf, 1.0), np.ones((2, 3))):
        for n in (1, 4, 9):
            assert (seq2seq._greatest(x, n) == np.argsort(-x, axis=-1, kind="stable")[:, :n]).all()


def test_a_search_over_many_sources_equals_a_plain_search_of_each():
    shape = seq2seq.Shape(vocab=760, width=16, heads=2, layers=2, inner=32)
    rng = np.random.default_rng(1)
    sources = [[725, 723, *rng.integers(0, 700, n).tolist(), 722] for n in (2, 9, 1, 5)]
    for seed, lift in enumerate([0.0, 3.0, 6.0]):
        weights = seq2seq.random_weights(shape, seed)
        weights["output.bias"][c.EOS] = lift
        model = seq2seq.Model(weights, shape)
        for source, got in zip(sources, model.beams(sources, 26, 4, 0.8, 3), strict=True):
            want = _plain_beam(model, source, 26, 4, 0.8, 3)
            assert [t for t, _ in got] == [t for t, _ in want]
            assert np.allclose([s for _, s in got], [s for _, s in want])


def test_candidates_take_a_step_of_many_sources_at_a_time(monkeypatch):
    """As many steps for twelve sources as for one, and hypotheses share what they have in common."""
    shape = seq2seq.Shape(vocab=760, width=16, heads=2, layers=1, inner=32)
    model = seq2seq.Model(seq2seq.random_weights(shape, 3), shape)
    seen, step = [], seq2seq.Model.search_step

    def counted(self, held, tokens):
        seen.append((held.n - held.agreed, tokens.shape))
        return step(self, held, tokens)

    monkeypatch.setattr(seq2seq.Model, "search_step", counted)
    found = model.beams([[725, 723, k, 6, 722] for k in range(12)], 200, 5)
    assert [len(f) for f in found] == [5] * 12
    assert len(seen) <= 199 and seen[0][1] == (12, 5) and max(n for n, _ in seen) < 150


def test_runs_of_equal_lists_are_found_without_python_lists():
    import pyarrow as pa

    from cantle.operators import inference

    lists = pa.array([[7], [5, 6], [5, 6], [5, 7], [5, 7], [5, 7], [], [], [5, 7], [1, 5, 7]], pa.list_(pa.int32()))
    rows, starts = inference._runs(lists)
    assert rows.tolist() == [0, 1, 1, 2, 2, 2, 3, 3, 4, 5] and starts.tolist() == [0, 1, 3, 6, 8, 9]
    rows, starts = inference._runs(lists.slice(2, 3))
    assert rows.tolist() == [0, 1, 1] and starts.tolist() == [0, 1]
    with pytest.raises(ValueError):
        inference._runs(pa.array([[1], None]))


def test_greedy_predictions_keep_other_columns(spark):
    """Rows come and go as Arrow batches; nested columns stay, an old prediction is replaced, and a run may go over two batches."""
    from cantle.operators import inference

    shape = seq2seq.Shape(vocab=760, width=16, heads=2, layers=1, inner=32)
    weights = seq2seq.random_weights(shape, 3)
    rows = spark.range(60).selectExpr("id", "named_struct('a', id, 'b', array(cast(id as string))) AS s", "array(1) AS pred_tokens", "transform(sequence(0, id % 3), x -> cast(x + 5 AS int)) AS source_tokens")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        out = inference.greedy_predictions(rows, weights, shape, 12)
        assert "MapInArrow" in out._jdf.queryExecution().toString() and "MapInPandas" not in out._jdf.queryExecution().toString()
        got = {r["id"]: r for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    model = seq2seq.Model(weights, shape)
    assert sorted(got) == list(range(60))
    for i, r in got.items():
        assert (r["s"]["a"], r["s"]["b"]) == (i, [str(i)])
        assert r["pred_tokens"] == [int(t) for t in model.greedy(np.array([list(range(5, 6 + i % 3))]), 12)[0][1:] if t != c.PAD]
