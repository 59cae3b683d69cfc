"""Fingerprints by executors, and parts that are made anew only where they changed."""

import hashlib

from pyspark.sql import functions as F

from cantle.sources import files


def test_fingerprints_of_files_and_folders(spark, tmp_path, monkeypatch):
    one = tmp_path / "a.txt"
    one.write_bytes(b"x\ny\xff\n\n")
    want = {"bytes": 6, "sha256": hashlib.sha256(one.read_bytes()).hexdigest(), "lines": 3}
    assert files.fingerprint(spark, str(one)) == want
    nothing = tmp_path / "none.jsonl"
    nothing.write_bytes(b"")
    assert files.fingerprint(spark, str(nothing)) == {"bytes": 0, "sha256": hashlib.sha256(b"").hexdigest(), "lines": 0}
    folder = tmp_path / "f.jsonl"
    (folder / "sub").mkdir(parents=True)
    (folder / "part-0").write_bytes(b"1\n2\n")
    (folder / "sub" / "part 1").write_bytes(b"z")
    (folder / "part-9").write_bytes(b"")
    (folder / "_SUCCESS").write_bytes(b"no data")
    found = files.fingerprint(spark, str(folder))
    assert found["bytes"] == 5 and found["lines"] == 2 and list(found["parts"]) == ["part-0", "sub/part 1"]
    assert found["parts"]["sub/part 1"] == hashlib.sha256(b"z").hexdigest()
    (folder / "part-0").write_bytes(b"1\n3\n")
    assert files.fingerprint(spark, str(folder))["sha256"] != found["sha256"]
    (folder / "part-0").write_bytes(b"1\n2\n")
    assert files.fingerprint(spark, str(folder)) == found
    monkeypatch.setattr(files, "WHOLE_BYTES", 3)  # larger ones are streamed
    assert files.fingerprint(spark, str(folder)) == found and files.fingerprint(spark, str(one)) == want


def test_only_changed_parts_are_made(spark, tmp_path):
    source, target, manifest = tmp_path / "s", str(tmp_path / "t"), str(tmp_path / "m.json")
    source.mkdir()
    for i in range(4):
        (source / f"p{i}.txt").write_text(f"{i}\n{i + 10}\n")
    made = []

    def make(rows):
        made.append(sorted(r["part"] for r in rows.select("part").distinct().collect()))
        return rows.select("part", (F.col("value").cast("int") * 2).alias("double"))

    run = lambda: files.refresh_parts(spark, str(source), target, manifest, make)
    read = lambda: sorted((r["part"], r["double"]) for r in spark.read.parquet(target).collect())
    assert run() == {"made": ["p0.txt", "p1.txt", "p2.txt", "p3.txt"], "removed": [], "kept": []}
    assert run()["made"] == [] and len(made) == 1
    (source / "p2.txt").write_text("7\n")
    (source / "p1.txt").unlink()
    (source / "new.txt").write_text("100\n")
    assert run() == {"made": ["new.txt", "p2.txt"], "removed": ["p1.txt"], "kept": ["p0.txt", "p3.txt"]}
    assert made[-1] == ["new.txt", "p2.txt"]
    assert read() == [("new.txt", 200), ("p0.txt", 0), ("p0.txt", 20), ("p2.txt", 14), ("p3.txt", 6), ("p3.txt", 26)]
