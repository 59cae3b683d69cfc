"""Every registered query against its oracle, on the smallest tables."""

import math
import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from cantle.plans import registry

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parent.parent
TABLES = "region nation customer supplier part orders lineitem events documents".split() + "embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _plain(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else v + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", [n for n in registry.QUERIES if n in registry.ORACLE_SQL])
def test_query_equals_oracle(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(repr([_plain(r[c]) for c in cols]) for r in df.collect())
    res = duck.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    want = sorted(repr([_plain(r[names.index(c)]) for c in cols]) for r in res.fetchall())
    assert got == want


def test_prepared_pairs_hold_boxes_higher_than_wide(spark):
    """The smallest tables have none that is narrowed, too."""
    con, sf = duckdb.connect(), SF.replace("sf0.001", "sf0.01")
    con.execute(f"CREATE VIEW supplier AS SELECT * FROM '{sf}/supplier.parquet'")
    tall = con.execute("SELECT count(*) FROM supplier WHERE 3.0 + s_suppkey % 7 > 5.0 + s_nationkey AND s_suppkey % 4 > 0").fetchone()[0]
    want = con.execute(registry.ORACLE_SQL["prepare_pairs"]).df().sort_values("target_fid")["outline_iou"].tolist()
    got = [r["outline_iou"] for r in registry.QUERIES["prepare_pairs"](spark, sf).orderBy("target_fid").collect()]
    assert tall and got == want


@pytest.mark.parametrize("name", [n for n in registry.QUERIES if n not in registry.ORACLE_SQL])
def test_query_without_oracle_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_entry_without_the_corpus_operators(tmp_path):
    for d in ("cantle", "tests"):
        shutil.copytree(ROOT / d, tmp_path / d, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'group_stats' in q and 'pipeline' not in q and not [n for n in q if n.startswith('op')]; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})


@pytest.mark.skipif(not (ROOT / "cantle" / "llm").exists(), reason="without the corpus operators")
def test_entry_without_the_pipeline_alone(tmp_path):
    shutil.copytree(ROOT / "cantle", tmp_path / "cantle", ignore=shutil.ignore_patterns("__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'group_stats' in q and 'pipeline' not in q and 'op1_soft_mixing' in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})


def test_nothing_else_imports_the_corpus_operators():
    for p in (ROOT / "cantle").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT / "cantle").parts:
            assert "cantle.llm" not in p.read_text()
