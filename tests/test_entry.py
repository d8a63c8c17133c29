import importlib.util
import os
import re
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
DATA = Path("/root/testdata/sf0.001")


def test_every_oracle_has_a_query():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_nothing_else_imports_the_text_operators():
    for p in (ROOT / "inundate").rglob("*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"\bllm\b", p.read_text()), p


@pytest.mark.parametrize("pipeline", [False, True])
def test_entry_imports_without_the_text_operators(tmp_path, pipeline):
    """With the pipeline's file gone too, and with it left behind."""
    if pipeline and not (ROOT / "corpus_pipeline.py").exists():
        pytest.skip("the pipeline's file is not here")
    if pipeline:
        shutil.copy(ROOT / "corpus_pipeline.py", tmp_path)
    shutil.copytree(ROOT / "inundate", tmp_path / "inundate", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; names = e.queries(); assert 'anchor_stage' in names and 'pipeline' not in names and not any(n.startswith('op') for n in names); e.oracle_sql()"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path, env=env)


@pytest.mark.skipif(not DATA.exists(), reason="the test tables are not here")
def test_flagship(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.count() > 0 and {"catchment_id", "depth_sum"} <= set(df.columns)


@pytest.mark.skipif(not DATA.exists() or importlib.util.find_spec("duckdb") is None, reason="needs the test tables and duckdb")
@pytest.mark.parametrize("name", ["anchor_stage", "stage_curves", "reconstruction_qc", "render_depth_depression", "gev_fit", "holdout_report", "stream_links", "line_snap", "fill_dem", "delineate_depressions", "condition_dem", "hand_stack", "assemble_cells", "render_regime_confidence"])
def test_queries_equal_sql(spark, name):
    import duckdb
    from inundate.plans import oracles, queries

    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    want = con.sql(oracles.ORACLES[name])
    names = sorted(want.columns)
    got = queries.QUERIES[name](spark, str(DATA)).select(*names).collect()
    text = lambda rows: sorted(str([None if v is None else float(v) if not isinstance(v, str) else v for v in r]) for r in rows)
    assert text(got) == text(want.select(*names).fetchall())
