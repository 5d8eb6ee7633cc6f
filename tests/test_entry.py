"""The driver contract on the smallest scale."""

import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from tenderloom.sources import adapters

CHECKED = ["L3_bidder_eligibility", "H7_compute_route", "C2_match_numeric", "F1_extract_numeric", "M2_verify_chain", "J3_apply_decisions", "N2_run_hash", "R2_ledger_stream"]


def test_registry():
    queries, oracle = entry.queries(), entry.oracle_sql()
    assert set(oracle) <= set(queries) and len(queries) > 120


@pytest.mark.parametrize("traces", [False, True])
def test_without_optional_folders(tmp_path, traces):
    """With the optional operators deleted, or only caches left of them, the other queries are there."""
    root = Path(entry.__file__).parent
    names = [*(p.name for p in root.glob("*.py")), "tenderloom"]
    for name in names:
        source = root / name
        if source.is_dir():
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(source, tmp_path / name)
    if traces:
        (tmp_path / "tenderloom" / "llm" / "__pycache__").mkdir(parents=True)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); print(len(q), set(o) <= set(q), [k for k in q if k.startswith('op') or k == 'pipeline'])"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120, check=False)
    assert out.returncode == 0, out.stderr
    assert int(out.stdout.split()[0]) > 120 and out.stdout.split(maxsplit=1)[1].strip() == "True []"


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", CHECKED)
def test_against_sql(spark, sf, name):
    con = duckdb.connect()
    for t in adapters.BASE_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    df = entry.queries()[name](spark, sf)
    cur = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cur.description]
    want = sorted(str(tuple(r)) for r in cur.fetchall())
    assert sorted(str(tuple(r)) for r in df.select(*columns).collect()) == want
