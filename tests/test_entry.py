import os
import re
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from fieldcheck.plans import registry

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ROOT = Path(__file__).resolve().parents[1]


def test_flagship(spark):
    assert entry.entry(spark).count() == 203


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_agrees_with_sql(spark, name):
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    want = con.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    got = entry.queries()[name](spark, SMALL)
    assert sorted(got.columns) == sorted(columns)
    plan = got._jdf.queryExecution().toString()
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin|Python|ArrowEval", plan)
    rows = lambda some: sorted(some, key=repr)
    plain = lambda v: round(v, 5) + 0.0 if isinstance(v, float) else v
    assert rows(tuple(plain(v) for v in r) for r in got.select(*columns).collect()) == rows(tuple(plain(v) for v in r) for r in want.fetchall())


def test_rest_works_without_the_optional_part(tmp_path):
    """Without the folders llm and corpus_pipeline.py the entry module imports and lists the other queries."""
    for p in ROOT.rglob("*.py"):
        rel = p.relative_to(ROOT)
        if "llm" not in rel.parts and rel.name != "corpus_pipeline.py" and ".git" not in rel.parts:
            (tmp_path / rel).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / rel).write_text(p.read_text())
    code = "import __spark_entry__ as e; print(len(e.queries()), any(k.startswith('op') and k[2].isdigit() for k in e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=True)
    assert out.stdout.split() == [str(len(registry.queries())), "False"]


def test_a_fault_within_the_optional_part_is_not_hidden(tmp_path):
    for p in ROOT.rglob("*.py"):
        rel = p.relative_to(ROOT)
        if ".git" not in rel.parts and "tests" not in rel.parts:
            (tmp_path / rel).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / rel).write_text(p.read_text())
    inner = tmp_path / "fieldcheck/llm/queries.py"
    if not inner.exists():
        pytest.skip("the optional part is not there")
    inner.write_text(inner.read_text() + "\nimport nothing_of_that_name\n")
    run = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=False)
    assert run.returncode and "nothing_of_that_name" in run.stderr


def test_nothing_outside_imports_the_optional_part():
    for p in ROOT.rglob("*.py"):
        rel = p.relative_to(ROOT)
        if "llm" in rel.parts or rel.name in ("corpus_pipeline.py", "__spark_entry__.py") or "tests" in rel.parts:
            continue
        assert not re.search(r"^\s*(from|import)\s+\S*llm", p.read_text(), re.M), rel
