"""Registered queries against DuckDB on the smallest tables, and what is left without the corpus subpackage."""

import importlib
import os
import subprocess
import sys
from pathlib import Path

import pytest

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
REPO = Path(__file__).resolve().parent.parent

registry = importlib.import_module("histora.plans.registry")


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else f"{v:.9g}"
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    return "null" if v is None else str(v)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_sql(spark, name):
    import duckdb

    found = registry.QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    cursor = c.execute(registry.ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = sorted(tuple(plain(dict(zip(names, r))[k]) for k in columns) for r in cursor.fetchall())
    assert sorted(tuple(plain(r[k]) for k in columns) for r in found.collect()) == want


def test_entry_without_the_corpus_subpackage(tmp_path):
    for p in REPO.iterdir():
        if p.name not in (".git", "corpus_pipeline.py", "histora", "tests"):
            (tmp_path / p.name).symlink_to(p)
    (tmp_path / "histora").mkdir()
    for p in (REPO / "histora").iterdir():
        if p.name != "llm":
            (tmp_path / "histora" / p.name).symlink_to(p)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'closure_sizes' in q and 'pipeline' not in q and not any(n.startswith('op') and n[2].isdigit() for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
