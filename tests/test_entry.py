"""The driver's entry points, and that the library stands without the training-data operators."""

import os
import re
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("gone", [("llm", "corpus_pipeline.py"), ("llm",), ("bpe.py",)])
def test_without_llm(tmp_path, gone):
    """Without the folders, with or without the pipeline, or with a module that can't be imported: the other queries stay."""
    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns(".git", *gone, "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 50 and not any(n.startswith('op') or n == 'pipeline' for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path / "r", env=os.environ | {"PYTHONPATH": str(tmp_path / "r")}, check=True, timeout=100)


def test_only_the_entry_knows_llm():
    for top, _, files in os.walk(os.path.join(ROOT, "vellum")):
        for f in files:
            if f.endswith(".py") and os.sep + "llm" not in top:
                with open(os.path.join(top, f)) as x:
                    assert not re.search(r"vellum\.llm|from vellum import llm", x.read())


@pytest.mark.parametrize("name", ["knn_topk", "tiny_merge", "debounce", "index_tick", "tag_counts", "greedy_pack", "markdown_update", "line_classify", "tag_assignment", "mark_indexed", "mark_reasoned", "delete_cascade", "search_rows", "page_notes", "stream_debounce"])
def test_against_duckdb(spark, sf, name):
    import duckdb

    from vellum.plans import catalogue

    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{sf}/{f}'")
    got = catalogue.queries()[name](spark, sf)
    cols = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({catalogue.oracle_sql()[name]})").fetchall()
    plain = lambda rows: sorted(repr(tuple(round(v, 6) if isinstance(v, float) else v for v in r)) for r in rows)
    assert plain(tuple(r) for r in got.select(*cols).collect()) == plain(want)
