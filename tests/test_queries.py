"""Every query against its SQL on the smallest tables."""

import os
import shutil
import subprocess
import sys

import pytest
from compare import assert_same

from lexispark.queries import all_queries, all_sql


@pytest.mark.parametrize("name", sorted(all_sql()))
def test_query_matches_sql(spark, sf_dir, name):
    assert_same(spark, sf_dir, all_queries()[name], all_sql()[name])


@pytest.mark.parametrize("name", sorted(set(all_queries()) - set(all_sql())))
def test_query_without_sql_runs(spark, sf_dir, name):
    assert all_queries()[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    frame = entry.entry(spark)
    assert frame.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("left", [(), ("corpus_pipeline.py",)])
def test_entry_without_the_training_data_operators(tmp_path, left):
    """With the subpackage deleted (and whether or not the pipeline is), everything else is still there."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for name in ("lexispark", "__spark_entry__.py"):
        source = os.path.join(root, name)
        (shutil.copytree if os.path.isdir(source) else shutil.copy)(source, tmp_path / name)
    for name in left:
        (tmp_path / name).write_text("import lexispark.llm.packing\n")
    shutil.rmtree(tmp_path / "lexispark" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); print(len(q), sorted(n for n in q if n.startswith('op') or n == 'pipeline'))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": ""}, capture_output=True, text=True, check=True)
    assert out.stdout.split(maxsplit=1) == [str(len(all_queries())), "[]\n"]
