import os
import shutil
import subprocess
import sys

import __spark_entry__ as entry

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_contract(spark):
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    first = entry.entry(spark)
    assert first.columns == ["signature", "size", "projects", "wasted_ms", "priority", "rank"] and first.count() > 0


def test_the_rest_stands_without_the_corpus_operators(tmp_path):
    """With the subpackage gone (the pipeline there or not), everything else imports and lists its queries."""
    skip = shutil.ignore_patterns("llm", "__pycache__", ".git", ".*")
    shutil.copytree(ROOT, tmp_path / "rest", ignore=skip)
    code = "import __spark_entry__ as e; q = e.queries(); e.oracle_sql(); assert len(q) > 40 and 'pipeline' not in q and not any(n.startswith('op') for n in q)"
    for _ in range(2):
        done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "rest", capture_output=True, text=True)
        assert done.returncode == 0, done.stderr
        (tmp_path / "rest" / "corpus_pipeline.py").unlink(missing_ok=True)
