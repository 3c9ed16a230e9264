import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = "import __spark_entry__ as e; q = e.queries(); print(len(q), sorted(n for n in q if n.startswith('op') or n == 'pipeline')); print(sorted(set(e.oracle_sql()) - set(q)))"


@pytest.mark.parametrize("pipeline", [False, True])
def test_queries_without_the_training_data_operators(tmp_path, pipeline):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=lambda d, names: [n for n in names if n in (".git", "spark-warehouse", "__pycache__", "llm") or n == "corpus_pipeline.py" and not pipeline])
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", CODE], cwd=copy, env=env, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    assert done.stdout.splitlines()[-1] == "[]" and done.stdout.splitlines()[-2].endswith(" []")
    assert int(done.stdout.splitlines()[-2].split()[0]) > 70
