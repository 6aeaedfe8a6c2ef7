from __future__ import annotations

import os
import shutil
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_works_without_the_training_data_part(tmp_path):
    shutil.copytree(f"{REPO}/sparkloom", tmp_path / "sparkloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{REPO}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert len(e.queries()) > 40 and set(e.oracle_sql()) <= set(e.queries()) and not any(q.startswith('op') for q in e.queries()); print('good')"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert done.stdout.strip().endswith("good"), done.stderr


def test_every_statement_belongs_to_a_query():
    sys.path.insert(0, REPO)
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
