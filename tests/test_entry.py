"""The entry module without the optional training-data package."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_entry_loads_without_the_training_data_package(tmp_path):
    copy = tmp_path / "copy"
    skip = shutil.ignore_patterns("llm", ".git", "__pycache__", ".pytest_cache", "spark-warehouse")
    shutil.copytree(ROOT, copy, ignore=skip)
    shown = "import __spark_entry__ as e; q = e.queries(); print(len(q), len(set(e.oracle_sql()) - set(q)), sorted(k for k in q if k.startswith('op') or k == 'pipeline'))"
    run = subprocess.run([sys.executable, "-c", shown], cwd=copy, capture_output=True, text=True, timeout=120)
    assert run.returncode == 0, run.stderr
    count, unknown, optional = run.stdout.split(maxsplit=2)
    assert int(count) > 100 and unknown == "0" and optional.strip() == "[]"
