"""Without the training-data folder and the pipeline the rest still imports."""

import os
import shutil
import subprocess
import sys

from conftest import ROOT


def test_entry_without_the_training_data_folder(tmp_path):
    for name in ("epilens", "__spark_entry__.py", "oracle_sql.py"):
        source = os.path.join(ROOT, name)
        if os.path.isdir(source):
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(source, tmp_path / name)
    code = "import __spark_entry__ as e; q = e.queries(); assert set(q) == set(e.oracle_sql()); print(len(q))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, check=True)
    assert int(out.stdout.split()[-1]) > 50
