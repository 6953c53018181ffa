"""The entry works with and without the training-data operators."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_without_the_llm_folders(tmp_path):
    """Whether corpus_pipeline.py is deleted with the folders or left behind."""
    shutil.copytree(f"{ROOT}/citeloom", tmp_path / "citeloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if os.path.exists(f"{ROOT}/{name}"):
            shutil.copy(f"{ROOT}/{name}", tmp_path)
    said = "import __spark_entry__ as e; q = e.queries(); assert 'drift_events' in q and not any(k.startswith('op') for k in q) and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    for _ in range(2):
        subprocess.run([sys.executable, "-c", said], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=True, timeout=120)
        (tmp_path / "corpus_pipeline.py").unlink(missing_ok=True)
