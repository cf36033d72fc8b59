"""The entry imports, and keeps its own queries, when the training-data folders are taken away."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
PROBE = "import __spark_entry__ as e; print(len(e.queries()), 'pipeline' in e.queries(), any(q.startswith('op1_') for q in e.queries()))"


@pytest.mark.parametrize("gone", [("llm",), ("llm", "corpus_pipeline.py")])
def test_import_without_training_folders(tmp_path, gone):
    def left_out(folder, names):
        return [n for n in names if n in gone or n.startswith((".git", "__pycache__"))]

    copy = tmp_path / "repo"
    copy.mkdir()
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), copy)
    shutil.copytree(os.path.join(ROOT, "fitframe"), copy / "fitframe", ignore=left_out)
    if "corpus_pipeline.py" not in gone and os.path.exists(os.path.join(ROOT, "corpus_pipeline.py")):
        shutil.copy(os.path.join(ROOT, "corpus_pipeline.py"), copy)
    out = subprocess.run([sys.executable, "-c", PROBE], cwd=copy, capture_output=True, text=True, check=True)
    n, pipeline, op1 = out.stdout.split()
    assert int(n) > 90 and (pipeline, op1) == ("False", "False")
