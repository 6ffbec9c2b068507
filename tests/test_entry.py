import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_without_the_training_operators(tmp_path):
    """Without the subpackage and its pipeline, and with the pipeline alone, the other queries are still there."""
    for name in ("alone", "with_pipeline"):
        to = tmp_path / name
        shutil.copytree(ROOT, to, ignore=shutil.ignore_patterns("llm", ".git", "__pycache__", "tests", *(["corpus_pipeline.py"] if name == "alone" else [])))
        code = "import __spark_entry__ as e; print(len(e.queries()), 'pipeline' in e.queries(), set(e.oracle_sql()) <= set(e.queries()))"
        out = subprocess.run([sys.executable, "-c", code], cwd=to, capture_output=True, text=True, timeout=120)
        many, pipeline, known = out.stdout.split()
        assert int(many) > 80 and pipeline == "False" and known == "True", out.stderr
