"""The entry module without the corpus operators."""

import os
import shutil
import subprocess
import sys

import __spark_entry__  # noqa: F401  (registers the catalog)
import catalog

HOME = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
LIST = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), 'pipeline' in e.queries())"


def listed(folder) -> list[str]:
    done = subprocess.run(
        [sys.executable, "-c", LIST], cwd=folder, capture_output=True, text=True, check=True,
        env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"},
    )
    return done.stdout.split()


def copied(folder, *left_out: str) -> None:
    skip = shutil.ignore_patterns(".git", "__pycache__", *left_out)
    shutil.copytree(HOME, folder, ignore=skip)


def test_the_core_queries_stand_alone(tmp_path):
    copied(tmp_path / "with_pipeline", "llm")
    copied(tmp_path / "without", "llm", "corpus_pipeline.py")
    expected = [str(len(catalog.QUERIES)), str(len(catalog.ORACLE)), "False"]
    assert listed(tmp_path / "with_pipeline") == expected
    assert listed(tmp_path / "without") == expected
