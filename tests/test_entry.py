"""The entry without the training-data package: everything else imports and runs."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
CODE = """
import __spark_entry__ as entry
assert entry.__file__.startswith({root!r})
assert not [q for q in entry.queries() if q.startswith("op") or q == "pipeline"], sorted(entry.queries())
assert len(entry.queries()) > 100 and set(entry.oracle_sql()) <= set(entry.queries())
"""


def without_llm(tmp_path, *gone):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", *gone))
    return copy


def run(copy, code):
    env = {**os.environ, "PYTHONPATH": str(copy)}
    return subprocess.run([sys.executable, "-c", code], cwd=copy, env=env, capture_output=True, text=True, timeout=120)


def test_entry_without_the_folders(tmp_path):
    done = run(copy := without_llm(tmp_path), CODE.format(root=str(copy)))
    assert done.returncode == 0, done.stderr


def test_entry_without_the_folders_and_the_pipeline(tmp_path):
    done = run(copy := without_llm(tmp_path, "corpus_pipeline.py"), CODE.format(root=str(copy)))
    assert done.returncode == 0, done.stderr


def test_entry_without_the_tokenizers(tmp_path):
    """A library that the training-data package needs may be absent."""
    code = "import sys\nsys.modules['public_tokenizers'] = None\n" + CODE.format(root=str(ROOT))
    done = run(ROOT, code)
    assert done.returncode == 0, done.stderr
