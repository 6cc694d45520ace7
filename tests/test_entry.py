"""The driver contract on a checkout without the optional parts."""

import os
import shutil
import subprocess
import sys

import pytest

from conftest import ROOT

PROBE = """
import __spark_entry__ as e
q, o = e.queries(), e.oracle_sql()
assert set(o) <= set(q)
print(len(q), sum(k.startswith("op") and k[2:3].isdigit() for k in q), "pipeline" in q)
"""


def checkout(tmp_path, without):
    """A copy of the tracked layout without some of its parts."""
    skip = {os.path.join(ROOT, w) for w in without}
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=lambda folder, names: [
        n for n in names if n in (".git", "__pycache__", ".pytest_cache") or os.path.join(folder, n) in skip])
    return copy


def run(copy, *command):
    env = {**os.environ, "PYTHONPATH": str(copy)}
    return subprocess.run([sys.executable, *command], cwd=copy, env=env, capture_output=True, text=True, timeout=300)


@pytest.mark.parametrize("without", [
    ["parlance/llm", "tests/llm", "corpus_pipeline.py"], ["parlance/llm", "tests/llm"], ["corpus_pipeline.py", "tests/llm"]])
def test_entry_without_optional_parts(tmp_path, without):
    copy = checkout(tmp_path, without)
    done = run(copy, "-c", PROBE)
    assert done.returncode == 0, done.stderr
    total, numbered, pipeline = done.stdout.split()
    assert int(total) > 80 and pipeline == "False"
    assert (int(numbered) > 0) == ("corpus_pipeline.py" == without[0] and os.path.isdir(os.path.join(ROOT, "parlance/llm")))
    collected = run(copy, "-m", "pytest", "tests", "--collect-only", "-q")
    assert collected.returncode == 0, collected.stdout[-2000:]


def test_another_missing_import_is_an_error(tmp_path):
    copy = checkout(tmp_path, ["tests"])
    target = copy / "parlance" / "llm"
    if not target.exists():
        pytest.skip("no optional subpackage in this checkout")
    (target / "common.py").write_text("import a_module_that_is_not_there\n")
    done = run(copy, "-c", PROBE)
    assert done.returncode != 0 and "a_module_that_is_not_there" in done.stderr
