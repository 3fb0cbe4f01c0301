"""The rest works where the training-data subpackage, its tests and, or, the pipeline are left out."""

import os
import shutil
import subprocess
import sys

import pytest
from conftest import ROOT

ALONE = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
GONE = {"all": ["leafwork/llm", "tests/llm", "corpus_pipeline.py"], "folders": ["leafwork/llm", "tests/llm"], "pipeline": ["corpus_pipeline.py"]}


@pytest.mark.parametrize("case", GONE)
def test_rest_imports(tmp_path, case):
    tree = tmp_path / "tree"
    shutil.copytree(ROOT, tree, ignore=shutil.ignore_patterns(".git", "__pycache__", "*.parquet"))
    for name in GONE[case]:
        path = tree / name
        shutil.rmtree(path, ignore_errors=True) if path.is_dir() else path.unlink(missing_ok=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'glossary_topk' in q and 'pipeline' not in q and set(e.oracle_sql()) <= set(q); print(sum(n.startswith('op') and n[2].isdigit() for n in q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tree, env=ALONE, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    assert int(done.stdout.split()[-1]) == (10 if case == "pipeline" else 0) or not os.path.isdir(f"{ROOT}/leafwork/llm")
    rest = subprocess.run([sys.executable, "-m", "pytest", "tests", "-q", "--collect-only", "--ignore=tests/llm"], cwd=tree, env=ALONE, capture_output=True, text=True, timeout=300)
    assert rest.returncode == 0, rest.stdout[-2000:]


def test_other_missing_modules_are_errors(tmp_path):
    tree = tmp_path / "tree"
    shutil.copytree(ROOT, tree, ignore=shutil.ignore_patterns(".git", "__pycache__"))
    if not (tree / "leafwork" / "llm").is_dir():
        pytest.skip("left out")
    queries = tree / "leafwork" / "llm" / "queries.py"
    queries.write_text("import leafwork_no_such_module\n" + queries.read_text().replace("from __future__ import annotations\n", ""))
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tree, env=ALONE, capture_output=True, text=True, timeout=120)
    assert done.returncode != 0 and "leafwork_no_such_module" in done.stderr
