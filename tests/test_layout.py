"""The library without its training-data subpackage: the entry imports, and no other test needs it."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_without_llm(tmp_path):
    to = tmp_path / "repo"
    shutil.copytree(ROOT, to, ignore=lambda folder, names: {n for n in names if n in (".git", "__pycache__", "corpus_pipeline.py", ".pytest_cache") or n == "llm" or n.endswith(".json")})
    env = os.environ | {"PYTHONPATH": str(to)}
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 140 and not [n for n in q if n.startswith('op') and n[2].isdigit()] and 'pipeline' not in q; assert set(o) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=to, env=env, check=True, timeout=120)
    found = subprocess.run([sys.executable, "-m", "pytest", "tests", "--collect-only", "-q", "-p", "no:cacheprovider"], cwd=to, env=env, capture_output=True, text=True, timeout=300)
    assert found.returncode == 0, found.stdout[-2000:]
    assert "test_oracles.py" in found.stdout


def test_nothing_else_imports_llm():
    for folder, _, names in os.walk(os.path.join(ROOT, "eligspark")):
        for name in names:
            if name.endswith(".py") and not folder.endswith("llm"):
                with open(os.path.join(folder, name), encoding="utf-8") as f:
                    assert "eligspark.llm" not in f.read(), name
