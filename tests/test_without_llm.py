"""The engine and its tests hold without the subpackage of training-data operators."""

from __future__ import annotations

import re
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
#: Modules of the subpackage, by any way of naming them in an import.
USES = re.compile(r"^\s*(from|import)\s+(tarnwork\.llm|\.+llm|corpus_pipeline)\b|^\s*from\s+(tarnwork|\.+)\s+import\s+.*\bllm\b", re.M)


def test_nothing_else_imports_it():
    places = [p for d in ("tarnwork", "tests") for p in (ROOT / d).rglob("*.py") if "llm" not in p.relative_to(ROOT).parts]
    places.append(ROOT / "bench.py")
    assert len(places) > 40
    assert [str(p) for p in places if USES.search(p.read_text())] == []


def test_a_copy_without_it_registers_and_collects(tmp_path):
    import os
    import shutil
    import subprocess
    import sys

    for name in ("tarnwork", "tests"):
        shutil.copytree(ROOT / name, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    env = {**os.environ, "PYTHONPATH": str(tmp_path)}
    run = lambda *args: subprocess.run([sys.executable, *args], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    entry = run("-c", "import __spark_entry__ as e; print(len(e.queries()), any(q.startswith('op1_') for q in e.queries()))")
    assert entry.returncode == 0 and int(entry.stdout.split()[0]) > 200 and entry.stdout.split()[1] == "False", entry.stderr
    found = run("-m", "pytest", "--collect-only", "-q", "-p", "no:cacheprovider", "tests")
    assert found.returncode == 0, found.stdout[-2000:]
