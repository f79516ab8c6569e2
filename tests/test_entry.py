"""The driver's contract."""

import importlib
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry_gives_rows(spark):
    entry = importlib.import_module("__spark_entry__")
    rows = entry.entry(spark)
    assert rows.count() == 20
    assert "mean_ssim" in rows.columns


def test_every_sql_has_its_query():
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_works_without_the_subpackage(tmp_path):
    """Without the training-data operators the entry still imports and has the other queries."""
    for name in ("__spark_entry__.py", "peerglyph"):
        subprocess.run(["cp", "-r", str(ROOT / name), str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "peerglyph" / "llm")], check=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 80 and not any(k.startswith('op') for k in q) and 'pipeline' not in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})


def test_a_missing_library_is_not_taken_for_a_missing_part(tmp_path):
    for name in ("__spark_entry__.py", "corpus_pipeline.py", "peerglyph"):
        subprocess.run(["cp", "-r", str(ROOT / name), str(tmp_path)], check=True)
    code = "import sys; sys.modules['numpy'] = None\ntry:\n    import __spark_entry__\nexcept ImportError as e:\n    print(e.name)"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
    assert done.stdout.strip() == "numpy"


def test_the_rest_passes_without_the_subpackage(tmp_path):
    """Its folder and its tests taken out, the other tests are still found, and the entry's pass."""
    for name in ("__spark_entry__.py", "corpus_pipeline.py", "bench.py", "peerglyph", "tests"):
        subprocess.run(["cp", "-r", str(ROOT / name), str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "peerglyph" / "llm"), str(tmp_path / "tests" / "llm")], check=True)
    env = {"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}
    code = "import __spark_entry__ as e; assert 'pipeline' not in e.queries() and set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=env)
    found = subprocess.run([sys.executable, "-m", "pytest", "tests", "-q", "--collect-only"], cwd=tmp_path, check=True, capture_output=True, text=True, env=env | {"HOME": str(tmp_path)})
    assert "error" not in found.stdout.lower() and "test_oracle" in found.stdout


def test_nothing_else_imports_the_subpackage():
    for path in (ROOT / "peerglyph").rglob("*.py"):
        if "llm" not in path.parts:
            assert "llm" not in path.read_text(), path
