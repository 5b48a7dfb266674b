import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(entry.__file__).parent


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "status" in df.columns


def test_every_sql_has_a_query():
    assert entry.oracle_sql().keys() <= entry.queries().keys()


def test_rest_stands_alone(tmp_path):
    for name in ("__spark_entry__.py", "remitweave"):
        src = ROOT / name
        (shutil.copytree if src.is_dir() else shutil.copy)(src, tmp_path / name)
    shutil.rmtree(tmp_path / "remitweave" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 50 and not any(k.startswith('op') and k[2].isdigit() for k in q), q.keys()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})


def test_nothing_else_imports_llm():
    for p in (ROOT / "remitweave").rglob("*.py"):
        if "llm" not in p.parts:
            assert "llm" not in p.read_text()
