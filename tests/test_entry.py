import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert rows and [r["rank"] for r in rows] == sorted(r["rank"] for r in rows)


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_rest_stands_alone(tmp_path):
    """Without the training-data subpackage everything else imports."""
    shutil.copytree(ROOT / "tessera", tmp_path / "tessera", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    (tmp_path / "tessera" / "llm" / "__pycache__").mkdir(parents=True)  # a folder that is left over
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not [k for k in q if k.startswith('op') or k == 'pipeline']; assert e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
