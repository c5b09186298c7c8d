"""Make this package importable on executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from functools import wraps
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's sources to the executors, once for each application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent.parent
    path = os.path.join(tempfile.mkdtemp(prefix="tessera-ship-"), "tessera_src.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def small_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """Bound Arrow batches by bytes, for texts of any length; a bound that the session has set stays."""
    key, usual = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"
    if spark.conf.get(key, usual) == usual:
        spark.conf.set(key, f"{most}b")


def shipped(f):
    """A query or stage that ships the package and bounds batches first; its session is its first argument."""

    @wraps(f)
    def run(spark, *args):
        ship(spark)
        small_batches(spark)
        return f(spark, *args)

    return run
