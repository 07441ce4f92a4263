"""Making this package importable where tasks run."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application; Spark's file server hands it out."""
    if (app := spark.sparkContext.applicationId) in _shipped:
        return
    _shipped.add(app)
    root, out = Path(__file__).resolve().parent, tempfile.mkdtemp(prefix="siltlog-zip-")
    atexit.register(shutil.rmtree, out, ignore_errors=True)
    with zipfile.ZipFile(f"{out}/siltlog_package.zip", "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"{root.name}/{p.relative_to(root)}")
    spark.sparkContext.addPyFile(f"{out}/siltlog_package.zip")
