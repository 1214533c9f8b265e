"""This package's sources for Python workers on other machines."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship_package(spark: SparkSession) -> None:
    """Send this package's sources to the executors, once for an application."""
    root, sc = Path(__file__).parents[1], spark.sparkContext
    name = f"driftlog-{sc.applicationId}.zip"
    if name not in sc._python_includes:
        own = tempfile.mkdtemp(prefix="driftlog-src-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        out = Path(own) / name
        with zipfile.ZipFile(out, "w") as z:
            for f in sorted((root / "driftlog").rglob("*.py")):
                z.write(f, f.relative_to(root))
        sc.addPyFile(str(out))
