"""Makes this package importable in Spark's Python workers, wherever the driver imported it from."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Adds a zip of the package to the session's Python files, once for each Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_vellum_shipped", False):
        return
    root = Path(__file__).resolve().parent
    if root.is_dir():
        path = os.path.join(tempfile.mkdtemp(prefix="vellum-"), "vellum.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, str(Path("vellum") / p.relative_to(root)))
        sc.addPyFile(path)
    sc._vellum_shipped = True
