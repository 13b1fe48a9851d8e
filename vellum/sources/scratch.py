"""Folders for data that is written and read again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def folder(spark: SparkSession) -> str:
    """A new folder's URI below ``spark.checkpoint.dir``; only Spark on this machine alone may go without that setting."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="vellum-")
    return f"{base if '://' in base else 'file://' + base}".rstrip("/") + f"/vellum-{uuid.uuid4().hex}"
