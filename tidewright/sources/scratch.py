"""Folders for tables that a query writes and reads again."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

_MADE: list[str] = []
atexit.register(lambda: [shutil.rmtree(p, ignore_errors=True) for p in _MADE])


def folder(spark: SparkSession, label: str) -> str:
    """A new path below ``spark.checkpoint.dir``; on a local master without that setting, in a folder of this process."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root is None:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        _MADE.append(tempfile.mkdtemp(prefix="tidewright-tables-"))
        root = f"file://{_MADE[-1]}"
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"
