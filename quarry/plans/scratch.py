"""Folders for tables that queries write themselves."""

from __future__ import annotations

import atexit
import os
import tempfile

from pyspark.sql import SparkSession

_MADE: list[tuple[SparkSession, str]] = []


def folder(spark: SparkSession, label: str) -> str:
    """A fresh path in spark.checkpoint.dir, which all executors see; a temporary one only where that is unset. It goes when the driver ends."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    path = f"{shared.rstrip('/') if shared else tempfile.mkdtemp(prefix='quarry-')}/{label}-{os.urandom(8).hex()}"
    if not _MADE:
        atexit.register(_clean)
    _MADE.append((spark, path if shared else os.path.dirname(path)))
    return path


def _clean() -> None:
    for spark, path in _MADE:
        try:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # noqa: BLE001, S112  the session may be gone already
            continue
