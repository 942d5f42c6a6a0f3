"""What driver and executors share: this package for Python workers, a folder for tables, and how rows are dealt out."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_ROOT = str(Path(__file__).resolve().parents[1])


def reach_package(spark: SparkSession) -> None:
    """Put the package's folder on the workers' path (executors must see that folder)."""
    env = spark.sparkContext.environment
    have = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT not in have:
        env["PYTHONPATH"] = os.pathsep.join([_ROOT, *have])


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that all executors see: under spark.checkpoint.dir, else a temporary one of a local session."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        local = tempfile.mkdtemp(prefix="factloom-")
        atexit.register(shutil.rmtree, local, ignore_errors=True)
        found = f"file://{local}"
    return f"{found.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def parts_for(spark: SparkSession, number: int, each: int) -> int:
    """How many partitions so many rows need, with about `each` in one; few rows still go to several cores."""
    return max(-(-number // each), min(spark.sparkContext.defaultParallelism, number // 256 + 1))


def dealt(rows: DataFrame, key: str, each: int) -> DataFrame:
    """rows by hash of the key over as many partitions as their number needs, about `each` in one.

    A small file is one task, whatever its rows grow to in the stages that follow, and
    adaptive execution goes by bytes before they have grown.  Stages that group by the key
    need no shuffle of their own afterwards, as long as the key is selected as it is.
    """
    return rows.repartition(parts_for(rows.sparkSession, rows.count(), each), key)
