"""Folders that all executors share, below the one that the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares; on one machine, where none is named, a temporary one."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/") if "://" in named or named.startswith("file:") else f"file://{named.rstrip('/')}"
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir is unset; on a cluster it must name a folder that all executors share")
    made = tempfile.mkdtemp(prefix="codestrata-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    return f"file://{made}"


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/codestrata-{name}-{uuid.uuid4().hex}"
