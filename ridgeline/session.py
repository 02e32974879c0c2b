"""Shared storage: where intermediate tables go so that lost executors cost no work.

Everything written here goes to the folder that the session names in
``spark.checkpoint.dir``; executors and the driver of a cluster all see it.  Only a local session
without that setting (tests) gets a folder of this process; on a cluster its absence is an error.
"""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_root: str | None = None
_scopes: list[str] = []  # folders of runs whose tables go when the run ends


def _local_root() -> str:
    global _own_root
    if _own_root is None:
        _own_root = tempfile.mkdtemp(prefix="ridgeline-")
        atexit.register(shutil.rmtree, _own_root, ignore_errors=True)
    return f"file://{_own_root}"


def shared_root(spark: SparkSession) -> str:
    """URI of the folder that the driver and all executors share."""
    conf = spark.sparkContext.getConf()
    root = conf.get("spark.checkpoint.dir")
    if not root:
        master = conf.get("spark.master") or ""
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        return _local_root()
    return root if "://" in root or root.startswith("file:") else f"file://{root}"


def run_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; no two calls get the same one."""
    scope = f"{_scopes[-1]}/" if _scopes else ""
    return f"{shared_root(spark).rstrip('/')}/{scope}{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store Spark reaches, if it is there."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextlib.contextmanager
def scratch(spark: SparkSession, name: str = "run"):
    """Intermediate tables of the block are removed when it ends; what it returns must be written elsewhere."""
    scope = f"{name}-{uuid.uuid4().hex}"
    _scopes.append(scope)
    try:
        yield
    finally:
        _scopes.remove(scope)
        remove(spark, f"{shared_root(spark).rstrip('/')}/{scope}")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Cuts lineage, survives executor loss, and gives later joins real sizes to plan with.
    """
    path = run_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
