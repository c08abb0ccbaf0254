"""Intermediate tables that outlive lost executors.

They are Parquet in the folder that the cluster names in ``spark.checkpoint.dir``,
which driver and executors share.  Where the setting is missing, a session on
one machine gets a temporary folder, removed when Python ends; a cluster must
name one.
"""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share."""
    named = spark.conf.get(CHECKPOINT_KEY, None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError(f"on a cluster {CHECKPOINT_KEY} must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="codeloom-shared-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return _own[app]


def cut(df: DataFrame, name: str, *used: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back; then drop the tables ``used`` that nothing else reads.

    This cuts the lineage durably: later stages neither repeat the work nor see
    another row order.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written = path
    discard(*used)
    return out


def discard(*tables: DataFrame) -> None:
    """Delete what ``cut`` wrote, once nothing reads it any more."""
    for df in tables:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df._written)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let the driver forget finished exchanges, so that their files go.

    Spark deletes shuffle files once the driver's JVM has collected the plan
    that made them; between two large steps that should not be left to chance.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
