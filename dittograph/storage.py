"""Where intermediate tables go: the folder that all executors share."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """URI of the session's shared folder, ``spark.checkpoint.dir``.

    Where it is unset, a temporary folder is made, but only for a driver-only
    ``local`` master: on a cluster a machine-local folder would lose data.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or getattr(sc, "_dittograph_shared", None)
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="dittograph-")
        atexit.register(shutil.rmtree, path, True)
        found = f"file://{path}"
        sc.setCheckpointDir(found)
        sc._dittograph_shared = found
    return found.rstrip("/")


_made: list[str] = []


def fresh(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other run uses."""
    _made.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def deleted(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Intermediate tables made inside are deleted at the end; write results elsewhere before."""
    first = len(_made)
    try:
        yield
    finally:
        while len(_made) > first:
            deleted(spark, _made.pop())


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts lineage, survives lost executors."""
    path = fresh(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.dittograph_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Delete a table of :func:`written` that nothing reads any more."""
    deleted(df.sparkSession, df.dittograph_path)
    _made.remove(df.dittograph_path)


def shuffles_released(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of jobs that are over: it does so when the driver collects garbage."""
    for _ in range(2):  # the first lets go of what Python holds in the JVM
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)
