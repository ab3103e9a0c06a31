"""Where iterative plans cut their lineage: tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders of applications of this process.
_OWN: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Where it is unset, a local session takes a folder of this machine; on a cluster,
    whose executors don't share such a folder, that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    at = spark.sparkContext._jsc.sc().getCheckpointDir()
    if at.isEmpty():
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="quernel-"))
        at = spark.sparkContext._jsc.sc().getCheckpointDir()
    return at.get().rstrip("/")


def _store(spark: SparkSession, path: str):
    """A path, and the file system that holds it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, in a folder of this application. That goes when the driver's process ends, in whatever
    store it lies."""
    own = f"{shared_dir(spark)}/quernel-{spark.sparkContext.applicationId}"
    if own not in _OWN:
        at, store = _store(spark, own)
        store.mkdirs(at)
        store.deleteOnExit(at)
        _OWN.add(own)
    return f"{own}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The frame, written as Parquet in the shared folder and read back: its lineage ends there."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a path through Spark's own file systems."""
    at, store = _store(spark, path)
    store.delete(at, True)
