"""Shared scratch space of a job: the folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_folder(spark: SparkSession) -> str:
    """A new folder name under the shared folder; only where none is set (tests), under one of our own."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        where = spark.conf.get("spark.checkpoint.dir", None)
        if not where:
            import tempfile

            where = tempfile.mkdtemp(prefix="spark-checkpoint-")
        context.setCheckpointDir(where)
    return f"{context._jsc.sc().getCheckpointDir().get()}/job-{uuid.uuid4().hex}"


def checkpointed(frame: DataFrame) -> DataFrame:
    """The frame, computed once."""
    scratch_folder(frame.sparkSession)
    return frame.checkpoint(eager=True)


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of ours, in whatever store it is."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def swapped_in(spark: SparkSession, fresh: str, path: str) -> None:
    """Puts a finished folder in the place of another, which goes only then. A reader finds the old one, none for a moment, or the new one."""
    jvm, configuration = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    new, old, gone = (jvm.org.apache.hadoop.fs.Path(p) for p in (fresh, path, f"{path}.{uuid.uuid4().hex}"))
    store = old.getFileSystem(configuration)
    if store.exists(old):
        store.rename(old, gone)
    if not store.rename(new, old):
        store.rename(gone, old)
        raise OSError(f"could not move {fresh} to {path}")
    store.delete(gone, True)


def unused(frame: DataFrame, name: str) -> str:
    """A column name like this one that the frame does not have."""
    taken = {c.lower() for c in frame.columns}
    while name.lower() in taken:
        name += "_"
    return name
