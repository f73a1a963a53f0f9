"""Shared storage for staged tables and streaming checkpoints."""

import atexit
import functools
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system for ``path``, and ``path`` as Hadoop sees it."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def exists(spark: SparkSession, path: str) -> bool:
    fs, hadoop_path = file_system(spark, path)
    return fs.exists(hadoop_path)


@functools.cache
def _local_scratch() -> str:
    path = tempfile.mkdtemp(prefix="scriptflow-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def shared_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a local session may go without; it gets a scratch folder that is removed
    when the process ends.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.startswith("local"):
        return _local_scratch()
    raise ValueError("set spark.checkpoint.dir to a folder that all executors share")


def scratch_dir(spark: SparkSession) -> str:
    """Where this application keeps what it needs until it ends."""
    return f"{shared_root(spark)}/scriptflow-{spark.sparkContext.applicationId}"


def fresh_dir(spark: SparkSession, label: str) -> str:
    """A path in the scratch folder that nothing else uses. It is not created."""
    return f"{scratch_dir(spark)}/{label}_{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the scratch folder and continue from the written table.

    For results that are used more than once: they are computed once, and the loss
    of an executor does not lose them.
    """
    path = fresh_dir(df.sparkSession, label)
    df.write.parquet(path)
    staged = df.sparkSession.read.schema(df.schema).parquet(path)
    staged.staged_path = path
    return staged


def release(*staged: DataFrame) -> None:
    """Remove staged tables that nothing will read any more. What was made of them must
    have been written; frames that still read from them can no longer be used."""
    for df in staged:
        fs, hadoop_path = file_system(df.sparkSession, df.staged_path)
        fs.delete(hadoop_path, True)


def remove_scratch(spark: SparkSession) -> None:
    """Remove the scratch folder. Frames that read from it can no longer be used."""
    fs, hadoop_path = file_system(spark, scratch_dir(spark))
    fs.delete(hadoop_path, True)
