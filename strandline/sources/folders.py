"""Folders that driver and executors share, reached through Spark's file systems."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    ``spark.checkpoint.dir`` is read from the session. Where none is configured, a temporary folder does
    if all runs on one machine; on a cluster, whose executors couldn't reach it, that is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if sc.master.split("[")[0] != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            import tempfile

            named = tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


@contextmanager
def shuffles_released(spark: SparkSession):
    """Inside, the files of a job's shuffles go as it ends, and not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def local_path(folder: str) -> str:
    """The path of a folder in a file system that driver and executors have mounted; ValueError for another store's."""
    scheme, _, rest = folder.rpartition(":")
    if scheme not in ("", "file"):
        raise ValueError(f"a corpus needs a mounted file system, which {folder} isn't in")
    return "/" + rest.lstrip("/") if rest.startswith("/") else rest


def spread(scanned: DataFrame) -> DataFrame:
    """The rows of a scan over as many tasks as there are cores, where its files give fewer."""
    cores = scanned.sparkSession.sparkContext.defaultParallelism
    return scanned if scanned.rdd.getNumPartitions() >= cores else scanned.repartition(cores)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder, in order; none if it isn't there."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def bytes_in(spark: SparkSession, path: str) -> int:
    """The bytes of all files in a folder."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(p).getLength()


def read_text(spark: SparkSession, path: str) -> str:
    """A small file as a whole."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark._jsc.hadoopConfiguration()).open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def put_new(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file under a name that isn't there yet, whole or not at all; false if another one was first."""
    fs_ = spark._jvm.org.apache.hadoop.fs
    conf, last = spark._jsc.hadoopConfiguration(), fs_.Path(path)
    part = fs_.Path(last.getParent(), f".{last.getName()}.{uuid.uuid4().hex}")
    stream = last.getFileSystem(conf).create(part, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    rename = getattr(fs_, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.NONE
    try:
        fs_.FileContext.getFileContext(last.getFileSystem(conf).getUri(), conf).rename(part, last, how)
    except Py4JJavaError as e:
        last.getFileSystem(conf).delete(part, False)
        if exists(spark, path):
            return False
        raise e
    return True
