"""Small files beside the data, through Hadoop's file systems, so that any store Spark reads will do."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch(spark: SparkSession, kind: str) -> str:
    """A new folder's path in the one that driver and executors share (``spark.checkpoint.dir``).

    Only a local session may do without that setting; on a cluster a folder of one machine would lose data.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="gridshift-")
        spark.conf.set("spark.checkpoint.dir", shared)
    return f"{shared.rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def same_place(spark: SparkSession, a: str, b: str) -> bool:
    """Whether one path is the other, or lies in it."""
    (fs, p), (other, q) = _path(spark, a), _path(spark, b)
    p, q = str(p.makeQualified(fs.getUri(), fs.getWorkingDirectory())), str(q.makeQualified(other.getUri(), other.getWorkingDirectory()))
    return p == q or p.startswith(q + "/") or q.startswith(p + "/")


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _path(spark, path)
    return fs.exists(p)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, p = _path(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _path(spark, path)
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _path(spark, path)
    fs.delete(p, True)


def folders(spark: SparkSession, path: str) -> list[str]:
    fs, p = _path(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()) if fs.exists(p) else []


def size(spark: SparkSession, path: str) -> int:
    fs, p = _path(spark, path)
    return fs.getContentSummary(p).getLength()
