"""The folder that the driver and all executors see, and tables written there."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that the cluster names in ``spark.checkpoint.dir``.

    Where that is unset, a local session gets a temporary folder; a cluster is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="cadenza-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def put_if_absent(spark: SparkSession, uri: str, content: str) -> bool:
    """Make a file, whole or not at all, where there is none; False if another writer was first.

    The content is written beside it and then given its name: by a hard link in a local or
    mounted folder, by a rename that doesn't replace elsewhere (atomic where the file system's is).
    """
    scheme, _, path = uri.rpartition("://")
    folder, _, name = uri.rpartition("/")
    aside = f"{folder}/.put-{uuid.uuid4().hex}-{name}"
    if scheme in ("", "file"):
        path = path if scheme else uri.removeprefix("file:")
        own = f"{Path(path).parent}/{aside.rpartition('/')[2]}"
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        Path(own).write_text(content)
        try:
            os.link(own, path)
            return True
        except FileExistsError:
            return False
        finally:
            os.unlink(own)
    fs = spark._jvm.org.apache.hadoop.fs
    files = fs.FileContext.getFileContext(spark._jvm.java.net.URI(uri), spark._jsc.hadoopConfiguration())
    stream = fs.Path(aside).getFileSystem(spark._jsc.hadoopConfiguration()).create(fs.Path(aside), False)
    stream.write(bytearray(content.encode()))
    stream.close()
    none = spark._jvm.org.apache.hadoop.fs.Options.Rename.NONE
    options = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = none
    try:
        files.rename(fs.Path(aside), fs.Path(uri), options)
        return True
    except Exception as e:
        if "FileAlreadyExistsException" in str(e):
            files.delete(fs.Path(aside), False)
            return False
        raise


def make_folder(spark: SparkSession, uri: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)


def listed(spark: SparkSession, uri: str, name: str) -> list[str]:
    """Names of a folder that fit a glob; none where there is no folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{uri}/{name}")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return [status.getPath().getName() for status in found or []]


def content(spark: SparkSession, uri: str) -> str:
    """A small file."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    stream = path.getFileSystem(spark._jsc.hadoopConfiguration()).open(path)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """Write a table to the shared folder and read it back: its rows stay what they are, and Spark knows its size."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
