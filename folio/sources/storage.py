"""Small files on whatever file system a path names: put once, read, list, delete. Only the driver uses these."""

from __future__ import annotations

import os
import uuid
from urllib.parse import unquote, urlparse

from pyspark.sql import SparkSession


def file_system(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def gone_with_driver(spark: SparkSession, path: str) -> str:
    """Have what lies at ``path`` deleted when the driver ends."""
    fs, at = file_system(spark, path)
    fs.deleteOnExit(at)
    return path


def put_once(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file with ``text``, whole or not at all; False if it exists already.

    A local file system links a finished file to the name, others rename it there without overwriting, which
    a distributed file system does as one step.
    """
    fs, at = file_system(spark, path)
    fs.mkdirs(at.getParent())
    if fs.getScheme() == "file":
        target = unquote(urlparse(fs.makeQualified(at).toString()).path)
        fresh = f"{os.path.dirname(target)}/.{uuid.uuid4().hex}"
        with open(fresh, "x", encoding="utf-8") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        try:
            os.link(fresh, target)
        except FileExistsError:
            return False
        finally:
            os.unlink(fresh)
        return True
    jvm = spark.sparkContext._jvm
    fresh = jvm.org.apache.hadoop.fs.Path(at.getParent(), f".{uuid.uuid4().hex}")
    out = fs.create(fresh, False)
    out.write(bytearray(text.encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    none = jvm.org.apache.hadoop.fs.Options.Rename.NONE
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = none
    try:
        context.rename(fresh, at, options)
    except Exception as e:
        fs.delete(fresh, False)
        if "FileAlreadyExistsException" in str(e):
            return False
        raise
    return True


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; none if there is no such folder. Hidden ones are left out."""
    fs, at = file_system(spark, path)
    if not fs.exists(at):
        return []
    return sorted(n for n in (s.getPath().getName() for s in fs.listStatus(at)) if not n.startswith((".", "_")))


def read_text(spark: SparkSession, path: str) -> str:
    fs, at = file_system(spark, path)
    stream = fs.open(at)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def delete(spark: SparkSession, path: str) -> None:
    fs, at = file_system(spark, path)
    fs.delete(at, True)
