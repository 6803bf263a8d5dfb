"""Folder listings by the driver: which folders exist, never what their files hold."""

from __future__ import annotations

import re
import uuid
from urllib.parse import unquote

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

# Fixed value: characters Spark escapes in the folder name of a partition value.
_ESCAPED = r"""[\x01-\x1f"#%'*/:=?\\\x7f{\[\]^]"""


def folder_name(value: str) -> str:
    """A partition value as Spark spells it in a folder name."""
    return re.sub(_ESCAPED, lambda char: f"%{ord(char[0]):02X}", value)


def plain_name(name: str) -> str:
    """The partition value of a folder's name."""
    return unquote(name)


def _located(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def qualified(spark: SparkSession, path: str) -> str:
    """The full path, scheme included, by which Spark names a file."""
    files, where = _located(spark, path.rstrip("/"))
    return files.makeQualified(where).toString()


def children(spark: SparkSession, path: str) -> list[str] | None:
    """Names directly in a folder; None if there is no such folder."""
    files, where = _located(spark, path)
    return [entry.getPath().getName() for entry in files.listStatus(where)] if files.exists(where) else None


def matching(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that a glob pattern names."""
    files, where = _located(spark, pattern)
    return [entry.getPath().toString() for entry in files.globStatus(where) or ()]


def content(spark: SparkSession, path: str) -> str:
    """Text of a small file."""
    files, where = _located(spark, path)
    stream = files.open(where)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file, whole or not at all; False, and nothing written, if there is one of that name.

    The text goes to a file of another name first, which is renamed without overwriting.
    """
    files, where = _located(spark, path)
    if files.exists(where):
        return False
    draft = spark._jvm.org.apache.hadoop.fs.Path(where.getParent(), f".draft-{uuid.uuid4().hex}")
    stream = files.create(draft, True)
    try:
        stream.write(bytearray(text, "utf-8"))
    finally:
        stream.close()
    hadoop = spark._jvm.org.apache.hadoop.fs
    way = getattr(hadoop, "Options$Rename")
    ways = spark.sparkContext._gateway.new_array(way, 1)
    ways[0] = way.NONE
    try:
        hadoop.FileContext.getFileContext(files.getUri(), spark._jsc.hadoopConfiguration()).rename(draft, where, ways)
    except Py4JJavaError as failure:
        files.delete(draft, False)
        if files.exists(where):
            return False
        raise failure
    return True


def delete(spark: SparkSession, path: str) -> None:
    files, where = _located(spark, path)
    files.delete(where, True)


def first_file(spark: SparkSession, path: str) -> str | None:
    """Some Parquet file below a folder."""
    for name in children(spark, path) or ():
        below = f"{path.rstrip('/')}/{name}"
        if name.endswith(".parquet"):
            return below
        if not name.startswith(("_", ".")):
            found = first_file(spark, below)
            if found:
                return found
    return None


def require(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder that must exist: a mistyped root must not read as no data."""
    names = children(spark, path)
    if names is None:
        raise FileNotFoundError(f"no such folder: {path}")
    return names


def columns_of(spark: SparkSession, path: str) -> list[str] | None:
    """Columns stored in one file below a folder, from its footer, which the driver reads; None for no file."""
    file = first_file(spark, path)
    if file is None:
        return None
    parquet = spark._jvm.org.apache.parquet.hadoop
    where = spark._jvm.org.apache.hadoop.fs.Path(file)
    reader = parquet.ParquetFileReader.open(
        parquet.util.HadoopInputFile.fromPath(where, spark._jsc.hadoopConfiguration())
    )
    try:
        return [field.getName() for field in reader.getFooter().getFileMetaData().getSchema().getFields()]
    finally:
        reader.close()
