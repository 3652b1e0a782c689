"""Small files on the cluster's file system, through Hadoop's own client.

Only metadata passes here (schemas, commit log entries), never table rows.
"""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class FileExists(Exception):
    """The file was already there."""


def _open(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path, hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    target, fs = _open(spark, path)
    return bool(fs.exists(target))


def names(spark: SparkSession, path: str) -> list[str]:
    """Names inside a folder, sorted; empty when there is no such folder."""
    target, fs = _open(spark, path)
    if not fs.exists(target):
        return []
    return sorted(status.getPath().getName() for status in fs.listStatus(target))


def size(spark: SparkSession, path: str) -> int:
    """Bytes below a folder."""
    target, fs = _open(spark, path)
    return int(fs.getContentSummary(target).getLength())


def length(spark: SparkSession, path: str) -> int:
    """Bytes of a file."""
    target, fs = _open(spark, path)
    return int(fs.getFileStatus(target).getLen())


def is_compressed(spark: SparkSession, path: str) -> bool:
    """Whether a codec belongs to the file's name, so that it is read in one go."""
    target, _ = _open(spark, path)
    codecs = spark._jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(spark._jsc.hadoopConfiguration())
    return codecs.getCodec(target) is not None


def first_line(spark: SparkSession, path: str) -> str | None:
    """The first line of a text file that is not blank, with a carriage return it may
    end with; decompressed by the file's name. None if there is no such line."""
    jvm, (target, fs) = spark._jvm, _open(spark, path)
    codecs = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(spark._jsc.hadoopConfiguration())
    stream = fs.open(target)
    try:
        codec = codecs.getCodec(target)
        lines = jvm.java.util.Scanner(codec.createInputStream(stream) if codec else stream, "UTF-8").useDelimiter("\n")
        while lines.hasNext():
            line = lines.next()
            if line.strip():
                return line
        return None
    finally:
        stream.close()


def read_text(spark: SparkSession, path: str) -> str:
    target, fs = _open(spark, path)
    stream = fs.open(target)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    target, fs = _open(spark, path)
    stream = fs.create(target, True)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()


def publish_text(spark: SparkSession, path: str, text: str, tag: str) -> None:
    """Write aside, then rename without overwrite: readers see all or nothing.

    Raises ``FileExists`` when another writer published the same name first.
    """
    folder, _, name = path.rpartition("/")
    aside = f"{folder}/_{name}.{tag}"
    write_text(spark, aside, text)
    source, _ = _open(spark, aside)
    target, fs = _open(spark, path)
    jvm = spark._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        fs.makeQualified(target).toUri(), spark._jsc.hadoopConfiguration()
    )
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    no_options = spark.sparkContext._gateway.new_array(rename, 0)
    try:
        context.rename(
            fs.makeQualified(source), fs.makeQualified(target), no_options
        )
    except Py4JJavaError as error:
        delete(spark, aside)
        if "FileAlreadyExists" in str(error.java_exception.getClass().getName()):
            raise FileExists(path) from None
        raise


def delete(spark: SparkSession, path: str) -> None:
    target, fs = _open(spark, path)
    fs.delete(target, True)
