"""Small driver-side files in any store that Spark can reach, by Hadoop's file systems."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import SparkSession, functions as F


def _path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


def read_text(spark: SparkSession, path: str) -> str | None:
    p, fs = _path(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Replace a file as a whole: readers see the old or the new one."""
    part, fs = _path(spark, f"{path}.tmp")
    out = fs.create(part, True)
    try:
        out.write(bytearray(text.encode()))
        out.hsync()
    finally:
        out.close()
    jvm = spark.sparkContext._jvm
    rename = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = rename
    target = jvm.org.apache.hadoop.fs.Path(path)
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(part, target, options)


def delete(spark: SparkSession, path: str) -> None:
    p, fs = _path(spark, path)
    fs.delete(p, True)


def read_json(spark: SparkSession, path: str, default: Any = None) -> Any:
    text = read_text(spark, path)
    return default if text is None else json.loads(text)


def write_json(spark: SparkSession, path: str, value: Any) -> None:
    write_text(spark, path, json.dumps(value, indent=2, sort_keys=True) + "\n")


def copy(spark: SparkSession, source: str, target: str) -> None:
    """Copy a folder under a temporary name, then give it its own."""
    a, fs = _path(spark, source)
    part, there = _path(spark, f"{target}.tmp")
    there.delete(part, True)
    there.mkdirs(part.getParent())
    spark.sparkContext._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, a, there, part, False, spark.sparkContext._jsc.hadoopConfiguration())
    there.rename(part, _path(spark, target)[0])


def checksums(spark: SparkSession, folder: str) -> dict[str, str]:
    """SHA-256 of every data file below a folder, by its path there."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    rows = files.select("path", F.sha2("content", 256).alias("sha")).collect()
    root = folder.rstrip("/").rsplit("/", 1)[-1]
    return {r.path.split(f"/{root}/", 1)[-1]: r.sha for r in sorted(rows)}
