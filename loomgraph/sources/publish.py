"""Atomic publication of a table folder.

A version is written by Spark's own committer into a staging folder (task retries
and lost executors leave no partial files), renamed to its final name, and then
named in a small pointer file that is itself replaced by a rename. Readers resolve
the pointer first, so they always scan one complete version. The version before the
current one stays for readers that opened it; older ones are deleted.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

POINTER = "_CURRENT"


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def publish(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` as the next version below ``path`` and return a scan of it."""
    spark = df.sparkSession
    version = f"v-{uuid.uuid4().hex}"
    staging, final = f"{path}/_staging-{version}", f"{path}/{version}"
    df.write.parquet(staging)
    jvm, fs = _fs(spark, path)
    at = jvm.org.apache.hadoop.fs.Path
    if not fs.rename(at(staging), at(final)):
        raise OSError(f"cannot publish {final}")
    pointer = at(f"{path}/_pointer-{version}")
    stream = fs.create(pointer, True)
    stream.write(bytearray(version, "utf-8"))
    stream.close()
    options = jvm.org.apache.hadoop.fs.Options.Rename
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(at(path).toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    overwrite = spark.sparkContext._gateway.new_array(options, 1)
    overwrite[0] = options.OVERWRITE
    before = _named(spark, path)
    files.rename(pointer, at(f"{path}/{POINTER}"), overwrite)
    for entry in fs.listStatus(at(path)):
        name = entry.getPath().getName()
        if name.startswith("v-") and name not in (version, before):
            fs.delete(entry.getPath(), True)
    return spark.read.schema(df.schema).parquet(final)


def _named(spark: SparkSession, path: str) -> str | None:
    """The version that the pointer names, if there is one."""
    jvm, fs = _fs(spark, path)
    pointer = jvm.org.apache.hadoop.fs.Path(f"{path}/{POINTER}")
    if not fs.exists(pointer):
        return None
    stream = fs.open(pointer)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def read_current(spark: SparkSession, path: str) -> DataFrame:
    """Scan the version that the pointer names."""
    version = _named(spark, path)
    if version is None:
        raise FileNotFoundError(f"nothing is published at {path}")
    return spark.read.parquet(f"{path}/{version}")


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders below ``path``, none if it does not exist."""
    jvm, fs = _fs(spark, path)
    root = jvm.org.apache.hadoop.fs.Path(path)
    return sorted(e.getPath().getName() for e in fs.listStatus(root) if e.isDirectory()) if fs.exists(root) else []


def remove(spark: SparkSession, path: str) -> None:
    jvm, fs = _fs(spark, path)
    fs.delete(jvm.org.apache.hadoop.fs.Path(path), True)
