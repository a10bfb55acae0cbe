"""Tables of a data folder."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table (a file or a folder of files) of the data folder."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def version(spark: SparkSession, folder: str, name: str) -> str:
    """Changes when the files of a table change: their names, sizes and times, hashed."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{name}.parquet")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    seen = sorted(f"{f.getPath()}|{f.getLen()}|{f.getModificationTime()}" for f in found)
    return hashlib.sha256("\n".join(seen).encode()).hexdigest()
