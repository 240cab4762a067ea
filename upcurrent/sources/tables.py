"""Readers of the test tables, and what reading and sending them needs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name all executors can reach, under spark.checkpoint.dir. Only a local session without that setting gets a temporary folder of the machine."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors reach")
        root = "file://" + tempfile.gettempdir()
    return f"{root.rstrip('/')}/upcurrent-{name}-{uuid.uuid4().hex}"


def broadcast_within(df: DataFrame, most: int, source: DataFrame | None = None) -> DataFrame:
    """df marked to be broadcast if it, or the table that bounds it, has at most that many rows, which are counted; a larger one is left to the planner."""
    return F.broadcast(df) if (df if source is None else source).limit(most + 1).count() <= most else df


def row_groups(df: DataFrame, most: int) -> int | None:
    """Row groups of the Parquet files df is read from, where these are fewer than most; None for more files or other sources."""
    files = df.inputFiles()
    if not 0 < len(files) < most or not all(f.endswith(".parquet") for f in files):
        return None
    jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    n = 0
    for f in files:
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(f))
        reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(path, conf))
        n += reader.getRowGroups().size()
        reader.close()
    return n


def spread(df: DataFrame) -> DataFrame:
    """df in at least as many partitions with rows as there are cores, for maps that spend their time in Python.

    A row group is read by one task however many splits its file has, so a few small files would leave most cores idle. Inputs of as many files as
    there are cores, as all large ones are, stay as they are: nothing of theirs is looked at or shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    n = row_groups(df, cores)
    return df if (df.rdd.getNumPartitions() if n is None else n) >= cores else df.repartition(cores)
