"""The first event of each key as a stream, one output row per key however often and late it is delivered within the watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def first_events_stream(events: DataFrame, keys: list[str], at: str, watermark: str = "1 hour") -> DataFrame:
    """Drops repeats of a key within the watermark. Its state holds keys of the watermark's span only; null keys count as a value."""
    return events.withWatermark(at, watermark).dropDuplicatesWithinWatermark(keys)


#: Folders that a table's keys are spread over.
BUCKETS = 256


def append_new(stream: DataFrame, table: str, keys: list[str], order: list[str], checkpoint: str):
    """Runs a stream over all that is there into a Parquet table of first rows by key, one folder per batch and bucket of keys.

    A batch is compared with the buckets its own keys fall into, no others are read. A batch that is repeated after a failure writes its folder
    anew and leaves its own earlier rows out of the comparison, so it neither skips nor repeats rows.
    """
    from ..operators.discovery import insert_ignore

    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table)
        there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
        if there:
            mine = [r["b"] for r in batch.select(bucket.alias("b")).distinct().collect()]  # at most BUCKETS
            known = spark.read.parquet(table).where((F.col("batch") != number) & F.col("bucket").isin(mine)).select(*keys)
        else:
            known = batch.select(*keys).limit(0)
        new = insert_ignore(known, batch, keys, order).withColumn("bucket", bucket)
        new.write.mode("overwrite").partitionBy("bucket").parquet(f"{table}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
