"""Streaming forms of the windows and of the incremental join. The reference has no streaming engine: these are extensions.

All read a folder of Parquet as a stream and run with ``availableNow``; the result tables and the checkpoints lie in the shared folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import shared_dir


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet file or folder as a stream."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 64)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isFile():  # a stream reads folders
        folder, name = path.rsplit("/", 1)
        return reader.option("recursiveFileLookup", "true").option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def run_to_table(df: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a streaming query over all that is there and returns the table it wrote."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    df.writeStream.format("parquet").outputMode(mode).option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{at}/out")


def run_batches(df: DataFrame, each: Callable[[DataFrame, int], None]) -> str:
    """Runs ``each`` on every micro-batch; returns the checkpoint folder."""
    at = f"{shared_dir(df.sparkSession)}/stream-{uuid.uuid4().hex}"
    df.writeStream.foreachBatch(each).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return at


def complete_counts(df: DataFrame, keys: list, late: str = "1 day", width: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Event-time windows of a stream with ``ts``, closed by the watermark (the end of a bounded stream closes the rest by a flush row)."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return df.withWatermark("ts", late).groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).alias("total"))


def sessions(df: DataFrame, key: str, gap: str, late: str = "1 day") -> DataFrame:
    return df.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))


def distinct_within(df: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    return df.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)
