"""Files of records into a table, each file once: a file stream whose checkpoint remembers what has been read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def record_stream(spark: SparkSession, path: str, schema: StructType, fmt: str = "json", files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.format(fmt).load(path)


def ingest_new(stream: DataFrame, target: str, checkpoint: str, key: str | None = None, time: str | None = None, late: str = "1 day") -> StreamingQuery:
    """Appends what is new to parquet at `target` and ends when all is read; run again, it goes on from there.

    key: rows that repeat a key are dropped; with `time` only within the watermark `late`, which bounds the state.
    """
    if key and time:
        stream = stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])
    elif key:
        stream = stream.dropDuplicates([key])
    return stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, time: str, *keys: str, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """Counts by time window and keys; windows close when the watermark has passed them."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width).alias("window"), *keys).agg(F.count(F.lit(1)).alias("n"))
