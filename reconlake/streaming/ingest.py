"""Incremental ingest: idempotent micro-batches into a log, latest row per key at read, tombstones, windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from reconlake.operators.dedup import latest_by


def ingest_stream(stream: DataFrame, log: str, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Write each micro-batch to its own folder of the log; a batch that runs again overwrites itself.

    Without an interval the query takes what is there and stops.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("ingested_in", F.lit(number)).write.mode("overwrite").parquet(f"{log}/batch={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def current(spark: SparkSession, log: str, keys: list[str], order: list[str], tombstones: DataFrame | None = None) -> DataFrame:
    """The latest row of each key in the log, by batch and then `order`, without the keys in `tombstones`."""
    rows = spark.read.option("basePath", log).parquet(f"{log}/batch=*").drop("batch")
    latest = latest_by(rows, keys, [F.desc("ingested_in"), *[F.desc(c) for c in order]])
    return latest.join(tombstones.select(*keys).distinct(), keys, "left_anti") if tombstones is not None else latest


def file_stream(spark: SparkSession, folder: str, schema: StructType, glob: str, fmt: str = "parquet") -> DataFrame:
    """New files of a folder; a file is taken once, whatever it is called twice under the checkpoint."""
    return spark.readStream.schema(schema).format(fmt).option("pathGlobFilter", glob).load(folder)


def windowed_counts(stream: DataFrame, at: str, keys: list[str], value: str, width: str = "15 minutes", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts and sums per event-time window; rows later than `late` behind the newest are dropped by the watermark."""
    window = F.window(at, width, slide) if slide else F.window(at, width)
    return stream.withWatermark(at, late).groupBy(window.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("window_start"), *keys, "n", "total")
