"""Streams: Markdown folders as a file stream, registry upserts by batch, and windowed counts of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellumine.plans.tables import kept
from vellumine.sources import registry as R

BUCKETS = 64


def markdown_stream(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content) of new ``*.md`` files as they appear."""
    rows = spark.readStream.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md")
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def upsert_stream(stream: DataFrame, table: str, checkpoint: str, buckets: int = BUCKETS):
    """Upsert a stream of registry rows into a table that is partitioned by a hash of the document's id.

    A batch reads and rewrites the buckets that it touches and no others; what it writes is staged beside the checkpoint first. A
    batch that is run again, after a failure in the midst of its commit too, gives the same rows. Returns the query.
    """
    spark = stream.sparkSession
    schema = T.StructType([*stream.schema.fields, T.StructField("bucket", T.IntegerType())])
    spark.createDataFrame([], schema).write.mode("ignore").partitionBy("bucket").parquet(table)

    def apply(batch: DataFrame, n: int) -> None:
        mark = F.pmod(F.xxhash64(R.document_id()), F.lit(buckets)).cast("int").alias("bucket")
        touched = [r["bucket"] for r in batch.select(mark).distinct().collect()]  # at most ``buckets`` rows
        old = spark.read.schema(schema).parquet(table).filter(F.col("bucket").isin(touched)).drop("bucket")
        new = kept(R.upsert(old, batch).select("*", mark), f"{checkpoint}-staged", "batch")
        new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(table)

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts of events per window and type; later events than ``late`` are dropped by the watermark."""
    windowed = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))
    return windowed.select(F.col("window.start").alias("window_start"), "event_type", "n")
