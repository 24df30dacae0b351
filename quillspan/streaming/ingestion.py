"""Uploads as a stream: new records are cut into chunks and written once each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from quillspan.core.workspace import path_exists
from quillspan.operators.ingest import natural_chunks


def ingest_stream(records: DataFrame, target: str, checkpoint: str, id_col: str = "doc_id", text_col: str = "text", buckets: int = 16) -> StreamingQuery:
    """Reads a stream of records, cuts each new one and writes its chunks under ``target``/chunks.

    Each record is written exactly once: every micro-batch goes to a folder
    named by its number, overwritten if the batch is repeated after a failure;
    within a batch a repeated id counts once, and ids that an earlier batch has
    written, kept by themselves under ``target``/ids, are left out, however
    much later they are delivered again. The query ends when all input present
    has been read.
    """
    seen = StructType([StructField(id_col, records.schema[id_col].dataType), StructField("batch", LongType())])

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = batch.where(F.col(id_col).isNotNull()).dropDuplicates([id_col])
        if number and path_exists(spark, f"{target}/ids"):
            # A repeated batch must not meet its own ids.
            earlier = spark.read.schema(seen).parquet(f"{target}/ids").where(F.col("batch") < number)
            fresh = fresh.join(earlier.select(id_col), id_col, "left_anti")
        chunks = natural_chunks(fresh, id_col, text_col).withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(buckets)))
        chunks.write.mode("overwrite").parquet(f"{target}/chunks/batch={number}")
        fresh.select(id_col).write.mode("overwrite").parquet(f"{target}/ids/batch={number}")

    return records.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def deduplicated_stream(records: DataFrame, time: str, keys: list[str], delay: str = "7 days") -> DataFrame:
    """The stream without repeated deliveries that arrive within ``delay`` of each other."""
    return records.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def windowed_counts(events: DataFrame, time: str = "ts", by: str = "event_type", width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """(start, by, n): tumbling-window counts with late data up to ``delay``; works on a table as well as on a stream."""
    w = events.withWatermark(time, delay).groupBy(F.window(time, width), by).agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.col("window.start").alias("start"), by, "n")
