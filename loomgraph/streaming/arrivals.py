"""Continuous intake: newly written files of a folder, tokenized and appended once per record."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators.tokens import tokenize


def document_stream(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 64) -> DataFrame:
    """Documents of Parquet files as they arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def run_intake(spark: SparkSession, folder: str, schema: str, target: str, checkpoint: str, key: str = "doc_id"):
    """Drain what has arrived into ``target``/documents and ``target``/tokens, once per key; state is in ``checkpoint``.

    Which keys have been seen is the stream's own state, so a micro-batch reads nothing of what was
    written before; a replayed one replaces itself. Records without key are ignored.
    """

    def take(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/documents/batch={number}")
        done = spark.read.parquet(f"{target}/documents/batch={number}")
        tokenize(done).write.mode("overwrite").parquet(f"{target}/tokens/batch={number}")

    fresh = document_stream(spark, folder, schema).where(F.col(key).isNotNull()).dropDuplicates([key])
    query = fresh.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def windowed_counts(events: DataFrame, length: str = "1 hour", lateness: str = "10 minutes", by: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """Counts and sums per event-time window; batch or stream (late rows beyond the watermark are left out of a stream)."""
    return events.withWatermark("ts", lateness).groupBy(F.window("ts", length), *by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("window_start"), *by, "n", "total")
