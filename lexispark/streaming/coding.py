"""Dictionary coding of documents as they arrive, and counts of codes in event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.dictionary import match


def read_records(spark: SparkSession, folder: str, schema: str, files: int = 100) -> DataFrame:
    """Records that arrive as parquet files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def coded(records: DataFrame, dictionary: DataFrame) -> DataFrame:
    """record_id, term, codes for each record of a stream: the matcher keeps no state, so it runs on streams as on tables."""
    return match(records, dictionary)


def window_counts(records: DataFrame, dictionary: DataFrame, time: str = "received_at", window: str = "1 day", late: str = "7 days") -> DataFrame:
    """window, code, n: matched codes by event-time window; records later than `late` are left out, their state is dropped.

    Records that are delivered again within that time count once.
    """
    r = records.select("record_id", "text", F.col(time).cast("timestamp").alias("at")).withWatermark("at", late).dropDuplicatesWithinWatermark(["record_id"])
    # the matcher returns its key and the codes, so the event time is the key
    keyed = r.withColumn("key", (F.col("at").cast("double") * 1000).cast("bigint"))
    hits = match(keyed.select("key", "text"), dictionary, key="key")
    hits = hits.select((F.col("key") / 1000.0).cast("timestamp").alias("at"), F.explode("codes").alias("code")).withWatermark("at", late)
    return hits.groupBy(F.window("at", window), "code").agg(F.count("*").alias("n"))


def run(df: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Write a stream to parquet; exactly once, for offsets and commits are in the checkpoint folder."""
    w = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (w.trigger(availableNow=True) if available_now else w).start()
