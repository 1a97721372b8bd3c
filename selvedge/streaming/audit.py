"""The audit log as an append-only stream."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from selvedge.session import exists, shared_dir, table, track


def append_audit(source: DataFrame, path: str, checkpoint: str, key: str, event_time: str, within: str) -> None:
    """Append each row of a stream once to the table at path, and return when what is there has been read.

    The checkpoint makes a restart go on where the last batch ended. A key that
    is in the table already, at an event time within the given span of the
    batch's, is left out; the table is laid out by day of event time and only
    those days are read, so the stream keeps no state and no row is ever late. A
    batch that is run again after a failure finds its own rows and adds nothing.
    """

    def append(batch: DataFrame, _: int) -> None:
        rows = batch.withColumn("event_date", F.to_date(event_time)).dropDuplicates([key])
        first, last = rows.agg(F.min("event_date"), F.max("event_date")).first()
        if exists(batch.sparkSession, path):
            known = batch.sparkSession.read.schema(rows.schema).parquet(path)
            near = F.col("event_date").isNull()
            if first is not None:
                near = near | F.expr(f"event_date between date '{first}' - interval {within} and date '{last}' + interval {within}")
            rows = rows.join(known.where(near).select(key).distinct(), key, "left_anti")
        rows.write.mode("append").partitionBy("event_date").parquet(path)

    source.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def hourly_counts(source: DataFrame, event_time: str, watermark: str) -> DataFrame:
    """Tumbling hours of a stream with late rows up to the watermark."""
    return source.withWatermark(event_time, watermark).groupBy(F.window(event_time, "1 hour"), "status").agg(F.count(F.lit(1)).alias("n_rows"))


def audit_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit table as a file stream, one file a batch."""
    schema = table(spark, sf_dir, "audit_log").schema
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{sf_dir}/audit_log.parquet*")  # a pattern, since the table may be one file
    return rows.withColumns({c: F.col(c).cast("timestamp") for c in ("logged_at", "received_at")})


def stream_audit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(hour, status, n_rows) of the table that the stream has appended."""
    folder = f"{shared_dir(spark).rstrip('/')}/selvedge-stream-{uuid.uuid4().hex}"
    track(folder)
    source = audit_source(spark, sf_dir)
    append_audit(source, f"{folder}/audit", f"{folder}/checkpoint", "log_id", "received_at", "7 days")
    if not exists(spark, f"{folder}/audit"):
        return spark.createDataFrame([], "hour timestamp_ntz, status string, n_rows bigint")
    rows = spark.read.schema(source.schema).parquet(f"{folder}/audit")
    return rows.groupBy(F.date_trunc("hour", "logged_at").cast("timestamp_ntz").alias("hour"), "status").agg(F.count(F.lit(1)).alias("n_rows"))
