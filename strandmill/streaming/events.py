"""Sessions over time, in batch and as a stream; and reads arriving as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def sessions(events: DataFrame, gap_seconds: int = 1800) -> DataFrame:
    """user_id, session_no, start, end, n_events, total of runs of events no more than the gap apart."""
    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    apart = F.timestamp_diff("MICROSECOND", F.lag("ts").over(order), "ts")
    new = F.when(apart.isNull() | (apart > gap_seconds * 1_000_000), 1).otherwise(0)
    run = events.withColumn("new", new).withColumn("session_no", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return run.groupBy("user_id", "session_no").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").alias("n_events"), F.sum("value").alias("total"))


def stream_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """The same over a stream: session windows behind a watermark."""
    windowed = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id")
    return windowed.agg(F.count("*").alias("n_events"), F.sum("value").alias("total")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n_events", "total")


def stream_fastq(spark: SparkSession, path: str) -> DataFrame:
    """Reads of FASTQ files as they appear in a folder; each file is one row of the stream's source."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(path)
    text = F.regexp_replace(F.regexp_replace(F.decode("content", "UTF-8"), "\r", ""), "\n$", "")
    lines = files.select("path", F.split(text, "\n").alias("l"))
    records = F.transform(F.sequence(F.lit(0), F.floor(F.size("l") / 4).cast("int") - 1), lambda i: F.struct(i.cast("long").alias("read_id"), F.regexp_extract(F.col("l")[i * 4], "^.([^ \t]*)", 1).alias("name"), F.col("l")[i * 4 + 1].alias("seq"), F.col("l")[i * 4 + 3].alias("qual")))
    return lines.filter(F.size("l") >= 4).select("path", F.explode(records).alias("r")).select("path", "r.*")
