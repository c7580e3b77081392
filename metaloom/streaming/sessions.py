"""Structured Streaming forms of the batch operators over events."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Microseconds of the day whose events only close windows.
_FAR = 4102444800000000


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream, and at its end two of a far day: the first moves the watermark, and a batch of its own follows."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    base = (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or "").rstrip("/")
    last = f"{base}/stream-end-{uuid.uuid4().hex}"
    far = spark.range(1).select(*[(F.timestamp_micros(F.lit(_FAR)).cast(f.dataType) if f.name == "ts" else F.lit(None).cast(f.dataType)).alias(f.name) for f in events.schema])
    far.write.parquet(f"{last}/end.parquet")
    read = lambda path: spark.readStream.schema(events.schema).option("pathGlobFilter", "*.parquet").parquet(path)
    return read(f"{sf_dir}/events.parquet*").unionByName(read(f"{last}/end.parquet")).withColumn("at", F.col("ts").cast("timestamp"))


def _drain(df: DataFrame) -> DataFrame:
    """Runs the stream over what there is, in append mode into files of the shared folder, and reads them back.

    A window is appended when the watermark has passed its end; a last batch without rows moves the watermark no further, so
    what is still open is closed by events of a far day that `_stream` adds at the end and the queries leave out.
    """
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        raise ValueError("spark.checkpoint.dir is unset: streams write below a folder that the driver and all executors share")
    path = f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"
    writer = df.writeStream.outputMode("append").format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state")
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{path}/rows")


def session_window_stream(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of 30 minutes per user; a gap of exactly 30 minutes keeps the session open."""
    s = _stream(spark, d).withWatermark("at", "1 hour").groupBy(F.session_window("at", "30 minutes"), "user_id").agg(F.count("*").alias("n_events"), F.max(F.unix_micros("at")).alias("last_us"))
    return _drain(s.select("user_id", F.unix_micros("session_window.start").alias("first_us"), "last_us", "n_events")).where(f"first_us < {_FAR}")


def daily_activity_stream(spark: SparkSession, d: str) -> DataFrame:
    s = _stream(spark, d).withWatermark("at", "1 day").groupBy(F.window("at", "1 day"), "event_type").agg(F.count("*").alias("n"))
    return _drain(s.select(F.unix_micros("window.start").alias("us"), "event_type", "n")).where(f"us < {_FAR}").select(F.date_format(F.timestamp_micros("us"), "yyyy-MM-dd").alias("day"), "event_type", "n")


def burst_stream(spark: SparkSession, d: str) -> DataFrame:
    """Bursts of a type's events with gaps of at most ten minutes, from five events on."""
    s = _stream(spark, d).withWatermark("at", "1 hour").groupBy(F.session_window("at", "10 minutes"), "event_type").agg(F.count("*").alias("n_events"), F.min(F.unix_micros("at")).alias("first_us"), F.max(F.unix_micros("at")).alias("last_us"))
    return _drain(s.select("event_type", "first_us", "last_us", "n_events")).where(f"first_us < {_FAR} and n_events >= 5")


def changed_only(spark: SparkSession, folder: str, schema: str, checkpoint: str, target: str, kind: str = "parquet") -> None:
    """Imports the files of a folder that weren't imported before: file names and offsets are kept in the checkpoint, so a second run reads nothing twice."""
    rows = spark.readStream.schema(schema).format(kind).load(folder).withColumn("file_name", F.col("_metadata.file_name"))
    rows.writeStream.outputMode("append").format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


QUERIES = {f.__name__: f for f in (session_window_stream, daily_activity_stream, burst_stream)}
ORACLE_SQL = {
    "session_window_stream": "WITH e AS (SELECT event_id, epoch_us(ts) AS us, user_id FROM events), f AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY user_id ORDER BY us, event_id) <= 1800000000 THEN 0 ELSE 1 END AS fresh FROM e), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS k FROM f) SELECT user_id, min(us) AS first_us, max(us) AS last_us, count(*) AS n_events FROM s GROUP BY user_id, k",
    "burst_stream": "WITH e AS (SELECT event_id, epoch_us(ts) AS us, event_type FROM events), f AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY event_type ORDER BY us, event_id) <= 600000000 THEN 0 ELSE 1 END AS fresh FROM e), s AS (SELECT *, sum(fresh) OVER (PARTITION BY event_type ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS k FROM f) SELECT event_type, min(us) AS first_us, max(us) AS last_us, count(*) AS n_events FROM s GROUP BY event_type, k HAVING count(*) >= 5",
    "daily_activity_stream": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL",
}
