"""The driver's tables seen as detector data.  Times are microseconds since 2024-01-01 unless a column says otherwise."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH_US = 1_704_067_200_000_000


def elapsed():
    return F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', cast(ts AS timestamp_ntz))")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def since(us: int) -> str:
    """SQL literal of the time so many microseconds after the epoch, without a zone."""
    return f"timestamp_ntz'{datetime(2024, 1, 1) + timedelta(microseconds=us)}'"


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval hits: an event begins at its time and lasts `value` seconds; areas are whole hundredths; a user is a record of ten windows."""
    e = table(spark, sf_dir, "events")
    size = F.floor(F.abs("value") * 1_000_000).cast("long")
    hundredths = F.floor(F.col("value") * 100).cast("long")
    sample = (F.col("event_id") % 10 * 100).cast("int")
    return e.select(
        F.col("event_id").alias("hit_id"), elapsed().alias("start"), (elapsed() + size).alias("end"),
        (F.col("user_id") % 2).alias("board"), (F.col("user_id") % 8).alias("channel"), hundredths.alias("area"), hundredths.alias("height"), "event_type",
        F.when(F.col("event_id") % 16 == 0, 4).otherwise(2).alias("dt"), F.col("user_id").alias("record_id"),
        sample.alias("sample_start"), (sample + 50).alias("sample_end"),
    )


HITS = f"""hits AS (SELECT event_id AS hit_id, epoch_us(ts) - {EPOCH_US} AS "start",
  epoch_us(ts) - {EPOCH_US} + CAST(floor(abs(value) * 1000000) AS BIGINT) AS "end", user_id % 2 AS board, user_id % 8 AS channel,
  CAST(floor(value * 100) AS BIGINT) AS area, CAST(floor(value * 100) AS BIGINT) AS height, event_type,
  CASE WHEN event_id % 16 = 0 THEN 4 ELSE 2 END AS dt, user_id AS record_id, CAST(event_id % 10 * 100 AS INTEGER) AS sample_start,
  CAST(event_id % 10 * 100 + 50 AS INTEGER) AS sample_end FROM events)"""


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Waveform records: whole samples, baseline 0, polarity by label parity, time in ps, dt in ns."""
    e = table(spark, sf_dir, "embeddings")
    wave = F.transform("embedding", lambda x: F.floor(x.cast("double") * 1000).cast("int"))
    return e.select(F.col("vec_id").alias("record_id"), (F.col("vec_id") * 1_000_000).alias("t"), F.lit(2).cast("long").alias("dt"), (F.col("label") % 2).alias("board"), F.col("label").alias("channel"), F.lit(0).alias("baseline"), (F.col("label") % 2 == 1).alias("positive"), wave.alias("wave"))


RECORDS = """records AS (SELECT vec_id AS record_id, vec_id * 1000000 AS t, 2 AS dt, label % 2 AS board, label AS channel, 0 AS baseline,
  label % 2 = 1 AS positive, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1000) AS INTEGER)) AS wave FROM embeddings)"""


LONGEST_INTERVAL = 100_000_000


def intervals(spark: SparkSession, sf_dir: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """Records with time, dt, length: an event has up to 100 samples of one second.

    With bounds only events that can matter for times from first to last are read: the bounds are put on the stored column, so the scan
    skips row groups; an interval lasts LONGEST_INTERVAL at most, so one that begins earlier can't reach in.
    """
    e = table(spark, sf_dir, "events")
    if first is not None:
        e = e.filter(f"ts >= {since(first - LONGEST_INTERVAL)}")
    if last is not None:
        e = e.filter(f"ts <= {since(last)}")
    return e.select(F.col("event_id").alias("row_id"), elapsed().alias("time"), F.lit(1_000_000).cast("long").alias("dt"), (F.col("user_id") % 100 + 1).alias("length"), (F.col("user_id") % 8).alias("channel"))


INTERVALS = f"""intervals AS (SELECT *, time + dt * length AS endtime FROM (SELECT event_id AS row_id, epoch_us(ts) - {EPOCH_US} AS time,
  CAST(1000000 AS BIGINT) AS dt, user_id % 100 + 1 AS length, user_id % 8 AS channel FROM events))"""
