"""Digitizer CSV files: delimited lines with board, channel, time tag and the samples to the end of the line."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.order import numbered

TO_PS = {"ps": 1, "ns": 1_000, "us": 1_000_000, "ms": 1_000_000_000, "s": 1_000_000_000_000}


@dataclass(frozen=True)
class WaveFormat:
    """Where a line's columns are (from 0) and the unit of its time tag."""

    delimiter: str = ";"
    board: int = 0
    channel: int = 1
    timetag: int = 2
    samples: int = 7
    unit: str = "ps"
    header: str = r"^\s*(BOARD|HEADER|META)"


FORMATS = {"vx2730": WaveFormat()}


def register_format(name: str, spec: WaveFormat) -> None:
    FORMATS[name] = spec


def parse(lines: DataFrame, spec: WaveFormat) -> DataFrame:
    """lines has `value`.  Headers and lines without a time tag go; samples that are no numbers become null."""
    cells = F.split("value", "\\Q" + spec.delimiter + "\\E", -1)
    rows = lines.filter(~F.regexp_like("value", F.lit(spec.header)) & (F.trim("value") != "")).withColumn("c", cells)
    number = lambda i, kind: F.get("c", F.lit(i)).try_cast(kind)
    samples = F.transform(F.filter(F.slice("c", spec.samples + 1, F.greatest(F.lit(0), F.size("c") - spec.samples)), lambda x: F.trim(x) != ""), lambda x: x.try_cast("int"))
    return rows.select(number(spec.board, "short").alias("board"), number(spec.channel, "short").alias("channel"), (number(spec.timetag, "long") * TO_PS[spec.unit]).alias("timestamp"), samples.alias("wave"), *[c for c in lines.columns if c != "value"]).filter("timestamp is not null")


def read(spark: SparkSession, path: str, fmt: str = "vx2730") -> DataFrame:
    """Rows of all files under path, with the file and the channel that its name gives (-1: none)."""
    lines = spark.read.text(path).withColumn("file", F.input_file_name())
    return parse(lines, FORMATS[fmt]).withColumn("file_channel", F.coalesce(F.regexp_extract("file", r"CH(\d+)", 1).try_cast("int"), F.lit(-1)))


def read_stream(spark: SparkSession, path: str, fmt: str = "vx2730") -> DataFrame:
    return parse(spark.readStream.text(path), FORMATS[fmt])


def structure(rows: DataFrame, baseline_samples: int | tuple[int, int] = (0, 40), dt: int = 2, length: int | None = None) -> DataFrame:
    """Rows (timestamp, board, channel, wave) as records with ids from 0 by (timestamp, board, channel, file).

    The baseline is the mean of the readable samples in a range, counted from the first sample (a number: the first so many); without any
    it is null.  With a length waves are cut, or filled up with 0; event_length stays the true one, at most the length.
    """
    first, last = baseline_samples if isinstance(baseline_samples, tuple) else (0, baseline_samples)
    head = F.filter(F.slice("wave", first + 1, max(0, last - first)), lambda x: x.isNotNull())
    total = F.aggregate(head, F.lit(0.0), lambda a, x: a + x)
    n = F.coalesce(F.size("wave"), F.lit(0))
    r = rows.withColumns({"baseline": F.when(F.size(head) > 0, total / F.size(head)), "dt": F.lit(dt), "polarity": F.lit("unknown"), "time": F.floor(F.col("timestamp") / 1000)})
    r = r.withColumn("event_length", n if length is None else F.least(n, F.lit(length)))
    if length is not None:
        zeros = F.array_repeat(F.lit(0), F.greatest(F.lit(0), F.lit(length) - n))
        r = r.withColumn("wave", F.slice(F.concat("wave", zeros), 1, length))
    order = [c for c in ("timestamp", "board", "channel", "file") if c in r.columns]
    return numbered(r, order, "record_id")
