"""Runs on disk: where their files lie, which files a run has, and when it was taken."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import csv_wave, v1725


@dataclass(frozen=True)
class Layout:
    """How a run's folder and its file names are made: {root}/{run}/RAW by default; channel and file number by regular expressions."""

    template: str = "{root}/{run}/RAW"
    pattern: str = "*"
    channel: str = r"CH(\d+)"
    index: str = r"_(\d+)\.[A-Za-z]+$"

    def path(self, root: str, run: str) -> str:
        return self.template.format(root=root.rstrip("/"), run=run)

    def files(self, spark: SparkSession, root: str, run: str) -> DataFrame:
        """(path, name, length, channel, index) of a run's files, listed without reading them; -1 and 0 where a name has no number."""
        found = spark.read.format("binaryFile").load(f"{self.path(root, run)}/{self.pattern}").select("path", "length")
        name = F.element_at(F.split("path", "/"), -1)
        number = lambda p, none: F.coalesce(F.regexp_extract("name", p, 1).try_cast("int"), F.lit(none))
        return found.withColumn("name", name).withColumns({"channel": number(self.channel, -1), "index": number(self.index, 0)})

    def grouped(self, spark: SparkSession, root: str, run: str) -> DataFrame:
        """(channel, paths): a run's files by channel, in the order of their numbers."""
        one = F.struct("index", "name", "path")
        return self.files(spark, root, run).groupBy("channel").agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["path"]).alias("paths"))


@dataclass(frozen=True)
class Adapter:
    """A reader and a layout under one name.  read(spark, path) gives rows with board or event, channel, timestamp, wave."""

    name: str
    read: object
    layout: Layout = field(default_factory=Layout)
    dt_ns: int = 2
    ticks_are_samples: bool = False

    def load(self, spark: SparkSession, root: str, run: str) -> DataFrame:
        """All rows of a run, time stamps in ps, with run_id and dt."""
        rows = self.read(spark, f"{self.layout.path(root, run)}/{self.layout.pattern}")
        if self.ticks_are_samples:
            rows = rows.withColumn("timestamp", F.col("timestamp") * self.dt_ns * 1000)
        if "board" not in rows.columns:
            rows = rows.withColumn("board", F.lit(0).cast("short"))
        return rows.withColumns({"run_id": F.lit(run), "dt": F.lit(self.dt_ns)})

    def columns(self, rows: DataFrame, unit: str = "ps") -> DataFrame:
        """Board, channel, time stamp (ps or ns), samples and baseline (null where the format has none)."""
        per = {"ps": 1, "ns": 1000}[unit]
        t = F.col("timestamp") if per == 1 else F.floor(F.col("timestamp") / per)
        base = F.col("baseline").cast("double") if "baseline" in rows.columns else F.lit(None).cast("double")
        return rows.select("board", "channel", t.alias("timestamp"), F.col("wave").alias("samples"), base.alias("baseline"))


ADAPTERS: dict[str, Adapter] = {}


def register_adapter(adapter: Adapter) -> None:
    ADAPTERS[adapter.name] = adapter


register_adapter(Adapter("vx2730", lambda spark, path: csv_wave.read(spark, path, "vx2730")))
register_adapter(Adapter("v1725", v1725.read, Layout(pattern="*.bin"), 4, True))


def adapter(name: str) -> Adapter:
    if name not in ADAPTERS:
        raise KeyError(f"no adapter {name}; there are {', '.join(sorted(ADAPTERS))}")
    return ADAPTERS[name]


def discover(spark: SparkSession, root: str, pattern: str = r".+") -> list[str]:
    """Names of the folders under root (one per run) that match."""
    p = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()] if fs.exists(p) else []
    return sorted(n for n in names if re.fullmatch(pattern, n))


def count_rows(spark: SparkSession, path: str, fmt: str = "vx2730") -> int:
    """Data rows of text files, headers and empty lines left out."""
    spec = csv_wave.FORMATS[fmt]
    lines = spark.read.text(path)
    return lines.filter(~F.regexp_like("value", F.lit(spec.header)) & (F.trim("value") != "")).count()


def scan_files(rows: DataFrame) -> DataFrame:
    """Per run, channel and file: rows, bytes, first and last time.  rows: run, channel, file, time, bytes."""
    return rows.groupBy("run", "channel", "file").agg(F.count("*").alias("n_rows"), F.sum("bytes").alias("bytes"), F.min("time").alias("first_time"), F.max("time").alias("last_time"))


def overview(files: DataFrame, first: int | None = None, last: int | None = None) -> DataFrame:
    """Per run: files, channels, rows, bytes and acquisition window; only runs that reach into [first, last)."""
    o = files.groupBy("run").agg(F.count("*").alias("n_files"), F.count_distinct("channel").alias("n_channels"), F.sum("n_rows").alias("n_rows"), F.sum("bytes").alias("bytes"), F.min("first_time").alias("first_time"), F.max("last_time").alias("last_time"))
    o = o.withColumn("duration", F.col("last_time") - F.col("first_time"))
    for test in ([] if first is None else [F.col("last_time") >= first]) + ([] if last is None else [F.col("first_time") < last]):
        o = o.filter(test)
    return o
