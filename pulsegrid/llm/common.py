"""Helpers that the corpus operators share: scratch tables, word patterns, the hold-out rule."""

from __future__ import annotations

import gc
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
GAPS = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; a temporary one only where none is set and all is one process."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="pulsegrid-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared scratch folder and reads it again: what follows no longer depends on executors' local disks.

    The shuffle files behind df are of no more use then, so the driver is asked to let them go.
    """
    spark, schema = df.sparkSession, df.schema
    path = f"{scratch_dir(spark)}/pulsegrid/{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    df.write.parquet(path)
    del df
    gc.collect()
    spark._jvm.System.gc()
    made = spark.read.schema(schema).parquet(path)
    made.scratch_path = path
    return made


#: Paths cut within the scopes that are open, innermost last.
_scopes: list[list[str]] = []


@contextmanager
def scope(paths: list[str]):
    """While open, the paths that cut() writes are noted in `paths`."""
    _scopes.append(paths)
    try:
        yield
    finally:
        _scopes.pop()


def release(paths: list[str], reader: DataFrame) -> None:
    """Deletes the noted tables but for those that `reader` reads, and forgets them."""
    spark = reader.sparkSession
    read = [f.split("/pulsegrid/", 1)[-1].split("/", 1)[0] for f in reader.inputFiles() if "/pulsegrid/" in f] if paths else []
    for path in [p for p in paths if p.rsplit("/", 1)[-1] not in read]:
        old = spark._jvm.org.apache.hadoop.fs.Path(path)
        old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
        paths.remove(path)


def bounded(df: DataFrame, rows: int = 1 << 18, size: int = 4 << 20) -> DataFrame:
    """A table made by cut(), marked for broadcast if it has at most so many rows and bytes; else as it is, to be shuffled."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength() > size:
        return df
    n = df.count()
    if n > rows:
        return df
    sent = F.broadcast(df)
    sent.broadcast_rows = n
    return sent


def drop_cut(df: DataFrame) -> None:
    """Deletes the files of a table made by cut() that nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def arrow_batches(spark: SparkSession, rows: int = 256, size: str = "8m") -> None:
    """Whole texts cross to Python in batches of so many rows and bytes, which bounds a worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def crc_mod(col: Column, n: int) -> Column:
    return F.crc32(col.cast("string").cast("binary")) % n


def unit_hash(*cols: Column) -> Column:
    """A number in [0, 1) that depends on the columns' values only."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11) / F.lit(float(1 << 53))


def n_words(text: Column) -> Column:
    """Number of words; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def bound(value: Column, use) -> Column:
    """use(value), with the value worked out once: inside a lambda an expression would be evaluated for every element."""
    return F.element_at(F.transform(F.array(value), use), 1)
