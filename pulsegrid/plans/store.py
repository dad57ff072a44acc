"""Stored products: export, checksums, and the scan, statistics, diagnosis and cleaning of a store.

A product lies in a folder of its key with Parquet files and, written last, `_meta.json` (schema, rows, lineage, version, checksum): a folder
without it is not finished.  Entries are rows: key, run_id, product, version, rows, size, n_files, created (ms), checksum.
"""

from __future__ import annotations

import json
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.order import running_sum

META = "_meta.json"
ENTRIES = "key string, run_id string, product string, version string, rows long, size long, n_files long, created long, checksum long"
FORMATS = ("parquet", "csv", "json", "orc")
ARRAY_FORMATS = ("npy", "npz", "hdf5")


def checksum(df: DataFrame) -> DataFrame:
    """One row: rows, and a 64-bit checksum that does not depend on their order (equal rows do not cancel out)."""
    h = F.xxhash64(*df.columns)
    return df.agg(F.count("*").alias("rows"), F.sum(F.shiftrightunsigned(h, 1).cast("decimal(38,0)")).alias("_s"), F.bit_xor(h).alias("_x")).select("rows", F.xxhash64("rows", "_s", "_x").alias("checksum"))


def file_checksums(spark: SparkSession, path: str, how: str = "sha256") -> DataFrame:
    """(path, length, checksum) of every file under a path; sha256, md5 or xxhash64.  Files of a product are small parts; each is read whole by one task."""
    c = F.col("content")
    digest = {"sha256": lambda: F.sha2(c, 256), "md5": lambda: F.md5(c), "xxhash64": lambda: F.lower(F.hex(F.xxhash64(c)))}[how]()
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", digest.alias("checksum"))


def verify(before: DataFrame, after: DataFrame) -> DataFrame:
    """Files (path, length, checksum) that changed, came or went."""
    a, b = before.select("path", F.col("checksum").alias("old")), after.select("path", F.col("checksum").alias("new"))
    state = F.when(F.col("old").isNull(), "unknown").when(F.col("new").isNull(), "missing").otherwise("changed")
    return a.join(b, "path", "full").filter(~F.col("old").eqNullSafe(F.col("new"))).select("path", state.alias("problem"))


def export(df: DataFrame, path: str, fmt: str | None = None, compression: str | None = None, partition_by: list[str] = ()) -> None:
    """Writes a product as parquet, orc, csv or json (format by the path's end unless given).

    CSV holds no arrays: they are written as JSON text.  npy and npz files are made on the driver, for products that fit there.
    """
    fmt = fmt or path.rsplit(".", 1)[-1].lower()
    if fmt in ARRAY_FORMATS:
        return export_arrays(df, path, fmt)
    if fmt not in FORMATS:
        raise ValueError(f"no export format {fmt}")
    if fmt == "csv":
        nested = [f.name for f in df.schema if f.dataType.typeName() in ("array", "map", "struct")]
        df = df.withColumns({n: F.to_json(n) for n in nested})
    writer = df.write.mode("overwrite")
    if compression:
        writer = writer.option("compression", compression)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer = writer.option("header", "true")
    writer.format(fmt).save(path)


def export_arrays(df: DataFrame, path: str, fmt: str, most_rows: int = 5_000_000) -> None:
    import numpy as np

    if fmt == "hdf5":
        raise ValueError("hdf5 needs a library that is not there")
    if df.limit(most_rows + 1).count() > most_rows:
        raise ValueError(f"over {most_rows} rows; array files are made on the driver")
    frame = df.toPandas()
    if fmt == "npz":
        np.savez(path, **{c: frame[c].to_numpy() for c in frame})
    else:
        np.save(path, frame.to_records(index=False))


def batch_export(engine, runs: list[str], product: str, path: str, fmt: str = "parquet") -> None:
    """A product of many runs in one job, a folder per run."""
    export(engine.runs(runs, product), path, fmt, partition_by=["run_id"])


def files(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, p = files(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def read_text(spark: SparkSession, path: str) -> str | None:
    fs, p = files(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)  # Spark's readers pass over names that begin with an underscore
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def save(df: DataFrame, path: str, facts: dict) -> DataFrame:
    """Writes a product and, when it is whole, its meta file; reads it again."""
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    sums = checksum(stored).first()
    meta = facts | {"schema": df.schema.simpleString(), "rows": sums["rows"], "checksum": sums["checksum"], "created": int(time.time() * 1000)}
    write_text(spark, f"{path}/{META}", json.dumps(meta, sort_keys=True, default=str))
    return stored


def entries(spark: SparkSession, store: str) -> DataFrame:
    """A row per finished or unfinished product of a store (a few thousand: a folder each).  Unfinished ones have null rows."""
    fs, root = files(spark, store)
    out = []
    for folder in fs.listStatus(root) if fs.exists(root) else []:
        if not folder.isDirectory():
            continue
        key = folder.getPath().getName()
        parts = [f for f in fs.listStatus(folder.getPath()) if f.getPath().getName().endswith(".parquet")]
        text = read_text(spark, f"{store}/{key}/{META}")
        meta = json.loads(text) if text else {}
        size = sum(f.getLen() for f in parts)
        out.append((key, meta.get("run_id"), meta.get("product"), meta.get("version"), meta.get("rows"), size, len(parts), meta.get("created", folder.getModificationTime()), meta.get("checksum")))
    return spark.createDataFrame(out, ENTRIES)


def wanted(e: DataFrame, run_id: str | None = None, product: str | None = None, least_size: int | None = None, most_size: int | None = None, older_than: int | None = None, newer_than: int | None = None) -> DataFrame:
    """Entries by run, product, size in bytes and time of creation (ms)."""
    tests: list[Column] = []
    for value, test in ((run_id, lambda v: F.col("run_id") == v), (product, lambda v: F.col("product") == v), (least_size, lambda v: F.col("size") >= v), (most_size, lambda v: F.col("size") <= v), (older_than, lambda v: F.col("created") < v), (newer_than, lambda v: F.col("created") > v)):
        if value is not None:
            tests.append(test(value))
    for t in tests:
        e = e.filter(t)
    return e


def statistics(e: DataFrame, by: list[str] = ()) -> DataFrame:
    """Per group (all in one without): entries, runs, products, bytes, rows, oldest and newest."""
    return e.groupBy(*by).agg(F.count("*").alias("n_entries"), F.count_distinct("run_id").alias("n_runs"), F.count_distinct("product").alias("n_products"), F.sum("size").alias("size"), F.sum("rows").alias("rows"), F.min("created").alias("oldest"), F.max("created").alias("newest"))


def diagnose(e: DataFrame, versions: dict[str, str]) -> DataFrame:
    """(key, problem): unfinished, no_files, unknown_product, version_mismatch; an entry may have more than one."""
    now = F.create_map(*[F.lit(x) for kv in versions.items() for x in kv]) if versions else F.create_map().cast("map<string,string>")
    tests = {"unfinished": F.col("rows").isNull(), "no_files": F.col("n_files") == 0, "unknown_product": F.col("product").isNotNull() & now[F.col("product")].isNull(), "version_mismatch": now[F.col("product")] != F.col("version")}
    found = F.array_compact(F.array(*[F.when(t, F.lit(n)) for n, t in tests.items()]))
    return e.select("key", F.explode(found).alias("problem"))


ORDERS = {"lru": "created", "oldest": "created", "largest": "size", "by_run": "created", "by_product": "created", "version": "created", "integrity": "created"}


def plan_cleanup(e: DataFrame, strategy: str = "lru", target_size: int | None = None, keep_newer_than: int | None = None, most_entries: int | None = None, problems: DataFrame | None = None, **which) -> DataFrame:
    """The entries to delete, in order: until their sizes reach the target, at most so many; those created later than a time stay.

    lru, oldest and by_*: oldest first; largest: largest first; version, integrity: only entries with such a problem.
    """
    if strategy not in ORDERS:
        raise ValueError(f"no strategy {strategy}")
    e = wanted(e, **which)
    if keep_newer_than is not None:
        e = e.filter(F.col("created") < keep_newer_than)
    if strategy in ("version", "integrity"):
        kinds = ["version_mismatch"] if strategy == "version" else ["unfinished", "no_files"]
        e = e.join(problems.filter(F.col("problem").isin(kinds)), "key", "left_semi")
    place = -F.col("size") if strategy == "largest" else F.col("created")
    e = e.withColumn("_place", place)
    e = running_sum(e, F.col("size"), ["_place", "key"], "_freed")
    e = running_sum(e, F.lit(1), ["_place", "key"], "_n")
    if target_size is not None:
        e = e.filter(F.col("_freed") - F.col("size") < target_size)
    if most_entries is not None:
        e = e.filter(F.col("_n") <= most_entries)
    return e.withColumnsRenamed({"_freed": "freed", "_n": "n"}).drop("_place")


def clean(spark: SparkSession, store: str, plan: DataFrame, dry_run: bool = True) -> dict:
    """Deletes the planned folders (a store's entries are few) unless dry_run; says how many and how many bytes."""
    rows = plan.select("key", "size").collect()
    out = {"dry_run": dry_run, "total": len(rows), "deleted": 0, "failed": 0, "freed": 0}
    for r in rows:
        fs, p = files(spark, f"{store}/{r['key']}")
        done = dry_run or fs.delete(p, True)
        out["deleted" if done else "failed"] += 1
        out["freed"] += r["size"] if done else 0
    return out
