"""Time ranges, chunks and checks over rows with `time`, `dt`, `length` (all in one unit) and `row_id`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .order import numbered, running_sum, with_previous

TIME_ORDER = ["time", "row_id"]


def endtime(df: DataFrame, unit: int = 1, dt: int | None = None) -> DataFrame:
    """Adds `endtime`: a column of that name as it is, else time + dt * length, else (no length) the time itself."""
    if "endtime" in df.columns:
        return df
    if "length" not in df.columns:
        return df.withColumn("endtime", F.col("time"))
    return df.withColumn("endtime", F.col("time") + resolved_dt(df, dt) * F.col("length") * unit)


def resolved_dt(df: DataFrame, dt: int | None = None) -> Column:
    """The sampling interval: the column `dt`, else the given one, else an error."""
    if "dt" in df.columns:
        return F.col("dt")
    if dt is None or dt <= 0:
        raise ValueError("rows have no dt and none is given")
    return F.lit(dt)


def absolute_time(timestamp: Column, offset: Column, dt_ns: Column, pre_trigger_ps: int = 0) -> Column:
    """Time (ps) of a sample `offset` samples after the one that the time stamp points at."""
    return timestamp - F.lit(pre_trigger_ps) + offset * dt_ns * 1000


def absolute_window(timestamp: Column, position: Column, start: Column, end: Column, dt_ns: Column, pre_trigger_ps: int = 0) -> tuple[Column, Column]:
    """Times (ps) of a sample window [start, end) whose time stamp points at `position`."""
    return tuple(absolute_time(timestamp, x - position, dt_ns, pre_trigger_ps) for x in (start, end))


def to_samples(time: Column, dt: int) -> Column:
    """Whole samples in a time, rounded down (also below 0)."""
    return ((time - F.pmod(time, F.lit(dt))) / F.lit(dt)).cast("long")


def to_time(samples: Column, dt: int) -> Column:
    return samples * F.lit(dt)


def select_range(df: DataFrame, start: int, end: int, strict: bool = False) -> DataFrame:
    """Rows that overlap [start, end), or lie in it if strict.  A bound on a stored `time` reaches the scan; for a derived time see views."""
    keep = (F.col("time") >= start) & (F.col("endtime") <= end) if strict else (F.col("time") < end) & (F.col("endtime") > start)
    return df.filter(keep)


def closed_window(df: DataFrame, first: int | None, last: int | None, time: str = "time") -> DataFrame:
    """Rows with first <= time <= last; None is open."""
    for test in ([] if first is None else [F.col(time) >= first]) + ([] if last is None else [F.col(time) <= last]):
        df = df.filter(test)
    return df


def index_range(df: DataFrame, start: int, end: int) -> DataFrame:
    """As an index by start answers: rows that begin in [start, end) and end after start.  Rows that begin earlier and reach in are not found."""
    return df.filter((F.col("time") >= start) & (F.col("time") < end) & (F.col("endtime") > start))


def index_point(df: DataFrame, time: int) -> DataFrame:
    """The last row that begins at or before the time, if it lasts beyond it."""
    last = df.filter(F.col("time") <= time).agg(F.max_by(F.struct(*df.columns), F.struct(*TIME_ORDER)).alias("row"))
    return last.filter("row is not null").select("row.*").filter(F.col("endtime") > time)


def overlaps(df: DataFrame, start: int, end: int) -> DataFrame:
    """One row: whether index_range finds any."""
    return index_range(df, start, end).agg((F.count("*") > 0).alias("overlaps"))


def clip(df: DataFrame, start: int, end: int) -> DataFrame:
    """Trims rows to the range by whole samples; rows without samples left go."""
    skip = F.greatest(F.lit(0), F.ceil((F.lit(start) - F.col("time")) / F.col("dt")))
    t = F.col("time") + skip * F.col("dt")
    left = F.least(F.col("length") - skip, F.floor((F.lit(end) - t) / F.col("dt")))
    return endtime(df.drop("endtime").withColumns({"time": t.cast("long"), "length": left.cast("long")}).filter(F.col("length") > 0))


def breaks(df: DataFrame, threshold: int, least: int = 1, **how) -> DataFrame:
    """Adds `segment`: a new one begins where a row starts more than the threshold after the row before ends.

    Segments under `least` rows go, and the others are numbered without them.
    """
    d = with_previous(df, TIME_ORDER, {"_end": "endtime"}, **how)
    new = F.when(F.col("_end").isNull() | (F.col("time") - F.col("_end") > threshold), 1).otherwise(0)
    d = running_sum(d, new, TIME_ORDER, "_segment", **how).drop("_end")
    kept = d.groupBy("_segment").agg(F.count("*").alias("_n")).filter(F.col("_n") >= least).drop("_n")
    return d.join(numbered(kept, ["_segment"], "segment"), "_segment").drop("_segment")


def tumbling(df: DataFrame, width: int, origin: int) -> DataFrame:
    """A row for each window of a fixed width that a row overlaps; rows over a bound stand in both windows."""
    first = F.floor((F.col("time") - origin) / width)
    last = F.greatest(first, F.floor((F.col("endtime") - 1 - origin) / width))
    return df.withColumn("window", F.explode(F.sequence(first, last)))


def by_count(df: DataFrame, size: int, **how) -> DataFrame:
    """Adds `chunk`: so many rows each in time order, the last one fewer."""
    return numbered(df, TIME_ORDER, "_n", **how).withColumn("chunk", F.floor(F.col("_n") / size)).drop("_n")


def split_at(df: DataFrame, time: int) -> tuple[DataFrame, DataFrame]:
    """Rows that begin before the time, and the others."""
    return df.filter(F.col("time") < time), df.filter(F.col("time") >= time)


def to_boundaries(df: DataFrame, bounds: list[int]) -> DataFrame:
    """A row for each chunk between sorted bounds that a row overlaps; rows over a bound stand on both sides.  A list of bounds is short."""
    edges = sorted(bounds)
    below = lambda x: F.size(F.filter(F.array(*map(F.lit, edges)), lambda b: b <= x))
    if not edges:
        return df.withColumn("chunk", F.lit(0))
    first = below(F.col("time"))
    return df.withColumn("chunk", F.explode(F.sequence(first, F.greatest(first, below(F.col("endtime") - 1)))))


def chunk_infos(df: DataFrame, chunk: str = "chunk") -> DataFrame:
    """Per chunk: start_time, end_time, n_records."""
    return df.groupBy(chunk).agg(F.min("time").alias("start_time"), F.max("endtime").alias("end_time"), F.count("*").alias("n_records"))


def rechunk(infos: DataFrame, target: int, most: int | None = None) -> DataFrame:
    """infos (chunk, n_records) with `target_chunk`: small chunks are put together until they reach the target.

    A chunk of `most` rows or more (twice the target) stays alone and is cut into `parts` of the target.  Which chunks meet depends on all
    before, so the infos, one row per chunk, are walked in one sorted stream.
    """
    from .clusters import streamed

    most = target * 2 if most is None else most

    def steps(col, state):
        import numpy as np

        number, held = state or (0, 0)
        out = []
        for n in col("n_records").tolist():
            if n >= most:
                number += held > 0
                out.append(number)
                number, held = number + -(-n // target), 0
                continue
            out.append(number)
            held += n
            if held >= target:
                number, held = number + 1, 0
        return np.asarray(out, np.int64), (number, held)

    rows = infos.filter("n_records > 0").withColumn("_all", F.lit(0))
    walked = streamed(rows, ["_all"], ["chunk"], steps).drop("_all").withColumnRenamed("part", "target_chunk")
    return walked.withColumn("parts", F.when(F.col("n_records") >= most, F.ceil(F.col("n_records") / target)).otherwise(1).cast("int"))


def halo(df: DataFrame, size: int, left: int, right: int, **how) -> DataFrame:
    """Chunks of `size` rows with the halo rows before and after: adds `chunk` and `main` (whether the row is the chunk's own)."""
    d = numbered(df, TIME_ORDER, "_n", **how)
    own = F.floor(F.col("_n") / size)
    reach = F.sequence(F.greatest(F.lit(0), F.floor((F.col("_n") - right) / size)), F.floor((F.col("_n") + left) / size))
    last = d.agg(F.floor((F.count("*") - 1) / size).alias("_last"))  # one row
    out = d.withColumn("_own", own).withColumn("chunk", F.explode(reach)).join(F.broadcast(last)).filter("chunk <= _last")
    return out.withColumn("main", F.col("chunk") == F.col("_own")).drop("_n", "_own", "_last")


def continuity(infos: DataFrame, largest_gap: int = 0, allow_gaps: bool = False) -> DataFrame:
    """One row: chunks, gaps above the largest one allowed, overlaps, the widest gap, and whether the sequence is valid."""
    d = with_previous(infos, ["start_time", "chunk"], {"_end": "end_time"})
    gap = F.col("start_time") - F.col("_end")
    sums = d.agg(F.count("*").alias("n_chunks"), F.count_if(gap > largest_gap).alias("n_gaps"), F.count_if(gap < 0).alias("n_overlaps"), F.coalesce(F.max(F.when(gap > largest_gap, gap)), F.lit(0)).alias("max_gap"))
    return sums.withColumn("is_valid", (F.col("n_overlaps") == 0) & (F.lit(allow_gaps) | (F.col("n_gaps") == 0)))


def boundary_check(df: DataFrame, start: int, end: int) -> DataFrame:
    """One row: rows that start before or end after a chunk's range."""
    early, late = F.col("time") < start, F.col("endtime") > end
    return df.agg(F.count("*").alias("n_records"), F.count_if(early).alias("n_before_start"), F.count_if(late).alias("n_after_end")).withColumn("violations", F.col("n_before_start") + F.col("n_after_end"))


def within_chunk(df: DataFrame, start: int, end: int) -> DataFrame:
    """df; reading a row outside the range is an error."""
    ok = (F.col("time") >= start) & (F.col("endtime") <= end)
    return df.filter(F.when(ok, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("row outside its chunk: "), F.col("row_id").cast("string"))).cast("boolean")))


def endtime_check(df: DataFrame, tolerance: int = 0, unit: int = 1) -> DataFrame:
    """One row: how many stored ends differ from time + dt * length by more than the tolerance, and by how much at most."""
    off = F.abs(F.col("endtime") - (F.col("time") + F.col("dt") * F.col("length") * unit))
    return df.agg(F.count("*").alias("n_records"), F.count_if(off > tolerance).alias("n_mismatches"), F.coalesce(F.max(off), F.lit(0)).alias("max_difference"))


def monotonic(df: DataFrame, field: str = "time", order: str = "row_id", strict: bool = False, **how) -> DataFrame:
    """One row: rows, violations of (strict) increase in row order, the row before the first one, smallest and largest step."""
    d = with_previous(df, [order], {"_before": field, "_row": order}, **how)
    step = F.col(field) - F.col("_before")
    bad = step <= 0 if strict else step < 0
    sums = d.agg(F.count("*").alias("n_records"), F.count_if(bad).alias("n_violations"), F.min(F.when(bad, F.col("_row"))).alias("first_violation"), F.coalesce(F.min(step), F.lit(0)).alias("min_diff"), F.coalesce(F.max(step), F.lit(0)).alias("max_diff"))
    return sums.withColumn("is_sorted", F.col("n_violations") == 0)


def time_range(df: DataFrame) -> DataFrame:
    """One row: first time and last end."""
    return df.agg(F.min("time").alias("t_min"), F.max("endtime").alias("t_max"))


def order_checks(df: DataFrame, keys: list[str], **how) -> DataFrame:
    """Per key: rows, steps back in time in row order, and overlaps in time order.  Neither order is made in one task per key."""
    by_row = with_previous(df, ["row_id"], {"_before": "time"}, keys, **how)
    back = by_row.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(F.col("time") < F.col("_before")).alias("steps_back"), F.min("time").alias("t_min"), F.max("endtime").alias("t_max"))
    by_time = with_previous(df, TIME_ORDER, {"_end": "endtime"}, keys, **how)
    laps = by_time.groupBy(*keys).agg(F.count_if(F.col("_end") > F.col("time")).alias("overlaps"))
    return back.join(laps, keys).select(*keys, "n", "steps_back", "overlaps", "t_min", "t_max")


def concat_sorted(parts: list[DataFrame]) -> DataFrame:
    """The rows of all parts in time order."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy(*TIME_ORDER)


def write_index(df: DataFrame, path: str, ranges: int | None = None) -> None:
    """Writes df in ranges of time, each file sorted, so that a bound on time skips files and row groups by their statistics."""
    dealt = df.repartitionByRange(ranges, "time") if ranges else df.repartitionByRange("time")
    dealt.sortWithinPartitions("time").write.mode("overwrite").parquet(path)
