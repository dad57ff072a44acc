"""Clusters of interval hits in time: gap rule, gap and width rule, anchored windows.

All rules first cut time into islands: an island ends where the next start lies more than the gap after every end so
far.  Islands are found within measured ranges of time and stitched by a carry per range (see order.py): rows are
shuffled once and no key and no run is ordered in one task.  An island no wider than the cap is one cluster; only wider
ones go through the sequential rule, streamed in sorted batches with the open cluster as the only state.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .order import ROWS_PER_RANGE, before_range, carried, numbered, ranged


def islands(hits: DataFrame, gap: int, keys: list[str] = (), start: str = "start", end: str = "end", tie: str = "hit_id", rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """hits with `island` (0.. within keys, in time order).  Joins an island iff start - largest end so far <= gap."""
    keys = list(keys)
    h = ranged(hits, start, rows_per_range=rows_per_range)
    inside = Window.partitionBy(*keys, "_range").orderBy(start, tie)
    earlier = before_range(h, keys, {"_end": F.max(end)}, {"_end": "max"})
    h = carried(h, keys, earlier)
    before = F.greatest(F.max(end).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.col("_end"))
    h = h.withColumn("_before", before)
    h = h.withColumn("_new", F.when(F.col("_before").isNull() | (F.col(start) - F.col("_before") > gap), 1).otherwise(0))
    offset = before_range(h, keys, {"_offset": F.sum("_new")}, {"_offset": "sum"})
    # The sum runs before the join, so that both read the same sorted ranges.
    h = h.withColumn("_own", F.sum("_new").over(inside.rowsBetween(Window.unboundedPreceding, 0))).drop("_end", "_before", "_new")
    h = carried(h, keys, offset)
    return h.withColumn("island", (F.col("_own") + F.coalesce("_offset", F.lit(0)) - 1).cast("long")).drop("_range", "_own", "_offset")


def greedy_steps(start: np.ndarray, end: np.ndarray, same: np.ndarray, gap: int, cap: int, state: tuple | None) -> tuple[np.ndarray, tuple]:
    """Parts of sorted hits by the gap and width rule.  state: (part, first start, last end, same) of the open cluster."""
    n, i, out = len(start), 0, np.zeros(len(start), np.int64)
    part, first, last, kind = state or (-1, 0, 0, 0)
    is_open = state is not None
    while i < n:
        if not is_open:
            part, first, last, kind = part + 1, int(start[i]), int(end[i]), int(same[i])
            out[i] = part
            i += 1
        reach = i + int(np.searchsorted(start[i:], first + cap, "right"))
        ends = np.maximum.accumulate(np.concatenate(([last], end[i:reach])))
        bad = (start[i:reach] - ends[:-1] > gap) | (ends[1:] - first > cap) | (same[i:reach] != kind)
        k = int(bad.argmax()) if bad.any() else len(bad)
        out[i : i + k] = part
        last = int(ends[k])
        i += k
        is_open = i == n and k == len(bad)
    return out, (part, first, last, kind)


def anchored_steps(time: np.ndarray, window: int, state: tuple | None) -> tuple[np.ndarray, tuple]:
    """Parts of sorted times by anchored windows.  state: (part, first time) of the open window."""
    n, i, out = len(time), 0, np.zeros(len(time), np.int64)
    part, first = state or (-1, 0)
    if state is not None:
        i = int(np.searchsorted(time, first + window, "right"))
        out[:i] = part
    while i < n:
        part, first = part + 1, int(time[i])
        j = int(np.searchsorted(time, first + window, "right"))
        out[i:j] = part
        i = j
    return out, (part, first)


def streamed(df: DataFrame, keys: list[str], order: list[str], steps) -> DataFrame:
    """df with `part`.  steps(columns, state) gives the parts of one key's next sorted rows and the state after them.

    Keys are dealt by hash and sorted on disk; a task sees batches of Arrow's size, so its memory doesn't grow with a key.
    They are dealt by a hash of their own: a repartition by the columns of a join before it is optimised out, and where that
    join turns into a broadcast while it runs, its rows are read by where they were written, so that one key's rows part.
    """

    def run(batches):
        open_key, state = None, None
        for b in batches:
            if not b.num_rows:
                continue
            ids = np.stack([b.column(k).to_numpy(zero_copy_only=False) for k in keys], axis=1)
            cuts = np.flatnonzero((ids[1:] != ids[:-1]).any(axis=1)) + 1
            parts = []
            for lo, hi in zip(np.r_[0, cuts], np.r_[cuts, len(ids)]):
                key = tuple(ids[lo])
                if key != open_key:
                    open_key, state = key, None
                got, state = steps(lambda c, lo=lo, hi=hi: b.column(c).to_numpy(zero_copy_only=False)[lo:hi], state)
                parts.append(got)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate(parts))], [*b.schema.names, "part"])

    dealt = df.repartition(F.xxhash64(*keys)).sortWithinPartitions(*keys, *order)
    return dealt.mapInArrow(run, StructType([*dealt.schema, StructField("part", LongType())]))


def greedy(hits: DataFrame, gap: int, max_width: int, keys: list[str] = (), start: str = "start", end: str = "end", tie: str = "hit_id", same: str | None = None, **how) -> DataFrame:
    """hits with `island` and `part`: a hit joins iff start - end so far <= gap, the cluster stays within max_width, and `same` is equal.

    Ends must not lie before starts.
    """
    keys = list(keys)
    h = islands(hits, gap, keys, start, end, tie, **how)
    kind = F.col(same) if same else F.lit(0)
    wide = h.groupBy(*keys, "island").agg(((F.max(end) - F.min(start) > max_width) | (F.min(kind) != F.max(kind))).alias("_wide"))
    h = h.join(wide, [*keys, "island"])
    plain = h.filter(~F.col("_wide")).drop("_wide").withColumn("part", F.lit(0).cast("long"))

    def steps(col, state):
        kinds = col(same) if same else np.zeros(len(col(start)), np.int64)
        return greedy_steps(col(start), col(end), kinds, gap, max_width, state)

    return plain.unionByName(streamed(h.filter("_wide").drop("_wide"), [*keys, "island"], [start, tie], steps))


def merged(hits: DataFrame, gap: int, max_width: int, keys: list[str], start: str = "start", end: str = "end", tie: str = "hit_id", same: str | None = "dt", **how) -> DataFrame:
    """The rule of merged hits: greedy within channels and one dt; a gap of 0 or less merges nothing."""
    if gap > 0:
        return greedy(hits, gap, max_width, keys, start, end, tie, same, **how)
    return numbered(hits, [start, tie], "island", keys, **how).withColumn("part", F.lit(0).cast("long"))


def anchored(points: DataFrame, window: int, time: str = "t", tie: str = "hit_id", **how) -> DataFrame:
    """points with `island` and `part`: a part holds the points up to and including its first time + window."""
    p = points.withColumn("_s", F.col(time)).withColumn("_e", F.col(time))
    p = islands(p, window, [], "_s", "_e", tie, **how).drop("_s", "_e")
    span = p.groupBy("island").agg((F.max(time) - F.min(time) > window).alias("_wide"))
    p = p.join(span, "island")
    plain = p.filter(~F.col("_wide")).drop("_wide").withColumn("part", F.lit(0).cast("long"))
    steps = lambda col, state: anchored_steps(col(time), window, state)
    return plain.unionByName(streamed(p.filter("_wide").drop("_wide"), ["island"], [time, tie], steps))


def summary(clustered: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """A row per cluster: first start, last end, center (rounded down), hits, distinct (board, channel), area."""
    each = clustered.groupBy(*keys).agg(F.min(start).alias("time_start"), F.max(end).alias("time_end"), F.count("*").alias("n_hits"), F.count_distinct("board", "channel").alias("n_channels"), F.round(F.sum("area"), 3).alias("area"))
    return each.withColumn("center_time", F.expr("(time_start + time_end - pmod(time_start + time_end, 2)) div 2"))


def event_rows(clustered: DataFrame, keys: list[str], time: str = "t") -> DataFrame:
    """Events with members ordered by channel: t_min and t_max are the lowest and highest channel's times."""
    members = F.array_sort(F.collect_list(F.struct("channel", F.col(time).alias("time"), "hit_id", "area", "height")))
    e = clustered.groupBy(*keys).agg(members.alias("m"))
    first, last = F.element_at("m", 1)["time"], F.element_at("m", -1)["time"]
    arrays = {"channels": "channel", "areas": "area", "heights": "height", "timestamps": "time"}
    lists = [F.col("m")[field].alias(name) for name, field in arrays.items()]
    return e.select(*keys, F.size("m").alias("n_hits"), first.alias("t_min"), last.alias("t_max"), *lists).withColumn("dt", F.col("t_max") - F.col("t_min"))
