"""Registered queries over time ranges and chunks, and SQL that gives the same rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import timeops
from ..operators.order import numbered
from .catalogue import WINDOW
from .registry import query
from .views import EPOCH_US, INTERVALS, intervals, table

T0, T1 = 5 * 86_400_000_000, 9 * 86_400_000_000
HOUR, DAY = 3_600_000_000, 86_400_000_000
IV = f"WITH {INTERVALS}"
ONE = f"{IV}, x AS (SELECT * FROM intervals)"


def rows(spark, sf_dir, first=None, last=None) -> DataFrame:
    return timeops.endtime(intervals(spark, sf_dir, first, last))


@query(f"{IV} SELECT row_id, time, endtime FROM intervals WHERE time < {T1} AND endtime > {T0}")
def time_select(spark, sf_dir):
    return timeops.select_range(rows(spark, sf_dir, T0, T1), T0, T1).select("row_id", "time", "endtime")


@query(f"{IV} SELECT row_id, time, endtime FROM intervals WHERE time >= {T0} AND endtime <= {T1}")
def time_select_strict(spark, sf_dir):
    return timeops.select_range(rows(spark, sf_dir, T0, T1), T0, T1, True).select("row_id", "time", "endtime")


@query(f"{IV} SELECT row_id, time FROM intervals WHERE time BETWEEN {T0} AND {T1}")
def time_window_closed(spark, sf_dir):
    return timeops.closed_window(rows(spark, sf_dir, T0, T1), T0, T1).select("row_id", "time")


@query(f"{IV} SELECT row_id, time, endtime FROM intervals WHERE time >= {T0} AND time < {T1} AND endtime > {T0}")
def time_index_range(spark, sf_dir):
    return timeops.index_range(rows(spark, sf_dir, T0, T1), T0, T1).select("row_id", "time", "endtime")


@query(f"{IV}, l AS (SELECT * FROM intervals WHERE time <= {T0} ORDER BY time DESC, row_id DESC LIMIT 1) SELECT row_id, time, endtime FROM l WHERE endtime > {T0}")
def time_index_point(spark, sf_dir):
    return timeops.index_point(rows(spark, sf_dir, last=T0), T0).select("row_id", "time", "endtime")


@query(f"{IV} SELECT count(*) > 0 AS overlaps FROM intervals WHERE time >= {T0} AND time < {T0 + HOUR} AND endtime > {T0}")
def time_index_overlaps(spark, sf_dir):
    return timeops.overlaps(rows(spark, sf_dir, T0, T0 + HOUR), T0, T0 + HOUR)


@query(f"SELECT event_id AS row_id, epoch_us(ts) - {EPOCH_US} AS time FROM events WHERE ts >= TIMESTAMP '2024-01-06 00:00:00' AND ts < TIMESTAMP '2024-01-10 00:00:00'")
def time_range_absolute(spark, sf_dir):
    """Dates as bounds, through the run's epoch."""
    from datetime import UTC, datetime

    from .epoch import Epoch

    epoch = Epoch(datetime(2024, 1, 1, tzinfo=UTC), "us")
    first, last = (epoch.relative(datetime(2024, 1, d, tzinfo=UTC)) for d in (6, 10))
    return rows(spark, sf_dir, first, last).filter((F.col("time") >= first) & (F.col("time") < last)).select("row_id", "time")


@query(f"""{IV}, a AS (SELECT *, greatest(0, CAST(ceil(({T0} - time) / dt) AS BIGINT)) AS skip FROM intervals), b AS (SELECT row_id, dt, time + skip * dt AS time, length - skip AS rest FROM a),
c AS (SELECT row_id, dt, time, least(rest, CAST(floor(({T1} - time) / dt) AS BIGINT)) AS length FROM b) SELECT row_id, time, length, time + dt * length AS endtime FROM c WHERE length > 0""")
def time_clip(spark, sf_dir):
    return timeops.clip(intervals(spark, sf_dir, T0, T1), T0, T1).select("row_id", "time", "length", "endtime")


@query(f"{IV} SELECT row_id, time * 1000 - 5000 + (length - 3) * dt * 1000 AS at, time * 1000 - 5000 + (2 - 3) * dt * 1000 AS begin, time * 1000 - 5000 + (length - 3) * dt * 1000 AS finish, CAST(floor((time - {T0}) / 7000.0) AS BIGINT) AS sample FROM intervals")
def sample_times(spark, sf_dir):
    d = rows(spark, sf_dir).withColumns({"ts": F.col("time") * 1000})
    begin, finish = timeops.absolute_window(F.col("ts"), F.lit(3), F.lit(2), F.col("length"), F.col("dt"), 5000)
    at = timeops.absolute_time(F.col("ts"), F.col("length") - 3, F.col("dt"), 5000)
    return d.select("row_id", at.alias("at"), begin.alias("begin"), finish.alias("finish"), timeops.to_samples(F.col("time") - T0, 7000).alias("sample"))


BREAKS = f"""{IV}, p AS (SELECT *, lag(endtime) OVER (ORDER BY time, row_id) AS prev FROM intervals),
s AS (SELECT *, sum(CASE WHEN prev IS NULL OR time - prev > {WINDOW} THEN 1 ELSE 0 END) OVER (ORDER BY time, row_id) AS seg FROM p),
g AS (SELECT seg, count(*) AS n, min(time) AS t_min, max(endtime) AS t_max FROM s GROUP BY seg)"""


@query(BREAKS + " SELECT row_number() OVER (ORDER BY seg) - 1 AS segment, n, t_min, t_max FROM g")
def split_by_breaks(spark, sf_dir):
    s = timeops.breaks(rows(spark, sf_dir), WINDOW)
    return s.groupBy("segment").agg(F.count("*").alias("n"), F.min("time").alias("t_min"), F.max("endtime").alias("t_max"))


@query(BREAKS + " SELECT row_number() OVER (ORDER BY seg) - 1 AS segment, n, t_min, t_max FROM g WHERE n >= 4")
def split_by_breaks_least(spark, sf_dir):
    s = timeops.breaks(rows(spark, sf_dir), WINDOW, 4)
    return s.groupBy("segment").agg(F.count("*").alias("n"), F.min("time").alias("t_min"), F.max("endtime").alias("t_max"))


@query(f"""{IV}, w AS (SELECT row_id, length, unnest(range(time // {HOUR}, greatest(time // {HOUR}, (endtime - 1) // {HOUR}) + 1)) AS "window" FROM intervals)
SELECT "window", count(*) AS n, CAST(sum(length) AS BIGINT) AS samples FROM w GROUP BY "window" """)
def split_by_time(spark, sf_dir):
    w = timeops.tumbling(rows(spark, sf_dir), HOUR, 0)
    return w.groupBy("window").agg(F.count("*").alias("n"), F.sum("length").alias("samples"))


BY_COUNT = f"{IV}, n AS (SELECT *, (row_number() OVER (ORDER BY time, row_id) - 1) // 700 AS chunk FROM intervals), i AS (SELECT chunk, min(time) AS start_time, max(endtime) AS end_time, count(*) AS n_records FROM n GROUP BY chunk)"


def counted(spark, sf_dir):
    return timeops.chunk_infos(timeops.by_count(rows(spark, sf_dir), 700))


@query(BY_COUNT + " SELECT * FROM i")
def split_by_count(spark, sf_dir):
    return counted(spark, sf_dir)


@query(BY_COUNT + ", g AS (SELECT start_time - lag(end_time) OVER (ORDER BY start_time, chunk) AS gap FROM i) SELECT count(*) AS n_chunks, count(*) FILTER (gap > 1000000) AS n_gaps, count(*) FILTER (gap < 0) AS n_overlaps, coalesce(max(CASE WHEN gap > 1000000 THEN gap END), 0) AS max_gap, count(*) FILTER (gap < 0) = 0 AS is_valid FROM g")
def chunk_continuity(spark, sf_dir):
    return timeops.continuity(counted(spark, sf_dir), 1_000_000, True)


@query(f"{IV} SELECT CASE WHEN time < {T0} THEN 0 ELSE 1 END AS side, count(*) AS n FROM intervals GROUP BY 1")
def split_at(spark, sf_dir):
    sides = timeops.split_at(rows(spark, sf_dir), T0)
    return reduce(DataFrame.unionByName, [s.agg(F.lit(k).alias("side"), F.count("*").alias("n")) for k, s in enumerate(sides)])


@query(f"{IV}, w AS (SELECT *, unnest(range(CAST(time >= {T0} AS INTEGER) + CAST(time >= {T1} AS INTEGER), CAST(endtime - 1 >= {T0} AS INTEGER) + CAST(endtime - 1 >= {T1} AS INTEGER) + 1)) AS chunk FROM intervals) SELECT CAST(chunk AS INTEGER) AS chunk, min(time) AS start_time, max(endtime) AS end_time, count(*) AS n_records FROM w GROUP BY chunk")
def rechunk_to_boundaries(spark, sf_dir):
    return timeops.chunk_infos(timeops.to_boundaries(rows(spark, sf_dir), [T1, T0]))


@query(f"""WITH RECURSIVE {INTERVALS}, d AS (SELECT time // {DAY} AS chunk, count(*) AS n_records FROM intervals GROUP BY 1), o AS (SELECT *, row_number() OVER (ORDER BY chunk) AS rn FROM d),
w AS (SELECT rn, CAST(0 AS BIGINT) AS number, CAST(0 AS BIGINT) AS held, CAST(-1 AS BIGINT) AS mine FROM (SELECT 0 AS rn) UNION ALL
 SELECT o.rn, CASE WHEN o.n_records >= 1400 THEN w.number + CAST(w.held > 0 AS BIGINT) + CAST(ceil(o.n_records / 700.0) AS BIGINT) WHEN w.held + o.n_records >= 700 THEN w.number + 1 ELSE w.number END,
 CASE WHEN o.n_records >= 1400 OR w.held + o.n_records >= 700 THEN 0 ELSE w.held + o.n_records END, CASE WHEN o.n_records >= 1400 THEN w.number + CAST(w.held > 0 AS BIGINT) ELSE w.number END FROM w JOIN o ON o.rn = w.rn + 1)
SELECT o.chunk, o.n_records, w.mine AS target_chunk, CAST(CASE WHEN o.n_records >= 1400 THEN ceil(o.n_records / 700.0) ELSE 1 END AS INTEGER) AS parts FROM o JOIN w USING (rn)""")
def rechunk(spark, sf_dir):
    infos = rows(spark, sf_dir).groupBy(F.floor(F.col("time") / DAY).alias("chunk")).agg(F.count("*").alias("n_records"))
    return timeops.rechunk(infos, 700)


@query(f"""{IV}, n AS (SELECT *, row_number() OVER (ORDER BY time, row_id) - 1 AS n, (count(*) OVER () - 1) // 700 AS last FROM intervals),
h AS (SELECT *, unnest(range(greatest(0, CAST(floor((n - 20) / 700.0) AS BIGINT)), least(last, (n + 10) // 700) + 1)) AS chunk FROM n)
SELECT chunk, chunk = n // 700 AS main, count(*) AS n, min(time) AS t_min, max(endtime) AS t_max FROM h GROUP BY 1, 2""")
def halo_chunks(spark, sf_dir):
    h = timeops.halo(rows(spark, sf_dir), 700, 10, 20)
    return h.groupBy("chunk", "main").agg(F.count("*").alias("n"), F.min("time").alias("t_min"), F.max("endtime").alias("t_max"))


@query(f"{IV}, c AS (SELECT *, time < {T0} AS early, endtime > {T1} AS late FROM intervals) SELECT count(*) AS n_records, count(*) FILTER (early) AS n_before_start, count(*) FILTER (late) AS n_after_end, count(*) FILTER (early) + count(*) FILTER (late) AS violations FROM c")
def chunk_boundary_check(spark, sf_dir):
    return timeops.boundary_check(rows(spark, sf_dir), T0, T1)


@query(f"{IV} SELECT row_id, time FROM intervals WHERE time >= {T0} AND endtime <= {T1}")
def within_chunk(spark, sf_dir):
    inside = timeops.select_range(rows(spark, sf_dir, T0, T1), T0, T1, True)
    return timeops.within_chunk(inside, T0, T1).select("row_id", "time")


@query(f"{IV}, e AS (SELECT abs(endtime + row_id % 3 - endtime) AS off FROM intervals) SELECT count(*) AS n_records, count(*) FILTER (off > 1) AS n_mismatches, max(off) AS max_difference FROM e")
def endtime_check(spark, sf_dir):
    return timeops.endtime_check(rows(spark, sf_dir).withColumn("endtime", F.col("endtime") + F.col("row_id") % 3), 1)


MONOTONIC = f"{IV}, d AS (SELECT *, time - lag(time) OVER (ORDER BY row_id) AS step, lag(row_id) OVER (ORDER BY row_id) AS before FROM intervals)"


@query(MONOTONIC + " SELECT count(*) AS n_records, count(*) FILTER (step < 0) AS n_violations, min(before) FILTER (step < 0) AS first_violation, min(step) AS min_diff, max(step) AS max_diff, count(*) FILTER (step < 0) = 0 AS is_sorted FROM d")
def monotonic_check(spark, sf_dir):
    return timeops.monotonic(rows(spark, sf_dir))


@query(f"{IV}, d AS (SELECT *, time - lag(time) OVER (ORDER BY time, row_id) AS step, lag(row_id) OVER (ORDER BY time, row_id) AS before, row_number() OVER (ORDER BY time, row_id) - 2 AS r FROM intervals) SELECT count(*) AS n_records, count(*) FILTER (step <= 0) AS n_violations, min(r) FILTER (step <= 0) AS first_violation, min(step) AS min_diff, max(step) AS max_diff, count(*) FILTER (step <= 0) = 0 AS is_sorted FROM d")
def monotonic_check_strict(spark, sf_dir):
    """Over rows renumbered in time order."""
    return timeops.monotonic(numbered(rows(spark, sf_dir), ["time", "row_id"], "n"), order="n", strict=True)


@query(f"{IV}, b AS (SELECT *, time < lag(time) OVER (PARTITION BY channel ORDER BY row_id) AS back, endtime > lead(time) OVER (PARTITION BY channel ORDER BY time, row_id) AS lap FROM intervals) SELECT channel, count(*) AS n, count(*) FILTER (back) AS steps_back, count(*) FILTER (lap) AS overlaps, min(time) AS t_min, max(endtime) AS t_max FROM b GROUP BY channel")
def order_checks(spark, sf_dir):
    return timeops.order_checks(rows(spark, sf_dir), ["channel"])


@query(f"{IV} SELECT min(time) AS t_min, max(endtime) AS t_max FROM intervals")
def time_range(spark, sf_dir):
    return timeops.time_range(rows(spark, sf_dir))


@query(f"{IV}, a AS (SELECT row_id, time FROM intervals UNION ALL SELECT row_id + 1000000, time + 5 FROM intervals) SELECT row_id, row_number() OVER (ORDER BY time, row_id) - 1 AS n FROM a")
def concat_sorted(spark, sf_dir):
    """Two parts as one sorted table, with its row numbers."""
    a = rows(spark, sf_dir).select("row_id", "time")
    b = a.select((F.col("row_id") + 1_000_000).alias("row_id"), (F.col("time") + 5).alias("time"))
    return numbered(timeops.concat_sorted([a, b]), ["time", "row_id"], "n").select("row_id", "n")


@query("SELECT l_orderkey, l_linenumber FROM lineitem ORDER BY l_orderkey, l_linenumber LIMIT 50")
def limit_50(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").orderBy("l_orderkey", "l_linenumber").limit(50)
