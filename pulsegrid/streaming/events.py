"""Streaming forms: gap sessions, islands of interval hits with state, tumbling windows, peak search, time ranges and unions of streams.

Late rows: a watermark says how long a row may come late; state and open windows go once it has passed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import pulses


def sessions(hits: DataFrame, gap: str = "60 seconds", late: str = "10 minutes", time: str = "ts", keys: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """Point hits of a key (a run; a stream of sessions needs one) closer than the gap make one event; state goes once the watermark has passed."""
    grouped = hits.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), *keys)
    return grouped.agg(F.count("*").alias("n_hits"), F.sum("area").alias("area")).select(F.col("w.start").alias("t_min"), F.col("w.end").alias("t_end"), *keys, "n_hits", "area")


def tumbling(hits: DataFrame, width: str = "1 hour", late: str = "10 minutes", time: str = "ts") -> DataFrame:
    return hits.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), "channel").agg(F.count("*").alias("n_hits"), F.sum("area").alias("area")).select(F.col("w.start").alias("t"), "channel", "n_hits", "area")


def islands(hits: DataFrame, gap: int, key: str = "run_id", late: str = "10 minutes", time: str = "ts") -> DataFrame:
    """Islands of interval hits (key, ts, start, end in microseconds, area) as the batch rule makes them: a hit joins if start - largest end so far <= gap.

    The state of a key is its open island.  It is given out when a hit begins beyond the gap, or when the watermark says that none
    can come any more: then the key starts anew, as after a break.  Rows of one micro-batch are put in order; a row that begins before its
    open island widens it.
    """
    out = f"{key} {hits.schema[key].dataType.simpleString()}, time_start long, time_end long, n_hits long, area double"

    def step(ids: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        closed, held = [], state.get if state.exists else None
        if state.hasTimedOut:
            closed.append(held)
            state.remove()
        else:
            rows = pd.concat(list(frames)).sort_values(["start", "end"], kind="stable")
            for s, e, a in zip(rows["start"], rows["end"], rows["area"]):
                if held is not None and s - held[1] <= gap:
                    held = (min(held[0], int(s)), max(held[1], int(e)), held[2] + 1, held[3] + float(a))
                else:
                    closed += [] if held is None else [held]
                    held = (int(s), int(e), 1, float(a))
            state.update(held)
            # Times of the watermark are milliseconds; a timeout must lie beyond it.
            state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs() + 1, (held[1] + gap) // 1000 + 1))
        yield pd.DataFrame([(ids[0], *c) for c in closed], columns=[key, "time_start", "time_end", "n_hits", "area"])

    marked = hits.withWatermark(time, late).groupBy(key)
    return marked.applyInPandasWithState(step, out, "time_start long, time_end long, n_hits long, area double", "append", "EventTimeTimeout")


def signal_peaks(records: DataFrame, smooth: dict | None = None, **limits) -> DataFrame:
    """Peak search over a stream of records, on smoothed waves if settings of the filter are given; heights are those of the searched wave."""
    rows = records if smooth is None else pulses.filtered_waves(records, **smooth)
    return pulses.peak_hits(rows, **limits)


def in_range(stream: DataFrame, start: int | None = None, end: int | None = None, time: str = "time") -> DataFrame:
    """Rows of a stream (or of a stored product taken as one) that overlap [start, end): by `endtime` where there is one."""
    last = "endtime" if "endtime" in stream.columns else time
    for test in ([] if start is None else [F.col(last) > start if last != time else F.col(time) >= start]) + ([] if end is None else [F.col(time) < end]):
        stream = stream.filter(test)
    return stream


def merged(streams: list[DataFrame]) -> DataFrame:
    """The rows of several streams as one; columns go by name."""
    return reduce(DataFrame.unionByName, streams)
