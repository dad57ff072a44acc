"""Waveform chains: records, windows, merges on a common grid, features of merged hits and of peaklets, peak search, filters."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import kernels
from ..functions.wave import signal
from .order import numbered

RECORD_ORDER = ["timestamp", "pid", "board", "channel", "seq"]
FEATURES = "time_peak long, center_time long, rise_time double, fall_time double, width_25_75 double, rise_time_10_50 double, range_90p_area double, area double, height double, width double"


def build_records(rows: DataFrame, dt_ns: int | None = None) -> DataFrame:
    """Rows (timestamp in ps, board, channel, wave, optionally pid, seq, dt, baseline) as records: dense ids in global order, time in ns, true length."""
    d = rows
    defaults = {"pid": F.lit(0), "seq": F.lit(0).cast("long"), "polarity": F.lit("unknown"), "trigger_type": F.lit(0), "flags": F.lit(0).cast("long")}
    d = d.withColumns({n: c for n, c in defaults.items() if n not in d.columns})
    if "dt" not in d.columns:
        if not dt_ns or dt_ns <= 0:
            raise ValueError("rows have no dt and none is given")
        d = d.withColumn("dt", F.lit(dt_ns))
    d = d.withColumns({"event_length": F.coalesce(F.size("wave"), F.lit(0)), "time": F.floor(F.col("timestamp") / 1000)})
    return numbered(d, RECORD_ORDER, "record_id")


def merged_parts(parts: list[DataFrame]) -> DataFrame:
    """Parts of records as one table, with ids anew."""
    out = parts[0].drop("record_id")
    for p in parts[1:]:
        out = out.unionByName(p.drop("record_id"))
    return numbered(out, RECORD_ORDER, "record_id")


def waves_of(records: DataFrame, ids: DataFrame, start: int = 0, end: int | None = None, corrected: bool = False, pad_to: int | None = None) -> DataFrame:
    """Samples [start, end) of the records named in ids (record_id): `wave`, `n` true samples; corrected: negative-going signals; padded with 0."""
    r = records.join(ids.select("record_id").distinct(), "record_id", "left_semi")
    stop = F.size("wave") if end is None else F.least(F.size("wave"), F.lit(end))
    n = F.greatest(F.lit(0), stop - start)
    part = F.slice("wave", F.lit(start + 1), n)
    if corrected:
        sign = F.when(F.col("positive"), -1.0).otherwise(1.0)
        base, way = F.col("baseline").cast("double"), sign
        part = F.transform(part, lambda x: way * (x - base))
    r = r.withColumns({"n": n, "wave": part})
    if pad_to is not None:
        zero = F.lit(0).cast(r.schema["wave"].dataType.elementType)
        r = r.withColumn("wave", F.slice(F.concat("wave", F.array_repeat(zero, F.greatest(F.lit(0), F.lit(pad_to) - F.col("n")))), 1, pad_to))
    return r.select("record_id", "wave", "n")


def samples(segments: DataFrame, group: str) -> DataFrame:
    """One row per sample of segments (group, board, channel, t0 in ps, dt in ns, wave)."""
    each = segments.select(group, "board", "channel", "dt", "t0", F.posexplode("wave").alias("_i", "value"))
    return each.withColumn("time", F.col("t0") + F.col("_i") * F.col("dt") * 1000).drop("_i", "t0")


def failed(message: Column) -> Column:
    return F.raise_error(message).cast("boolean")


def merge_channels(segments: DataFrame, group: str) -> DataFrame:
    """(group, board, channel, time, dt, value): each channel's samples once.

    Equal samples at one time are one observation; unequal ones, mixed dt, values that are not finite and times off the grid
    are errors.
    """
    s = samples(segments, group).withColumn("value", F.col("value").cast("float"))
    finite = ~F.isnan("value") & (F.abs("value") < float("inf")) & F.col("value").isNotNull()
    s = s.filter(F.when(finite, F.lit(True)).otherwise(failed(F.lit("a sample is not finite"))))
    once = s.groupBy(group, "board", "channel", "time").agg(F.min("value").alias("value"), F.max("value").alias("_high"), F.min("dt").alias("dt"), F.max("dt").alias("_dt"))
    where = F.concat_ws(" ", F.lit("conflicting samples at board, channel, time:"), *[F.col(c).cast("string") for c in ("board", "channel", "time")])
    once = once.filter(F.when(F.col("value") == F.col("_high"), F.lit(True)).otherwise(failed(where)))
    w = Window.partitionBy(group)
    grid = once.withColumns({"_lo": F.min("dt").over(w), "_hi": F.max("_dt").over(w), "_t": F.min("time").over(w)})
    aligned = (F.col("_lo") == F.col("_hi")) & (F.col("dt") > 0) & ((F.col("time") - F.col("_t")) % (F.col("dt") * 1000) == 0)
    fine = grid.filter(F.when(aligned, F.lit(True)).otherwise(failed(F.lit("samples do not share one grid"))))
    return fine.select(group, "board", "channel", "time", "dt", "value")


def summed(channel_samples: DataFrame, group: str) -> DataFrame:
    """(group, time, dt, value): the channels' sum by time, in double, then float."""
    return channel_samples.groupBy(group, "time").agg(F.min("dt").alias("dt"), F.sum(F.col("value").cast("double")).cast("float").alias("value"))


def dense(summed_samples: DataFrame, group: str) -> DataFrame:
    """(group, time_start, time_end, dt, wave): a group's samples on its grid, 0 where there is none.  A group is one pulse."""
    m = summed_samples.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("time", "value"))).alias("m"), F.min("dt").alias("dt"))
    step = F.col("dt") * 1000
    before = F.concat(F.slice("m", 1, 1), F.slice("m", F.lit(1), F.greatest(F.lit(0), F.size("m") - 1)))
    zero = F.lit(0.0).cast("float")
    gap = lambda x, y: F.greatest(F.lit(0), ((x["time"] - y["time"]) / step).cast("int") - 1)
    filled = F.flatten(F.zip_with("m", before, lambda x, y: F.concat(F.array_repeat(zero, gap(x, y)), F.array(x["value"]))))
    first, last = F.element_at("m", 1)["time"], F.element_at("m", -1)["time"]
    return m.select(group, first.alias("time_start"), (last + step).alias("time_end"), "dt", filled.alias("wave"))


def peaklet_waveforms(segments: DataFrame, group: str = "peak_id") -> DataFrame:
    """The summed wave of every peaklet over its merged hits' segments."""
    return dense(summed(merge_channels(segments, group), group), group)


def window_segments(records: DataFrame, windows: DataFrame) -> DataFrame:
    """Signed signals of sample windows: windows (record_id, sample_start, sample_end, ...) joined with records (record_id, t in ps, dt, wave, baseline, positive)."""
    r = records.select("record_id", F.col("t").alias("_t"), "dt", "wave", "baseline", "positive")
    w = windows.join(r, "record_id")
    s, e = F.greatest(F.lit(0), F.col("sample_start")), F.least(F.size("wave"), F.col("sample_end"))
    part = F.transform(F.slice("wave", s + 1, F.greatest(F.lit(0), e - s)), lambda x: x.cast("float"))
    out = w.withColumns({"t0": F.col("_t") + s * F.col("dt") * 1000, "wave": signal(part, F.col("baseline").cast("float"), F.col("positive"))})
    return out.drop("_t", "baseline", "positive")


def merged_features(records: DataFrame, merged: DataFrame, clip_negative: bool = False) -> DataFrame:
    """Per merged hit with a sample window of one record: times, area, height, rise and fall; valid 0 and NaN where no sample is left.

    merged: merged_id, record_id, sample_start, sample_end, and what else is carried.
    """
    s = window_segments(records, merged)
    if clip_negative:
        s = s.withColumn("wave", F.transform("wave", lambda x: F.greatest(x, F.lit(0).cast("float"))))
    n, step = F.size("wave"), F.col("dt") * 1000
    t1 = F.col("t0") + n * step
    s = s.withColumns({"time_start": F.col("t0"), "time_end": t1, "height": F.array_max("wave").cast("double")})
    s = s.withColumn("area", F.aggregate("wave", F.lit(0.0), lambda a, x: a + x.cast("double")))
    s = s.withColumn("max_time", F.col("t0") + (F.array_position("wave", F.array_max("wave")) - 1) * step)
    total = F.col("time_start") + F.col("time_end")
    s = s.withColumns({"center_time": ((total - F.pmod(total, F.lit(2))) / 2).cast("long"), "width": (F.col("time_end") - F.col("time_start")) / 1000.0})
    s = s.withColumns({"rise_time": (F.col("max_time") - F.col("time_start")) / 1000.0, "fall_time": (F.col("time_end") - F.col("max_time")) / 1000.0, "valid": (n > 0).cast("int")})
    for c in ("area", "height", "width", "rise_time", "fall_time"):
        s = s.withColumn(c, F.when(F.col("valid") == 1, F.col(c)).otherwise(float("nan")))
    return s.drop("wave", "t0")


def mapped(df: DataFrame, keep: list[str], wave: str, schema: str, rule) -> DataFrame:
    """Rows of rule(wave, row) for each row: the columns in keep, then those of schema.  rule gives a list of tuples; Arrow batches, no row objects."""
    out = StructType([*df.select(*keep).schema, *StructType.fromDDL(schema)])
    names, kinds = [f.name for f in out], [f.dataType.simpleString() for f in out]
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "array<float>": pa.list_(pa.float32())}

    def run(batches):
        for b in batches:
            cols, rows, at = {c: b.column(c).to_pylist() for c in b.schema.names if c != wave}, [], []
            for i, w in enumerate(b.column(wave)):
                x = np.zeros(0) if not w.is_valid else w.values.to_numpy(zero_copy_only=False)
                got = rule(x, {c: v[i] for c, v in cols.items()})
                rows += got
                at += [i] * len(got)
            kept = [b.column(c).take(pa.array(at, pa.int64())) for c in keep]
            made = [pa.array([r[k] for r in rows], arrow[kinds[len(keep) + k]]) for k in range(len(out) - len(keep))]
            yield pa.RecordBatch.from_arrays([*kept, *made], names)

    return df.mapInArrow(run, out)


def peaklet_features(waveforms: DataFrame, group: str = "peak_id") -> DataFrame:
    """Times of the area's shares, rise, fall, widths, area and height of every peaklet's wave."""
    rule = lambda w, r: [kernels.pulse_features(w, r["time_start"], r["time_end"], r["dt"])]
    cols = [group, "time_start", "time_end"]
    return mapped(waveforms.select(*cols, "dt", "wave"), cols, "wave", FEATURES, rule)


def waveform_widths(hits: DataFrame, records: DataFrame, rate_ghz: float = 0.5, low: float = 0.1, high: float = 0.9, interpolate: bool = True) -> DataFrame:
    """Rise, fall and total width (ns and samples) of the peaks at hits (record_id, position); peaks that are not above the baseline go."""
    rows = hits.select("record_id", "position").join(records.select("record_id", "wave"), "record_id")

    def rule(w, r):
        got = kernels.rise_and_fall(w, r["position"], low, high, interpolate)
        return [] if got is None else [(*(x / rate_ghz for x in got[:3]), *got)]

    schema = "rise_time double, fall_time double, total_width double, rise_time_samples double, fall_time_samples double, total_width_samples double, peak_height double"
    return mapped(rows, ["record_id", "position"], "wave", schema, rule)


def peak_hits(records: DataFrame, derivative: bool = True, method: str = "minmax", extend: int = 4, **limits) -> DataFrame:
    """Hits by peak search on the falling slope (or on the signal): position, height, edges, dt and time stamp of the position."""
    if method not in ("minmax", "diff"):
        raise ValueError(f"no height method {method}")

    def rule(w, r):
        w = w.astype(np.float64)
        sign = 1.0 if r["positive"] else -1.0
        x = sign * np.diff(w) if derivative else sign * (w - r["baseline"])
        found = kernels.find_peaks(x, **limits)
        return [(p, kernels.peak_height(w, a, b, method, extend), 0.0, a, b, r["t"] + p * r["dt"] * 1000) for p, a, b in found]

    schema = "position bigint, height double, integral double, edge_start double, edge_end double, timestamp bigint"
    rows = records.select("record_id", "board", "channel", "dt", "t", "baseline", "positive", "wave")
    return mapped(rows, ["record_id", "board", "channel", "dt"], "wave", schema, rule)


def filtered_waves(records: DataFrame, kind: str = "SG", window: int = 11, order: int = 2, low: float = 0.1, high: float = 0.2, rate: float = 0.5, poles: int = 4, by_channel: dict | None = None) -> DataFrame:
    """records with `wave` smoothed (SG) or band-passed without phase (BW), as floats.  by_channel: {(board, channel): other settings}."""
    common = {"kind": kind, "window": window, "order": order, "low": low, "high": high, "rate": rate, "poles": poles}
    own = {c: common | dict(v) for c, v in (by_channel or {}).items()}
    for settings in (common, *own.values()):
        if settings["kind"] not in ("SG", "BW"):
            raise ValueError(f"no filter {settings['kind']}")

    def rule(w, r):
        s = own.get((r["board"], r["channel"]), common)
        if not len(w):
            return [([],)]
        if s["kind"] == "SG":
            return [(kernels.smooth(w, s["window"], s["order"]),)]
        return [(kernels.zero_phase(kernels.band_pass(s["poles"], s["low"], s["high"], s["rate"]), w),)]

    rest = [c for c in records.columns if c != "wave"]
    return mapped(records, rest, "wave", "wave array<float>", rule)
