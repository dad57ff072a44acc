"""From selected pairs to events: positions, the energy placeholder, events with their flags, energies by channel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .order import numbered
from .peaks import center_of_gravity

#: Flag bits of a position.
POSITION_VALID, Z_DONE, XY_DONE, LOW_S2_SIGNAL, EDGE = 1 << 0, 1 << 1, 1 << 2, 1 << 3, 1 << 4
ENERGY_NOT_IMPLEMENTED = 1 << 6
#: Flag bits of an event.
EVENT_VALID, HAS_POSITION, FIDUCIAL, SINGLE_SCATTER, AMBIGUOUS, LOW_S1, LOW_S2 = 1 << 0, 1 << 1, 1 << 2, 1 << 3, 1 << 8, 1 << 9, 1 << 10
NAN = float("nan")


def bits(tests: dict[int, Column]) -> Column:
    out = F.lit(0)
    for bit, test in tests.items():
        out = out.bitwiseOR(F.when(test, bit).otherwise(0))
    return out


def positions(pairs: DataFrame, channel_areas: DataFrame, layout: DataFrame, drift_unit_ns: float = 1e-3, velocity: float = 0.0013, least_s2: float = 100.0, radius: float = 62.5, edge: float = 5.0) -> DataFrame:
    """A row per selected pair: x, y by the S2's channels, z by the drift, errors, quality and flags.  pairs need pair_id.

    channel_areas: peak_id, board, channel, area.  S2s under least_s2 get no x and y (a NaN area does).
    """
    drift = F.col("drift") * F.lit(drift_unit_ns)
    p = pairs.select("pair_id", F.col("s1_id").alias("s1_peak_id"), F.col("s2_id").alias("s2_peak_id"), drift.alias("drift_time_ns"), F.col("s2_area").cast("double").alias("s2_area"), *[c for c in ("s2_n_channels",) if c in pairs.columns])
    low = ~F.isnan("s2_area") & (F.col("s2_area") < least_s2)
    wanted = p.filter(~low).select(F.col("s2_peak_id").alias("peak_id")).distinct()
    place = center_of_gravity(channel_areas.join(wanted, "peak_id", "left_semi"), layout, "peak_id").withColumnRenamed("peak_id", "_of")
    p = p.join(place, F.col("s2_peak_id") == F.col("_of"), "left").drop("_of")
    there = F.col("x").isNotNull() & ~F.isnan("x")
    p = p.withColumns({"_there": there, "x": F.when(there, F.col("x")).otherwise(NAN), "y": F.when(there, F.col("y")).otherwise(NAN), "n": F.when(there, F.col("n")).otherwise(0)})
    p = p.withColumn("r", F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y")))
    error = F.when(F.col("_there") & (F.col("n") > 0), 10.0 / F.sqrt("n")).otherwise(0.0)
    flags = bits({Z_DONE: F.lit(True), XY_DONE: F.col("_there"), POSITION_VALID: F.col("_there"), LOW_S2_SIGNAL: low, EDGE: F.col("_there") & (F.col("r") > radius - edge)})
    p = p.withColumns({"z": F.col("drift_time_ns") * velocity, "z_err": F.lit(10.0 * velocity), "z_quality": F.lit(1.0), "x_err": error, "y_err": error, "xy_chi2": F.lit(0.0)})
    p = p.withColumns({"xy_ndf": F.when(F.col("n") > 0, F.greatest(F.col("n") - 2, F.lit(1))).otherwise(0).cast("int"), "position_goodness": F.when(F.col("_there"), 0.9).otherwise(0.1)})
    p = p.withColumns({"xy_method": F.when(F.col("_there"), "cog").otherwise("none"), "z_method": F.lit("drift_time"), "flags": flags})
    return numbered(p.drop("_there", "n"), ["pair_id"], "event_id")


def energies(pairs: DataFrame, drift_unit_ns: float = 1e-3) -> DataFrame:
    """A row per selected pair with its observables; energies are not computed: NaN, method `none` and a flag."""
    p = pairs.select("pair_id", F.col("s1_id").alias("s1_peak_id"), F.col("s2_id").alias("s2_peak_id"), "s1_area", "s2_area", (F.col("drift") * F.lit(drift_unit_ns)).alias("drift_time_ns"))
    empty = ("s1_energy", "s2_energy", "total_energy", "s1_energy_fraction", "s1_energy_err", "s2_energy_err", "total_energy_err", "energy_chi2")
    p = p.withColumns(dict.fromkeys(empty, F.lit(NAN)))
    p = p.withColumns({"energy_ndf": F.lit(0), "energy_goodness": F.lit(0.0), "s1_method": F.lit("none"), "s2_method": F.lit("none"), "flags": F.lit(ENERGY_NOT_IMPLEMENTED)})
    return numbered(p, ["pair_id"], "event_id")


def events(pairs: DataFrame, places: DataFrame, run_id: str, least_s1: float = 0.0, least_s2: float = 0.0, fiducial_radius: float | None = None, fiducial_z: tuple[float, float] | None = None) -> DataFrame:
    """Selected pairs (pair_id, score) joined with their positions by pair_id, with flags.  No positions: no events."""
    at = places.select("pair_id", "event_id", "x", "y", "z", "r", "drift_time_ns", F.col("flags").alias("_place"))
    e = pairs.drop("drift").withColumnsRenamed({"s1_id": "s1_peak_id", "s2_id": "s2_peak_id", "s1_t": "s1_time", "s2_t": "s2_time"}).join(at, "pair_id")
    inside = lambda c, low, high: ~F.isnan(c) & (F.col(c) >= low) & (F.col(c) <= high)
    in_r = F.lit(True) if fiducial_radius is None else inside("r", float("-inf"), fiducial_radius)
    in_z = F.lit(True) if fiducial_z is None else inside("z", *fiducial_z)
    s1, s2, placed = F.col("s1_area") >= least_s1, F.col("s2_area") >= least_s2, F.col("_place").bitwiseAND(POSITION_VALID) != 0
    score = F.col("score") if "score" in pairs.columns else F.lit(0.0)
    flags = bits({EVENT_VALID: placed & s1 & s2, HAS_POSITION: placed, FIDUCIAL: in_r & in_z, SINGLE_SCATTER: ~F.isnan(score) & (score > 0.5), AMBIGUOUS: (F.col("n_s1") > 1) | (F.col("n_s2") > 1), LOW_S1: ~s1, LOW_S2: ~s2})
    constants = {"s1_area_fraction_top": 0.5, "s2_area_fraction_top": 0.5, "s1_rise_time": 0.0, "s2_rise_time": 0.0}
    e = e.withColumn("flags", flags).withColumns({k: F.lit(v) for k, v in constants.items()}).withColumns({"run_id": F.lit(run_id), "event_number": F.col("event_id")})
    return e.drop("_place")


def channel_matrix(channel_areas: DataFrame, channels: list[tuple[int, int]], per_count: list[float], key: str = "peak_id") -> DataFrame:
    """Per peak the counts of the model's channels in order, as an array.  A peak without any of them, or with a NaN area, is left out."""
    if len(set(channels)) != len(channels) or len(per_count) != len(channels) or any(not 0 < s < float("inf") for s in per_count):
        raise ValueError("distinct channels and a positive finite scale for each are needed")
    own = lambda b, c: (F.col("board") == b) & (F.col("channel") == c)
    each = [F.sum(F.when(own(b, c), F.col("area") / F.lit(float(s))).otherwise(0.0)) for (b, c), s in zip(channels, per_count)]
    known = F.lit(False)
    for b, c in channels:
        known = known | own(b, c)
    rows = channel_areas.withColumn("area", F.col("area").cast("double")).filter(known)
    return rows.groupBy(key).agg(F.array(*each).alias("counts")).filter(~F.exists("counts", F.isnan))
