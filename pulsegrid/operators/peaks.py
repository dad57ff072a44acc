"""Peak labels, positions, events, calibration and per-channel views."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LABELS = {"unknown": 0, "s1": 1, "s2": 2, "s1_s2": 3}


def chosen(spec: dict, columns: list[str] | None = None) -> Column:
    """Any of the accepted groups and none of the rejected; a group is an AND of inclusive ranges {field: (low, high)}.

    A group with a field that is not among the columns never holds; an empty group always does; NaN lies in no range.
    """

    def within(field: str, low, high) -> Column:
        c = F.col(field)
        tests = [~F.isnan(c.cast("double"))] + ([] if low is None else [c >= low]) + ([] if high is None else [c <= high])
        return reduce(lambda a, b: a & b, tests)

    def group(ranges: dict) -> Column:
        if columns is not None and set(ranges) - set(columns):
            return F.lit(False)
        return reduce(lambda a, b: a & b, [within(f, *r) for f, r in ranges.items()], F.lit(True))

    any_of = lambda gs: reduce(lambda a, b: a | b, map(group, gs), F.lit(False))
    return any_of(spec.get("accept", [])) & ~any_of(spec.get("reject", []))


def classify(peaks: DataFrame, specs: dict[str, dict], order=("s1_s2", "s1", "s2"), default: str = "unknown") -> DataFrame:
    label = F.lit(LABELS[default])
    for name in reversed([n for n in order if n in specs]):
        label = F.when(chosen(specs[name], peaks.columns), LABELS[name]).otherwise(label)
    return peaks.withColumn("label", label)


def center_of_gravity(channel_areas: DataFrame, layout: DataFrame, key: str = "peak_id") -> DataFrame:
    """Area-weighted mean of the sensors' places.  layout: board, channel, x, y, gain, one row a channel (see detector.layout_table).

    Rows whose area is 0 or negative, or whose channel is unknown, go; a NaN area makes the place NaN.
    """
    area = F.col("area").cast("double")
    rows = channel_areas.filter(F.isnan(area) | (area > 0)).join(layout, ["board", "channel"]).withColumn("_q", area / F.col("gain"))
    mean = lambda c: (F.sum(F.col("_q") * F.col(c)) / F.sum("_q")).alias(c)
    sums = rows.groupBy(key).agg(mean("x"), mean("y"), F.count("*").alias("n"), F.sum("_q").alias("_total"))
    return sums.filter(F.isnan("_total") | (F.col("_total") > 0)).drop("_total")


def classify_ranges(peaks: DataFrame, s1: dict, s2: dict, conflict: str = "both") -> DataFrame:
    """Labels by one group of ranges each; where both hold: `both` (3), or what `conflict` names (s1, s2, unknown)."""
    if conflict not in ("both", "s1", "s2", "unknown"):
        raise ValueError(f"no conflict rule {conflict}")
    both = LABELS["s1_s2" if conflict == "both" else conflict]
    is_s1, is_s2 = chosen({"accept": [s1]}), chosen({"accept": [s2]})
    return peaks.withColumn("label", F.when(is_s1 & is_s2, both).when(is_s1, LABELS["s1"]).when(is_s2, LABELS["s2"]).otherwise(LABELS["unknown"]))


def assembled(peaklets: DataFrame, features: DataFrame) -> DataFrame:
    """Peaks: the features of each peaklet with its hit and channel counts.  A peaklet without features is an error."""
    f = features.withColumn("_there", F.lit(True))
    joined = peaklets.select("peak_id", "n_hits", "n_channels").join(f, "peak_id", "left")
    lacks = F.raise_error(F.concat(F.lit("no features for peak "), F.col("peak_id").cast("string"))).cast("boolean")
    return joined.filter(F.when(F.col("_there"), F.lit(True)).otherwise(lacks)).drop("_there")


def conserved(channels: DataFrame, totals: DataFrame, key: str = "peak_id") -> DataFrame:
    """channels; an error where a peak's channel areas do not add up to its area within 1e-3 + 1e-5 of it, or its shares to 1."""
    sums = channels.groupBy(key).agg(F.sum("area").alias("_sum"), F.sum("area_fraction").alias("_share"))
    t = totals.select(key, F.col("area").cast("double").alias("_area"))
    both = sums.join(t, key)
    off = F.abs(F.col("_sum") - F.col("_area")) > 1e-3 + 1e-5 * F.abs("_area")
    bad = off | ((F.col("_area") != 0) & (F.abs(F.col("_share") - 1) > 1e-4))
    fail = F.raise_error(F.concat(F.lit("areas are not conserved in peak "), F.col(key).cast("string"))).cast("boolean")
    fine = both.filter(F.when(bad, fail).otherwise(F.lit(True))).select(key)
    return channels.join(fine, key)


def channel_areas(hits: DataFrame, key: str) -> DataFrame:
    """Per cluster, board and channel: area, height, hits and the share of the cluster's area."""
    each = hits.groupBy(key, "board", "channel").agg(F.sum("area").alias("area"), F.max("height").alias("height"), F.count("*").alias("n_hits"))
    total = F.sum("area").over(Window.partitionBy(key))
    return each.withColumn("area_fraction", F.when(total == 0, 0.0).otherwise(F.col("area") / total))


def roles(records: DataFrame, config: DataFrame, role: str, mask: Column) -> DataFrame:
    """records with `keep`: the channel has the role (detector unless configured) and the mask holds."""
    return records.join(config, ["board", "channel"], "left").withColumn("keep", (F.coalesce("role", F.lit("detector")) == role) & mask)


def calibrate(df: DataFrame, gains: DataFrame) -> DataFrame:
    """area_pe = area / gain of (board, channel); NaN where no gain is known."""
    return df.join(gains, ["board", "channel"], "left").withColumn("area_pe", F.coalesce(F.col("area") / F.col("gain"), F.lit(float("nan"))))


def coincidence(events: DataFrame, channels: list[int]) -> DataFrame:
    """Events whose channels hold all the given ones."""
    return events.filter(F.size(F.array_except(F.array(*map(F.lit, channels)), F.col("channels"))) == 0)


def attribute(channels: Column, values: Column, channel: int) -> Column:
    """The first value of a channel, or null."""
    return F.get(values, F.array_position(channels, channel).cast("int") - 1)


def run_statistics(hits: DataFrame, keys: list[str] = ("board", "channel"), start: str = "start", end: str = "end") -> DataFrame:
    """Per channel: hits, first start, last end, area."""
    return hits.groupBy(*keys).agg(F.count("*").alias("n_hits"), F.min(start).alias("t_min"), F.max(end).alias("t_max"), F.sum("area").alias("area"))


def filtered(df: DataFrame, keep, column: str | None = None) -> DataFrame:
    """Rows for which keep holds: a Column, a function Column -> Column, or a function of a pandas Series (of `column`) -> booleans."""
    if isinstance(keep, Column):
        return df.filter(keep)
    try:
        test = keep(F.col(column)) if column else keep(df)
        if isinstance(test, Column):
            return df.filter(test)
    except Exception:  # not a function of columns
        if column is None:
            raise
    if column is None:
        raise TypeError("a function of rows must give a Column")
    passes = F.pandas_udf(lambda s: s.map(keep).astype(bool), "boolean")
    return df.filter(passes(F.col(column)))


def dashboard(events: DataFrame) -> DataFrame:
    """Derived columns of a display: r2, r, theta, cos(theta) and log10 of the areas; what is not finite is NaN."""
    finite = lambda c: F.when(F.abs(c) < float("inf"), c).otherwise(float("nan"))
    x, y = finite(F.col("x").cast("double")), finite(F.col("y").cast("double"))
    log = lambda c: F.when(F.col(c) > 0, F.log10(F.col(c).cast("double"))).otherwise(float("nan"))
    e = events.withColumns({"x": x, "y": y}).withColumn("r2", F.col("x") * F.col("x") + F.col("y") * F.col("y"))
    e = e.withColumns({"r": F.sqrt("r2"), "theta": F.atan2("y", "x"), "log10_s1": log("s1_area"), "log10_s2": log("s2_area")})
    return e.withColumn("cos_theta", F.cos("theta"))
