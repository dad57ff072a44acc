"""Walks over membership tables: peak to merged hits to hits, pairs of a peak, waveforms of a peak's channels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def of_ids(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows whose key is among ids."""
    return rows.join(ids.select(key).distinct(), key, "left_semi")


def members(parts: DataFrame, key: str, member: str) -> DataFrame:
    """Per key the sorted array of its members."""
    return parts.groupBy(key).agg(F.sort_array(F.collect_list(member)).alias(f"{member}s"))


def with_intervals(hits: DataFrame, key: str, tie: str = "hit_index") -> DataFrame:
    """Hits (time_start, time_end in ps) of each key with the time in ns since the one before started and ended; null for the first."""
    w = Window.partitionBy(key).orderBy("time_start", tie)
    since = lambda c: (F.col("time_start") - F.lag(c).over(w)) / 1000.0
    return hits.withColumns({"dt_start_to_start_ns": since("time_start"), "dt_end_to_start_ns": since("time_end")})


def hit_times(hits: DataFrame) -> DataFrame:
    """time_start and time_end (ps) of hits whose time stamp points at their position."""
    at = lambda edge: F.col("timestamp") + (F.col(edge) - F.col("position")) * F.col("dt") * 1000
    return hits.withColumns({"time_start": at("edge_start"), "time_end": at("edge_end")})


def hits_of_merged(merged_parts: DataFrame, hits: DataFrame) -> DataFrame:
    """Hits of every merged hit.  merged_parts: merged_index, hit_index."""
    return with_intervals(merged_parts.join(hits, "hit_index"), "merged_index")


def hits_of_peaks(peak_parts: DataFrame, merged_parts: DataFrame, hits: DataFrame) -> DataFrame:
    """Hits of every peak.  peak_parts: peak_id, merged_index."""
    return with_intervals(peak_parts.join(merged_parts, "merged_index").join(hits, "hit_index"), "peak_id")


def pairs_of(pairs: DataFrame, peak_id: int, side: str) -> DataFrame:
    """The pairs of an S1 ("s1") or S2 ("s2")."""
    return pairs.filter(F.col(f"{side}_id") == peak_id)


def pair_waveforms(pairs: DataFrame, waveforms: DataFrame) -> DataFrame:
    """Every pair with both peaks' waves: s1_wave, s2_wave (null where a peak has none).  waveforms: peak_id, wave."""
    of = lambda side: waveforms.select(F.col("peak_id").alias(f"{side}_id"), F.col("wave").alias(f"{side}_wave"))
    return pairs.join(of("s1"), "s1_id", "left").join(of("s2"), "s2_id", "left")


def pair_positions(pairs: DataFrame, places: DataFrame) -> DataFrame:
    """Every pair with x, y, z, r of its pair_id."""
    return pairs.join(places.select("pair_id", "x", "y", "z", "r"), "pair_id", "left")


def peak_channels(channel_areas: DataFrame, key: str = "peak_id") -> DataFrame:
    """Per peak the list of its channels with area, height and hits, the largest area first."""
    one = F.struct(F.negative("area").alias("_order"), "board", "channel", "area", "height", "n_hits", "area_fraction")
    sorted_ = channel_areas.groupBy(key).agg(F.array_sort(F.collect_list(one)).alias("channels"))
    fields = ("board", "channel", "area", "height", "n_hits", "area_fraction")
    return sorted_.withColumn("channels", F.transform("channels", lambda c: F.struct(*[c[f].alias(f) for f in fields])))


def products_row(products: dict[str, DataFrame], key: str) -> DataFrame:
    """Several products with one row per key side by side; a column that an earlier product has is prefixed with the product's name."""
    out = None
    for name, df in products.items():
        if out is None:
            out = df
            continue
        taken = set(out.columns) - {key}
        out = out.join(df.withColumnsRenamed({c: f"{name}_{c}" for c in df.columns if c in taken}), key)
    return out


def first_match(left: DataFrame, right: DataFrame, key: str, order: str) -> DataFrame:
    """left with the columns of the first right row (by order) of its key; null where there is none."""
    rest = [c for c in right.columns if c != key and c not in left.columns]
    one = right.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("_first"))
    return left.join(one, key, "left").select(*left.columns, *[F.col("_first")[c].alias(c) for c in rest])
