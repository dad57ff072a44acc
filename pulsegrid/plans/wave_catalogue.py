"""Registered queries over records and waveforms, and SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import wave
from ..functions.kernels import SHARES
from ..operators import lookup, peaks, pulses
from ..operators.order import numbered
from .registry import query
from .views import RECORDS, records, table

SIGN = "CASE WHEN positive THEN x ELSE -x END"

RAW = """raw AS (SELECT vec_id AS seq, vec_id * 7919 % 500 * 1001 AS timestamp, vec_id % 2 AS pid, label % 2 AS board, label AS channel FROM embeddings)"""
ORDERED = f"WITH {RAW} SELECT seq, row_number() OVER (ORDER BY timestamp, pid, board, channel, seq) - 1 AS record_id, CAST(floor(timestamp / 1000.0) AS BIGINT) AS time, 64 AS event_length FROM raw"


def raw_rows(spark, sf_dir):
    e, i = table(spark, sf_dir, "embeddings"), F.col("vec_id")
    return e.select(i.alias("seq"), (i * 7919 % 500 * 1001).alias("timestamp"), (i % 2).alias("pid"), (F.col("label") % 2).alias("board"), F.col("label").alias("channel"), F.col("embedding").alias("wave"), F.lit(2).alias("dt"))


@query(ORDERED)
def build_records(spark, sf_dir):
    """Ids in the global order of (timestamp, pid, board, channel, seq)."""
    return pulses.build_records(raw_rows(spark, sf_dir)).select("seq", "record_id", "time", "event_length")


@query(ORDERED)
def merge_record_parts(spark, sf_dir):
    """Two parts with ids of their own, put together and numbered anew."""
    r = raw_rows(spark, sf_dir)
    parts = [pulses.build_records(r.filter(F.col("seq") % 3 == 0)), pulses.build_records(r.filter(F.col("seq") % 3 != 0))]
    return pulses.merged_parts(parts).select("seq", "record_id", "time", "event_length")


FEATURES = f"""f AS (SELECT *, list_transform(wave, lambda x: {SIGN}) AS s FROM records)"""


@query(f"""WITH {RECORDS}, {FEATURES} SELECT record_id, t, CAST(list_max(list_slice(s, 11, 40)) + CASE WHEN NOT positive AND channel = 3 THEN 5 WHEN channel = 3 THEN -5 ELSE 0 END AS DOUBLE) AS height,
 CAST(list_max(list_slice(wave, 11, 40)) - list_min(list_slice(wave, 11, 40)) AS DOUBLE) AS amp, CAST(list_sum(list_slice(s, 6, 64)) + 59 * CASE WHEN NOT positive AND channel = 3 THEN 5 WHEN channel = 3 THEN -5 ELSE 0 END AS DOUBLE) AS area FROM f""")
def basic_features_ranges(spark, sf_dir):
    """Height over samples 10 to 40, area from sample 5 on; channel 3 has a fixed baseline."""
    fixed = F.when(F.col("channel") == 3, 5)
    f = wave.basic_features(F.col("wave"), F.col("baseline"), F.col("positive"), (10, 40), (5, None), fixed)
    return records(spark, sf_dir).select("record_id", "t", *[f[c].alias(c) for c in ("height", "amp", "area")])


@query(f"""WITH {RECORDS}, {FEATURES}, v AS (SELECT record_id, t, CAST(list_max(s) AS DOUBLE) AS height, CAST(list_sum(s) AS DOUBLE) AS area, channel FROM f)
SELECT record_id, t AS timestamp, height, area, CASE WHEN channel < 6 THEN area / (channel + 1) ELSE 'nan'::DOUBLE END AS area_pe, CASE WHEN channel < 6 THEN height / (channel + 1) ELSE 'nan'::DOUBLE END AS height_pe, row_number() OVER (ORDER BY t, record_id) - 1 AS n FROM v""")
def df(spark, sf_dir):
    """Records with their features and calibrated ones, in time order."""
    r = records(spark, sf_dir)
    f = wave.basic_features(F.col("wave"), F.col("baseline"), F.col("positive"))
    gains = r.select("board", "channel").distinct().filter("channel < 6").withColumn("gain", F.col("channel") + 1.0)
    d = r.select("record_id", F.col("t").alias("timestamp"), "board", "channel", f["height"].alias("height"), f["area"].alias("area"))
    d = peaks.calibrate(d, gains).withColumn("height_pe", F.coalesce(F.col("height") / F.col("gain"), F.lit(float("nan"))))
    return numbered(d, ["timestamp", "record_id"], "n").select("record_id", "timestamp", "height", "area", "area_pe", "height_pe", "n").orderBy("n")


@query(f"WITH {RECORDS} SELECT record_id, array_to_string(list_transform(list_concat(list_slice(wave, 11, 30), [0, 0, 0, 0, 0]), lambda x: CAST(CASE WHEN positive THEN -x ELSE x END AS BIGINT)), ',') AS wave, 20 AS n FROM records WHERE record_id % 50 = 0")
def waveform_fetch(spark, sf_dir):
    """Samples 10 to 30 of some records as negative-going signals, padded to 25."""
    r = records(spark, sf_dir)
    w = pulses.waves_of(r, r.filter("record_id % 50 = 0"), 10, 30, True, 25)
    return w.select("record_id", F.array_join(F.col("wave").cast("array<bigint>").cast("array<string>"), ",").alias("wave"), "n")


@query(f"WITH {RECORDS} SELECT record_id, t FROM records WHERE t BETWEEN 100000000 AND 200000000")
def records_time_window(spark, sf_dir):
    from ..operators.timeops import closed_window

    return closed_window(records(spark, sf_dir), 100_000_000, 200_000_000, "t").select("record_id", "t")


def hits_sql(limit: str, where: str = "true") -> str:
    return f"""WITH {RECORDS}, m AS (SELECT *, list_transform(wave, lambda x: {SIGN}) AS sig FROM records), k AS (SELECT *, {limit} AS lim FROM m WHERE {where}),
s AS (SELECT record_id, t, dt, len(wave) AS n, lim, unnest(range(0, len(wave))) AS i, unnest(sig) AS v FROM k), g AS (SELECT *, i - row_number() OVER (PARTITION BY record_id ORDER BY i) AS grp FROM s WHERE v >= lim),
r AS (SELECT record_id, min(t) AS t, min(dt) AS dt, min(n) AS n, min(i) AS s, max(i) + 1 AS e FROM g GROUP BY record_id, grp),
hit AS (SELECT record_id, (s + e - 1) // 2 AS position, greatest(0, s - 2) AS edge_start, least(n, e + 2) AS edge_end, t + ((s + e - 1) // 2) * dt * 1000 AS timestamp FROM r)"""


KEPT = "list_max(wave) > list_min(wave) AND list_max(sig) > 0 AND list_max(sig) <= list_max(wave) - list_min(wave) AND list_max(sig) >= 0.55 * (list_max(wave) - list_min(wave))"


@query(hits_sql("CASE WHEN channel % 3 = 0 THEN 120 ELSE 180 END", KEPT) + " SELECT record_id, position, edge_start, edge_end, timestamp FROM hit")
def hit_threshold_by_channel(spark, sf_dir):
    """Thresholds by channel, over records that pass the asymmetry mask."""
    limit = F.when(F.col("channel") % 3 == 0, 120).otherwise(180)
    keep = wave.asymmetry(F.col("wave"), F.col("baseline"), F.col("positive"), 0.55)
    return wave.threshold_hits(records(spark, sf_dir), limit, keep=keep).select("record_id", "position", "edge_start", "edge_end", "timestamp")


def found_hits(spark, sf_dir):
    return wave.threshold_hits(records(spark, sf_dir), 150)


WINDOWED = hits_sql("150") + f""", w AS (SELECT hit.*, unnest(range(edge_start, edge_end)) AS i, sig, t AS rt FROM hit JOIN m USING (record_id)), x AS (SELECT *, sig[i + 1] AS v FROM w),
f AS (SELECT record_id, position, min(rt) + edge_start * 2000 AS time_start, min(rt) + edge_end * 2000 AS time_end, sum(v) AS area, max(v) AS height, CAST(arg_min(i, (-v, i)) AS BIGINT) AS top, min(rt) AS rt FROM x GROUP BY record_id, position, edge_start, edge_end)"""


@query(WINDOWED + """ SELECT record_id, position, time_start, time_end, (time_start + time_end) // 2 AS center_time, rt + top * 2000 AS max_time, CAST(area AS DOUBLE) AS area, CAST(height AS DOUBLE) AS height,
 (time_end - time_start) / CAST(1000 AS DOUBLE) AS width, (rt + top * 2000 - time_start) / CAST(1000 AS DOUBLE) AS rise_time, (time_end - rt - top * 2000) / CAST(1000 AS DOUBLE) AS fall_time, 1 AS valid FROM f""")
def hit_merged_features(spark, sf_dir):
    """Features over the sample windows of threshold hits."""
    m = found_hits(spark, sf_dir).select("record_id", "position", F.col("edge_start").alias("sample_start"), F.col("edge_end").alias("sample_end"))
    f = pulses.merged_features(records(spark, sf_dir), m)
    return f.select("record_id", "position", "time_start", "time_end", "center_time", "max_time", "area", "height", "width", "rise_time", "fall_time", "valid")


SEGMENTS = """seg AS (SELECT vec_id % 25 AS peak_id, label AS channel, vec_id // 25 % 5 * 24 * 2000 AS t0, vec_id // 25 % 5 * 24 AS s0 FROM embeddings),
once AS (SELECT DISTINCT peak_id, channel, t0 + i * 2000 AS time, ((s0 + i) * 7 + channel * 3 + peak_id) % 50 - 20 AS v FROM (SELECT *, unnest(range(0, 20 + channel % 3 * 10)) AS i FROM seg)),
sums AS (SELECT peak_id, time, sum(v) AS v FROM once GROUP BY peak_id, time), span AS (SELECT peak_id, min(time) AS t0, max(time) AS t1 FROM sums GROUP BY peak_id),
grid AS (SELECT peak_id, t0, t1, unnest(range(0, (t1 - t0) // 2000 + 1)) AS i FROM span), dense AS (SELECT grid.*, coalesce(v, 0) AS v FROM grid LEFT JOIN sums ON sums.peak_id = grid.peak_id AND sums.time = t0 + i * 2000)"""


def segments(spark, sf_dir):
    """Waves of up to ten channels a peak that overlap on one grid."""
    e, i = table(spark, sf_dir, "embeddings"), F.col("vec_id")
    start = F.floor(i / 25) % 5 * 24
    n = 20 + F.col("label") % 3 * 10
    value = lambda k: ((start + k) * 7 + F.col("label") * 3 + i % 25) % 50 - 20
    w = F.transform(F.sequence(F.lit(0), n - 1), lambda k: value(k).cast("float"))
    return e.select((i % 25).alias("peak_id"), F.lit(0).alias("board"), F.col("label").alias("channel"), F.lit(2).alias("dt"), (start * 2000).cast("long").alias("t0"), w.alias("wave"))


@query(f"WITH {SEGMENTS} SELECT peak_id, channel, time, CAST(v AS DOUBLE) AS value FROM once")
def waveform_merge(spark, sf_dir):
    """Each channel's samples once."""
    return pulses.merge_channels(segments(spark, sf_dir), "peak_id").select("peak_id", "channel", "time", F.col("value").cast("double").alias("value"))


@query(f"WITH {SEGMENTS} SELECT peak_id, min(t0) AS time_start, max(t1) + 2000 AS time_end, array_to_string(list(CAST(v AS BIGINT) ORDER BY i), ',') AS wave FROM dense GROUP BY peak_id")
def peaklet_waveforms(spark, sf_dir):
    w = pulses.peaklet_waveforms(segments(spark, sf_dir))
    return w.select("peak_id", "time_start", "time_end", F.array_join(F.col("wave").cast("array<bigint>").cast("array<string>"), ",").alias("wave"))


def shares_sql() -> str:
    names = [f"t{int(100 * q):02d}" for q in SHARES]
    idx = ", ".join(f"min(CASE WHEN acc >= CAST({q} AS DOUBLE) * total THEN i END) AS i{n}" for q, n in zip(SHARES, names))
    at = ", ".join(
        f"CAST(trunc(t0 + (CASE WHEN i{n} IS NULL THEN n - 1 WHEN i{n} = 0 THEN 0 WHEN accs[i{n} + 1] = CAST({q} AS DOUBLE) * total THEN i{n} ELSE i{n} - 1 + (CAST({q} AS DOUBLE) * total - accs[i{n}]) / (accs[i{n} + 1] - accs[i{n}]) END) * CAST(2000 AS DOUBLE)) AS BIGINT) AS {n}"
        for q, n in zip(SHARES, names)
    )
    return f"""acc AS (SELECT peak_id, i, t0, t1, CAST(v AS DOUBLE) AS v, CAST(sum(v) OVER (PARTITION BY peak_id ORDER BY i) AS DOUBLE) AS acc, CAST(sum(v) OVER (PARTITION BY peak_id) AS DOUBLE) AS total FROM dense),
ix AS (SELECT peak_id, min(t0) AS t0, max(t1) + 2000 AS t1, count(*) AS n, min(total) AS total, list(acc ORDER BY i) AS accs, max(v) AS height, CAST(arg_min(i, (-v, i)) AS BIGINT) AS top, {idx} FROM acc GROUP BY peak_id),
tm AS (SELECT *, t0 + top * 2000 AS peak, {at} FROM ix)"""


@query(f"""WITH {SEGMENTS}, {shares_sql()} SELECT peak_id, t0 AS time_start, t1 AS time_end, peak AS time_peak, CASE WHEN total > 0 THEN t50 ELSE t0 END AS center_time, CASE WHEN total > 0 THEN peak - t10 ELSE peak - t0 END / CAST(1000 AS DOUBLE) AS rise_time,
 CASE WHEN total > 0 THEN t90 - t50 ELSE 0 END / CAST(1000 AS DOUBLE) AS fall_time, CASE WHEN total > 0 THEN t75 - t25 ELSE 0 END / CAST(1000 AS DOUBLE) AS width_25_75, CASE WHEN total > 0 THEN t50 - t10 ELSE 0 END / CAST(1000 AS DOUBLE) AS rise_time_10_50,
 CASE WHEN total > 0 THEN t95 - t05 ELSE 0 END / CAST(1000 AS DOUBLE) AS range_90p_area, total AS area, height, (t1 - t0) / CAST(1000 AS DOUBLE) AS width FROM tm""")
def peaklet_features(spark, sf_dir):
    return pulses.peaklet_features(pulses.peaklet_waveforms(segments(spark, sf_dir)))


@query(f"WITH {SEGMENTS}, {shares_sql()}, n AS (SELECT peak_id, count(*) AS n_hits, count(DISTINCT channel) AS n_channels FROM seg GROUP BY peak_id) SELECT peak_id, n_hits, n_channels, t0 AS time_start, total AS area, height FROM tm JOIN n USING (peak_id)")
def peaks_assembly(spark, sf_dir):
    """Peaklets and their features, one to one."""
    s = segments(spark, sf_dir)
    counts = s.groupBy("peak_id").agg(F.count("*").alias("n_hits"), F.count_distinct("channel").alias("n_channels"))
    f = pulses.peaklet_features(pulses.peaklet_waveforms(s))
    return peaks.assembled(counts, f).select("peak_id", "n_hits", "n_channels", "time_start", "area", "height")


@query(f"WITH {SEGMENTS}, c AS (SELECT peak_id, 0 AS board, channel, CAST(sum(v) AS DOUBLE) AS area, CAST(max(v) AS DOUBLE) AS height FROM once GROUP BY peak_id, channel), t AS (SELECT *, sum(area) OVER (PARTITION BY peak_id) AS total FROM c) SELECT peak_id, board, channel, area, height, CASE WHEN total = 0 THEN 0 ELSE area / total END AS area_fraction FROM t")
def peaklet_channel_areas(spark, sf_dir):
    """Areas by channel over merged samples, so that overlapping hits count once; the sums are held against the peaks' areas."""
    once = pulses.merge_channels(segments(spark, sf_dir), "peak_id")
    c = once.groupBy("peak_id", "board", "channel").agg(F.sum(F.col("value").cast("double")).alias("area"), F.max(F.col("value").cast("double")).alias("height"))
    total = once.groupBy("peak_id").agg(F.sum(F.col("value").cast("double")).alias("total"))
    c = c.join(total, "peak_id").withColumn("area_fraction", F.when(F.col("total") == 0, 0.0).otherwise(F.col("area") / F.col("total")))
    return peaks.conserved(c.drop("total"), total.withColumnRenamed("total", "area"))


@query(f"WITH {SEGMENTS}, l AS (SELECT peak_id AS s1_id, peak_id + 1 AS s2_id FROM span WHERE peak_id < 20), w AS (SELECT peak_id, list(CAST(v AS BIGINT) ORDER BY i) AS wave FROM dense GROUP BY peak_id) SELECT s1_id, s2_id, len(a.wave) AS n1, CAST(list_sum(b.wave) AS BIGINT) AS sum2 FROM l LEFT JOIN w a ON a.peak_id = s1_id LEFT JOIN w b ON b.peak_id = s2_id")
def pair_waveforms(spark, sf_dir):
    """Both waves of pairs of peaks."""
    w = pulses.peaklet_waveforms(segments(spark, sf_dir))
    p = w.filter("peak_id < 20").select(F.col("peak_id").alias("s1_id"), (F.col("peak_id") + 1).alias("s2_id"))
    total = F.aggregate("s2_wave", F.lit(0.0), lambda a, x: a + x).cast("long")
    return lookup.pair_waveforms(p, w).select("s1_id", "s2_id", F.size("s1_wave").alias("n1"), total.alias("sum2"))


def cross(prefix: str, where: str, test: str, level: str) -> str:
    """First crossing of a level among the samples of one side, between samples."""
    return f"""{prefix} AS (SELECT record_id, position, min(i) AS i FROM c WHERE {where} AND v {test} CAST({level} AS DOUBLE) * top GROUP BY record_id, position),
{prefix}p AS (SELECT {prefix}.record_id, {prefix}.position, CASE WHEN {prefix}.i = lo OR abs(a.v - b.v) < 1e-10 THEN {prefix}.i ELSE {prefix}.i - 1 + (CAST({level} AS DOUBLE) * a.top - b.v) / (a.v - b.v) END AS at
 FROM {prefix} JOIN (SELECT record_id, position, min(i) AS lo FROM c WHERE {where} GROUP BY ALL) f USING (record_id, position) JOIN c a ON a.record_id = {prefix}.record_id AND a.position = {prefix}.position AND a.i = {prefix}.i
 LEFT JOIN c b ON b.record_id = {prefix}.record_id AND b.position = {prefix}.position AND b.i = {prefix}.i - 1)"""


LEFT, RIGHT = "i < position", "i >= position"
CROSSINGS = ", ".join([cross("a1", LEFT, ">=", "0.1"), cross("a9", LEFT, ">=", "0.9"), cross("d9", RIGHT, "<=", "0.9"), cross("d1", RIGHT, "<=", "0.1")])


@query(hits_sql("150") + f""", b AS (SELECT hit.record_id, position, wave, list_avg(list_transform(list_slice(wave, 1, 50), lambda x: CAST(x AS DOUBLE))) AS base FROM hit JOIN records USING (record_id)),
e AS (SELECT record_id, position, unnest(range(0, len(wave))) AS i, unnest(wave) - base AS v, wave[position + 1] - base AS top FROM b), c AS (SELECT * FROM e WHERE top > 0), {CROSSINGS}
SELECT record_id, position, round(coalesce(a9p.at - a1p.at, 0), 9) AS rise_time_samples, round(coalesce(d1p.at - d9p.at, 0), 9) AS fall_time_samples, round(coalesce(d1p.at - a1p.at, 0), 9) AS total_width_samples, round(coalesce(d1p.at - a1p.at, 0) / CAST(0.5 AS DOUBLE), 9) AS total_width, round(top, 9) AS peak_height
FROM (SELECT DISTINCT record_id, position, top FROM c) q LEFT JOIN a1p USING (record_id, position) LEFT JOIN a9p USING (record_id, position) LEFT JOIN d9p USING (record_id, position) LEFT JOIN d1p USING (record_id, position)""")
def waveform_width(spark, sf_dir):
    w = pulses.waveform_widths(found_hits(spark, sf_dir), records(spark, sf_dir))
    cols = ("rise_time_samples", "fall_time_samples", "total_width_samples", "total_width", "peak_height")
    return w.select("record_id", "position", *[F.round(c, 9).alias(c) for c in cols])


@query(f"""WITH {RECORDS}, s AS (SELECT record_id, unnest(range(0, len(wave))) AS i, unnest(list_transform(wave, lambda x: greatest(0, {SIGN}))) AS v FROM records), c AS (SELECT *, sum(v) OVER (PARTITION BY record_id ORDER BY i) AS acc, sum(v) OVER (PARTITION BY record_id) AS total FROM s),
w AS (SELECT record_id AS source, min(CASE WHEN acc >= CAST(0.1 AS DOUBLE) * total THEN i END) AS lo, min(CASE WHEN acc >= CAST(0.9 AS DOUBLE) * total THEN i END) AS hi FROM c GROUP BY record_id)
SELECT source, row_number() OVER (ORDER BY source) - 1 AS record_id, CAST(2 * lo AS DOUBLE) AS t_low, CAST(2 * hi AS DOUBLE) AS t_high, CAST(2 * (hi - lo) AS DOUBLE) AS width, hi - lo AS width_samples FROM w""")
def waveform_width_integral_ns(spark, sf_dir):
    """In ns and samples; record_id is the number of the row."""
    w = records(spark, sf_dir).select(F.col("record_id").alias("source"), "dt", wave.width_integral(F.col("wave"), F.col("baseline"), F.col("positive")).alias("w"))
    ns = lambda c: (c * F.col("dt")).cast("double")
    d = w.select("source", ns(F.col("w.t_low")).alias("t_low"), ns(F.col("w.t_high")).alias("t_high"), ns(F.col("w.t_high") - F.col("w.t_low")).alias("width"), (F.col("w.t_high") - F.col("w.t_low")).alias("width_samples"))
    return numbered(d, ["source"], "record_id")


@query()
def hit(spark, sf_dir):
    """Peak search on the slope; held against a plain walk in the tests."""
    return pulses.peak_hits(records(spark, sf_dir), height=100.0, least_prominence=50.0, width=None)


@query()
def filtered_waveforms(spark, sf_dir):
    """Smoothed waves, band-passed ones on channel 1; held against polynomial fits and the filter's response in the tests."""
    return pulses.filtered_waves(records(spark, sf_dir), by_channel={(1, 1): {"kind": "BW", "low": 0.02, "high": 0.2}})


@query(f"WITH {RECORDS}, x AS (SELECT record_id, unnest(range(0, len(wave))) AS i, unnest(wave) AS v FROM records), o AS (SELECT *, -v > 150 AS hot FROM x), p AS (SELECT *, lag(hot, 1, false) OVER (PARTITION BY record_id ORDER BY i) AS was FROM o) SELECT record_id, CAST(i AS BIGINT) AS start FROM p WHERE hot AND NOT was")
def find_hits(spark, sf_dir):
    """Starts of runs strictly below the baseline less the threshold."""
    over = F.transform("wave", lambda x: F.col("baseline") - x > 150)
    r = records(spark, sf_dir).select("record_id", over.alias("over"))
    begins = F.filter(F.sequence(F.lit(0), F.size("over") - 1), lambda i: F.get("over", i) & ~F.coalesce(F.get("over", i - 1), F.lit(False)))
    return r.select("record_id", F.explode(F.transform(begins, lambda i: i.cast("long"))).alias("start"))


@query(f"WITH {RECORDS} SELECT record_id, channel IN (2, 7) AND list_max(wave) > list_min(wave) AND CASE WHEN positive THEN list_max(wave) ELSE -list_min(wave) END > 0 AND CASE WHEN positive THEN list_max(wave) ELSE -list_min(wave) END <= list_max(wave) - list_min(wave) AND CASE WHEN positive THEN list_max(wave) ELSE -list_min(wave) END >= 0.5 * (list_max(wave) - list_min(wave)) AS keep FROM records")
def records_veto_mask(spark, sf_dir):
    from ..operators import detector

    roles = {"defaults": {"role": "detector"}, "groups": [{"channels": ["0:2", "1:7"], "config": {"role": "veto"}}]}
    found = [(c % 2, c) for c in range(10)]
    config = detector.settings_table(spark, detector.effective(found, None, roles), "role string")
    mask = wave.asymmetry(F.col("wave"), F.col("baseline"), F.col("positive"), 0.5)
    return peaks.roles(records(spark, sf_dir), config, "veto", mask).select("record_id", "keep")


@query(f"WITH {RECORDS}, {FEATURES} SELECT record_id, CAST(list_max(s) AS DOUBLE) AS height, CAST(list_sum(s) AS DOUBLE) AS area, CAST(2 * len(wave) AS BIGINT) AS span, t AS records_t FROM f")
def products_side_by_side(spark, sf_dir):
    """Two products of one key in one row; the second's column that the first has too is prefixed."""
    r = records(spark, sf_dir)
    f = wave.basic_features(F.col("wave"), F.col("baseline"), F.col("positive"))
    one = r.select("record_id", f["height"].alias("height"), f["area"].alias("area"), F.lit(0).alias("t"))
    two = r.select("record_id", "t", (F.size("wave") * F.col("dt")).cast("long").alias("span"))
    return lookup.products_row({"features": one, "records": two}, "record_id").drop("t")


@query(f"WITH {RECORDS}, {FEATURES}, n AS (SELECT label AS channel, min(vec_id) AS record_id FROM embeddings GROUP BY label) SELECT f.record_id, n.record_id AS first_of_channel FROM f LEFT JOIN n ON n.channel = f.channel AND f.channel < 8")
def first_match(spark, sf_dir):
    """Each record with the first row of a table that has many per key."""
    r = records(spark, sf_dir).select("record_id", "channel")
    many = r.filter("channel < 8").select("channel", F.col("record_id").alias("first_of_channel"))
    return lookup.first_match(r, many, "channel", "first_of_channel").select("record_id", "first_of_channel")
