"""Registered queries over peaks, pairs and events, and SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clusters, detector, events, lookup, pairs, peaks
from .catalogue import GAP, island_sql
from .registry import query
from .views import HITS, hits

DRIFT = 600_000_000
NAN = "'nan'::DOUBLE"

S1S2 = HITS + """, pk AS (SELECT hit_id AS peak_id, "start" AS t, area, "end" - "start" AS width, hit_id % 5 + 1 AS n_channels, CASE event_type WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 ELSE 0 END AS label FROM hits),
s1 AS (SELECT * FROM pk WHERE label = 1), s2 AS (SELECT * FROM pk WHERE label = 2),
pairs AS (SELECT s1.peak_id AS s1_id, s2.peak_id AS s2_id, s1.t AS s1_t, s2.t AS s2_t, s2.t - s1.t AS drift, s1.area AS s1_area, s2.area AS s2_area, s1.width AS s1_width, s2.width AS s2_width, s1.n_channels AS s1_n_channels, s2.n_channels AS s2_n_channels
 FROM s1 JOIN s2 ON s2.t - s1.t BETWEEN 0 AND """ + str(DRIFT) + f"""),
n AS (SELECT *, count(*) OVER (PARTITION BY s2_id) AS n_s1, count(*) OVER (PARTITION BY s1_id) AS n_s2, CASE WHEN s1_area > 0 THEN CASE WHEN s2_area > 0 THEN log10(CAST(s2_area AS DOUBLE) / s1_area) WHEN s2_area = 0 THEN '-inf'::DOUBLE ELSE {NAN} END ELSE 0 END AS log10_ratio FROM pairs),
cand AS (SELECT *, 1 + CASE WHEN n_s1 > 1 THEN 16 ELSE 0 END + CASE WHEN n_s2 > 1 THEN 32 ELSE 0 END AS flags, row_number() OVER (ORDER BY s2_t, s2_id, s1_t, s1_id) - 1 AS pair_id FROM n),
o1 AS (SELECT peak_id AS s1_id, -1 AS s2_id, -1 AS drift, 128 AS flags FROM s1 WHERE peak_id NOT IN (SELECT s1_id FROM pairs)), o2 AS (SELECT -1 AS s1_id, peak_id AS s2_id, -1 AS drift, 256 AS flags FROM s2 WHERE peak_id NOT IN (SELECT s2_id FROM pairs))"""


def labelled_peaks(spark, sf_dir):
    h = hits(spark, sf_dir)
    p = h.select(F.col("hit_id").alias("peak_id"), F.col("start").alias("t"), "area", (F.col("end") - F.col("start")).alias("width"), (F.col("hit_id") % 5 + 1).alias("n_channels"))
    kinds = F.when(F.col("event_type") == "click", 1).when(F.col("event_type") == "purchase", 2)
    labels = h.select(F.col("hit_id").alias("peak_id"), kinds.alias("label")).filter("label is not null")
    return pairs.labelled(p, labels)


def sides(spark, sf_dir):
    return pairs.sides(labelled_peaks(spark, sf_dir))


def candidates(spark, sf_dir):
    return pairs.candidates(*sides(spark, sf_dir), DRIFT)


def with_all_orphans(spark, sf_dir):
    a, b = sides(spark, sf_dir)
    return pairs.with_orphans(pairs.candidates(a, b, DRIFT), a, b)


@query(f"WITH {S1S2} SELECT peak_id, label FROM pk")
def label_join(spark, sf_dir):
    return labelled_peaks(spark, sf_dir).select("peak_id", "label")


@query(f"WITH {S1S2} SELECT pair_id, s1_id, s2_id, drift, n_s1, n_s2, CASE WHEN isfinite(log10_ratio) THEN round(log10_ratio, 9) ELSE log10_ratio END AS log10_ratio, flags FROM cand")
def s1_s2_pair_candidates(spark, sf_dir):
    finite = F.abs("log10_ratio") < float("inf")
    ratio = F.when(finite, F.round("log10_ratio", 9)).otherwise(F.col("log10_ratio")).alias("log10_ratio")
    return pairs.with_pair_id(candidates(spark, sf_dir)).select("pair_id", "s1_id", "s2_id", "drift", "n_s1", "n_s2", ratio, "flags")


@query(f"WITH {S1S2}, f1 AS (SELECT * FROM s1 WHERE area >= 2000), f2 AS (SELECT * FROM s2 WHERE area >= 5000) SELECT f1.peak_id AS s1_id, f2.peak_id AS s2_id, f2.t - f1.t AS drift FROM f1 JOIN f2 ON f2.t - f1.t BETWEEN 60000000 AND {DRIFT}")
def s1_s2_pair_candidates_cut(spark, sf_dir):
    """With least areas and a least drift."""
    a, b = pairs.sides(labelled_peaks(spark, sf_dir), 2000, 5000)
    return pairs.candidates(a, b, DRIFT, 60_000_000).select("s1_id", "s2_id", "drift")


@query(f"WITH {S1S2} SELECT * FROM o1 UNION ALL SELECT * FROM o2")
def s1_s2_orphans(spark, sf_dir):
    a, b = sides(spark, sf_dir)
    p = pairs.candidates(a, b, DRIFT)
    both = pairs.orphans(a, p, "s1").unionByName(pairs.orphans(b, p, "s2"))
    return both.select("s1_id", "s2_id", "drift", "flags")


@query(f"WITH {S1S2} SELECT s1_id, s2_id, drift, flags FROM cand UNION ALL SELECT * FROM o1 UNION ALL SELECT * FROM o2")
def s1_s2_candidates_and_orphans(spark, sf_dir):
    return with_all_orphans(spark, sf_dir).select("s1_id", "s2_id", "drift", "flags")


LARGEST = f"""WITH {S1S2}, l AS (SELECT *, CASE WHEN s1_area > -1 THEN ln(1 + CAST(s1_area AS DOUBLE)) ELSE {NAN} END AS score FROM cand WHERE s2_area > s1_area),
r AS (SELECT *, row_number() OVER s AS rank_s2, score - lead(score) OVER s AS d FROM l WINDOW s AS (PARTITION BY s2_id ORDER BY isnan(score), score DESC, s1_id)),
q AS (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY isnan(score), score DESC, s2_id) AS rank_s1, CASE WHEN rank_s2 = 1 THEN coalesce(d, 'inf'::DOUBLE) END AS delta FROM r),
b AS (SELECT * EXCLUDE (flags), flags + CASE WHEN rank_s2 = 1 AND NOT isnan(delta) AND delta < 0.1 THEN 64 ELSE 0 END AS flags FROM q)"""


@query(LARGEST + " SELECT s1_id, s2_id, drift, s1_area, s2_area, rank_s1, round(least(delta, 1e9), 9) AS delta, flags FROM b WHERE rank_s2 = 1")
def s1_s2_pairs(spark, sf_dir):
    p = pairs.select(candidates(spark, sf_dir))
    return p.select("s1_id", "s2_id", "drift", "s1_area", "s2_area", "rank_s1", F.round(F.least("delta", F.lit(1e9)), 9).alias("delta"), "flags")


@query(LARGEST + " SELECT s1_id, s2_id, rank_s2, rank_s1, rank_s2 = 1 AS selected FROM b")
def s1_s2_pairs_ranked(spark, sf_dir):
    """All pairs with their ranks."""
    return pairs.select(candidates(spark, sf_dir), chosen_only=False).select("s1_id", "s2_id", "rank_s2", "rank_s1", "selected")


BOUNDS = f"""WITH {S1S2}, lim AS (SELECT min(drift) AS lo, max(drift) AS hi FROM (SELECT drift FROM cand WHERE s2_area > s1_area UNION ALL SELECT drift FROM o1 UNION ALL SELECT drift FROM o2)),
ts AS (SELECT cand.*, CASE WHEN hi > lo THEN 1 - (drift - lo) / (hi - lo) ELSE 1.0 END AS score_time FROM cand, lim WHERE s2_area > s1_area)"""


@query(BOUNDS + ", r AS (SELECT *, row_number() OVER (PARTITION BY s2_id ORDER BY score_time DESC, s1_id) AS k FROM ts) SELECT s1_id, s2_id, drift, round(score_time, 9) AS score FROM r WHERE k = 1")
def s1_s2_pairs_nearest(spark, sf_dir):
    return pairs.select(with_all_orphans(spark, sf_dir), "nearest").select("s1_id", "s2_id", "drift", F.round("score", 9).alias("score"))


L1 = "ln(1 + CAST({} AS DOUBLE))"
BEST = f"0.2 * score_time + 0.4 * ({L1.format('greatest(s1_area, 0)')} + 0.5 * {L1.format('greatest(s1_n_channels, 1)')} - 0.5 * {L1.format('greatest(s1_width, 1)')}) + 0.2 * ({L1.format('greatest(s2_area, 0)')} + 0.3 * {L1.format('greatest(s2_n_channels, 1)')})"


@query(BOUNDS + f", v AS (SELECT *, round({BEST}, 7) AS score FROM ts), r AS (SELECT *, row_number() OVER (PARTITION BY s2_id ORDER BY score DESC, s1_id) AS k FROM v) SELECT s1_id, s2_id, score FROM r WHERE k = 1")
def s1_s2_pairs_best_score(spark, sf_dir):
    return pairs.select(with_all_orphans(spark, sf_dir), "best_score").select("s1_id", "s2_id", F.round("score", 7).alias("score"))


@query(f"WITH {S1S2} SELECT s1_id, s2_id, true AS selected FROM cand WHERE s2_area > s1_area")
def s1_s2_pairs_all(spark, sf_dir):
    return pairs.select(with_all_orphans(spark, sf_dir), "all").select("s1_id", "s2_id", "selected")


@query(LARGEST + " SELECT s1_id, s2_id, drift BETWEEN 100000000 AND 500000000 AND log10_ratio <= 0.7 AND NOT isnan(log10_ratio) AND flags & 48 <> 0 AND flags & 1 = 1 AND flags & 64 = 0 AND rank_s2 = 1 AS keep FROM b")
def pair_mask(spark, sf_dir):
    m = pairs.mask({"drift": (100_000_000, 500_000_000), "log10_ratio": (None, 0.7)}, flags_any=48, flags_all=1, flags_none=64, selected=True)
    return pairs.select(candidates(spark, sf_dir), chosen_only=False).select("s1_id", "s2_id", m.alias("keep"))


@query(f"WITH {S1S2}, k AS (SELECT min(s2_id) AS of FROM cand WHERE n_s1 > 1) SELECT cand.s1_id, cand.s2_id, cand.drift FROM cand, k WHERE s2_id = k.of")
def pairs_of_s2(spark, sf_dir):
    """The pairs of the first ambiguous S2."""
    c = candidates(spark, sf_dir)
    one = c.filter("n_s1 > 1").agg(F.min("s2_id").alias("s2_id"))
    return lookup.of_ids(c, one, "s2_id").select("s1_id", "s2_id", "drift")


SPECS = {"s1": {"accept": [{"width": (0, 20_000_000), "area": (0, 3000)}], "reject": [{"channel": (7, 7)}]}, "s2": {"accept": [{"width": (30_000_000, None), "area": (3000, None)}, {"channel": (2, 2)}]}}


@query(f"""WITH {HITS}, p AS (SELECT *, "end" - "start" AS width FROM hits) SELECT hit_id, CASE WHEN width BETWEEN 0 AND 20000000 AND area BETWEEN 0 AND 3000 AND NOT channel = 7 THEN 1
 WHEN (width >= 30000000 AND area >= 3000) OR channel = 2 THEN 2 ELSE 0 END AS label FROM p""")
def peak_classification(spark, sf_dir):
    return peaks.classify(hits(spark, sf_dir).withColumn("width", F.col("end") - F.col("start")), SPECS).select("hit_id", "label")


def layout(spark):
    """Eight sensors on two boards; the first entry of channel 0 is overruled by a later one."""
    gone = [{"board": 0, "channel": 0, "x_mm": 99.0, "y_mm": 99.0, "gain": 7.0}]
    own = [{"board": c % 2, "channel": c, "x_mm": 40.0 * (c % 3 - 1), "y_mm": 40.0 * (c % 4 - 1), "gain": 1.0 + c % 2} for c in range(8)]
    return detector.layout_table(spark, detector.layout_from_config({"detector_geometry": {"pmt_mapping": gone + own}}))


LAYOUT = "layout AS (SELECT c % 2 AS board, c AS channel, CAST(40 * (c % 3 - 1) AS DOUBLE) AS x, CAST(40 * (c % 4 - 1) AS DOUBLE) AS y, CAST(1 + c % 2 AS DOUBLE) AS gain FROM range(8) t(c))"


@query("SELECT * FROM (VALUES (1, 'LV2389', -26.8::DOUBLE, 17.7::DOUBLE, 0::BIGINT, 15::BIGINT, 9200000.0::DOUBLE, 'negative'), (2, 'LV2387', -1.9, 32.0, 0, 14, 9200000.0, 'negative'), (3, 'LV2380', -24.9, -14.4, 0, 13, 9200000.0, 'negative'), (4, 'LV2332', 0.0, 0.0, 0, 12, 9200000.0, 'negative'), (5, 'LV2391', 24.9, 14.4, 0, 11, 9200000.0, 'negative'), (6, 'LV2364', 1.9, -32.0, 0, 10, 9200000.0, 'negative'), (7, 'LV2319', 26.8, -17.7, 0, 9, 9200000.0, 'negative')) t(pmt_no, pmt_id, x, y, board, channel, gain, polarity)")
def sensor_layout(spark, sf_dir):
    """The layout used where none is given."""
    return detector.layout_table(spark, detector.layout())


@query(f"WITH {HITS}, {LAYOUT}, " + island_sql(GAP).split(" FROM events), ", 1)[1] + """, a AS (SELECT CAST(island AS BIGINT) AS island, board, channel, sum(area) AS area FROM i GROUP BY island, board, channel)
SELECT island, round(sum(area / gain * x) / sum(area / gain), 9) AS x, round(sum(area / gain * y) / sum(area / gain), 9) AS y, count(*) AS n FROM a JOIN layout USING (board, channel) WHERE area > 0 GROUP BY island HAVING sum(area / gain) > 0""")
def center_of_gravity(spark, sf_dir):
    a = peaks.channel_areas(clusters.islands(hits(spark, sf_dir), GAP), "island")
    return peaks.center_of_gravity(a, layout(spark), "island").select("island", F.round("x", 9).alias("x"), F.round("y", 9).alias("y"), "n")


#: Every S2's light by channel: its own, and a share for two neighbours.
SHARED = """, ca AS (SELECT peak_id, c % 2 AS board, c AS channel, CASE c - b WHEN 0 THEN area ELSE area // 3 END AS area FROM (SELECT hit_id AS peak_id, channel AS b, area, unnest([channel, channel + 1, channel + 2]) AS c FROM hits)),
ar AS (SELECT ca.peak_id, sum(ca.area / gain * x) / sum(ca.area / gain) AS x, sum(ca.area / gain * y) / sum(ca.area / gain) AS y, count(*) AS n FROM ca JOIN layout USING (board, channel) WHERE ca.area > 0 GROUP BY ca.peak_id)"""
PLACES = LARGEST.replace(HITS, f"{HITS}, {LAYOUT}{SHARED}") + f""", p AS (SELECT b.*, CASE WHEN s2_area < 4000 THEN NULL ELSE ar.x END AS px, CASE WHEN s2_area < 4000 THEN NULL ELSE ar.y END AS py, coalesce(CASE WHEN s2_area < 4000 THEN 0 ELSE ar.n END, 0) AS pn FROM b LEFT JOIN ar ON ar.peak_id = b.s2_id WHERE rank_s2 = 1),
pos AS (SELECT row_number() OVER (ORDER BY pair_id) - 1 AS event_id, pair_id, s1_id AS s1_peak_id, s2_id AS s2_peak_id, drift * CAST(0.001 AS DOUBLE) AS drift_time_ns, CAST(s2_area AS DOUBLE) AS s2_area, px IS NOT NULL AS ok, coalesce(px, {NAN}) AS x, coalesce(py, {NAN}) AS y, sqrt(coalesce(px, {NAN}) * coalesce(px, {NAN}) + coalesce(py, {NAN}) * coalesce(py, {NAN})) AS r, pn,
 s1_area, s1_t, s2_t, log10_ratio, n_s1, n_s2, score FROM p),
fl AS (SELECT *, 2 + CASE WHEN ok THEN 5 ELSE 0 END + CASE WHEN s2_area < 4000 THEN 8 ELSE 0 END + CASE WHEN ok AND r > 52.5 THEN 16 ELSE 0 END AS flags FROM pos)"""


def selected(spark, sf_dir):
    return pairs.select(pairs.with_pair_id(candidates(spark, sf_dir)))


def shared_light(spark, sf_dir):
    c, own = F.col("c"), F.col("channel")
    h = hits(spark, sf_dir).select("hit_id", "channel", "area", F.explode(F.array(own, own + 1, own + 2)).alias("c"))
    third = F.expr("(area - pmod(area, 3)) div 3")
    return h.select(F.col("hit_id").alias("peak_id"), (c % 2).alias("board"), c.alias("channel"), F.when(c == own, F.col("area")).otherwise(third).alias("area"))


def places(spark, sf_dir, chosen=None):
    chosen = selected(spark, sf_dir) if chosen is None else chosen
    return events.positions(chosen, shared_light(spark, sf_dir), layout(spark), least_s2=4000.0, radius=57.5)


ROUNDED = ", ".join(f"round({c}, 6) AS {c}" for c in ("x", "y", "r")) + ", drift_time_ns"


def rounded(df):
    return df.withColumns({c: F.round(c, 6) for c in ("x", "y", "r", "x_err", "y_err") if c in df.columns})


@query(PLACES + f""" SELECT event_id, pair_id, s1_peak_id, s2_peak_id, s2_area, {ROUNDED}, drift_time_ns * CAST(0.0013 AS DOUBLE) AS z, round(CAST(0.013 AS DOUBLE), 6) AS z_err, CAST(1 AS DOUBLE) AS z_quality,
 round(CASE WHEN pn > 0 THEN 10 / sqrt(pn) ELSE 0 END, 6) AS x_err, round(CASE WHEN pn > 0 THEN 10 / sqrt(pn) ELSE 0 END, 6) AS y_err, CAST(0 AS DOUBLE) AS xy_chi2, CAST(CASE WHEN pn > 0 THEN greatest(pn - 2, 1) ELSE 0 END AS INTEGER) AS xy_ndf,
 CASE WHEN ok THEN CAST(0.9 AS DOUBLE) ELSE CAST(0.1 AS DOUBLE) END AS position_goodness, CASE WHEN ok THEN 'cog' ELSE 'none' END AS xy_method, 'drift_time' AS z_method, flags FROM fl""")
def position_reconstruction(spark, sf_dir):
    return rounded(places(spark, sf_dir)).withColumn("z_err", F.round("z_err", 6)).drop("s2_n_channels")


@query(LARGEST + f" SELECT row_number() OVER (ORDER BY pair_id) - 1 AS event_id, pair_id, s1_id AS s1_peak_id, s2_id AS s2_peak_id, s1_area, s2_area, {NAN} AS total_energy, 'none' AS s1_method, 64 AS flags FROM b WHERE rank_s2 = 1")
def energy_reconstruction(spark, sf_dir):
    e = events.energies(selected(spark, sf_dir))
    return e.select("event_id", "pair_id", "s1_peak_id", "s2_peak_id", "s1_area", "s2_area", "total_energy", "s1_method", "flags")


@query(PLACES + f""" SELECT event_id, event_id AS event_number, 'r1' AS run_id, pair_id, s1_peak_id, s2_peak_id, {ROUNDED}, drift_time_ns * CAST(0.0013 AS DOUBLE) AS z, s1_t AS s1_time, s2_t AS s2_time, s1_area, n_s1, n_s2, CAST(0.5 AS DOUBLE) AS s1_area_fraction_top,
 CASE WHEN ok AND s1_area >= 500 AND s2_area >= 3000 THEN 1 ELSE 0 END + CASE WHEN ok THEN 2 ELSE 0 END + CASE WHEN r <= 45 AND NOT isnan(r) AND drift_time_ns * CAST(0.0013 AS DOUBLE) BETWEEN 50 AND 700 THEN 4 ELSE 0 END
 + CASE WHEN score > 0.5 AND NOT isnan(score) THEN 8 ELSE 0 END + CASE WHEN n_s1 > 1 OR n_s2 > 1 THEN 256 ELSE 0 END + CASE WHEN s1_area < 500 THEN 512 ELSE 0 END + CASE WHEN s2_area < 3000 THEN 1024 ELSE 0 END AS flags FROM fl""")
def physics_events(spark, sf_dir):
    """Pairs and positions as events, joined by pair_id; candidates are counted, not listed."""
    s = pairs.largest(*sides(spark, sf_dir), DRIFT)
    e = events.events(s, places(spark, sf_dir, s), "r1", 500, 3000, 45.0, (50.0, 700.0))
    return rounded(e).select("event_id", "event_number", "run_id", "pair_id", "s1_peak_id", "s2_peak_id", "x", "y", "z", "r", "drift_time_ns", "s1_time", "s2_time", "s1_area", "n_s1", "n_s2", "s1_area_fraction_top", "flags")


@query(f"WITH {HITS}, ca AS (SELECT peak_id, c % 2 AS board, c AS channel, CASE c - b WHEN 0 THEN area ELSE area // 3 END AS area FROM (SELECT hit_id AS peak_id, channel AS b, area, unnest([channel, channel + 1, channel + 2]) AS c FROM hits)), m AS (SELECT peak_id, " + ", ".join(f"sum(CASE WHEN channel = {c} THEN area / CAST({c + 1} AS DOUBLE) ELSE 0 END) AS c{c}" for c in range(7)) + " FROM ca WHERE channel < 7 GROUP BY peak_id) SELECT peak_id, round(" + " + ".join(f"{c + 1} * c{c}" for c in range(7)) + ", 6) AS weighted FROM m")
def model_input(spark, sf_dir):
    """Counts by the model's seven channels, as one weighted sum."""
    m = events.channel_matrix(shared_light(spark, sf_dir), [(c % 2, c) for c in range(7)], [c + 1.0 for c in range(7)])
    return m.select("peak_id", F.round(sum((F.col("counts")[c] * (c + 1) for c in range(7)), F.lit(0.0)), 6).alias("weighted"))


@query(f"WITH {HITS}, {LAYOUT} SELECT hit_id, CASE WHEN channel = 5 THEN {NAN} ELSE area / gain END AS area_pe FROM hits JOIN layout USING (board, channel)")
def pe_calibration(spark, sf_dir):
    """Channel 5 has no gain."""
    gains = layout(spark).select("board", "channel", "gain").filter("channel <> 5")
    return peaks.calibrate(hits(spark, sf_dir), gains).select("hit_id", "area_pe")


CONFIG = {"defaults": {"threshold": 10.0, "role": "detector"}, "groups": [{"name": "low", "channels": ["0:0", (0, 2), "1:1"], "config": {"threshold": 5.0}}, {"name": "veto", "channels": ["0:2"], "config": {"role": "veto"}}], "channels": {"1:1": {"threshold": 7.5}, (0, 4): {"role": "veto"}}}


@query(f"WITH {HITS} SELECT DISTINCT board, channel, CASE WHEN channel IN (0, 2) THEN CAST(5 AS DOUBLE) WHEN channel = 1 THEN CAST(7.5 AS DOUBLE) WHEN channel = 6 THEN CAST(3 AS DOUBLE) ELSE CAST(10 AS DOUBLE) END AS threshold, CASE WHEN channel IN (2, 4) THEN 'veto' ELSE 'detector' END AS role, true AS base FROM hits")
def channel_settings(spark, sf_dir):
    """Base, defaults, groups and channels, and the run's own block."""
    found = [tuple(r) for r in hits(spark, sf_dir).select("board", "channel").distinct().collect()]  # a detector's channels
    run = {"r1": CONFIG | {"channels": CONFIG["channels"] | {"0:6": {"threshold": 3.0}}}}
    settings = detector.effective(found, {"threshold": 1.0, "base": True}, run, "r1")
    return detector.settings_table(spark, settings, "threshold double, role string, base boolean")


@query(island_sql(GAP) + """, h AS (SELECT CAST(island AS BIGINT) AS peak_id, hit_id AS merged_index, "start" AS t0, "end" AS t1 FROM i) SELECT peak_id, merged_index * 2 + k AS hit_index, t0 + k AS time_start,
 (t0 + k - lag(t0 + k) OVER w) / CAST(1000 AS DOUBLE) AS dt_start_to_start_ns, (t0 + k - lag(t1) OVER w) / CAST(1000 AS DOUBLE) AS dt_end_to_start_ns FROM h, (SELECT unnest([0, 1]) AS k) WINDOW w AS (PARTITION BY peak_id ORDER BY t0 + k, merged_index * 2 + k)""")
def hits_of_peaks(spark, sf_dir):
    """From peaks over merged hits to hits, with the intervals between them; each merged hit stands for two hits."""
    i = clusters.islands(hits(spark, sf_dir), GAP)
    peak_parts = i.select(F.col("island").alias("peak_id"), F.col("hit_id").alias("merged_index"))
    both = i.withColumn("k", F.explode(F.array(F.lit(0), F.lit(1))))
    merged_parts = both.select(F.col("hit_id").alias("merged_index"), (F.col("hit_id") * 2 + F.col("k")).alias("hit_index"))
    each = both.select((F.col("hit_id") * 2 + F.col("k")).alias("hit_index"), (F.col("start") + F.col("k")).alias("time_start"), F.col("end").alias("time_end"))
    return lookup.hits_of_peaks(peak_parts, merged_parts, each).select("peak_id", "hit_index", "time_start", "dt_start_to_start_ns", "dt_end_to_start_ns")


@query(f"WITH {HITS} SELECT board, channel, count(*) AS n_hits, min(\"start\") AS t_min, max(\"end\") AS t_max, CAST(sum(area) AS BIGINT) AS area FROM hits GROUP BY board, channel")
def run_statistics(spark, sf_dir):
    return peaks.run_statistics(hits(spark, sf_dir))


@query(f"WITH {HITS} SELECT hit_id FROM hits WHERE area > 6000 AND channel <> 3")
def filter_by_function(spark, sf_dir):
    """By a function of a column and by one of the rows."""
    some = peaks.filtered(hits(spark, sf_dir), lambda a: a > 6000, "area")
    return peaks.filtered(some, lambda df: df["channel"] != 3).select("hit_id")


@query(f"WITH {HITS} SELECT hit_id, CASE WHEN area BETWEEN 0 AND 2000 AND (\"end\" - \"start\") < 20000000 THEN CASE WHEN height >= 1500 THEN 3 ELSE 1 END WHEN height >= 1500 THEN 2 ELSE 0 END AS label FROM hits")
def s1_s2_ranges(spark, sf_dir):
    """The older classifier: S1 and S2 by ranges, a label of its own where both hold."""
    h = hits(spark, sf_dir).withColumn("width", F.col("end") - F.col("start"))
    return peaks.classify_ranges(h, {"area": (0, 2000), "width": (None, 19_999_999)}, {"height": (1500, None)}, "both").select("hit_id", "label")
