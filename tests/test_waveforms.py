"""Waveform rules against the values worked out by hand and against plain walks."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.functions import kernels, wave
from pulsegrid.operators import clusters, events, lookup, pairs, peaks, pulses

REC = "record_id long, t long, dt int, wave array<int>, baseline double, positive boolean"


def test_area_shares():
    assert kernels.share_times(np.array([0, 10, 20, 30, 40, 50, 40, 30, 20, 10, 0]), 0, 1).tolist() == [1125, 1750, 3062, 4500, 5937, 7250, 7875]
    assert kernels.share_times(np.array([0, 0, 10, 0, 10, 0]), 1000, 2).tolist() == [3200, 3400, 4000, 5000, 8000, 8600, 8800]
    assert set(kernels.share_times(np.zeros(3), 1234, 1)) == set(kernels.share_times(np.zeros(0), 1234, 1)) == {1234}


def test_pulse_features(spark):
    seg = spark.createDataFrame([(0, 6000, 12000, 2, [20.0, 40.0, 20.0]), (1, 0, 4000, 1, [10.0, -8.0, 10.0, -2.0]), (2, 5000, 8000, 1, [-2.0, 1.0, -3.0]), (3, 7, 7, 1, [])], "peak_id long, time_start long, time_end long, dt int, wave array<float>")
    got = {r["peak_id"]: r for r in pulses.peaklet_features(seg).collect()}
    assert (got[0]["time_peak"], got[0]["area"], got[0]["height"], got[0]["width"]) == (8000, 80, 40, 6.0)
    assert (got[1]["area"], got[1]["center_time"]) == (10, 0)
    assert (got[2]["area"], got[2]["height"], got[2]["center_time"], got[2]["time_peak"]) == (-4, 1, 5000, 6000)
    assert got[3]["time_peak"] == got[3]["center_time"] == 7 and got[3]["area"] == 0


def segments(spark, rows):
    return spark.createDataFrame(rows, "peak_id long, board int, channel int, dt int, t0 long, wave array<float>")


def test_waveform_merge(spark):
    twice = segments(spark, [(0, 0, 1, 1, 1000, [10.0, 20.0]), (0, 0, 1, 1, 1000, [10.0, 20.0])])
    assert [(r["time"], r["value"]) for r in pulses.merge_channels(twice, "peak_id").orderBy("time").collect()] == [(1000, 10), (2000, 20)]
    rows = [(0, 0, 1, 1, 1000, [2.0, 3.0]), (0, 0, 1, 1, 1000, [2.0, 3.0]), (0, 0, 2, 1, 2000, [5.0, 7.0]), (0, 0, 2, 1, 5000, [11.0])]
    r = pulses.peaklet_waveforms(segments(spark, rows)).first()
    assert (r["time_start"], r["time_end"], r["wave"]) == (1000, 6000, [2, 8, 7, 0, 11])
    bad = {"conflicting": [(0, 0, 1, 1, 1000, [10.0]), (0, 0, 1, 1, 1000, [11.0])], "grid": [(0, 0, 1, 1, 1000, [1.0]), (0, 0, 2, 1, 1500, [1.0])], "finite": [(0, 0, 1, 1, 0, [float("nan")])]}
    bad["one grid"] = [(0, 0, 1, 1, 0, [1.0]), (0, 0, 2, 2, 0, [1.0])]
    for word, rows in bad.items():
        with pytest.raises(Exception, match=word):
            pulses.merge_channels(segments(spark, rows), "peak_id").collect()


def test_threshold_hits(spark):
    w = [100] * 30
    w[5:8], w[15:18] = [80] * 3, [70] * 3
    rec = spark.createDataFrame([(1, 0, 2, w, 100.0, False)], REC)
    got = wave.threshold_hits(rec, 10, 0, 0).orderBy("position").collect()
    assert [(r["edge_start"], r["edge_end"], r["width"]) for r in got] == [(5, 8, 3), (15, 18, 3)]
    w = [100] * 30
    w[10:12] = [80] * 2
    r = wave.threshold_hits(spark.createDataFrame([(1, 0, 2, w, 100.0, False)], REC), 10, 2, 3).first()
    assert (r["edge_start"], r["edge_end"], r["width"]) == (8, 15, 7)
    assert wave.threshold_hits(rec, 10, keep=F.lit(False)).count() == 0


def test_basic_features_of_an_empty_record(spark):
    rec = spark.createDataFrame([(1, 0, 2, [], 100.0, False), (2, 0, 2, [90, 80, 100], 100.0, False)], REC)
    f = wave.basic_features(F.col("wave"), F.col("baseline"), F.col("positive"), (1, None), (0, 2), F.lit(None).cast("double"))
    rows = {r["record_id"]: r for r in rec.select("record_id", *[c.alias(n) for n, c in f.items()]).collect()}
    assert tuple(rows[1])[1:] == (0, 0, 0, 0) and tuple(rows[2])[1:] == (20, 20, 30, 20)


def test_merged_hits(spark):
    cols = "hit_id long, board int, channel int, dt int, start long, end long"
    make = lambda rows: spark.createDataFrame(rows, cols)
    n = lambda df, gap, cap=10_000_000: clusters.merged(df, gap, cap, ["board", "channel"]).groupBy("board", "channel", "island", "part").count().count()
    near = make([(0, 0, 0, 2, 96000, 108000), (1, 0, 0, 2, 106000, 112000)])
    assert n(near, 3000) == 1 and n(near, 0) == 2
    assert n(make([(0, 0, 0, 2, 96000, 108000), (1, 0, 1, 2, 96000, 108000)]), 100_000) == 2
    assert n(make([(0, 0, 0, 2, 100000, 104000), (1, 0, 0, 2, 200000, 204000)]), 5000) == 2
    capped = [(0, 0, 0, 2, 98000, 102000), (1, 0, 0, 2, 104000, 108000), (2, 0, 0, 2, 110000, 114000)]
    assert n(make(capped), 10_000, 12_000) == 2
    assert n(make([(0, 0, 0, 2, 0, 10), (1, 0, 0, 4, 5, 12), (2, 0, 0, 4, 8, 20)]), 100) == 2


def test_greedy_parts_over_many_batches():
    r = random.Random(3)
    start = np.sort(np.array([r.randint(0, 5000) for _ in range(900)]))
    end = start + np.array([r.randint(0, 60) for _ in range(900)])
    kind = np.array([r.randint(0, 6) == 0 for _ in range(900)], np.int64)
    whole, _ = clusters.greedy_steps(start, end, kind, 4, 50, None)
    parts, state, at = [], None, 0
    while at < 900:
        n = r.randint(1, 40)
        got, state = clusters.greedy_steps(start[at : at + n], end[at : at + n], kind[at : at + n], 4, 50, state)
        parts += got.tolist()
        at += n
    assert parts == whole.tolist()
    want, first, last, k, part = [], 0, 0, 0, -1
    for s, e, x in zip(start, end, kind):
        if part < 0 or s - last > 4 or max(last, e) - first > 50 or x != k:
            part, first, last, k = part + 1, s, e, x
        last = max(last, e)
        want.append(part)
    assert parts == want
    windows, state, at = [], None, 0
    while at < 900:
        got, state = clusters.anchored_steps(start[at : at + 7], 33, state)
        windows += got.tolist()
        at += 7
    assert windows == clusters.anchored_steps(start, 33, None)[0].tolist()


def slow_peaks(x, height, distance, prominence, width):
    """The rules one step at a time."""
    found, i = [], 1
    while i < len(x) - 1:
        j = i
        while j + 1 < len(x) and x[j + 1] == x[i]:
            j += 1
        if x[i - 1] < x[i] and j + 1 < len(x) and x[j + 1] < x[i]:
            found.append((i + j) // 2)
        i = j + 1
    found = [p for p in found if x[p] >= height]
    gone = set()
    for p in sorted(found, key=lambda p: (x[p], p), reverse=True):
        if p not in gone:
            gone |= {q for q in found if q != p and abs(q - p) < distance}
    out = []
    for p in (p for p in found if p not in gone):
        bases, sides = [], []
        for step in (-1, 1):
            i, low, base = p, x[p], p
            while 0 <= i < len(x) and x[i] <= x[p]:
                if x[i] < low:
                    low, base = x[i], i
                i += step
            bases.append(base)
            sides.append(low)
        prom = x[p] - max(sides)
        if prom < prominence:
            continue
        level, ends = x[p] - prom / 2, []
        for step, base in zip((-1, 1), bases):
            i = p
            while i != base and level < x[i]:
                i += step
            ends.append(i - step * ((level - x[i]) / (x[i - step] - x[i])) if x[i] < level else float(i))
        if ends[1] - ends[0] >= width:
            out.append((p, ends[0], ends[1]))
    return out


def test_find_peaks_against_a_walk():
    r = random.Random(6)
    n = 0
    for _ in range(400):
        x = np.array([r.choice((0, 1, 2, 3, 5, 8, 13)) for _ in range(r.randint(0, 60))], float)
        how = r.randint(0, 4), r.randint(1, 6), r.choice((0.7, 2, 4)), r.choice((0, 1, 2))
        got, want = kernels.find_peaks(x, *how), slow_peaks(x.tolist(), *how)
        assert [g[0] for g in got] == [w[0] for w in want] and np.allclose(got, want)
        n += len(got)
    assert n > 300


def test_hit_heights_and_edges(spark):
    w = [100] * 40
    w[12:16] = [60, 20, 40, 80]
    rec = spark.createDataFrame([(1, 0, 0, 5000, 2, w, 100.0, False), (2, 0, 0, 0, 2, [], 100.0, False)], "record_id long, board int, channel int, t long, dt int, wave array<int>, baseline double, positive boolean")
    r = pulses.peak_hits(rec, derivative=False, width=None).collect()
    assert len(r) == 1 and r[0]["position"] == 13 and r[0]["height"] == 80 and r[0]["timestamp"] == 5000 + 13 * 2000 and r[0]["integral"] == 0
    assert pulses.peak_hits(rec, width=None).first()["position"] == 11  # the middle of two equal steps
    assert kernels.find_hits(np.array([5, 5, -20, -20, 5, -16, 5]), 5.0, 20).tolist() == [2, 5]
    with pytest.raises(ValueError):
        pulses.peak_hits(rec, method="none")


def test_smoothing_is_a_polynomial_fit():
    r = np.random.default_rng(1)
    x = r.normal(size=(3, 40))
    got = kernels.smooth(x, 11, 2)
    for row, y in zip(x, got):
        for i in range(40):
            lo = min(max(0, i - 5), 29)
            fit = np.polyfit(np.arange(lo, lo + 11), row[lo : lo + 11], 2)
            assert y[i] == pytest.approx(np.polyval(fit, i), abs=1e-4)
    assert kernels.smoothing_window(8, 11, 2) == 7 and kernels.smoothing_window(3, 11, 3) is None
    assert kernels.smooth(np.ones(2), 11, 2).tolist() == [1, 1]


def test_band_pass_response():
    for order, low, high, rate in ((4, 0.02, 0.2, 0.5), (3, 5.0, 12.0, 100.0), (1, 0.1, 0.3, 1.0)):
        s = kernels.band_pass(order, low, high, rate)
        w1, w2 = (2 * rate * math.tan(math.pi * f / rate) for f in (low, high))
        for f in np.linspace(0.001, 0.49, 40) * rate:
            z = np.exp(2j * np.pi * f / rate)
            gain = np.prod([abs((b0 + b1 / z + b2 / z**2) / (1 + a1 / z + a2 / z**2)) for b0, b1, b2, _, a1, a2 in s])
            w = 2 * rate * math.tan(math.pi * f / rate)
            assert gain == pytest.approx(1 / math.sqrt(1 + ((w * w - w1 * w2) / (w * (w2 - w1))) ** (2 * order)), rel=1e-6)
    s = kernels.band_pass(4, 0.02, 0.2, 0.5)
    t = np.arange(400)
    inside = np.sin(2 * np.pi * 0.16 * t)
    assert np.allclose(kernels.zero_phase(s, inside)[100:300], inside[100:300], atol=0.02)  # neither delayed nor weakened
    assert np.abs(kernels.zero_phase(s, np.full(400, 7.0))).max() < 1e-3
    assert kernels.zero_phase(s, np.arange(27.0)).tolist() == list(range(27)) and kernels.padding(s) == 27
    with pytest.raises(ValueError):
        kernels.band_pass(4, 0.1, 0.5, 0.5)


def test_filters_by_channel(spark):
    rows = [(i, 0, i % 2, [float(x) for x in np.random.default_rng(i).normal(size=50)]) for i in range(4)] + [(9, 0, 0, [])]
    rec = spark.createDataFrame(rows, "record_id long, board int, channel int, wave array<float>")
    got = {r["record_id"]: r["wave"] for r in pulses.filtered_waves(rec, by_channel={(0, 1): {"kind": "BW", "low": 0.02, "high": 0.2}}).collect()}
    for i, _, c, w in rows[:4]:
        want = kernels.zero_phase(kernels.band_pass(4, 0.02, 0.2, 0.5), np.array(w)) if c else kernels.smooth(np.array(w))
        assert np.allclose(got[i], want, atol=1e-5)
    assert got[9] == []


def test_rise_and_fall():
    w = np.zeros(100)
    w[60:71] = [1, 2, 4, 6, 8, 10, 8, 6, 4, 2, 1]
    rise, fall, total, top = kernels.rise_and_fall(w, 65, interpolate=True)
    assert (top, rise, fall, total) == pytest.approx((10, 0.0, 70 - 65.5, 70 - 60))  # 90 % is not reached before the peak itself
    assert kernels.rise_and_fall(w, 10) is None and kernels.rise_and_fall(w, 100) is None


def test_pairs_flags_and_ratio(spark):
    side = "peak_id long, t long, area double"
    one = pairs.candidates(spark.createDataFrame([(1, 1000, 100.0)], side), spark.createDataFrame([(9, 20000, 5000.0)], side), 50000).first()
    assert (one["drift"], one["n_s1"], one["n_s2"], one["flags"]) == (19000, 1, 1, 1) and one["log10_ratio"] == pytest.approx(math.log10(50))
    s1 = spark.createDataFrame([(1, 5000, 0.0), (2, 12000, 1.0), (3, 19000, 1.0)], side)
    s2 = spark.createDataFrame([(9, 20000, -4.0)], side)
    got = {r["s1_id"]: r["log10_ratio"] for r in pairs.candidates(s1, s2, 15000).collect()}
    assert got[1] == 0 and math.isnan(got[2]) and sorted(r["s1_id"] for r in pairs.candidates(s1, s2, 10000).collect()) == [2, 3]


def test_pair_selection_with_orphans(spark):
    """The reference's cases: two S1 of one S2 and an orphan of each kind; drifts 100 and 200."""
    cols = "s1_id long, s2_id long, drift long, s1_area double, s2_area double, s1_width double, s1_n_channels int, s2_n_channels int, flags int"
    p = spark.createDataFrame([(1, 20, 100, 100.0, 1000.0, 1.0, 1, 1, 1), (2, 20, 200, 200.0, 1000.0, 1.0, 1, 1, 1), (7, -1, -1, 5.0, 0.0, 1.0, 1, 0, 128), (-1, 8, -1, 0.0, 5.0, 1.0, 0, 1, 256), (3, 20, 50, 2000.0, 1000.0, 1.0, 1, 1, 1)], cols)
    ranked = pairs.select(p, chosen_only=False).collect()
    assert sorted((r["s1_id"], r["selected"]) for r in ranked) == [(1, False), (2, True)]
    near = spark.createDataFrame([(10, 20, 100, 100.0, 1000.0, 1.0, 1, 1, 1), (11, 20, 200, 160.0, 1000.0, 1.0, 1, 1, 1), (5, -1, -1, 1.0, 0.0, 1.0, 1, 0, 128)], cols)
    one = pairs.select(near, "nearest").first()
    assert one["s1_id"] == 10 and one["score"] == pytest.approx(1 - 101 / 201)
    best = pairs.select(near, "best_score").first()
    assert best["s1_id"] == 11
    assert pairs.select(p, "all").count() == 2 and pairs.select(p, "all", larger=False).count() == 3
    keep = pairs.mask({"drift": (None, 150)}, flags_none=384)
    assert sorted(r["s1_id"] for r in p.filter(keep).collect()) == [1, 3]


def test_positions_and_events_without_light(spark):
    chosen = spark.createDataFrame([(0, 1, 20, 0, 5000, 5000, 100.0, 50.0, 1, 1, 0.9)], "pair_id long, s1_id long, s2_id long, s1_t long, s2_t long, drift long, s1_area double, s2_area double, n_s1 int, n_s2 int, score double")
    light = spark.createDataFrame([(20, 0, 0, 5.0)], "peak_id long, board long, channel long, area double")
    layout = spark.createDataFrame([(0, 0, 3.0, 4.0, 2.0)], "board long, channel long, x double, y double, gain double")
    weak = events.positions(chosen, light, layout).first()
    assert weak["flags"] == events.Z_DONE | events.LOW_S2_SIGNAL and math.isnan(weak["x"]) and weak["position_goodness"] == 0.1
    p = events.positions(chosen, light, layout, least_s2=10.0, radius=6.0, edge=2.0)
    r = p.first()
    assert (r["x"], r["y"], r["r"], r["xy_ndf"], r["flags"]) == (3, 4, 5, 1, 1 | 2 | 4 | 16) and r["z"] == pytest.approx(5.0 * 0.0013)
    e = events.events(chosen, p, "run").first()
    assert e["flags"] == events.EVENT_VALID | events.HAS_POSITION | events.FIDUCIAL | events.SINGLE_SCATTER and e["run_id"] == "run"
    assert events.events(chosen, p.limit(0), "run").count() == 0
    nan = spark.createDataFrame([(20, 0, 0, float("nan"))], light.schema)
    assert math.isnan(events.positions(chosen, nan, layout, least_s2=10.0).first()["x"])


def test_peaks_need_features_and_keep_areas(spark):
    p = spark.createDataFrame([(0, 1, 1), (1, 1, 1)], "peak_id long, n_hits int, n_channels int")
    f = spark.createDataFrame([(0, 5.0)], "peak_id long, area double")
    with pytest.raises(Exception, match="no features for peak 1"):
        peaks.assembled(p, f).collect()
    c = spark.createDataFrame([(0, 0, 1, 5.5, 1.0)], "peak_id long, board int, channel int, area double, area_fraction double")
    with pytest.raises(Exception, match="not conserved"):
        peaks.conserved(c, f).collect()
    specs = {"s1": {"accept": [{"width": (0, 100), "area": (0, 500)}]}, "s2": {"accept": [{"width": (300, None), "area": (1000, None)}, {"nosuch": (0, 1)}]}}
    w = spark.createDataFrame([(0, 50.0, 100.0), (1, 400.0, 2000.0), (2, 150.0, 500.0), (3, float("nan"), 1.0)], "peak_id long, width double, area double")
    assert [r["label"] for r in peaks.classify(w, specs).orderBy("peak_id").collect()] == [1, 2, 0, 0]


def test_lookups(spark):
    h = spark.createDataFrame([(0, 10, 8, 12, 100000, 2), (1, 14, 13, 16, 108000, 2)], "hit_index long, position long, edge_start int, edge_end int, timestamp long, dt int")
    parts = spark.createDataFrame([(5, 0), (5, 1)], "merged_index long, hit_index long")
    got = lookup.hits_of_merged(parts, lookup.hit_times(h)).orderBy("hit_index").collect()
    assert [(r["time_start"], r["time_end"]) for r in got] == [(96000, 104000), (106000, 112000)] and got[0]["dt_start_to_start_ns"] is None and (got[1]["dt_start_to_start_ns"], got[1]["dt_end_to_start_ns"]) == (10.0, 2.0)
    c = spark.createDataFrame([(0, 0, 1, 5.0, 1.0, 1, 0.2), (0, 0, 2, 20.0, 1.0, 1, 0.8)], "peak_id long, board int, channel int, area double, height double, n_hits int, area_fraction double")
    assert [x["channel"] for x in lookup.peak_channels(c).first()["channels"]] == [2, 1]
    assert lookup.members(parts, "merged_index", "hit_index").first()["hit_indexs"] == [0, 1]
