"""Registered queries over the driver's tables, and SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import wave
from ..operators import clusters, histogram, peaks
from ..operators.order import numbered, running_sum
from .registry import ORACLE_SQL, QUERIES, query
from .views import HITS, RECORDS, hits, records, table

__all__ = ["ORACLE_SQL", "QUERIES"]

GAP, WINDOW, CAP = 60_000_000, 300_000_000, 900_000_000
#: A cap that many islands pass, so that the sequential rule has work.
TIGHT = 40_000_000


def island_sql(gap: int, keys: str = "") -> str:
    part = f"PARTITION BY {keys}" if keys else ""
    return f"""WITH {HITS}, p AS (SELECT *, max("end") OVER ({part} ORDER BY "start", hit_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM hits),
i AS (SELECT *, sum(CASE WHEN prev IS NULL OR "start" - prev > {gap} THEN 1 ELSE 0 END) OVER ({part} ORDER BY "start", hit_id) - 1 AS island FROM p)"""


# ---- clusters

@query(island_sql(GAP) + """ SELECT CAST(island AS BIGINT) AS island, min("start") AS time_start, max("end") AS time_end, count(*) AS n_hits,
 count(DISTINCT (board, channel)) AS n_channels, CAST(sum(area) AS BIGINT) AS area, (min("start") + max("end")) // 2 AS center_time FROM i GROUP BY island""")
def hit_grouped(spark, sf_dir):
    return clusters.summary(clusters.islands(hits(spark, sf_dir), GAP), ["island"])


@query(island_sql(GAP, "board, channel") + """ SELECT board, channel, CAST(island AS BIGINT) AS island, count(*) AS n_hits, min("start") AS time_start, max("end") AS time_end
 FROM i GROUP BY board, channel, island""")
def hit_clusters_by_channel(spark, sf_dir):
    c = clusters.islands(hits(spark, sf_dir), GAP, ["board", "channel"])
    return c.groupBy("board", "channel", "island").agg(F.count("*").alias("n_hits"), F.min("start").alias("time_start"), F.max("end").alias("time_end"))


def greedy_sql(gap: int, cap: int, keys: str = "", same: str = "0") -> str:
    """Islands, then their rows one after the other; the state is the open cluster."""
    k = f"{keys}, " if keys else ""
    on = " AND ".join(f"o.{c} = w.{c}" for c in [*filter(None, keys.split(", ")), "island"])
    ok = f'o."start" - w.last <= {gap} AND greatest(w.last, o."end") - w.first <= {cap} AND o.kind = w.kind'
    own = ", ".join(f"o.{c}" for c in filter(None, keys.split(", ")))
    return island_sql(gap, keys).replace("WITH ", "WITH RECURSIVE ", 1) + f""", o AS (SELECT *, {same} AS kind, row_number() OVER (PARTITION BY {k}island ORDER BY "start", hit_id) AS rn FROM i),
w AS (SELECT {k}island, rn, hit_id, 0 AS part, "start" AS first, "end" AS last, kind FROM o WHERE rn = 1
 UNION ALL SELECT {own + ", " if own else ""}o.island, o.rn, o.hit_id, CASE WHEN {ok} THEN w.part ELSE w.part + 1 END, CASE WHEN {ok} THEN w.first ELSE o."start" END,
 CASE WHEN {ok} THEN greatest(w.last, o."end") ELSE o."end" END, CASE WHEN {ok} THEN w.kind ELSE o.kind END FROM w JOIN o ON {on} AND o.rn = w.rn + 1),
c AS (SELECT o.*, CAST(w.part AS BIGINT) AS part FROM o JOIN w ON {on} AND o.rn = w.rn)"""


CHANNEL = ["board", "channel"]


def merged(spark, sf_dir):
    return clusters.merged(hits(spark, sf_dir), GAP, TIGHT, CHANNEL)


def merged_rows(c):
    """A row per merged hit: bounds, anchor (the member nearest to the middle) and, if all members share a record, the sample window."""
    keys = [*CHANNEL, "island", "part"]
    of_cluster = Window.partitionBy(*keys)  # not a join: bounds and members come from one walk
    c = c.withColumns({"time_start": F.min("start").over(of_cluster), "time_end": F.max("end").over(of_cluster)})
    near = F.struct(F.abs(F.col("start") + F.col("end") - F.col("time_start") - F.col("time_end")), F.col("start"), F.col("hit_id"))
    anchor = F.min_by(F.struct("hit_id", "record_id", "dt"), near).alias("a")
    shape = [F.min("start").alias("time_start"), F.max("end").alias("time_end"), F.count("*").alias("component_count"), F.min("record_id").alias("lo"), F.max("record_id").alias("hi"), F.min("sample_start").alias("s"), F.max("sample_end").alias("e")]
    m = c.groupBy(*keys).agg(*shape, anchor)
    one = F.col("lo") == F.col("hi")
    window = [F.when(one, F.col(x)).otherwise(-1).alias(n) for x, n in (("s", "sample_start"), ("e", "sample_end"))]
    width = F.when(one, F.col("e") - F.col("s")).otherwise(-1).cast("double").alias("width")
    return m.select(*keys, "time_start", "time_end", "component_count", F.col("a.hit_id").alias("anchor"), F.col("a.record_id").alias("record_id"), F.col("a.dt").alias("dt"), *window, width, one.alias("is_single_record"))


MERGED_ROWS = """, m AS (SELECT board, channel, island, part, min("start") AS ts, max("end") AS te, count(*) AS n, min(record_id) AS lo, max(record_id) AS hi, min(sample_start) AS s, max(sample_end) AS e FROM c GROUP BY board, channel, island, part),
a AS (SELECT m.*, c.hit_id, c.record_id, c.dt, row_number() OVER (PARTITION BY m.board, m.channel, m.island, m.part ORDER BY abs(c."start" + c."end" - m.ts - m.te), c."start", c.hit_id) AS k FROM m JOIN c USING (board, channel, island, part))
SELECT board, channel, CAST(island AS BIGINT) AS island, part, ts AS time_start, te AS time_end, n AS component_count, hit_id AS anchor, record_id, dt,
 CASE WHEN lo = hi THEN s ELSE -1 END AS sample_start, CASE WHEN lo = hi THEN e ELSE -1 END AS sample_end, CAST(CASE WHEN lo = hi THEN e - s ELSE -1 END AS DOUBLE) AS width, lo = hi AS is_single_record FROM a WHERE k = 1"""


@query(greedy_sql(GAP, TIGHT, "board, channel", "dt") + MERGED_ROWS)
def hit_merged(spark, sf_dir):
    """Gap and width rule per channel and dt."""
    return merged_rows(merged(spark, sf_dir))


@query(f"WITH {HITS}, c AS (SELECT *, row_number() OVER (PARTITION BY board, channel ORDER BY \"start\", hit_id) - 1 AS island, CAST(0 AS BIGINT) AS part FROM hits)" + MERGED_ROWS)
def hit_merged_disabled(spark, sf_dir):
    """A gap of 0: every hit by itself."""
    return merged_rows(clusters.merged(hits(spark, sf_dir), 0, TIGHT, CHANNEL))


@query(greedy_sql(GAP, TIGHT, "board, channel", "dt") + " SELECT board, channel, CAST(island AS BIGINT) AS island, part, hit_id FROM c")
def hit_merged_components(spark, sf_dir):
    return merged(spark, sf_dir).select(*CHANNEL, "island", "part", "hit_id")


@query(greedy_sql(GAP, TIGHT, "board, channel", "dt") + ', n AS (SELECT *, dense_rank() OVER (ORDER BY board, channel, island, part) - 1 AS cluster_index FROM c) SELECT cluster_index, hit_id AS hit_index FROM n')
def hit_merge_clusters(spark, sf_dir):
    """Clusters numbered channel by channel."""
    keys = [*CHANNEL, "island", "part"]
    c = merged(spark, sf_dir).select(*keys, "hit_id").persist()  # the numbers read it several times; rows and numbers come from one walk
    return c.join(numbered(c.select(*keys).distinct(), keys, "cluster_index"), keys).select("cluster_index", F.col("hit_id").alias("hit_index"))


def peaklet_members(spark, sf_dir):
    """Gap and width rule over all channels, with peak_id from 0 in time order."""
    c = clusters.greedy(hits(spark, sf_dir), GAP, CAP)
    return c.join(numbered(c.select("island", "part").distinct(), ["island", "part"], "peak_id"), ["island", "part"])


PEAKLETS = greedy_sql(GAP, CAP) + ", pk AS (SELECT *, dense_rank() OVER (ORDER BY island, part) - 1 AS peak_id FROM c)"


@query(PEAKLETS + """, s AS (SELECT peak_id, min("start") AS time_start, max("end") AS time_end, count(*) AS n_hits, count(DISTINCT (board, channel)) AS n_channels, CAST(sum(area) AS BIGINT) AS area FROM pk GROUP BY peak_id)
SELECT *, (time_start + time_end) // 2 AS center_time, CAST(sum(n_hits) OVER (ORDER BY peak_id) - n_hits AS BIGINT) AS component_offset FROM s""")
def peaklets(spark, sf_dir):
    s = clusters.summary(peaklet_members(spark, sf_dir), ["peak_id"])
    d = running_sum(s, F.col("n_hits"), ["peak_id"], "_after")
    return d.withColumn("component_offset", F.col("_after") - F.col("n_hits")).drop("_after")


@query(PEAKLETS + " SELECT peak_id, hit_id AS merged_index FROM pk")
def peaklet_components(spark, sf_dir):
    return peaklet_members(spark, sf_dir).select("peak_id", F.col("hit_id").alias("merged_index"))


ANCHORED = f"""WITH RECURSIVE {HITS}, p AS (SELECT *, lag("start") OVER (ORDER BY "start", hit_id) AS prev FROM hits),
i AS (SELECT *, sum(CASE WHEN prev IS NULL OR "start" - prev > {WINDOW} THEN 1 ELSE 0 END) OVER (ORDER BY "start", hit_id) - 1 AS island FROM p),
o AS (SELECT *, row_number() OVER (PARTITION BY island ORDER BY "start", hit_id) AS rn FROM i),
w AS (SELECT island, rn, 0 AS part, "start" AS first FROM o WHERE rn = 1
 UNION ALL SELECT o.island, o.rn, CASE WHEN o."start" > w.first + {WINDOW} THEN w.part + 1 ELSE w.part END, CASE WHEN o."start" > w.first + {WINDOW} THEN o."start" ELSE w.first END FROM w JOIN o ON o.island = w.island AND o.rn = w.rn + 1),
m AS (SELECT CAST(o.island AS BIGINT) AS island, CAST(w.part AS BIGINT) AS part, list({{'channel': channel, 'time': "start", 'hit_id': hit_id, 'area': area, 'height': height}} ORDER BY channel, "start", hit_id) AS m FROM o JOIN w ON o.island = w.island AND o.rn = w.rn GROUP BY 1, 2),
e AS (SELECT island, part, len(m) AS n_hits, m[1].time AS t_min, m[-1].time AS t_max, m[-1].time - m[1].time AS dt, m FROM m)"""


def event_windows(spark, sf_dir):
    h = hits(spark, sf_dir).withColumnRenamed("start", "t")
    return clusters.event_rows(clusters.anchored(h, WINDOW), ["island", "part"])


def joined(c):
    return F.array_join(F.col(c).cast("array<string>"), ",").alias(c)


@query(ANCHORED + """ SELECT island, part, n_hits, t_min, t_max, dt, array_to_string(list_transform(m, lambda x: x.channel), ',') AS channels, array_to_string(list_transform(m, lambda x: x.area), ',') AS areas,
 array_to_string(list_transform(m, lambda x: x.height), ',') AS heights, array_to_string(list_transform(m, lambda x: x.time), ',') AS timestamps FROM e""")
def df_events(spark, sf_dir):
    """The lists of an event, in channel order, as text."""
    return event_windows(spark, sf_dir).select("island", "part", "n_hits", "t_min", "t_max", "dt", *map(joined, ("channels", "areas", "heights", "timestamps")))


def paired(events, window: int, n_channels: int = 2, first: int = 6):
    """Events whose channel-ordered span is within the window, with the first lists' entries as columns."""
    at = lambda c, i: F.get(c, F.lit(i))
    cols = [at(f"{c}s", i).alias(f"{c}_ch{first + i}") for c in ("area", "height") for i in range(n_channels)]
    return events.filter(F.col("dt") <= window).select("island", "part", "n_hits", (F.element_at("timestamps", -1) - F.element_at("timestamps", 1)).alias("delta_t"), *cols)


@query(ANCHORED + f" SELECT island, part, n_hits, t_max - t_min AS delta_t, m[1].area AS area_ch6, m[2].area AS area_ch7, m[1].height AS height_ch6, m[2].height AS height_ch7 FROM e WHERE dt <= {WINDOW // 2}")
def df_paired(spark, sf_dir):
    return paired(event_windows(spark, sf_dir), WINDOW // 2)


@query(ANCHORED + f" SELECT island, part, n_hits, t_max - t_min AS delta_t, m[1].area AS area_ch6, m[2].area AS area_ch7, m[1].height AS height_ch6, m[2].height AS height_ch7 FROM e WHERE dt <= {WINDOW} AND n_hits >= 2")
def df_paired_custom(spark, sf_dir):
    """Pairing by the caller's own function of the events."""
    return event_windows(spark, sf_dir).transform(lambda e: paired(e.filter("n_hits >= 2"), WINDOW))


@query(island_sql(GAP) + ', m AS (SELECT island, hit_id, "start", "start" - lag("start") OVER (PARTITION BY island ORDER BY "start", hit_id) AS dt_start_to_start, "start" - lag("end") OVER (PARTITION BY island ORDER BY "start", hit_id) AS dt_end_to_start FROM i) SELECT CAST(island AS BIGINT) AS island, hit_id, dt_start_to_start, dt_end_to_start FROM m')
def hit_intervals(spark, sf_dir):
    w = Window.partitionBy("island").orderBy("start", "hit_id")
    return clusters.islands(hits(spark, sf_dir), GAP).select("island", "hit_id", (F.col("start") - F.lag("start").over(w)).alias("dt_start_to_start"), (F.col("start") - F.lag("end").over(w)).alias("dt_end_to_start"))


@query(island_sql(GAP) + ", g AS (SELECT CAST(island AS BIGINT) AS island, list_sort(list(hit_id)) AS ids FROM i GROUP BY island) SELECT island, array_to_string(ids, ',') AS hit_ids FROM g")
def cluster_lookup(spark, sf_dir):
    return clusters.islands(hits(spark, sf_dir), GAP).groupBy("island").agg(F.array_join(F.array_sort(F.collect_list("hit_id")).cast("array<string>"), ",").alias("hit_ids"))


@query(island_sql(GAP) + """, c AS (SELECT CAST(island AS BIGINT) AS island, board, channel, CAST(sum(area) AS BIGINT) AS area, max(height) AS height, count(*) AS n_hits FROM i GROUP BY island, board, channel)
SELECT *, CASE WHEN sum(area) OVER w = 0 THEN 0.0 ELSE area / sum(area) OVER w END AS area_fraction FROM c WINDOW w AS (PARTITION BY island)""")
def peaklet_channels(spark, sf_dir):
    return peaks.channel_areas(clusters.islands(hits(spark, sf_dir), GAP), "island")


@query(island_sql(GAP) + """, e AS (SELECT CAST(island AS BIGINT) AS island, list_sort(list_distinct(list(channel))) AS channels FROM i GROUP BY island)
SELECT island, len(channels) AS n_channels FROM e WHERE list_has_all(channels, [1, 3])""")
def coincidence(spark, sf_dir):
    e = clusters.islands(hits(spark, sf_dir), GAP).groupBy("island").agg(F.array_sort(F.collect_set("channel")).alias("channels"))
    return peaks.coincidence(e, [1, 3]).select("island", F.size("channels").cast("long").alias("n_channels"))


@query(island_sql(GAP) + """, f AS (SELECT CAST(island AS BIGINT) AS island, channel, area, row_number() OVER (PARTITION BY island, channel ORDER BY hit_id) AS k FROM i)
SELECT island, max(CASE WHEN channel = 1 THEN area END) AS area_1, max(CASE WHEN channel = 3 THEN area END) AS area_3 FROM f WHERE k = 1 GROUP BY island""")
def channel_attributes(spark, sf_dir):
    m = clusters.islands(hits(spark, sf_dir), GAP).groupBy("island").agg(F.array_sort(F.collect_list(F.struct("hit_id", "channel", "area"))).alias("m"))
    return m.select("island", *[peaks.attribute(F.col("m.channel"), F.col("m.area"), c).alias(f"area_{c}") for c in (1, 3)])


# ---- waveforms

@query(f"""WITH {RECORDS} SELECT record_id, CAST(CASE WHEN positive THEN list_max(wave) ELSE -list_min(wave) END AS DOUBLE) AS height, CAST(list_max(wave) - list_min(wave) AS DOUBLE) AS amp,
 CAST(CASE WHEN positive THEN list_sum(wave) ELSE -list_sum(wave) END AS DOUBLE) AS area,
 CAST(list_max(list_transform(range(2, len(wave) + 1), lambda i: abs(wave[i] - wave[i - 1]))) AS DOUBLE) AS max_abs_diff FROM records""")
def basic_features(spark, sf_dir):
    f = wave.basic_features(F.col("wave"), F.col("baseline"), F.col("positive"))
    return records(spark, sf_dir).select("record_id", *[c.alias(n) for n, c in f.items()])


ASYM = "CASE WHEN positive THEN list_max(wave) ELSE -list_min(wave) END"


@query(f"WITH {RECORDS} SELECT record_id, list_max(wave) > list_min(wave) AND {ASYM} > 0 AND {ASYM} <= list_max(wave) - list_min(wave) AND {ASYM} >= 0.5 * (list_max(wave) - list_min(wave)) AS keep FROM records")
def records_asymmetry_mask(spark, sf_dir):
    return records(spark, sf_dir).select("record_id", wave.asymmetry(F.col("wave"), F.col("baseline"), F.col("positive"), 0.5).alias("keep"))


@query(f"WITH {RECORDS} SELECT record_id, channel NOT IN (2, 7) AND list_max(wave) > list_min(wave) AND {ASYM} > 0 AND {ASYM} <= list_max(wave) - list_min(wave) AND {ASYM} >= 0.5 * (list_max(wave) - list_min(wave)) AS keep FROM records")
def records_detector_mask(spark, sf_dir):
    r = records(spark, sf_dir)
    config = spark.createDataFrame([(0, 2, "veto"), (1, 7, "veto")], "board int, channel int, role string")
    return peaks.roles(r, config, "detector", wave.asymmetry(F.col("wave"), F.col("baseline"), F.col("positive"), 0.5)).select("record_id", "keep")


@query(f"""WITH {RECORDS}, s AS (SELECT record_id, t, dt, len(wave) AS n, unnest(range(0, len(wave))) AS i, unnest(list_transform(wave, lambda x: CASE WHEN positive THEN x ELSE -x END)) >= 150 AS hot FROM records),
g AS (SELECT *, i - row_number() OVER (PARTITION BY record_id ORDER BY i) AS grp FROM s WHERE hot),
r AS (SELECT record_id, min(t) AS t, min(dt) AS dt, min(n) AS n, min(i) AS s, max(i) + 1 AS e FROM g GROUP BY record_id, grp)
SELECT record_id, (s + e - 1) // 2 AS position, greatest(0, s - 2) AS edge_start, least(n, e + 2) AS edge_end, t + ((s + e - 1) // 2) * dt * 1000 AS timestamp, least(n, e + 2) - greatest(0, s - 2) AS width FROM r""")
def hit_threshold(spark, sf_dir):
    return wave.threshold_hits(records(spark, sf_dir), 150)


@query(f"""WITH {RECORDS}, s AS (SELECT record_id, unnest(range(0, len(wave))) AS i, unnest(list_transform(wave, lambda x: greatest(0, CASE WHEN positive THEN x ELSE -x END))) AS v FROM records),
c AS (SELECT *, sum(v) OVER (PARTITION BY record_id ORDER BY i) AS acc, sum(v) OVER (PARTITION BY record_id) AS total FROM s)
SELECT record_id, CAST(max(total) AS DOUBLE) AS q_total, min(CASE WHEN acc >= CAST(0.1 AS DOUBLE) * total THEN i END) AS t_low, min(CASE WHEN acc >= CAST(0.9 AS DOUBLE) * total THEN i END) AS t_high FROM c GROUP BY record_id""")
def waveform_width_integral(spark, sf_dir):
    w = records(spark, sf_dir).select("record_id", wave.width_integral(F.col("wave"), F.col("baseline"), F.col("positive")).alias("w"))
    return w.select("record_id", F.col("w.total").alias("q_total"), "w.t_low", "w.t_high")


@query(f"""WITH {RECORDS}, s AS (SELECT channel, unnest(range(0, len(wave))) AS i, unnest(list_transform(wave, lambda x: CASE WHEN positive THEN x ELSE -x END)) AS v FROM records)
SELECT channel, i AS sample, CAST(sum(v) AS BIGINT) AS total FROM s GROUP BY channel, i""")
def waveform_sum(spark, sf_dir):
    x = records(spark, sf_dir).select("channel", F.posexplode(wave.signal(F.col("wave"), F.col("baseline"), F.col("positive"))).alias("sample", "v"))
    return x.groupBy("channel", "sample").agg(F.sum("v").cast("long").alias("total"))


# ---- histograms and samples

RANGES = {"l_quantity": (0.0, 50.0), "l_discount": (0.0, 0.1), "l_tax": (0.0, 0.08)}


def bin_sql(c: str, lo: float, hi: float, n: int) -> str:
    return f"CASE WHEN {c} BETWEEN CAST({lo} AS DOUBLE) AND CAST({hi} AS DOUBLE) THEN least({n - 1}, CAST(floor(({c} - CAST({lo} AS DOUBLE)) / CAST({(hi - lo) / n!r} AS DOUBLE)) AS INTEGER)) END"


@query(f"SELECT {bin_sql('l_quantity', 0.0, 50.0, 20)} AS bin, count(*) AS n FROM lineitem GROUP BY 1")
def histogram_1d(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(histogram.bin_of(F.col("l_quantity"), 0.0, 50.0, 20).alias("bin")).agg(F.count("*").alias("n"))


@query("WITH b AS (SELECT " + ", ".join(f"{bin_sql(c, *r, 10)} AS {c}" for c, r in RANGES.items()) + " FROM lineitem) " + " UNION ALL ".join(f"SELECT '{x}' AS x, '{y}' AS y, {x} AS xb, {y} AS yb, count(*) AS n FROM b WHERE {x} IS NOT NULL AND {y} IS NOT NULL GROUP BY {x}, {y}" for x, y in (("l_quantity", "l_discount"), ("l_quantity", "l_tax"), ("l_discount", "l_tax"))))
def corner_histogram(spark, sf_dir):
    return histogram.corner(table(spark, sf_dir, "lineitem"), RANGES, 10)


@query("""WITH b AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1)
SELECT k, n, CASE WHEN n <= 4 THEN n ELSE least(n, 12, CAST(ceil(4 + 8 * (1 - exp(-(n - 4) / CAST(8 AS DOUBLE)))) AS BIGINT)) END AS size FROM b""")
def adaptive_sample_count(spark, sf_dir):
    b = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.count("*").alias("n"))
    return b.withColumn("size", histogram.sample_size(F.col("n")))


XE, YE = histogram.linear_edges(0.0, 10_000.0, 8), [0.0, 1.0, 3.0, 4.0, 8.0]


def edge_sql(c: str, edges: list[float]) -> str:
    """Bin by explicit edges, the last one inclusive."""
    e = "[" + ", ".join(f"CAST({x!r} AS DOUBLE)" for x in edges) + "]"
    return f"CASE WHEN {c} BETWEEN {edges[0]!r} AND {edges[-1]!r} THEN CAST(least({len(edges) - 1}, len(list_filter({e}, lambda e: e <= {c}))) - 1 AS INTEGER) END"


STRATA = f"""WITH {HITS}, v AS (SELECT hit_id, CAST(area AS DOUBLE) AS x, CAST(channel AS DOUBLE) AS y FROM hits), b AS (SELECT *, {edge_sql("x", XE)} AS xb, {edge_sql("y", YE)} AS yb FROM v),
d AS (SELECT *, {XE} AS xe, {YE} AS ye FROM b WHERE xb IS NOT NULL AND yb IS NOT NULL),
f AS (SELECT *, (x - (CAST(xe[xb + 1] AS DOUBLE) + xe[xb + 2]) / 2) / (CAST(xe[xb + 2] AS DOUBLE) - xe[xb + 1]) AS dx, (y - (CAST(ye[yb + 1] AS DOUBLE) + ye[yb + 2]) / 2) / (CAST(ye[yb + 2] AS DOUBLE) - ye[yb + 1]) AS dy FROM d),
r AS (SELECT *, count(*) OVER (PARTITION BY xb, yb) AS bin_n, row_number() OVER (PARTITION BY xb, yb ORDER BY dx * dx + dy * dy, hit_id) = 1 AS representative FROM f),
q AS (SELECT *, CASE WHEN bin_n <= 4 THEN bin_n ELSE least(bin_n, 12, CAST(ceil(4 + 8 * (1 - exp(-(bin_n - 4) / CAST(8 AS DOUBLE)))) AS BIGINT)) END AS size,
 row_number() OVER (PARTITION BY xb, yb ORDER BY representative DESC, md5(CAST(hit_id AS VARCHAR) || ':0'), hit_id) AS k FROM r)"""


def strata(spark, sf_dir):
    h = hits(spark, sf_dir).withColumns({"x": F.col("area").cast("double"), "y": F.col("channel").cast("double")})
    return histogram.stratified(h, "x", "y", (8, YE), ((0.0, 10_000.0), None), "hit_id")


@query(STRATA + " SELECT hit_id, xb, yb, bin_n, representative FROM q WHERE k <= size")
def stratified_sample(spark, sf_dir):
    return strata(spark, sf_dir)[0].select("hit_id", "xb", "yb", "bin_n", "representative")


@query(STRATA + " SELECT xb, yb, bin_n, max(CASE WHEN representative THEN hit_id END) AS near, max(size) AS n_sampled, max(size) / bin_n AS sampling_fraction FROM q GROUP BY xb, yb, bin_n")
def stratified_bins(spark, sf_dir):
    return strata(spark, sf_dir)[1]


QE, PE = histogram.symlog_edges(-40.0, 50.0, 9, 2.0), histogram.log_edges(0.01, 0.11, 5)


@query(f"WITH v AS (SELECT l_quantity - 25 AS x, l_discount AS y, l_tax AS w FROM lineitem), b AS (SELECT {edge_sql('x', QE)} AS xb, {edge_sql('y', PE)} AS yb, w FROM v) SELECT xb, yb, round(sum(w), 6) AS n FROM b WHERE xb IS NOT NULL AND yb IS NOT NULL GROUP BY xb, yb")
def histogram_2d(spark, sf_dir):
    """Weighted, with symlog and log edges."""
    v = table(spark, sf_dir, "lineitem").select((F.col("l_quantity") - 25).alias("x"), F.col("l_discount").alias("y"), F.col("l_tax").alias("w"))
    return histogram.histogram_2d(v, "x", "y", QE, PE, "w").withColumn("n", F.round("n", 6))


@query(f"WITH b AS (SELECT {edge_sql('l_quantity', [0.0, 10.0, 15.0, 50.0])} AS bin FROM lineitem), c AS (SELECT bin, count(*) AS n FROM b WHERE bin IS NOT NULL GROUP BY bin) SELECT bin, n / sum(n) OVER () / CAST(CASE bin WHEN 0 THEN 10 WHEN 1 THEN 5 ELSE 35 END AS DOUBLE) AS n FROM c")
def histogram_density(spark, sf_dir):
    return histogram.histogram(table(spark, sf_dir, "lineitem"), "l_quantity", [0.0, 10.0, 15.0, 50.0], density=True)


@query(f"""WITH {HITS}, e AS (SELECT hit_id, CAST(channel - 3 AS DOUBLE) AS x, CAST(board * 2 - 1 AS DOUBLE) AS y, area AS s1_area, height - 5000 AS s2_area FROM hits)
SELECT hit_id, x * x + y * y AS r2, round(sqrt(x * x + y * y), 9) AS r, round(atan2(y, x), 9) AS theta, round(cos(atan2(y, x)), 9) AS cos_theta, CASE WHEN s1_area > 0 THEN round(log10(s1_area), 9) ELSE 'nan'::DOUBLE END AS log10_s1, CASE WHEN s2_area > 0 THEN round(log10(s2_area), 9) ELSE 'nan'::DOUBLE END AS log10_s2 FROM e""")
def dashboard_frame(spark, sf_dir):
    e = hits(spark, sf_dir).select("hit_id", (F.col("channel") - 3).alias("x"), (F.col("board") * 2 - 1).alias("y"), F.col("area").alias("s1_area"), (F.col("height") - 5000).alias("s2_area"))
    d = peaks.dashboard(e).drop("x", "y", "s1_area", "s2_area")
    return d.withColumns({c: F.round(c, 9) for c in ("r", "theta", "cos_theta", "log10_s1", "log10_s2")})
