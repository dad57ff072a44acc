"""Rules that small tables don't show: plans that change while they run, values on a bound, long texts."""

import random
from contextlib import contextmanager

from pyspark.sql import functions as F

from pulsegrid.functions import wave
from pulsegrid.llm import common, jaccard, secrets
from pulsegrid.operators import clusters, pairs
from pulsegrid.plans import catalogue


@contextmanager
def settings(spark, **conf):
    conf = {"spark.sql." + k.replace("__", "."): v for k, v in conf.items()}
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_streamed_rows_are_dealt_by_a_shuffle_of_their_own(spark):
    """A repartition by the join's own columns is optimised out; a broadcast in the join's place then parts an island's rows."""
    df = spark.range(5000).selectExpr("id AS start", "id + 9 AS end", "id AS hit_id", "id % 3 AS channel")
    with settings(spark, autoBroadcastJoinThreshold="-1"):
        plan = clusters.greedy(df, 40, 60, ["channel"], rows_per_range=100)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_COL" in plan


def test_a_pulse_on_the_bound_of_the_asymmetry_mask_passes(spark):
    df = spark.createDataFrame([(1, [55, -45], True), (2, [54, -46], True), (3, [-55, 45], False), (4, [110, -90], True)], "record_id long, wave array<int>, positive boolean")
    keep = wave.asymmetry(F.col("wave"), F.lit(0), F.col("positive"), 0.55)
    assert sorted(r["record_id"] for r in df.filter(keep).collect()) == [1, 3, 4]


def test_ordinary_strings_come_from_the_whole_text(spark):
    """Numbers up to the end of the text, and their last piece, count among the ordinary strings."""
    texts = [" ".join(["1234567"] * n) for n in (3, 50, 51, 400)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: [x["stratum"].split(":") for x in r["o"]] for r in df.select("doc_id", secrets.ordinary(F.col("text")).alias("o")).collect()}
    for i, t in enumerate(texts):
        digits = len(t.replace(" ", ""))
        bands = [int(b) for kind, b in got[i] if kind == "hex"]
        assert len(set(bands)) == 1 and len(bands) == -(-digits // secrets.LENGTHS[bands[0] - 1])


def test_the_largest_pairs_without_listing_candidates(spark):
    r = random.Random(4)
    side = lambda n, at: spark.createDataFrame([(at + i, r.randint(0, 3000), r.randint(-3, 12)) for i in range(n)], "peak_id long, t long, area long")
    s1, s2 = side(300, 0), side(200, 1000)
    want = pairs.select(pairs.with_pair_id(pairs.candidates(s1, s2, 70)))
    cols = ["pair_id", "s1_id", "s2_id", "s1_t", "s2_t", "drift", "s1_area", "s2_area", "n_s1", "n_s2", "score", "rank_s2", "delta", "flags", "log10_ratio", "selected"]
    got = pairs.largest(s1, s2, 70)
    rows = lambda df: sorted(map(str, df.select(*cols).collect()))
    assert rows(got) == rows(want) and got.count() > 100


def test_merge_clusters_come_from_one_walk(spark):
    """Rows and their clusters' numbers are read from the same kept walk."""
    plan = catalogue.hit_merge_clusters(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "InMemoryTableScan" in plan


def test_merged_rows_come_from_one_walk(spark):
    """Bounds, counts and anchors read the same members."""
    plan = catalogue.hit_merged(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_compiled_ordinary_strings_are_those_of_the_battery(spark):
    """Each counts once, in the stratum and bin that the candidates' battery gives it."""
    r = random.Random(6)
    word = lambda: "".join(r.choices(r.choice(["abcdefghijklmnopqrstuvwxyz", "abcdef", "0123456789"]), k=r.randint(1, 8)))
    texts = [None, "", "x", *(" ".join(r.choice([w, w.capitalize()]) for w in (word() for _ in range(r.randint(1, 400)))) for _ in range(60))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = df.select(F.inline(secrets.ordinary(F.coalesce("text", F.lit("")))))
    rows = lambda d: sorted(map(tuple, d.select("stratum", "bin").collect()))
    assert rows(secrets.ordinary_strings(df)) == rows(want) and len(rows(want)) > 500


def test_few_pairs_are_left_to_the_last_join_of_a_group_of_near_copies(spark, monkeypatch):
    """Near copies link through those in the group's middle; many outer ones link to nothing and must not take all places of pivots."""
    r = random.Random(8)
    base = [f"w{i}" for i in range(150)]
    edited = lambda n: " ".join(r.choice("xyz") + str(r.random()) if i in at else w for at in [set(r.sample(range(150), n))] for i, w in enumerate(base))
    texts = [edited(n) for n in [*[1] * 40, *[2] * 300, *[6] * 500]]
    r.shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    left = []
    whole = jaccard.all_pairs
    monkeypatch.setattr(jaccard, "all_pairs", lambda ix, now: left.append(common.cut(whole(ix, now))) or left[-1])
    got = {x["doc_id"]: x["component_id"] for x in jaccard.groups(df, k=5, percent=80).collect()}
    sets = [jaccard.shingles(t, 5, jaccard.Powers()) for t in texts]
    want = list(range(len(texts)))
    links = 0
    for b in range(len(texts)):
        for a in range(b):
            same = jaccard.common(sets[a], sets[b])
            if 100 * same >= 80 * (len(sets[a]) + len(sets[b]) - same):
                links += 1
                low, high = sorted((want[a], want[b]))
                want = [low if x == high else x for x in want]
    assert got == dict(enumerate(want))
    assert sum(d.count() for d in left) * 20 < links
