import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import clusters, pairs
from pulsegrid.plans import queries as catalogue
from pulsegrid.plans.engine import Engine, Operator, Option
from pulsegrid.sources import csv_wave, v1725

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in ("events", "embeddings", "lineitem", "orders"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def same(a, b):
    return a == b or (a is not None and b is not None and abs(float(a) - float(b)) < 1e-6)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_against_sql(spark, duck, name):
    mine = catalogue.QUERIES[name](spark, SF)
    cols = sorted(mine.columns)
    rel = duck.sql(catalogue.ORACLE_SQL[name])
    assert cols == sorted(rel.columns)
    key = lambda r: tuple("" if x is None else f"{float(x):.6f}" if isinstance(x, (int, float)) else str(x) for x in r)
    plain = lambda x: None if isinstance(x, float) and x != x else x
    a = sorted((tuple(r) for r in mine.select(*cols).collect()), key=key)
    b = sorted(rel.select(*[f'"{c}"' for c in cols]).fetchall(), key=key)
    assert len(a) == len(b)
    assert all(x == y or same(plain(x), plain(y)) for r, q in zip(a, b) for x, y in zip(r, q))


def walk(rows, gap, cap):
    out, first, last = [], None, None
    for s, e, i in sorted(rows, key=lambda r: (r[0], r[2])):
        if first is None or s - last > gap or max(last, e) - first > cap:
            out.append([])
            first, last = s, e
        last = max(last, e)
        out[-1].append(i)
    return sorted(map(sorted, out))


def test_greedy_against_a_sequential_walk(spark):
    r = random.Random(1)
    rows = [(s := r.randint(0, 3000), s + r.randint(0, 30), i) for i in range(600)]
    df = spark.createDataFrame(rows, "start long, end long, hit_id long")
    got = clusters.greedy(df, 5, 40, rows_per_range=50).groupBy("island", "part").agg(F.collect_list("hit_id").alias("ids")).collect()
    assert sorted(sorted(x["ids"]) for x in got) == walk(rows, 5, 40)


def test_anchored_windows(spark):
    r = random.Random(2)
    rows = [(r.randint(0, 2000), i) for i in range(400)]
    df = spark.createDataFrame(rows, "t long, hit_id long")
    got = clusters.anchored(df, 12, rows_per_range=30).groupBy("island", "part").agg(F.collect_list("hit_id").alias("ids")).collect()
    out, first = [], None
    for t, i in sorted(rows):
        if first is None or t > first + 12:
            out.append([])
            first = t
        out[-1].append(i)
    assert sorted(sorted(x["ids"]) for x in got) == sorted(map(sorted, out))


def test_pairs_count_ambiguity_and_pick_the_largest(spark):
    s1 = spark.createDataFrame([(1, 1000, 10.0), (2, 2000, 30.0), (3, 3000, 20.0)], "peak_id long, t long, area double")
    s2 = spark.createDataFrame([(9, 20000, 500.0)], "peak_id long, t long, area double")
    p = pairs.candidates(s1, s2, 50000)
    assert sorted((r["s1_id"], r["drift"], r["n_s1"], r["flags"]) for r in p.collect()) == [(1, 19000, 3, 17), (2, 18000, 3, 17), (3, 17000, 3, 17)]
    assert pairs.select(p).first()["s1_id"] == 2
    assert pairs.candidates(s1, s2, 17500).count() == 1


def test_pair_selection_modes(spark):
    side = "peak_id long, t long, area double, width long, n_channels long"
    s1 = spark.createDataFrame([(1, 1000, 10.0, 50, 9), (2, 2000, 30.0, 90000, 1), (3, 3000, 9.0, 900, 2)], side)
    p = pairs.candidates(s1, spark.createDataFrame([(9, 20000, 500.0, 10, 4)], side), 50000)
    score = lambda d, area, width, n: 0.2 * (1 - (d - 17000) / 2000) + 0.4 * (math.log1p(area) + 0.5 * math.log1p(n) - 0.5 * math.log1p(width)) + 0.2 * (math.log1p(500) + 0.3 * math.log1p(4))
    best = pairs.select(p, "best_score").first()
    assert best["s1_id"] == 1 and best["score"] == pytest.approx(score(19000, 10, 50, 9)) and best["delta"] == pytest.approx(score(19000, 10, 50, 9) - score(17000, 9, 900, 2))
    assert pairs.select(p, "nearest").first()["s1_id"] == 3 and pairs.select(p, "all").count() == 3
    with pytest.raises(ValueError):
        pairs.select(p, "no such mode")


def test_csv_source(spark, tmp_path):
    (tmp_path / "RUN_CH3_0.CSV").write_text("META;x\nHEADER;X;TIMETAG\n0;3;5000;1;0;0;0;7;8;9\n0;3;6000;1;0;0;0;1;x;3\n")
    rows = csv_wave.structure(csv_wave.read(spark, f"file://{tmp_path}"), 2).orderBy("timestamp").collect()
    assert [(r["channel"], r["timestamp"], r["wave"], r["file_channel"]) for r in rows] == [(3, 5000, [7, 8, 9], 3), (3, 6000, [1, None, 3], 3)]
    assert rows[0]["baseline"] == 7.5 and rows[0]["time"] == 5


def test_binary_source(spark, tmp_path):
    def channel(ts, base, wave):
        return (3 + len(wave) // 2).to_bytes(4, "little") + ts.to_bytes(6, "little") + base.to_bytes(2, "little") + b"".join(w.to_bytes(2, "little", signed=True) for w in wave)

    head = bytearray(16)
    head[4], head[11] = 0b101, 0b1
    raw = bytes(head) + channel(77, 5, [1, -2]) + channel(78, 6, [3, 4, 5, 6]) + channel(79, 7, [])
    (tmp_path / "a.bin").write_bytes(raw + bytes(head) + b"cut")
    rows = v1725.read(spark, str(tmp_path)).orderBy("channel").collect()
    assert [(r["channel"], r["timestamp"], r["baseline"], r["wave"]) for r in rows] == [(0, 77, 5, [1, -2]), (2, 78, 6, [3, 4, 5, 6]), (8, 79, 7, [])]


def test_engine_keeps_products_under_their_lineage(spark, tmp_path):
    built = []
    e = Engine(spark, f"file://{tmp_path}")
    e.register(Operator("a", lambda eng, run, needs, opt: built.append(1) or spark.range(opt["n"]), options={"n": Option(3, int, least=1)}), Operator("b", lambda eng, run, needs, opt: needs["a"].withColumn("x", F.col("id") * 2), ("a",)))
    assert e.table("r", "b", keep=True).count() == 3 and e.table("r", "b").count() == 3 and len(built) == 1
    old = e.key("r", "b")
    e.set_config({"n": 5}, "a")
    assert e.key("r", "b") != old and e.table("r", "b").count() == 5
    with pytest.raises(ValueError):
        e.set_config({"n": 0}, "a")
        e.table("r", "a")
