"""Registered queries over stores and runs, on entries made from the driver's tables, and SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import runs
from . import store
from .registry import query
from .views import EPOCH_US, elapsed, table

ENTRIES = """e AS (SELECT CAST(o_orderkey AS VARCHAR) AS key, 'r' || CAST(o_custkey % 7 AS VARCHAR) AS run_id, o_orderpriority AS product, CASE WHEN o_orderkey % 5 = 0 THEN 'old' ELSE 'new' END AS version,
 CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderkey % 1000 END AS rows, CAST(floor(o_totalprice) AS BIGINT) AS size, o_orderkey % 4 AS n_files, epoch_us(o_orderdate) // 1000 AS created FROM orders)"""
VERSIONS = {"1-URGENT": "new", "2-HIGH": "new", "3-MEDIUM": "new"}


def entries(spark, sf_dir):
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    created = F.expr("timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', cast(o_orderdate AS timestamp_ntz))")
    return o.select(
        k.cast("string").alias("key"), F.concat(F.lit("r"), (F.col("o_custkey") % 7).cast("string")).alias("run_id"), F.col("o_orderpriority").alias("product"),
        F.when(k % 5 == 0, "old").otherwise("new").alias("version"), F.when(k % 11 != 0, k % 1000).alias("rows"), F.floor("o_totalprice").alias("size"), (k % 4).alias("n_files"), created.alias("created"),
    )


STATS = "count(*) AS n_entries, count(DISTINCT run_id) AS n_runs, count(DISTINCT product) AS n_products, CAST(sum(size) AS BIGINT) AS size, CAST(sum(rows) AS BIGINT) AS rows, min(created) AS oldest, max(created) AS newest"


@query(f"WITH {ENTRIES} SELECT run_id, {STATS} FROM e GROUP BY run_id")
def cache_statistics(spark, sf_dir):
    return store.statistics(entries(spark, sf_dir), ["run_id"])


@query(f"WITH {ENTRIES} SELECT key, size FROM e WHERE run_id = 'r3' AND size >= 100000 AND created < 850000000000")
def cache_filter(spark, sf_dir):
    return store.wanted(entries(spark, sf_dir), run_id="r3", least_size=100_000, older_than=850_000_000_000).select("key", "size")


@query(f"WITH {ENTRIES}, k AS (SELECT *, product IN ('1-URGENT', '2-HIGH', '3-MEDIUM') AS known FROM e) SELECT key, 'unfinished' AS problem FROM k WHERE rows IS NULL UNION ALL SELECT key, 'no_files' FROM k WHERE n_files = 0 UNION ALL SELECT key, 'unknown_product' FROM k WHERE NOT known UNION ALL SELECT key, 'version_mismatch' FROM k WHERE known AND version <> 'new'")
def cache_diagnostics(spark, sf_dir):
    return store.diagnose(entries(spark, sf_dir), VERSIONS)


def plan_sql(order: str, where: str, keep: str) -> str:
    return f"WITH {ENTRIES}, p AS (SELECT *, CAST(sum(size) OVER w AS BIGINT) AS freed, row_number() OVER w AS n FROM e WHERE {where} WINDOW w AS (ORDER BY {order}, key ROWS UNBOUNDED PRECEDING)) SELECT key, n, freed FROM p WHERE {keep}"


@query(plan_sql("size DESC", "product = '2-HIGH'", "freed - size < 50000000 AND n <= 120"))
def cache_cleanup_largest(spark, sf_dir):
    return store.plan_cleanup(entries(spark, sf_dir), "largest", 50_000_000, most_entries=120, product="2-HIGH").select("key", "n", "freed")


@query(plan_sql("created", "created < 900000000000 AND version = 'old' AND product IN ('1-URGENT', '2-HIGH', '3-MEDIUM')", "freed - size < 30000000"))
def cache_cleanup_version(spark, sf_dir):
    e = entries(spark, sf_dir)
    problems = store.diagnose(e, VERSIONS)
    return store.plan_cleanup(e, "version", 30_000_000, 900_000_000_000, problems=problems).select("key", "n", "freed")


RUNS = f"""f AS (SELECT 'run_' || lpad(CAST(day(ts) AS VARCHAR), 2, '0') AS run, user_id % 8 AS channel, 'CH' || CAST(user_id % 8 AS VARCHAR) || '_' || CAST(hour(ts) // 12 AS VARCHAR) || '.CSV' AS file, epoch_us(ts) - {EPOCH_US} AS time, CAST(floor(value) AS BIGINT) AS bytes FROM events)"""


def run_rows(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    channel = (F.col("user_id") % 8).cast("string")
    return e.select(F.concat(F.lit("run_"), F.date_format("ts", "dd")).alias("run"), (F.col("user_id") % 8).alias("channel"), F.concat(F.lit("CH"), channel, F.lit("_"), F.floor(F.hour("ts") / 12).cast("string"), F.lit(".CSV")).alias("file"), elapsed().alias("time"), F.floor("value").alias("bytes"))


@query(f"WITH {RUNS} SELECT run, channel, file, count(*) AS n_rows, CAST(sum(bytes) AS BIGINT) AS bytes, min(time) AS first_time, max(time) AS last_time FROM f GROUP BY run, channel, file")
def daq_run_scan(spark, sf_dir):
    return runs.scan_files(run_rows(spark, sf_dir))


@query(f"WITH {RUNS}, s AS (SELECT run, channel, file, count(*) AS n_rows, sum(bytes) AS bytes, min(time) AS a, max(time) AS b FROM f GROUP BY run, channel, file) SELECT run, count(*) AS n_files, count(DISTINCT channel) AS n_channels, CAST(sum(n_rows) AS BIGINT) AS n_rows, CAST(sum(bytes) AS BIGINT) AS bytes, min(a) AS first_time, max(b) AS last_time, max(b) - min(a) AS duration FROM s GROUP BY run HAVING max(b) >= {5 * 86_400_000_000} AND min(a) < {20 * 86_400_000_000}")
def daq_overview(spark, sf_dir):
    files = runs.scan_files(run_rows(spark, sf_dir))
    return runs.overview(files, 5 * 86_400_000_000, 20 * 86_400_000_000)


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(json_extract(props, '$.k') AS BIGINT) % 3 = 0 AS third FROM events")
def json_settings(spark, sf_dir):
    """Settings that lie in a table as JSON text."""
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").select("event_id", k.alias("k"), (k % 3 == 0).alias("third"))


@query("SELECT v, CAST(round_even(v / 4.0, 0) AS DOUBLE) AS even, CAST(floor(v / 4.0) AS BIGINT) AS low, ((v % 4) + 4) % 4 AS rest, CASE WHEN v > -1 THEN round(ln(1 + CAST(v AS DOUBLE)), 9) ELSE 'nan'::DOUBLE END AS log1, greatest(-3, least(3, v)) AS clipped, round(atan2(CAST(v AS DOUBLE), CAST(2 AS DOUBLE)), 9) AS angle FROM (SELECT event_id % 41 - 20 AS v FROM events WHERE event_id < 41)")
def scalar_functions(spark, sf_dir):
    """Rounding half to even, division rounded down below 0, guarded logarithm, clipping, angle."""
    v = F.col("v")
    d = table(spark, sf_dir, "events").filter("event_id < 41").select((F.col("event_id") % 41 - 20).alias("v"))
    log1 = F.when(v > -1, F.round(F.log1p(v.cast("double")), 9)).otherwise(float("nan"))
    return d.select("v", F.rint(v / 4.0).alias("even"), F.floor(v / 4.0).alias("low"), F.pmod(v, F.lit(4)).alias("rest"), log1.alias("log1"), F.greatest(F.lit(-3), F.least(F.lit(3), v)).alias("clipped"), F.round(F.atan2(v.cast("double"), F.lit(2.0)), 9).alias("angle"))
