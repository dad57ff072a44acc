"""Mixing sources to target weights by a time-varying curriculum.

Each source has a weight schedule w(t) = W (1 + a (1 - 2t)) over training time t in [0, 1]; its integral is W, so
the total a source gets follows from W alone.  Targets are water-filled: weights share the budget, a target stops
at `max_epochs` times its source's size and the excess is shared again by weight until none is above.  A source's
documents stand in a fixed pseudo-random order; a document that begins after c words of its source is trained at the
time t at which the cumulative demand D(t) = T (t + a t - a t^2) reaches c, that is at the inverse of D.

The order is that of an MD5 of id and size; equal ones follow each other by id and size.  No source is gathered in one
task: a bucket is a range of that hash with about `rows_per_bucket` rows, rows are ordered within (source, bucket), and
only the buckets' sums are added up per source, so the order doesn't depend on the number of buckets.  The targets are
worked out in one window over the sources, a row each: for tens to some millions of sources, not for a source per page.

Edge cases: null or empty text has size 0 and nothing is taken from it; a null source is a source of its own, last in
order; an empty table gives an empty result; rows with equal ids are separate documents; columns of the input are
carried in one struct, so their names cannot clash with the operator's.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, documents, n_words

WEIGHTS = (5.0, 2.0, 1.0)
#: Schedule slopes, dealt like the weights: heavy sources come early, light ones late.
SLOPES = (0.5, 0.0, -0.5)


def targets(per_source: DataFrame, weights=WEIGHTS, slopes=SLOPES, share: float = 1.5, max_epochs: float = 2.0) -> DataFrame:
    """per_source: (source, source_size), a row per source.  Adds weight, slope and target (double)."""
    every = Window.partitionBy(F.lit(0))
    order = every.orderBy(F.col("source").asc_nulls_last())
    deal = lambda xs: F.element_at(F.array(*map(F.lit, xs)), ((F.col("rank") - 1) % len(xs) + 1).cast("int"))
    capped = every.orderBy("ratio", "rank")
    before, rest = capped.rowsBetween(Window.unboundedPreceding, -1), capped.rowsBetween(0, Window.unboundedFollowing)
    t = per_source.withColumn("rank", F.row_number().over(order)).withColumns({"weight": deal([float(w) for w in weights]), "slope": deal([float(a) for a in slopes])})
    t = t.withColumns({"cap": F.col("source_size") * F.lit(float(max_epochs)), "budget": F.sum("source_size").over(every) * F.lit(float(share))}).withColumn("ratio", F.col("cap") / F.col("weight"))
    # In ascending order of cap / weight the capped sources come first; the level is what the others get per weight.
    t = t.withColumn("level", (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
    t = t.withColumn("open_level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "rank", "level"))).over(every)["level"])
    return t.withColumn("target", F.coalesce(F.least("cap", F.col("weight") * F.col("open_level")), F.col("cap"))).select("source", "source_size", "weight", "slope", "target")


def mix(docs: DataFrame, size_col: str = "size", id_col: str = "doc_id", source_col: str = "source", weights=WEIGHTS, slopes=SLOPES, share: float = 1.5, max_epochs: float = 2.0, rows_per_bucket: int = 4000, least_buckets: int = 256, seed: int = 17) -> DataFrame:
    """A row per document: row (struct of its columns), size, source_size, target, slope, start (words of its source before it), taken.

    `taken` counts words over all passes: the mix reads a source's stream again and again until its target, rounded to
    whole words, is reached, so a source's sum of `taken` is its target but for rounding.
    """
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[source_col].alias("source"), docs[id_col].alias("id"), docs[size_col].cast("long").alias("size"))
    n = max(least_buckets, math.ceil(docs.count() / rows_per_bucket))
    key = F.md5(F.concat_ws(":", F.coalesce(F.col("id").cast("string"), F.lit("")), F.coalesce(F.col("size"), F.lit(0)).cast("string"), F.lit(str(seed))).cast("binary"))
    rows = rows.withColumn("key", key).withColumn("bucket", F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * n / F.lit(float(1 << 32))))
    per_bucket = rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    per_source = targets(per_bucket.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, slopes, share, max_epochs)
    in_source = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    begins = cut(per_bucket.withColumn("begin", F.coalesce(F.sum("bucket_size").over(in_source), F.lit(0))).join(per_source.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).select(F.col("source").alias("of"), F.col("bucket").alias("in"), "begin", "source_size", "target", "slope"))
    in_bucket = Window.partitionBy("source", "bucket").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    keyed = rows.withColumn("within", F.coalesce(F.sum("size").over(in_bucket), F.lit(0)))
    out = keyed.join(begins, F.col("source").eqNullSafe(F.col("of")) & (F.col("bucket") == F.col("in"))).withColumn("start", F.col("begin") + F.col("within"))
    words = F.round("target").cast("long")
    passes = math.ceil(max_epochs) + 1
    taken = sum((F.greatest(F.lit(0), F.least(F.col("size"), words - F.col("start") - F.lit(e) * F.col("source_size"))) for e in range(passes)), F.lit(0))
    return out.select("row", "source", "size", "source_size", "target", "slope", "start", taken.cast("long").alias("taken"))


def position(offset, target, slope):
    """Training time in [0, 1] at which a source's cumulative demand reaches `offset` words: the inverse of D."""
    q = F.least(F.lit(1.0), offset / target)
    a = slope
    root = F.sqrt(F.greatest(F.lit(0.0), (1 + a) * (1 + a) - 4 * a * q))
    return F.when(F.abs(a) < 1e-9, q).otherwise(F.abs(((1 + a) - root) / (2 * a)))


def stream(mixed: DataFrame, max_epochs: float = 2.0) -> DataFrame:
    """Documents in training order: the row of each pass of a document that gives any word, range-sorted by position."""
    begins = F.transform(F.sequence(F.lit(0), F.lit(math.ceil(max_epochs))), lambda e: F.col("start") + e * F.col("source_size"))
    hit = mixed.filter("taken > 0").withColumn("offset", F.explode(F.filter(begins, lambda b: b < F.round("target").cast("long"))))
    placed = hit.withColumn("position", position(F.col("offset"), F.col("target"), F.col("slope")))
    return placed.orderBy("position", "source", "start")


def op1_mixing(spark, sf_dir):
    """All documents in the order in which training first meets them; those not taken come last."""
    d = documents(spark, sf_dir)
    sized = cut(d.select("doc_id", "source", n_words(F.col("text")).alias("size")))
    m = mix(sized)
    first = F.when(F.col("taken") > 0, position(F.col("start"), F.col("target"), F.col("slope")))
    return m.select("row.doc_id", "size", "source_size", "target", "taken", first.alias("position")).orderBy(F.col("position").asc_nulls_last(), "doc_id")


OP1_SQL = r"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][(rank - 1) % 3 + 1]::DOUBLE AS weight, [0.5, 0.0, -0.5][(rank - 1) % 3 + 1]::DOUBLE AS slope, source_size * 2.0::DOUBLE AS cap, sum(source_size) OVER () * 1.5::DOUBLE AS budget FROM s),
r AS (SELECT *, cap / weight AS ratio FROM w),
l AS (SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY ratio, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY ratio, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
o AS (SELECT (arg_min(level, (ratio, rank))) AS open_level FROM l WHERE level <= ratio),
t AS (SELECT source, source_size, slope, coalesce(least(cap, weight * open_level), cap) AS target FROM l, (SELECT max(open_level) AS open_level FROM o)),
k AS (SELECT *, md5(coalesce(doc_id::VARCHAR, '') || ':' || size::VARCHAR || ':17') AS key FROM d),
b AS (SELECT k.*, t.source_size, t.slope, t.target, coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source),
m AS (SELECT *, round(target)::BIGINT AS words FROM b),
g AS (SELECT *, (greatest(0, least(size, words - start)) + greatest(0, least(size, words - start - source_size)) + greatest(0, least(size, words - start - 2 * source_size)))::BIGINT AS taken, least(1.0::DOUBLE, start / target) AS q FROM m)
SELECT doc_id, size::BIGINT AS size, source_size, target, taken, CASE WHEN taken > 0 THEN CASE WHEN abs(slope) < 1e-9 THEN q ELSE abs(((1 + slope) - sqrt(greatest(0.0::DOUBLE, (1 + slope) * (1 + slope) - 4 * slope * q))) / (2 * slope)) END END AS position FROM g"""
