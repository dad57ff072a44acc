"""Histograms and adaptive samples."""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bin_of(x: Column, low: float, high: float, bins: int) -> Column:
    """Half-open bins, the last edge inclusive; null outside and for NaN."""
    inside = ~F.isnan(x.cast("double")) & (x >= low) & (x <= high)
    return F.when(inside, F.least(F.lit(bins - 1), F.floor((x - low) / ((high - low) / bins)))).cast("int")


def bin_of_edges(x: Column, edges: list[float]) -> Column:
    """As bin_of, for explicit rising edges (a short list)."""
    x = x.cast("double")
    below = F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: e <= x))
    inside = ~F.isnan(x) & (x >= edges[0]) & (x <= edges[-1])
    return F.when(inside, F.least(F.lit(len(edges) - 1), below) - 1).cast("int")


def linear_edges(low: float, high: float, bins: int) -> list[float]:
    return [low + (high - low) * i / bins for i in range(bins)] + [high]


def log_edges(low: float, high: float, bins: int) -> list[float]:
    """Edges evenly spaced in the logarithm; low must be positive."""
    a, b = math.log10(low), math.log10(high)
    return [low] + [10 ** (a + (b - a) * i / bins) for i in range(1, bins)] + [high]


def symlog_edges(low: float, high: float, bins: int, linear: float) -> list[float]:
    """Edges evenly spaced on an axis that is linear within +-linear and logarithmic (base 10) beyond."""
    slope = 1 / (1 - 1 / 10)

    def there(v: float) -> float:
        return v * slope if abs(v) <= linear else math.copysign(linear * (slope + math.log10(abs(v) / linear)), v)

    def back(t: float) -> float:
        return t / slope if abs(t) <= linear * slope else math.copysign(linear * 10 ** (abs(t) / linear - slope), t)

    a, b = there(low), there(high)
    return [low] + [back(a + (b - a) * i / bins) for i in range(1, bins)] + [high]


def histogram(df: DataFrame, x: str, edges: list[float], weight: str | None = None, density: bool = False) -> DataFrame:
    """(bin, n) of the bins that have rows: counts, sums of weights, or their density."""
    b = df.select(bin_of_edges(F.col(x), edges).alias("bin"), (F.col(weight) if weight else F.lit(1)).alias("w")).filter("bin is not null")
    n = F.sum("w") if weight else F.count("*")
    out = b.groupBy("bin").agg(n.alias("n"))
    if not density:
        return out
    widths = F.array(*[F.lit(float(h - lo)) for lo, h in zip(edges, edges[1:])])
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))  # at most as many rows as bins
    return out.withColumn("n", F.col("n") / total / F.element_at(widths, F.col("bin") + 1))


def histogram_2d(df: DataFrame, x: str, y: str, x_edges: list[float], y_edges: list[float], weight: str | None = None) -> DataFrame:
    """(xb, yb, n) of the bins that have rows."""
    b = df.select(bin_of_edges(F.col(x), x_edges).alias("xb"), bin_of_edges(F.col(y), y_edges).alias("yb"), (F.col(weight) if weight else F.lit(1)).alias("w"))
    return b.filter("xb is not null and yb is not null").groupBy("xb", "yb").agg((F.sum("w") if weight else F.count("*")).alias("n"))


def corner(df: DataFrame, ranges: dict[str, tuple[float, float]], bins: int, density: bool = False) -> DataFrame:
    """Counts (or densities) of all pairs of variables in one pass: (x, y, xb, yb, n)."""
    names = list(ranges)
    b = df.select(*[bin_of(F.col(n), *ranges[n], bins).alias(n) for n in names])
    pairs = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.col(x).alias("xb"), F.col(y).alias("yb")) for x, y in combinations(names, 2)])
    out = b.select(F.inline(pairs)).filter("xb is not null and yb is not null").groupBy("x", "y", "xb", "yb").agg(F.count("*").alias("n"))
    if not density:
        return out
    width = F.create_map(*[F.lit(v) for n in names for v in (n, (ranges[n][1] - ranges[n][0]) / bins)])
    total = F.sum("n").over(Window.partitionBy("x", "y"))  # at most bins x bins rows a pair
    return out.withColumn("n", F.col("n") / total / (width[F.col("x")] * width[F.col("y")]))


def sample_size(n: Column, n_full: int = 4, n_max: int = 12) -> Column:
    """All of a small bin; of a larger one a number that rises to n_max."""
    extra = n_max - n_full
    grown = F.ceil(n_full + extra * (1 - F.exp(-(n - n_full) / F.lit(float(max(extra, 1))))))
    return F.when(n <= n_full, n).otherwise(F.least(n, F.lit(n_max), grown)).cast("long")


def edges_of(spec: int | list[float], value_range: tuple[float, float] | None) -> list[float]:
    """Explicit edges as they are; for a number of bins the range is needed."""
    return list(map(float, spec)) if not isinstance(spec, int) else linear_edges(*map(float, value_range), spec)


def stratified(df: DataFrame, x: str, y: str, bins=25, ranges=(None, None), key: str = "id", seed: int = 0, n_full: int = 4, n_max: int = 12, representative: bool = True) -> tuple[DataFrame, DataFrame]:
    """Per 2-D bin the row nearest its center, and others by a seeded hash, up to the adaptive size; and a row of facts per bin.

    bins: a number, a list of edges, or one of either for each axis.  Counts and centers are aggregates, and the others
    are ranked within n_max a bin, which each task applies before any row is shuffled.
    """
    both = bins if isinstance(bins, tuple) else (bins, bins)
    xe, ye = (edges_of(b, r) for b, r in zip(both, ranges))
    d = df.withColumns({"xb": bin_of_edges(F.col(x), xe), "yb": bin_of_edges(F.col(y), ye)}).filter("xb is not null and yb is not null")

    def off(c: str, b: str, edges: list[float]) -> Column:
        low, high = (F.element_at(F.array(*[F.lit(e) for e in edges]), F.col(b) + k) for k in (1, 2))
        return (F.col(c) - (low + high) / 2.0) / (high - low)

    dx, dy = off(x, "xb", xe), off(y, "yb", ye)
    d = d.withColumn("_far", dx * dx + dy * dy)
    facts = d.groupBy("xb", "yb").agg(F.count("*").alias("bin_n"), F.min_by(key, F.struct("_far", key)).alias("near"))
    facts = facts.withColumn("n_sampled", sample_size(F.col("bin_n"), n_full, n_max))
    picked = d.drop("_far").join(F.broadcast(facts), ["xb", "yb"])  # at most as many rows as bins
    first = (F.col(key) == F.col("near")) if representative else F.lit(False)
    mark = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))
    order = Window.partitionBy("xb", "yb").orderBy(mark, key)
    others = picked.filter(~first).withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= n_max)
    others = others.filter(F.col("_rank") <= F.col("n_sampled") - (1 if representative else 0)).drop("_rank").withColumn("representative", F.lit(False))
    nearest = picked.filter(first & (F.col("n_sampled") > 0)).withColumn("representative", F.lit(True))
    return nearest.unionByName(others).drop("near", "n_sampled"), facts.withColumn("sampling_fraction", F.col("n_sampled") / F.col("bin_n"))
