"""Order without a single task: ranges of a measured partitioning, values carried over their bounds, dense numbers.

A table is cut into ranges of its first order column at measured quantiles, so that ranges hold about as many rows each
wherever the rows are dense.  Windows run within a range; what a row needs from before its range comes from one small
row per range.  Rows that share one value of the first order column share a range.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_RANGE = 500_000
MOST_RANGES = 4096
STEP = 64


def measured_bounds(df: DataFrame, col: str, rows_per_range: int = ROWS_PER_RANGE) -> list:
    """Lower bounds of the ranges but the first; at most MOST_RANGES of them, and no fewer ranges than tasks that run at once."""
    n = df.count()
    ranges = min(MOST_RANGES, max(math.ceil(n / rows_per_range), min(df.sparkSession.sparkContext.defaultParallelism, n // 2000)))
    if ranges < 2:
        return []
    found = df.agg(F.percentile_approx(col, [i / ranges for i in range(1, ranges)], 10 * MOST_RANGES).alias("q")).first()["q"]
    return sorted(set(found or []))


def range_of(value: Column, bounds: list) -> Column:
    """Number of bounds that are not above the value, by two short scans."""
    if not bounds:
        return F.lit(0)
    blocks = [bounds[i : i + STEP] for i in range(0, len(bounds), STEP)]
    count = lambda xs: F.size(F.filter(F.array(*map(F.lit, xs)), lambda b: b <= value))
    if len(blocks) == 1:
        return count(bounds)
    block = count([b[0] for b in blocks])
    within = F.element_at(F.array(*[F.array(*map(F.lit, b)) for b in blocks]), F.greatest(block, F.lit(1)))
    inside = F.size(F.filter(within, lambda b: b <= value))
    return F.when(block == 0, F.lit(0)).otherwise((block - 1) * STEP + inside)


def ranged(df: DataFrame, col: str, name: str = "_range", rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    return df.withColumn(name, F.coalesce(range_of(F.col(col), measured_bounds(df, col, rows_per_range)), F.lit(-1)))


def before_range(df: DataFrame, keys: list[str], values: dict[str, Column], over: dict[str, str], name: str = "_range") -> DataFrame:
    """A row per key and range: `values` aggregated over its own rows and then, by the aggregates in `over`, over all earlier ranges."""
    w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(name).rowsBetween(Window.unboundedPreceding, -1)
    each = df.groupBy(*keys, name).agg(*[c.alias(k) for k, c in values.items()])
    how = {"max": F.max, "sum": F.sum, "last": lambda c: F.last(c, ignorenulls=True)}
    return each.select(*keys, name, *[how[f](k).over(w).alias(k) for k, f in over.items()])


def carried(df: DataFrame, keys: list[str], carry: DataFrame, name: str = "_range") -> DataFrame:
    """df with the carry of each row's range.  Without keys the carry has at most MOST_RANGES + 1 rows and is broadcast."""
    return df.join(carry if keys else F.broadcast(carry), [*keys, name], "left")


def numbered(df: DataFrame, order: list[str], name: str, keys: list[str] = (), rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """df with dense numbers from 0 (within keys) in the order of the columns, which must tell rows apart."""
    keys = list(keys)
    d = ranged(df, order[0], rows_per_range=rows_per_range)
    offset = before_range(d, keys, {"_offset": F.count("*")}, {"_offset": "sum"})
    w = Window.partitionBy(*keys, "_range").orderBy(*order)
    n = F.coalesce("_offset", F.lit(0)) + F.row_number().over(w) - 1
    return carried(d, keys, offset).withColumn(name, n.cast("long")).drop("_range", "_offset")


def with_previous(df: DataFrame, order: list[str], cols: dict[str, str], keys: list[str] = (), rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """df with new columns {new: old} that hold the row before's value (within keys) in the order of the columns."""
    keys = list(keys)
    d = ranged(df, order[0], rows_per_range=rows_per_range)
    last = {f"_last_{new}": F.max_by(old, F.struct(*order)) for new, old in cols.items()}
    carry = before_range(d, keys, last, dict.fromkeys(last, "last"))
    w = Window.partitionBy(*keys, "_range").orderBy(*order)
    d = carried(d, keys, carry).withColumn("_first", F.row_number().over(w) == 1)
    for new, old in cols.items():
        d = d.withColumn(new, F.when(F.col("_first"), F.col(f"_last_{new}")).otherwise(F.lag(old).over(w)))
    return d.drop("_range", "_first", *last)


def running_sum(df: DataFrame, value: Column, order: list[str], name: str, keys: list[str] = (), rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """df with the sum of `value` over all rows up to and including each (within keys)."""
    keys = list(keys)
    d = ranged(df.withColumn("_value", value), order[0], rows_per_range=rows_per_range)
    carry = before_range(d, keys, {"_so_far": F.sum("_value")}, {"_so_far": "sum"})
    w = Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    total = F.coalesce("_so_far", F.lit(0)) + F.sum("_value").over(w)
    return carried(d, keys, carry).withColumn(name, total).drop("_range", "_value", "_so_far")
