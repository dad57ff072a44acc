"""Column functions over a record's array of samples (`wave`), on the JVM."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def signal(wave: Column, baseline: Column, positive: Column) -> Column:
    """Samples above (positive) or below (negative) the baseline as positive numbers."""
    return F.transform(wave, lambda x: F.when(positive, x - baseline).otherwise(baseline - x))


def basic_features(wave: Column, baseline: Column, positive: Column, height_range: tuple[int, int | None] = (0, None), area_range: tuple[int, int | None] = (0, None), fixed_baseline: Column | None = None) -> dict[str, Column]:
    """height and amp over height_range, area over area_range (samples [start, end)), max_abs_diff over all; 0 where there is no sample.

    fixed_baseline overrules the record's own where it is not null.
    """
    base = baseline if fixed_baseline is None else F.coalesce(fixed_baseline, baseline)
    cut = lambda r: wave if tuple(r) == (0, None) else F.slice(wave, F.lit(r[0] + 1), F.greatest(F.lit(0), F.least(F.size(wave), F.lit(r[1] if r[1] is not None else 1 << 30)) - r[0]))
    h, a = cut(height_range), cut(area_range)
    some = lambda w, c: F.when(F.size(w) > 0, c).otherwise(F.lit(0.0))
    total = F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)
    flat = F.size(a) * base
    more = F.greatest(F.lit(0), F.size(wave) - 1)
    steps = F.zip_with(F.slice(wave, F.lit(2), more), F.slice(wave, F.lit(1), more), lambda x, y: F.abs(x - y))
    return {
        "height": some(h, F.when(positive, F.array_max(h) - base).otherwise(base - F.array_min(h)).cast("double")),
        "amp": some(h, (F.array_max(h) - F.array_min(h)).cast("double")),
        "area": some(a, F.when(positive, total - flat).otherwise(flat - total)),
        "max_abs_diff": some(wave, F.coalesce(F.array_max(steps), F.lit(0)).cast("double")),
    }


def asymmetry(wave: Column, baseline: Column, positive: Column, cut: float = 0.7) -> Column:
    """Whether the pulse's side of the baseline makes up enough of the whole swing.

    The cut counts as the decimal that it is written as: both sides are multiplied up to whole numbers, since 0.55 x 100 is above 55 in doubles.
    """
    share = Fraction(str(cut))
    swing = F.array_max(wave) - F.array_min(wave)
    h = F.when(positive, F.array_max(wave) - baseline).otherwise(baseline - F.array_min(wave))
    return F.coalesce((F.size(wave) > 0) & (swing > 0) & (h > 0) & (h <= swing) & (h.cast("double") * float(share.denominator) >= swing.cast("double") * float(share.numerator)), F.lit(False))


def threshold_hits(records: DataFrame, threshold: float | Column, left: int = 2, right: int = 2, keep: Column | None = None) -> DataFrame:
    """A row per run of samples at or beyond the threshold.  records: record_id, t, dt, wave, baseline, positive.

    threshold may be a column (of a joined table of channels); keep is a mask of the records that are looked at.  A record
    that never reaches the threshold is dropped before its samples are looked at one by one.
    """
    limit = threshold if isinstance(threshold, Column) else F.lit(threshold)
    records = (records if keep is None else records.filter(keep)).withColumn("_limit", limit)
    threshold = F.col("_limit")
    reach = F.when(F.col("positive"), F.array_max("wave") >= F.col("baseline") + threshold).otherwise(F.array_min("wave") <= F.col("baseline") - threshold)
    over = F.transform(signal(F.col("wave"), F.col("baseline"), F.col("positive")), lambda x: x >= threshold)
    # Where a run begins: over here and not one before.
    rec = records.filter(reach).withColumn("over", over).withColumn("n", F.size("wave"))
    begins = F.filter(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.get("over", i) & ~F.coalesce(F.get("over", i - 1), F.lit(False)))
    ends = F.filter(F.sequence(F.lit(1), F.col("n")), lambda i: F.get("over", i - 1) & ~F.coalesce(F.get("over", i), F.lit(False)))
    runs = rec.select("record_id", "t", "dt", "n", F.explode(F.arrays_zip(begins.alias("s"), ends.alias("e"))).alias("r"))
    s, e = F.col("r.s"), F.col("r.e")
    position = F.floor((s + e - 1) / 2).cast("long")
    return runs.select("record_id", position.alias("position"), F.greatest(F.lit(0), s - left).alias("edge_start"), F.least(F.col("n"), e + right).alias("edge_end"), (F.col("t") + position * F.col("dt") * 1000).alias("timestamp")).withColumn("width", F.col("edge_end") - F.col("edge_start"))


def width_integral(wave: Column, baseline: Column, positive: Column, low: float = 0.1, high: float = 0.9) -> Column:
    """Struct (total, t_low, t_high): first samples at which the clipped signal's running sum reaches the shares."""
    x = F.transform(signal(wave, baseline, positive), lambda v: F.greatest(v, F.lit(0)).cast("double"))
    total = F.aggregate(x, F.lit(0.0), lambda a, v: a + v)

    def walk(b: Column) -> Column:
        start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("i"), F.lit(-1).alias("lo"), F.lit(-1).alias("hi"))

        def step(a: Column, v: Column) -> Column:
            new = a["sum"] + v
            mark = lambda f, q: F.when((a[f] < 0) & (new >= q * b["total"]), a["i"]).otherwise(a[f])
            return F.struct(new.alias("sum"), (a["i"] + 1).alias("i"), mark("lo", low).alias("lo"), mark("hi", high).alias("hi"))

        return F.aggregate(b["x"], start, step, lambda a: F.struct(b["total"].alias("total"), a["lo"].alias("t_low"), a["hi"].alias("t_high")))

    return F.element_at(F.transform(F.array(F.struct(x.alias("x"), total.alias("total"))), walk), 1)
