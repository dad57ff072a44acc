"""Document fingerprints by a threshold-scaled sketch, in DataFrame functions only.

A document's sketch holds the hash of every five-word shingle (words lower-cased) whose unsigned 64-bit hash is below
2^64 / 2^SHIFT.  The fraction is the same for all documents, so the sketch of a union is the union of the sketches, and
the share of the smaller sketch found in the larger estimates containment however unequal the documents are.

The next document is found without a global window: ids are cut at quantiles into ranges, a range's first document is
also sent to the range before it (the very first one to the last), and lead() runs within a range.  Text is shuffled once.

Ranges hold about per_range documents up to MOST_RANGES of them, and grow beyond that: with 65536 ranges 100 TB make
1.5 GB of text a task, which is sorted on disk.  Bounds are literals of that bounded number.

Edge cases: null counts as empty; fewer than five words make one shingle of all words; a text of which no hash is below
the threshold (most texts under eight shingles, and those without words) has an empty fingerprint; of two texts with empty
ones the likeness is 1 if the texts are equal and 0 if not, one empty fingerprint and one not are unlike (0); equal ids
follow each other in the order of their texts; one document alone is followed by itself; an empty table gives an empty
result; columns other than id and text are never looked at.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import GAPS, bound, documents

WORDS = 5
#: A shingle hash is kept if its upper SHIFT bits are 0: one in 2^SHIFT.
SHIFT = 3
MOST_RANGES = 1 << 16


def shingle_hashes(text: Column, k: int = WORDS) -> Column:
    # Word hashes first, so that a shingle is a short array of longs rather than of strings.
    hashed = F.transform(F.filter(F.split(F.lower(text), GAPS), lambda w: w != ""), lambda w: F.xxhash64(w))
    return bound(hashed, lambda ws: F.transform(F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(ws) - (k - 1))), lambda i: i <= F.size(ws)), lambda i: F.xxhash64(F.slice(ws, i, k))))


def sketch(text: Column, shift: int = SHIFT, k: int = WORDS) -> Column:
    """Sorted distinct hashes below the threshold."""
    return F.array_sort(F.array_distinct(F.filter(shingle_hashes(text, k), lambda x: F.shiftrightunsigned(x, 64 - shift) == 0)))


def printed(hashes: Column) -> Column:
    return F.array_join(F.transform(hashes, lambda h: F.lower(F.hex(h))), ",")


def containment(a: Column, b: Column, equal: Column) -> Column:
    """Share of the smaller sketch that the larger has; equal: whether the texts are, for empty sketches."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(equal.cast("double"))


def jaccard(a: Column, b: Column, equal: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return F.when(F.size(a) + F.size(b) > 0, both / (F.size(a) + F.size(b) - both)).otherwise(equal.cast("double"))


def with_next(docs: DataFrame, per_range: int = 1000, most_ranges: int = MOST_RANGES) -> tuple[DataFrame, Window]:
    """docs (doc_id, text) with `next_text`, the text of the next row by (doc_id, text), and the window of a range."""
    seen = docs.agg(F.count("*").alias("n"), F.min("doc_id").alias("first"), F.count_if(F.col("doc_id").isNull()).alias("unnamed")).first()
    ranges = min(most_ranges, max(1, math.ceil(seen["n"] / per_range)))
    cuts = docs.select(F.percentile_approx("doc_id", [i / ranges for i in range(ranges)], max(20000, 4 * ranges)).alias("q")).first()
    bounds = sorted(set(cuts["q"] or []) - {seen["first"]})
    step = max(1, math.isqrt(len(bounds)))
    blocks = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    one = lambda xs: F.expr(f"array({','.join(f'{x}L' for x in xs)})") if xs else F.array().cast("array<long>")
    count = lambda xs: F.size(F.filter(xs, lambda b: b <= F.col("doc_id")))
    if blocks:  # two short scans instead of one long one
        block = count(one([b[0] for b in blocks]))
        fine = F.array(*[one(b[1:]) for b in blocks])
        at = F.when(block == 0, F.lit(0)).otherwise((block - 1) * step + 1 + count(F.element_at(fine, F.greatest(block, F.lit(1)))))
    else:
        at = F.lit(0)
    placed = docs.select("doc_id", "text", F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(at).cast("int").alias("range"))
    opens = F.array_contains(one(bounds), F.col("doc_id")) if bounds else F.lit(False)
    opening = F.when(opens, F.col("range") - 1)
    everywhere = F.array(F.struct(F.col("range"), F.lit(0).alias("extra")))
    sent = placed.withColumn("to", F.explode(F.when(opening.isNotNull(), F.array_append(everywhere, F.struct(opening.alias("range"), F.lit(1).alias("extra")))).otherwise(everywhere)))
    sent = sent.select("doc_id", "text", "to.range", "to.extra")
    # The very first row follows the very last one.
    lead = F.col("doc_id").isNull() if seen["unnamed"] else F.col("doc_id") == seen["first"]
    head = docs.filter(lead).orderBy("text").limit(1).select("doc_id", "text", F.lit(len(bounds)).alias("range"), F.lit(2).alias("extra"))
    w = Window.partitionBy("range").orderBy("last", F.col("doc_id").asc_nulls_first(), "text")
    return sent.unionAll(head).withColumn("last", F.when(F.col("extra") == 2, 1).otherwise(0)).withColumn("next_text", F.lead("text").over(w)), w


def fingerprints(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", shift: int = SHIFT, k: int = WORDS) -> DataFrame:
    """A row per document: see op3_fingerprint; also jaccard_edited, jaccard_next."""
    d = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    paired, w = with_next(d)
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    e = paired.withColumns({"n_chars": n.cast("long"), "edited": F.concat(F.substring("text", F.lit(1), n - half), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), half)), "a": sketch(F.col("text"), shift, k)})
    e = e.withColumn("next_a", F.lead("a").over(w)).filter("extra = 0")
    e = e.withColumns({"edited_sha256": F.sha2("edited", 256), "b": sketch(F.col("edited"), shift, k)})
    same, next_same = F.col("text") == F.col("edited"), F.col("text") == F.coalesce("next_text", F.lit(""))
    likeness = {"near_edited": containment(F.col("a"), F.col("b"), same), "near_next": containment(F.col("a"), F.col("next_a"), next_same), "jaccard_edited": jaccard(F.col("a"), F.col("b"), same), "jaccard_next": jaccard(F.col("a"), F.col("next_a"), next_same)}
    prints = [printed(F.col("a")).alias("fingerprint"), printed(F.col("b")).alias("edited_fingerprint")]
    return e.select("doc_id", "n_chars", "edited_sha256", *prints, *[c.alias(n) for n, c in likeness.items()])


def op3_fingerprint(spark, sf_dir):
    return fingerprints(documents(spark, sf_dir))
