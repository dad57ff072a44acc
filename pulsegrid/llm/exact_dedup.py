"""Exact dedup by distributed MSD radix partitioning.

All documents begin in one group.  At each level a group is split by its members' next bytes (a digit of `width`
bytes; digits widen from level to level, so a text of n bytes needs about log(n) levels).  A part with one member is
done: it has no copy.  A part whose digit is shorter than the width has ended: all of it was equal up to here and no
bytes are left, so its members are copies.  Only the other parts go on.  Parts are named by the largest member, never
by a digest, and equality follows from equal digits alone.

A level counts its parts with partial aggregation (a part of copies collapses in each map task); of them only those
with more than one member are kept, as a table of one row per part.  That table is broadcast where its counted size
allows and joined by (group, digit) beyond that; it is read from the shared scratch folder, so nothing stands between
the rows' shuffle and the join and adaptive execution can split a hot part.  Rows without a copy in their first bytes
are told by their absence from it: their texts are neither written nor, where the table is broadcast, shuffled.

Rows are numbered when they are first written to the scratch folder, and only read from there afterwards, so a lost
executor can't change a row's number between two readings.

Edge cases: null counts as empty, and empty texts are copies of each other; rows with equal ids are separate rows, of
which the last in the order of the numbers stays if their texts are equal; null ids are smaller than any id; an empty table gives an empty
result; columns of the input are carried in one struct, so their names cannot clash with the operator's.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, bounded, cut, documents

FIRST_WIDTH, WIDER, WIDEST = 64, 16, 1 << 20
#: Tables of repeated digits up to so many bytes on disk and rows are broadcast.
SENT_BYTES, SENT_ROWS = 16 << 20, 1 << 19


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z only.  lower() does the same, and faster, where a text is all ASCII."""
    t = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(t) == F.char_length(t), F.lower(t)).otherwise(F.translate(t, UPPER, LOWER))


def exact_groups(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", carry: list[str] | None = None, first_width: int = FIRST_WIDTH) -> DataFrame:
    """A row per row of docs: row (struct of the columns in `carry`, all by default), id, keep_id, group_size, kept."""
    carry = docs.columns if carry is None else carry
    rest_of = F.struct(*[docs[c] for c in carry if c != text_col], F.lit(0).alias("none"))
    rows = docs.select(rest_of.alias("row"), docs[text_col].alias("text"), docs[id_col].alias("id"))
    row = F.struct(*[F.col("text").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in carry])
    digit = lambda at, width: F.substring(lower_ascii(F.col("text")).cast("binary"), at + 1, width)
    # The first level only tells the rows whose first bytes are their own.
    split = rows.withColumn("digit", digit(0, first_width))
    again = bounded(cut(split.groupBy("digit").agg(F.count("*").alias("n")).filter("n > 1").select("digit")), SENT_ROWS, SENT_BYTES)
    begun = F.monotonically_increasing_id().alias("uid"), F.lit(0).cast("long").alias("part")
    if hasattr(again, "broadcast_rows"):
        alone, todo = split.join(again, "digit", "left_anti"), cut(split.join(again, "digit").select("row", "text", "id", *begun))
    else:  # the texts are shuffled once, for both
        both = cut(split.join(again.withColumn("met", F.lit(True)), "digit", "left").select("row", "text", "id", "met", *begun))
        alone, todo = both.filter("met is null"), both.filter("met").drop("met")
    alone = alone.select(row.alias("row"), "id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    done, at, width = [alone], 0, first_width * (1 + WIDER)
    while not todo.isEmpty():
        split = todo.withColumn("digit", digit(at, width))
        parts = split.groupBy("part", "digit").agg(F.max(F.struct(F.col("id"), F.col("uid"))).alias("top"), F.count("*").alias("n")).filter("n > 1")
        parts = bounded(cut(parts.select("part", "digit", F.col("top.uid").alias("top"), F.col("top.id").alias("top_id"), "n", (F.length("digit") < width).alias("ended"))), SENT_ROWS, SENT_BYTES)
        state = split.join(parts, ["part", "digit"], "left")
        over = F.col("n").isNull() | F.col("ended")
        done.append(state.filter(over).select(row.alias("row"), "id", F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("top_id")).alias("keep_id"), F.coalesce("n", F.lit(1).cast("long")).alias("group_size"), (F.col("n").isNull() | (F.col("uid") == F.col("top"))).alias("kept")))
        todo = cut(state.filter("not ended").select("row", "text", "id", "uid", F.col("top").alias("part")))
        at, width = at + width, min(width * WIDER, WIDEST)
    return reduce(DataFrame.unionAll, done)


def keep_one(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """docs without the copies."""
    return exact_groups(docs, text_col, id_col).filter("kept").select("row.*")


def op5_exact_dedup(spark, sf_dir):
    d = documents(spark, sf_dir).select("doc_id", "text")
    d = d.withColumn("text_sha256", F.sha2(lower_ascii(F.col("text")), 256))
    g = exact_groups(d, carry=["text_sha256"])
    return g.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "row.text_sha256")


OP5_SQL = f"""WITH t AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS text FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(text) AS text_sha256 FROM t WINDOW w AS (PARTITION BY text)"""
