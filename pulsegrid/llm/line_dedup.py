"""Line dedup by a log-template tree, in DataFrame functions only.

Digits are masked.  A line's templates are the masked line itself and, for lines of at least `wild_tokens` words, the
line with one or two of its sixths left open, wherever they stand: lines of one length that differ in up to two fields
share such a template.  A template keeps over half of the words and five at least; the bars of a table are no words.
A line recurs if one of its templates stands in at least `min_docs` documents; recurring lines are dropped from every
document but the one with the smallest id, so what repeats is kept once.  Lines under `min_tokens` tokens stay.

Open templates are made for few lines only: whichever two sixths are open, one third of the line stays whole, so a
line that shares no third with a different line of its length shares no open template either.

Only hashes are shuffled to count templates, and after the first count each different line once (partial aggregation
takes up the hot ones); a text is shuffled once, when the numbers of its dropped lines meet it.

Edge cases: null text stays null, lines of white space only stay; a line that recurs within one document only stays;
rows with equal ids count as one document, but a row's lines are its own: another text under the id loses none for them;
rows without id count as one document and keep their lines; an empty table gives an empty result; only id and text are
looked at.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound, cut, documents

BLOCKS = 6
LEAST_KEPT = 5


def edge(n: Column, q: int, of: int = BLOCKS) -> Column:
    return F.floor(n * q / of).cast("int")


def parsed(masked: Column, min_tokens: int, wild_tokens: int) -> Column:
    """Struct (full, n, parts) of a masked line: its hash, number of words and hashes of its sixths; null if it has no template."""
    tokens = F.filter(F.split(masked, r"[\x20\x09\x0B-\x0D]+"), lambda t: t != "")
    words = lambda t: F.filter(t, lambda w: w != "|")

    def of(w: Column) -> Column:
        n = F.size(w)
        parts = F.array(*[F.hash(F.slice(w, edge(n, q) + 1, edge(n, q + 1) - edge(n, q))) for q in range(BLOCKS)])
        return F.struct(n.alias("n"), F.when(n >= max(BLOCKS, wild_tokens), parts).alias("parts"))

    line = lambda t: F.when(F.size(t) >= max(1, min_tokens), bound(words(t), lambda w: bound(of(w), lambda x: F.struct(F.xxhash64(t).alias("full"), x["n"].alias("n"), x["parts"].alias("parts")))))
    return bound(tokens, line)


def opened(n: Column, parts: Column) -> Column:
    """Hashes of the templates with one or two open sixths that keep enough words."""
    size = [edge(n, q + 1) - edge(n, q) for q in range(BLOCKS)]

    def template(gone: tuple[int, ...]) -> Column:
        kept = n - sum((size[q] for q in gone), F.lit(0))
        # With two open sixths allowed throughout, those with one find nothing more.
        wanted = (kept >= LEAST_KEPT) & (kept * 2 > n) & (F.lit(len(gone) == 2) | (n < BLOCKS + 3))
        return F.when(wanted, F.xxhash64(n, F.lit(",".join(map(str, gone))), *[parts[q] for q in range(BLOCKS) if q not in gone]))

    return F.filter(F.array(*[template(g) for k in (1, 2) for g in combinations(range(BLOCKS), k)]), lambda x: x.isNotNull())


def templates(pool: DataFrame) -> DataFrame:
    """(full, sig, low, high, nameless): the templates of different lines; each is its own, those near another have open ones."""
    wide = pool.filter(F.col("parts").isNotNull())
    thirds = wide.select("full", F.explode(F.array(*[F.xxhash64("n", F.lit(q), F.col("parts")[2 * q], F.col("parts")[2 * q + 1]) for q in range(BLOCKS // 2)])).alias("third"))
    shared = thirds.groupBy("third").agg(F.count("*").alias("lines")).filter("lines > 1").select("third")
    near = cut(thirds.join(shared, "third", "left_semi").select("full").distinct())
    own = ["low", "high", "nameless"]
    open_ = wide.join(near, "full", "left_semi").select("full", F.explode(opened(F.col("n"), F.col("parts"))).alias("sig"), *own)
    return cut(pool.select("full", F.col("full").alias("sig"), *own).unionAll(open_))


def recurring(docs: DataFrame, min_docs: int, min_tokens: int, wild_tokens: int) -> DataFrame:
    """(of, of_text, drop): numbers of the lines, from 0, that the rows of an id and a text's hash lose."""
    masked = F.split(F.regexp_replace("text", "[0-9]+", "0"), "\n")
    lines = docs.filter(F.col("text").isNotNull()).select("doc_id", F.xxhash64("text").alias("hash"), F.posexplode(F.transform(masked, lambda x: parsed(x, min_tokens, wild_tokens))).alias("line", "p")).filter(F.col("p").isNotNull())
    lines = cut(lines.select("doc_id", "hash", "line", "p.*"))
    pool = cut(lines.groupBy("full").agg(F.first("n").alias("n"), F.first("parts").alias("parts"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.max(F.col("doc_id").isNull()).alias("nameless")))
    sigs = templates(pool)
    often = sigs.groupBy("sig").agg(F.min("low").alias("first"), F.max("high").alias("high"), F.max("nameless").alias("nameless"))
    if min_docs > 1:
        # Two documents: the smallest and the largest id differ, or one of them has none.
        often = often.filter((F.col("first") != F.col("high")) | (F.col("nameless") & F.col("first").isNotNull()))
    often = often.select("sig", "first")
    if min_docs > 2:
        pairs = lines.select("full", "doc_id").distinct().join(sigs.join(often, "sig", "left_semi").select("full", "sig"), "full").select("sig", "doc_id").distinct()
        often = often.join(pairs.groupBy("sig").agg(F.count("*").alias("docs")).filter(F.col("docs") >= min_docs), "sig", "left_semi")
    found = cut(sigs.join(often, "sig").groupBy("full").agg(F.min("first").alias("first")))
    hit = lines.select("doc_id", "hash", "line", "full").join(found, "full").filter(F.col("doc_id") != F.col("first"))
    return hit.groupBy(F.col("doc_id").alias("of"), F.col("hash").alias("of_text")).agg(F.collect_set("line").alias("drop"))


def drop_lines(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", min_docs: int = 2, min_tokens: int = 6, wild_tokens: int = BLOCKS) -> DataFrame:
    """A row per document: doc_id, n_lines, n_dropped, text without its recurring lines."""
    d = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    drops = recurring(d, min_docs, min_tokens, wild_tokens)
    parts = F.split("text", "\n")
    left = F.filter(parts, lambda x, i: ~F.array_contains("drop", i))
    out = d.join(drops, (F.col("doc_id") == F.col("of")) & (F.xxhash64("text") == F.col("of_text")), "left")
    gone = F.col("drop").isNotNull()
    lost = F.when(gone, F.size("drop")).otherwise(0).cast("long").alias("n_dropped")
    return out.select("doc_id", F.coalesce(F.size(parts), F.lit(0)).cast("long").alias("n_lines"), lost, F.when(gone, F.array_join(left, "\n")).otherwise(F.col("text")).alias("text"))


def op10_line_dedup(spark, sf_dir):
    return drop_lines(documents(spark, sf_dir), min_tokens=1)
