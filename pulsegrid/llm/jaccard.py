"""N-gram Jaccard join with token-combination prefixes, and the groups that its links make.

A document is the set of its word shingles' 64-bit hashes; equal sets are one node, so copies never pair up.  Tokens
have a global order: tokens of the frequent class last, by count; the others first, by hash.  Two nodes of at least
the wanted Jaccard share k tokens within their first n - ceil(t n) + k tokens.  Nodes under SMALL tokens use k = 2: the
extended prefix's rare tokens are indexed singly and its frequent ones in combinations of two (if none of the shared
tokens is rare, two frequent ones are shared).  Larger nodes use k = 1; sizes near SMALL are indexed both ways, so
every pair that can be similar meets in one way.  Every candidate is verified on whole sets.

The frequent class comes from lossy counts over all documents, held to FREQUENT tokens: it only shapes the order and
the keys, never what is found.

Near copies share most keys of their prefixes, so many keys have the same nodes.  Such keys make one list, named by a
hash of its nodes; a node stands in it at its first place among them, which is never behind the first common token.

groups() doesn't pair all candidates of a posting list.  First each member is verified against PIVOTS of its first
PIVOT_LISTS lists, in some rounds with other ones; members that are by then in one component need no more comparison.  From the second round
on the lists are a node's longest ones, and to the pivots come the HUBS members with the most links so far: in a group of
near copies those in the middle link to most others, while members without any link would take all places dealt by component.
Only pairs of a list that still lie in different components, and pass the filters of length, position and parity, are then formed and verified,
so no link that joins two components is lost.  links() skips the pivots and verifies every pair.

The parity filter: a set has buckets by hash and a bit for each that holds an odd number of its tokens.  Where two sets'
bits differ, at least one token is in one set only, so the number of differing bits never exceeds the symmetric
difference, which a wanted Jaccard bounds.  It is used twice: with PARITY bits inside the join, so that members of a large
group that are nearly similar enough are rejected without their pairs ever leaving it, and with two or more bits a token
on every candidate before whole sets are made.  A longer row of bits folds to a shorter one by exclusive or, so sets
of different sizes compare.  A pair leaves the join at its first common key by place; other keys give it only where
that one is not among the HEAD first of both nodes.

Whole sets are made from the texts of the survivors only; texts are never shuffled for that while the survivors' ids are
few enough to be broadcast by their counted size, and are joined by id beyond that.

Edge cases: null text counts as empty; a set without shingle is linked with nothing; a text of fewer words than a
shingle is one shingle; a null id has no links and a null component; rows with equal ids are nodes by their texts, and in
groups() such an id ties the components of all its texts into one (it is reachable from each of them), while keep_one()
goes by rows and never drops a text for another one's sake; an empty table gives an empty result; only id and text are
looked at.  A percentage of 50 or less is refused: one-shingle sets would have to be indexed in another way.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, arrow_batches, bounded, cut, documents, drop_cut

FREQUENT = 1 << 16
SMALL = 256
PIVOT_ROUNDS, PIVOTS, HUBS = 2, 4, 16
#: A node meets the pivots of so many of its lists, those at its first places.
PIVOT_LISTS = 8
HEAD = 16
PARITY = 512
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_LETTERS = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_UNBASE = pow(_BASE, -1, 1 << 64)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Powers:
    """Powers of the base and of its inverse modulo 2^64, grown as needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = 1 << int(n - 1).bit_length()
            self.up = np.multiply.accumulate(np.r_[np.uint64(1), np.full(size - 1, _BASE, np.uint64)])
            self.down = np.multiply.accumulate(np.r_[np.uint64(1), np.full(size - 1, _UNBASE, np.uint64)])
        return self.up, self.down


def shingles(text: str | None, k: int, powers: Powers) -> np.ndarray:
    """Sorted distinct hashes (uint64) of a text's word shingles."""
    words = (text or "").encode("utf-8", "replace").translate(_TABLE).split()
    if not words:
        return np.zeros(0, np.uint64)
    raw = np.frombuffer(b" ".join(words), np.uint8)
    up, down = powers.of(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_LETTERS[raw] * up[: len(raw)], out=sums[1:])
    lens = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lens + 1) - 1
    starts = ends - lens
    last = ends[min(k, len(words)) - 1 :]
    first = starts[: len(last)]
    h = (sums[last] - sums[first]) * down[first] + (last - first).astype(np.uint64)
    return np.unique(mixed(h))


def node_of(tokens: np.ndarray) -> int:
    """A number for a set: equal sets have equal ones."""
    if not len(tokens):
        return 0
    with np.errstate(over="ignore"):
        a = mixed(np.array([np.bitwise_xor.reduce(mixed(tokens + np.uint64(1))), tokens.sum(dtype=np.uint64) ^ np.uint64(len(tokens))], np.uint64))
        return int((a[0] + a[1] * np.uint64(0x2545F4914F6CDD1D)).astype(np.int64))


def parity(tokens: np.ndarray, buckets: int = 0) -> np.ndarray:
    """Packed bits: which hash buckets hold an odd number of tokens.  By default two buckets a token or more, a power of two."""
    buckets = buckets or max(64, 1 << (2 * len(tokens) - 1).bit_length())
    odd = np.bincount((tokens & np.uint64(buckets - 1)).astype(np.int64), minlength=buckets) & 1
    return np.packbits(odd.astype(bool), bitorder="little")


def differ(x: np.ndarray, y: np.ndarray) -> int:
    """Number of bits in which two parity rows differ; the longer one is folded."""
    if len(x) < len(y):
        x, y = y, x
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


NO_KEYS = np.zeros(0, np.uint64), np.zeros(0, np.int32)


def keys(tokens: np.ndarray, frequent: np.ndarray, order: np.ndarray, percent: int, small: int) -> tuple[np.ndarray, np.ndarray]:
    """Index keys of a set and each one's place in its token order.  frequent: sorted; order: their ranks, rare first."""
    n = len(tokens)
    if n < 2:
        return NO_KEYS
    at = np.minimum(np.searchsorted(frequent, tokens), max(0, len(frequent) - 1))
    often = frequent[at] == tokens if len(frequent) else np.zeros(n, bool)
    rank = order[at[often]]
    seq = np.concatenate([tokens[~often], tokens[often][np.argsort(rank, kind="stable")]])
    n_rare = n - int(often.sum())
    prefix = n - -(-percent * n // 100) + 1
    out, place = [], []
    if n >= small:
        out.append(seq[:prefix])
        place.append(np.arange(min(prefix, n)))
    if n * percent < small * 100:
        two = min(n, prefix + 1)
        out.append(seq[: min(two, n_rare)])
        place.append(np.arange(min(two, n_rare)))
        tail = seq[n_rare:two]
        if len(tail) > 1:
            i, j = np.triu_indices(len(tail), 1)
            out.append(mixed(tail[i] * np.uint64(3) + mixed(tail[j])))
            place.append(i + n_rare)
    h, first = np.unique(np.concatenate(out), return_index=True)
    return h, np.concatenate(place)[first].astype(np.int32)


def frequent_tokens(docs: DataFrame, k: int, most: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """At most `most` tokens, by lossy counts over all documents: sorted, and their ranks by count."""

    def count(batches):
        powers, held, counts = Powers(), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for b in batches:
            got = [shingles(t, k, powers) for t in b.column(0).to_pylist()]
            if not got:
                continue
            new, n = np.unique(np.concatenate(got), return_counts=True)
            both, back = np.unique(np.concatenate([held, new]), return_inverse=True)
            sums = np.bincount(back, np.concatenate([counts, n]), len(both)).astype(np.int64)
            keep = sums > 2
            held, counts = both[keep], sums[keep]
        if len(held) > most:
            top = np.argsort(-counts, kind="stable")[:most]
            held, counts = held[top], counts[top]
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int64)), pa.array(counts)], ["token", "n"])

    top = docs.select("text").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).filter("n > 8").orderBy(F.desc("n"), "token").limit(most).toPandas()
    tokens = top["token"].to_numpy(np.int64).astype(np.uint64)
    ranks = np.arange(len(tokens), 0, -1)
    by = np.argsort(tokens)
    return tokens[by], ranks[by]


def common(x: np.ndarray, y: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(x) > len(y):
        x, y = y, x
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    return int((y[at] == x).sum())


def matched(pairs: DataFrame, sets: DataFrame, judge) -> DataFrame:
    """Those of pairs (a, b) for which judge(payload of a, n of a, payload of b, n of b) holds.  sets: node, n, payload."""

    def run(batches):
        for b in batches:
            each = zip(*(b.column(i) for i in range(2, 6)))
            keep = [judge(x.as_buffer(), n.as_py(), y.as_buffer(), m.as_py()) for x, n, y, m in each]
            yield b.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    one = pairs.join(sets.select(F.col("node").alias("a"), F.col("payload").alias("x"), F.col("n").alias("nx")), "a")
    two = one.join(sets.select(F.col("node").alias("b"), F.col("payload").alias("y"), F.col("n").alias("ny")), "b")
    return two.select("a", "b", "x", "nx", "y", "ny").mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, comp) of every node that has a link, by alternating large and small stars; comp is the smallest node."""
    e = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct())
    before = None
    while True:
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u")
        new = cut(small.select("u", F.col("m").alias("v")).unionAll(small.select(F.col("v").alias("u"), F.col("m").alias("v"))).filter("u != v").distinct())
        drop_cut(e)
        e = new
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("comp"))
        before = now


@dataclass
class Index:
    """What the join keeps of a table.

    of: a row per document (uid, doc_id, hash of its text, node, n).  nodes: a row per node (node, n, keys, places, odd, bits).
    reps: (node, doc_id, many) with the smallest id, and whether it has other rows.  lists: (key, node, n, place).
    """

    docs: DataFrame
    of: DataFrame
    nodes: DataFrame
    reps: DataFrame
    lists: DataFrame
    k: int
    percent: int


def lengths(x: Column, y: Column, percent: int) -> Column:
    return F.least(x, y) * 100 >= F.greatest(x, y) * percent


def alike(odd_a: Column, n: Column, odd_b: Column, m: Column, percent: int) -> Column:
    """The parity filter on PARITY bits."""
    apart = sum((F.bit_count(odd_a[i].bitwiseXOR(odd_b[i])) for i in range(PARITY // 64)), F.lit(0))
    return apart * (100 + percent) <= (n + m) * (100 - percent)


def prepared(docs: DataFrame, text_col: str, id_col: str, k: int, percent: int, small: int) -> Index:
    if percent <= 50:
        raise ValueError("percent must be over 50")
    arrow_batches(docs.sparkSession)
    d = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    frequent, order = frequent_tokens(d, k)

    def index(batches):
        powers = Powers()
        for b in batches:
            for lo in range(0, b.num_rows, 128):
                part = b.slice(lo, 128)
                sets = [shingles(t, k, powers) for t in part.column(3).to_pylist()]
                nodes = [node_of(s) for s in sets]
                # A row without id gives no keys.
                live = [part.column(1)[i].is_valid for i in range(part.num_rows)]
                found = [keys(s, frequent, order, percent, small) if ok else NO_KEYS for s, ok in zip(sets, live)]
                odd = [parity(s, PARITY).view(np.int64) if len(f[0]) else [] for s, f in zip(sets, found)]
                bits = [parity(s).tobytes() if len(f[0]) else b"" for s, f in zip(sets, found)]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(nodes, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([f[0].astype(np.int64) for f in found], pa.list_(pa.int64())), pa.array([f[1] for f in found], pa.list_(pa.int32())), pa.array(odd, pa.list_(pa.int64())), pa.array(bits, pa.binary())], ["uid", "doc_id", "hash", "node", "n", "keys", "places", "odd", "bits"])

    numbered = d.select(F.monotonically_increasing_id().alias("uid"), "doc_id", F.xxhash64("text").alias("hash"), "text")
    indexed = cut(numbered.mapInArrow(index, "uid long, doc_id long, hash long, node long, n long, keys array<long>, places array<int>, odd array<long>, bits binary"))
    of = indexed.select("uid", "doc_id", "hash", "node", "n")
    # Copies collapse in each map task; one row of a node, that with the smallest id, speaks for it.
    of_node = of.filter("doc_id is not null and n > 0").groupBy("node").agg(F.min(F.struct("doc_id", "uid")).alias("top"), F.count("*").alias("rows"))
    reps = cut(of_node.select("node", "top.doc_id", "top.uid", (F.col("rows") > 1).alias("many")))
    again = bounded(cut(reps.filter("many").select("node", F.col("uid").alias("top"))))
    others = bounded(cut(of.join(again, "node").filter("uid != top").select("uid")))
    nodes = indexed.filter(F.size("keys") > 0).join(others, "uid", "left_anti").drop("uid", "doc_id", "hash")
    if not hasattr(others, "broadcast_rows"):  # too many to send: shuffled once rather than at each use
        nodes = cut(nodes)
    # One row per list and node; keys with one node are of no use, and keys with the same nodes are one list.
    postings = nodes.select("node", F.col("n").cast("int").alias("n"), F.explode(F.arrays_zip("keys", "places")).alias("k")).select(F.col("k.keys").alias("key"), "node", "n", F.col("k.places").alias("place"))
    of_key, mark = Window.partitionBy("key"), F.xxhash64("node")
    same = F.xxhash64(F.count("*").over(of_key), F.bit_xor(mark).over(of_key), F.sum(F.shiftrightunsigned(F.xxhash64("node", F.lit(1)), 34)).over(of_key))
    shared = postings.withColumn("members", F.count("*").over(of_key)).withColumn("list", same).filter("members > 1")
    lists = cut(shared.groupBy(F.col("list").alias("key"), "node").agg(F.first("n").alias("n"), F.min("place").alias("place")))
    return Index(d, of, nodes, reps, lists, k, percent)


def verify(ix: Index, pairs: DataFrame) -> DataFrame:
    """Those of pairs (a, b) of nodes whose sets are similar enough."""
    percent, k = ix.percent, ix.k

    def may(x, n, y, m):
        return differ(np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)) * (100 + percent) <= (n + m) * (100 - percent)

    def are(x, n, y, m):
        x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        same = common(x, y)
        return 100 * same >= percent * (len(x) + len(y) - same)

    def tokens(batches):
        powers = Powers()
        for b in batches:
            sets = [shingles(t, k, powers) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([node_of(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "n", "payload"])

    hopeful = cut(matched(pairs, ix.nodes.select("node", "n", F.col("bits").alias("payload")), may))
    wanted = cut(hopeful.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(ix.reps, "node").select("doc_id").distinct())
    sets = cut(ix.docs.join(bounded(wanted), "doc_id", "left_semi").select("text").mapInArrow(tokens, "node long, n long, payload binary"))
    links = cut(matched(hopeful, sets.dropDuplicates(["node"]), are))
    for spent in (sets, wanted, hopeful):
        drop_cut(spent)
    return links


def all_pairs(ix: Index, now: DataFrame) -> DataFrame:
    """(a, b): pairs of the lists that pass the filters and lie in different components.  now: lists with comp."""
    percent = ix.percent
    # A node's keys are bounded by its own prefix.
    heads = now.groupBy("node").agg(F.slice(F.sort_array(F.collect_list(F.struct("place", "key"))), 1, HEAD).alias("head"))
    now = cut(now.join(heads.join(ix.nodes.select("node", "odd"), "node"), "node"))
    other = now.select("key", F.col("node").alias("b"), F.col("n").alias("m"), F.col("place").alias("spot"), F.col("comp").alias("c"), F.col("odd").alias("odd_b"), F.col("head.key").alias("head_b"))
    near = alike(F.col("odd"), F.col("n"), F.col("odd_b"), F.col("m"), percent)
    least = F.ceil((F.col("n") + F.col("m")) * F.lit(percent) / F.lit(100 + percent))
    reach = 1 + F.least(F.col("n") - F.col("place") - 1, F.col("m") - F.col("spot") - 1)
    before = F.filter("head", lambda h: h < F.struct("place", "key"))
    earlier = F.arrays_overlap(F.transform(before, lambda h: h["key"]), F.col("head_b"))
    met = now.join(other, "key").filter((F.col("node") < F.col("b")) & (F.col("comp") != F.col("c")) & lengths(F.col("n"), F.col("m"), percent) & (reach >= least) & near & ~earlier)
    return met.select(F.col("node").alias("a"), "b").distinct()


def joined(ix: Index, pivot_rounds: int) -> tuple[DataFrame | None, DataFrame | None]:
    """Verified pairs of nodes that span the components, and (node, comp) of the nodes that have a link."""
    comp = links = None
    for step in range(pivot_rounds + 1):
        if comp is None:
            now = ix.lists.withColumn("comp", F.col("node"))
        else:
            now = ix.lists.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
            open_ = now.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low != high").select("key")
            now = cut(now.join(open_, "key"))
            if now.isEmpty():
                break
        if step < pivot_rounds:
            first = now
            if links is None:
                first, order = first.withColumn("hub", F.lit(0)), ["place"]
            else:  # from the second round on the longest lists, in which most pairs are left, and each node's links so far
                hubs = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("hub"))
                first = first.join(now.groupBy("key").agg(F.count("*").alias("members")), "key").join(hubs, "node", "left")
                order = [F.desc("members"), "place"]
            place = Window.partitionBy("node").orderBy(*order, "key")
            first = first.withColumn("_n", F.row_number().over(place)).filter(F.col("_n") <= PIVOT_LISTS).select("key", "node", "n", "comp", F.coalesce("hub", F.lit(0)).alias("hub"))
            first = cut(first.join(ix.nodes.select("node", "odd"), "node"))
            # max_by keeps one row per key and task, however long the list.
            row, dealt = F.struct("node", "n", "comp", "odd"), F.pmod(F.xxhash64("node", F.lit(step)), F.lit(HUBS))
            by = [F.max_by(row, F.xxhash64("comp" if step else "node", F.lit(step * PIVOTS + i), "node")) for i in range(PIVOTS)]
            if links is not None:  # nodes in the middle of a group link to most of it, so the best linked ones of each share of a list are pivots too
                by += [F.max_by(row, F.when((dealt == i) & (F.col("hub") > 0), F.struct("hub", "node"))) for i in range(HUBS)]
            pivot = first.groupBy("key").agg(F.array_distinct(F.array_compact(F.array(*by))).alias("p")).withColumn("p", F.explode("p"))
            other = (F.col("p.comp") != F.col("comp")) & lengths(F.col("p.n"), F.col("n"), ix.percent) & alike(F.col("p.odd"), F.col("p.n"), F.col("odd"), F.col("n"), ix.percent)
            met = cut(first.join(pivot, "key").filter(other).select(F.col("p.node").alias("a"), F.col("node").alias("b")).distinct())
            drop_cut(first)
        else:
            met = all_pairs(ix, now)
        found = verify(ix, met)
        if not found.isEmpty():
            links = found if links is None else cut(links.unionAll(found))
            comp = components(links)
    return links, comp


def named(ix: Index, comp: DataFrame | None, key: list[str]) -> DataFrame:
    """(of, and the smallest `key` of its component under `low`) for the nodes that have links or more than one row."""
    rows = ix.of.filter("doc_id is not null and n > 0").groupBy("node").agg(F.min(F.struct(*key)).alias("low"), F.count("*").alias("rows"))
    if comp is None:
        return bounded(cut(rows.filter("rows > 1").select(F.col("node").alias("of"), "low")))
    comp = comp.unionAll(comp.select(F.col("comp").alias("node"), "comp").distinct())
    some = rows.join(comp, "node", "left").filter("rows > 1 or comp is not null").withColumn("comp", F.coalesce("comp", "node"))
    some = cut(some.select("node", "comp", "low"))
    least = some.groupBy("comp").agg(F.min("low").alias("low"))
    return bounded(cut(some.drop("low").join(bounded(cut(least)), "comp").select(F.col("node").alias("of"), "low")))


def tied(ix: Index, links: DataFrame | None) -> DataFrame | None:
    """links, and pairs of the nodes that share an id."""
    ids = ix.of.filter("doc_id is not null and n > 0").groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).filter("a != b")
    ids = cut(ids.select("doc_id", "a"))
    if ids.isEmpty():
        return None
    more = ix.of.filter("n > 0").join(ids, "doc_id").filter("node != a").select("a", F.col("node").alias("b"))
    return more if links is None else links.unionAll(more)


def groups(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", k: int = 4, percent: int = 85, small: int = SMALL, pivot_rounds: int = PIVOT_ROUNDS) -> DataFrame:
    """A row per document: doc_id, n_shingles, component_id (smallest id that links lead to, its own included)."""
    ix = prepared(docs, text_col, id_col, k, percent, small)
    links, comp = joined(ix, pivot_rounds)
    more = tied(ix, links)
    if more is not None:
        comp = components(more)
    table = named(ix, comp, ["doc_id"])
    out = ix.of.join(table, (ix.of["node"] == table["of"]) & (ix.of["n"] > 0), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("low.doc_id", "doc_id")).alias("component_id"))


def links(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", k: int = 4, percent: int = 85, small: int = SMALL) -> tuple[DataFrame, DataFrame]:
    """Every link between different sets, as (a, b) of the smallest ids of both, and the membership (doc_id, rep)."""
    ix = prepared(docs, text_col, id_col, k, percent, small)
    found, _ = joined(ix, 0)
    found = docs.sparkSession.createDataFrame([], "a long, b long") if found is None else found
    of = lambda side, name: ix.reps.select(F.col("node").alias(side), F.col("doc_id").alias(name))
    pairs = found.join(of("a", "x"), "a").join(of("b", "y"), "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return pairs, ix.of.filter("n > 0").join(of("node", "rep"), "node").select("doc_id", "rep")


def keep_one(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", k: int = 4, percent: int = 85, small: int = SMALL, pivot_rounds: int = PIVOT_ROUNDS) -> DataFrame:
    """docs, of each group of linked texts the row with the smallest id; rows without id stay.

    Rows equal in id and text stay or go together.  Another text under an id that goes is not touched.
    """
    ix = prepared(docs, text_col, id_col, k, percent, small)
    _, comp = joined(ix, pivot_rounds)
    table = named(ix, comp, ["doc_id", "hash"])
    rows = ix.of.filter("doc_id is not null and n > 0").join(table, F.col("node") == F.col("of"))
    gone = rows.filter(F.struct("doc_id", "hash") != F.col("low")).select(F.col("doc_id").alias("gone_id"), F.col("hash").alias("gone_hash")).distinct()
    gone = bounded(cut(gone))
    return docs.join(gone, (docs[id_col].cast("long") == gone["gone_id"]) & (F.xxhash64(docs[text_col]) == gone["gone_hash"]), "left_anti")


def op8_jaccard_join(spark, sf_dir):
    return groups(documents(spark, sf_dir))


OP8_SQL = rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(1, len(w) - 3) + 1), lambda i: array_to_string(w[i:i + 3], ' '))) AS s FROM w WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
r AS (SELECT a AS doc_id, b AS to_id FROM l UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.to_id)
SELECT w.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, least(w.doc_id, min(r.to_id)) AS component_id FROM w LEFT JOIN n USING (doc_id) LEFT JOIN r USING (doc_id) GROUP BY w.doc_id"""
