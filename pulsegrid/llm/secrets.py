"""Secret scans: known formats and a randomness test battery, in DataFrame functions only.

Known formats are found by regular expressions.  Besides, every run of 20 or more characters of a token alphabet is a
candidate.  Its encoding is inferred from its characters (hex, base32, base64) and three tests measure how far it is
from a random string of that alphabet: chi-squared uniformity of its characters, the number of runs above and below the
alphabet's middle, and the lag-1 serial correlation of its characters' places in the alphabet.  The three z values give
one chi-squared value, and that a random string's chance to be as far off: the candidate's likeness to a random one.

False discoveries are controlled among what is reported.  The null hypothesis is "ordinary": its distribution is that of
the corpus's own ordinary strings, which go through the same battery: every text's words in lower case, its words with
capitals and numbers, joined and cut to the lengths of the bands, and for hex its numbers.  A candidate's p value is the
share of ordinary strings of its encoding and length that are at least as much like a random one; per such stratum the
Benjamini-Hochberg line over the candidates' p values, at Q, says which are reported as `random`.  Short strings, in
which the tests tell little, have ordinary ones like them, so their p values are large: the control is aware of length.
The strata are few and all likenesses go through histograms of fixed size, so nothing that grows with the corpus is
gathered; marked candidates are written once; texts are never shuffled.

A random span overlaps no known one.  Offsets are code points: the pieces between matches and the matches themselves are
measured in turn, in blocks of the square root of their number, so a text with very many matches takes no squared time.

Edge cases: null counts as empty; empty texts have no spans and the digest of the empty string; a stratum without
ordinary strings of its length or shorter reports nothing; a corpus without candidates has no strata; repeated rows get equal results; a null id stays
null; other columns are never looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound, cut, documents

#: The base formats, in the order of the digest.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "random")
#: Runs are maximal and start at their first character, so asking for the least length finds what dropping short runs leaves.
ACCESS_LONG, HEX_LONG = r"AKIA[A-Z0-9]{16,}", r"[0-9a-f]{24,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
ALPHABETS = {"hex": "0123456789abcdef", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"}
Q = 0.05
#: Likenesses are counted in so many bins of their logarithm, from 1 down to 1e-30.
BINS = 512
#: A stratum with fewer ordinary strings takes those of the next shorter ones too: they look more random, so the control stays safe.
LEAST_ORDINARY = 200
#: Over the sum of the products of a string's letter numbers.
HIGH = float(1 << 20)
LENGTHS = (20, 24, 32, 40, 48, 64, 96, 128)


SPANS = "array<struct<start:int,end:int,match:string>>"


def found(text: Column, pattern: str) -> Column:
    """Array of (start, end, match) of a pattern's matches, leftmost and not overlapping."""
    p = F.lit(pattern)
    hits = F.regexp_extract_all(text, p, F.lit(0))
    gaps = F.split(text, pattern, -1)

    def block(each: Column) -> Column:
        """Spans of some matches in a row, from 0, and their whole length."""
        step = lambda acc, x: bound(
            F.struct((acc["at"] + x["gap"]).alias("start"), (acc["at"] + x["gap"] + F.char_length(x["hit"])).alias("end")),
            lambda e: F.struct(e["end"].alias("at"), F.array_append(acc["got"], F.struct(e["start"].alias("start"), e["end"].alias("end"), x["hit"].alias("match"))).alias("got")),
        )
        return F.aggregate(each, F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("got")), step)

    def offsets(blocks: Column) -> Column:
        """Where each block begins."""
        begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("got"))
        return F.aggregate(blocks, begin, lambda acc, x: F.struct((acc["at"] + x["at"]).alias("at"), F.array_append(acc["got"], acc["at"]).alias("got")), lambda acc: acc["got"])

    def shifted(blocks: Column) -> Column:
        move = lambda b, at: F.transform(b["got"], lambda s: F.struct((s["start"] + at).alias("start"), (s["end"] + at).alias("end"), s["match"].alias("match")))
        return bound(offsets(blocks), lambda at: F.flatten(F.zip_with(blocks, at, move)))

    def spans(m: Column) -> Column:
        n = F.size(m["hits"])
        before = F.transform(F.slice(m["gaps"], F.lit(1), n), F.char_length)
        each = F.arrays_zip(m["hits"].alias("hit"), before.alias("gap"))
        width = F.greatest(F.lit(1), F.ceil(F.sqrt(n.cast("double"))).cast("int"))
        in_blocks = lambda e, w: F.transform(F.sequence(F.lit(0), F.floor((F.size(e) - 1) / w).cast("int")), lambda k: block(F.slice(e, k * w + 1, w)))
        return bound(F.struct(each.alias("e"), width.alias("w")), lambda v: bound(in_blocks(v["e"], v["w"]), shifted))

    both = F.struct(hits.alias("hits"), gaps.alias("gaps"))
    return F.when(F.regexp_like(text, p), bound(both, spans)).otherwise(F.array().cast(SPANS))


def base_spans(text: Column) -> Column:
    """Array of (start, kind number, end)."""
    as_spans = lambda found_, k: F.transform(found_, lambda x: F.struct(x["start"].alias("start"), F.lit(k).alias("kind"), x["end"].alias("end")))
    value = lambda x: F.regexp_extract(x["match"], ASSIGN, 2)
    assign = F.filter(found(text, ASSIGN), lambda x: F.char_length(value(x)) >= 6)
    return F.array_sort(F.concat(as_spans(assign, 0), as_spans(found(text, ACCESS_LONG), 1), as_spans(found(text, HEX_LONG), 2)))


def normal_tail(z: Column) -> Column:
    """Upper tail of the standard normal distribution, by a logistic approximation (error below 0.0002)."""
    return 1 / (1 + F.exp(F.least(F.lit(700.0), 0.07056 * z * z * z + 1.5976 * z)))


def far_off(squares: Column, runs: Column, serial: Column, k: Column, n: Column) -> Column:
    """How far n >= 2 characters of k are off a random string, as a normal value: sum of squared counts, changes of half, products of neighbours about the middle."""
    chi = ((k / n * squares - n) - (k - 1)) / F.sqrt(2 * (k - 1) * (1 - 1 / n))
    z_runs = (runs - (n - 1) / 2) / F.sqrt((n - 1) / 4)
    z_serial = serial / ((k * k - 1) / 12 * F.sqrt(n - 1))
    # Too uneven counts, too few or too many runs, and correlation of either sign speak against randomness.
    stat = F.pow(F.greatest(F.lit(0.0), chi), 2.0) + F.pow(z_runs, 2.0) + F.pow(z_serial, 2.0)
    return (F.cbrt(stat / 3) - (1 - 2 / 27)) / (2 / 27) ** 0.5


def likeness(squares: Column, runs: Column, serial: Column, k: Column, n: Column) -> Column:
    """Chance of a random string to look less random."""
    return F.when(n >= 2, normal_tail(far_off(squares, runs, serial, k, n))).otherwise(0.0)  # nothing but padding is not random


def encoding_of(s: Column) -> Column:
    return F.when(F.regexp_like(s, F.lit("^[0-9a-f]+$")), "hex").when(F.regexp_like(s, F.lit("^[0-9A-F]+$")), "hex").when(F.regexp_like(s, F.lit("^[A-Z2-7]+=*$")), "base32").otherwise("base64")


def battery(s: Column) -> Column:
    """Struct (encoding, p) of a string: p is the chance that a random string of its alphabet looks less random."""
    body = F.rtrim(F.translate(s, "-_", "+/"), F.lit("="))
    encoding = encoding_of(s)

    def tests(v: Column) -> Column:
        alphabet = F.when(v["encoding"] == "hex", ALPHABETS["hex"]).when(v["encoding"] == "base32", ALPHABETS["base32"]).otherwise(ALPHABETS["base64"])
        text = F.when(v["encoding"] == "hex", F.lower(v["body"])).otherwise(v["body"])
        places = bound(F.struct(text.alias("t"), alphabet.alias("a")), lambda w: F.transform(F.filter(F.split(w["t"], ""), lambda c: c != ""), lambda c: F.instr(w["a"], c).cast("double")))
        # A character's count is what the string loses without it.
        one = lambda w, c: F.pow((F.char_length(w["t"]) - F.char_length(F.replace(w["t"], c, F.lit("")))).cast("double"), 2.0)
        squares = bound(F.struct(text.alias("t"), alphabet.alias("a")), lambda w: F.aggregate(F.filter(F.split(w["a"], ""), lambda c: c != ""), F.lit(0.0), lambda acc, c: acc + one(w, c)))
        return bound(F.struct(places.alias("x"), squares.alias("squares"), F.char_length(alphabet).cast("double").alias("k"), F.size(places).cast("double").alias("n")), statistics)

    def statistics(v: Column) -> Column:
        x, middle = v["x"], (v["k"] + 1) / 2
        total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, b: a + b)
        pairs = lambda f: F.zip_with(F.slice(x, F.lit(1), F.size(x) - 1), F.slice(x, F.lit(2), F.size(x) - 1), f)
        runs = total(pairs(lambda a, b: F.when((a > middle) == (b > middle), 0.0).otherwise(1.0)))
        return likeness(v["squares"], runs, total(pairs(lambda a, b: (a - middle) * (b - middle))), v["k"], v["n"])

    return bound(F.struct(body.alias("body"), encoding.alias("encoding")), lambda v: F.struct(v["encoding"].alias("encoding"), tests(v).alias("p")))


def stratum(length: Column, encoding: Column) -> Column:
    band = sum(((length >= n).cast("int") for n in LENGTHS), F.lit(0))
    return F.concat(encoding, F.lit(":"), band.cast("string"))


def bin_of(p: Column) -> Column:
    """Bin of a likeness: 0 for 1, the last for 1e-30 and less."""
    return F.least(F.lit(BINS - 1), F.floor(-F.log(F.greatest(p, F.lit(1e-30))) / F.log(F.lit(1e30)) * BINS)).cast("int")


def candidates(text: Column, base: Column) -> Column:
    """Array of (start, end, stratum, bin) of token runs that overlap no base span."""

    def judged(c: Column) -> Column:
        length = c["end"] - c["start"]
        return bound(battery(c["match"]), lambda b: F.struct(c["start"].alias("start"), c["end"].alias("end"), stratum(length, b["encoding"]).alias("stratum"), bin_of(b["p"]).alias("bin")))

    def free(v: Column) -> Column:
        return F.filter(v["runs"], lambda c: ~F.exists(v["base"], lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))

    return F.transform(bound(F.struct(found(text, CANDIDATE).alias("runs"), base.alias("base")), free), judged)


def ordinary_pieces(text: Column, capitals: bool = True) -> Column:
    """Array of a text's ordinary strings: all pieces of its words, of its words with capitals and numbers, and of its numbers.

    Words are there in lower case and (unless `capitals` is false) in capitals, cut alike.

    Words are runs of up to 16 letters, numbers of up to 8 digits, so that what may be secrets is not among them.  The pieces' length
    is one of LENGTHS, dealt by the text's hash: over many texts all lengths have their share.  Pieces follow one another to the
    text's end; the last one ends there.  Strings shorter than a piece are cut to the longest of LENGTHS that they hold.
    """
    lower = F.array_join(F.regexp_extract_all(F.lower(text), F.lit(r"(?<![A-Za-z0-9])[a-z]{2,16}(?![A-Za-z0-9])"), F.lit(0)), "")
    named = F.array_join(F.regexp_extract_all(text, F.lit(r"(?<![A-Za-z0-9])(?:[A-Z]?[a-z]{1,15}|[0-9]{1,8})(?![A-Za-z0-9])"), F.lit(0)), "_")
    shouted = F.upper(lower)
    numbers = F.array_join(F.regexp_extract_all(text, F.lit(r"(?<![A-Za-z0-9])[0-9]{1,8}(?![A-Za-z0-9])"), F.lit(0)), "")

    n = F.element_at(F.array(*map(F.lit, LENGTHS)), F.pmod(F.xxhash64(text), F.lit(len(LENGTHS))).cast("int") + 1)

    def length(t: Column, most: Column) -> Column:
        return F.array_max(F.filter(F.array(*map(F.lit, LENGTHS)), lambda x: (x <= most) & (x <= F.char_length(t))))

    def cut_up(t: Column, n: Column) -> Column:
        whole = F.regexp_extract_all(t, F.concat(F.lit(".{"), n.cast("string"), F.lit("}")), F.lit(0))
        return F.when(F.char_length(t) % n == 0, whole).otherwise(F.concat(whole, F.array(F.right(t, n))))

    def pieces(v: Column) -> Column:
        long_enough = F.filter(v["all"], lambda t: F.char_length(t) >= LENGTHS[0])
        return F.flatten(F.transform(long_enough, lambda t: bound(F.struct(t.alias("t"), length(t, v["n"]).alias("n")), lambda x: cut_up(x["t"], x["n"]))))

    return bound(F.struct(F.array(lower, named, *[shouted] * capitals, numbers).alias("all"), n.alias("n")), pieces)


def ordinary(text: Column) -> Column:
    """Array of (stratum, bin) of a text's ordinary strings."""
    each = lambda t: bound(battery(t), lambda b: F.struct(stratum(F.char_length(t), b["encoding"]).alias("stratum"), bin_of(b["p"]).alias("bin")))
    return F.transform(ordinary_pieces(text), each)


def ordinary_strings(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(stratum, bin), a row per ordinary string of all texts: what `ordinary` gives, by compiled expressions.

    The strings hold letters, digits and underscores.  Counts are what a string loses without a character; changes of half
    are the ends of the runs of the upper half; neighbours' products need one look per character.  Words in lower case and in
    capitals are measured once: their counts are the same, and their products differ by what the neighbours' sums give, for
    which a letter's number is raised by HIGH: one sum of products then holds the sum of the numbers in its higher part.
    """
    rows = docs.select(F.explode(ordinary_pieces(F.coalesce(docs[text_col], F.lit("")), capitals=False)).alias("s"))
    rows = rows.select("s", encoding_of(F.col("s")).alias("encoding"), F.regexp_like("s", F.lit("^[a-z]+$")).alias("letters"))
    t = F.when(F.col("encoding") == "hex", F.lower("s")).otherwise(F.replace(F.col("s"), F.lit("_"), F.lit("/")))
    rows = rows.select("encoding", "letters", t.alias("t"), F.octet_length(t).alias("n"))

    def by_encoding(f) -> Column:
        kind = F.col("encoding")
        return F.when(kind == "hex", f(ALPHABETS["hex"])).when(kind == "base32", f(ALPHABETS["base32"])).otherwise(f(ALPHABETS["base64"]))

    def runs(alphabet: str) -> Column:
        upper = f"[{alphabet[len(alphabet) // 2 :]}]"
        at = lambda p: F.regexp_like("t", F.lit(p)).cast("int")
        return (2 * F.regexp_count("t", F.lit(f"{upper}+")) - at(f"^{upper}") - at(f"{upper}$")).cast("double")

    def neighbours(place) -> Column:
        """Sum of the products of neighbours' places."""
        places = F.array(*[F.lit(float(place(chr(i)))) for i in range(1, 128)])
        x = F.transform(F.split("t", ""), lambda c: F.element_at(places, F.ascii(c)))
        products = bound(x, lambda v: F.zip_with(F.slice(v, F.lit(1), F.size(v) - 1), F.slice(v, F.lit(2), F.size(v) - 1), lambda a, b: a * b))
        return F.aggregate(products, F.lit(0.0), lambda a, b: a + b)

    def serial(alphabet: str) -> Column:
        return neighbours(lambda c: alphabet.find(c) + 1 - (len(alphabet) + 1) / 2)

    count = lambda c: (F.col("n") - F.octet_length(F.replace(F.col("t"), c, F.lit("")))).cast("double")
    squares = F.aggregate(F.transform(F.array_distinct(F.split("t", "")), count), F.lit(0.0), lambda acc, x: acc + x * x)
    numbered = neighbours(lambda c: HIGH + ord(c) - ord("a") + 1)
    # Words in capitals are base32 where those in lower case are base64; both are hex alike.
    capitals = F.when(F.col("letters"), F.when(F.col("encoding") == "hex", F.col("runs")).otherwise(runs(ALPHABETS["base32"].lower())))
    m = rows.withColumns({"squares": squares, "near": F.when(F.col("letters"), numbered).otherwise(by_encoding(serial)), "runs": by_encoding(runs)})
    both = F.col("near") - (F.col("n") - 1) * HIGH * HIGH
    m = m.withColumns({"runs_of_capitals": capitals, "sums": F.floor(both / HIGH).cast("double")}).withColumn("products", both - F.col("sums") * HIGH)
    other = F.when(F.col("encoding") == "hex", "hex").otherwise("base32")
    each = lambda encoding, runs: F.struct(encoding.alias("encoding"), runs.alias("runs"))
    own, second = each(F.col("encoding"), F.col("runs")), each(other, F.col("runs_of_capitals"))
    m = m.select("letters", "n", "squares", "near", "sums", "products", F.explode(F.when(F.col("letters"), F.array(own, second)).otherwise(F.array(own))).alias("o"))
    m = m.select("letters", "n", "squares", "near", "sums", "products", "o.encoding", "o.runs")
    # Where a word's letters begin in the alphabet, from its middle.
    m = m.withColumn("middle", by_encoding(lambda a: F.lit((len(a) + 1) / 2 - a.find("a" if "a" in a else "A"))))
    middle = F.col("middle")
    lag = F.when(F.col("letters"), F.col("products") - middle * F.col("sums") + (F.col("n") - 1) * middle * middle).otherwise(F.col("near"))
    # Spark puts a stage's steps into one method, and one that is too long is never compiled.  So `k` and `lag` are columns, and the
    # stratum goes through bound(), whose kind of function keeps a step to itself.
    m = m.select("encoding", "n", "squares", "runs", by_encoding(lambda a: F.lit(float(len(a)))).alias("k"), lag.alias("lag"))
    z = far_off(F.col("squares"), F.col("runs"), F.col("lag"), F.col("k"), F.col("n").cast("double"))
    m = m.select(bound(F.col("n"), lambda n: stratum(n, F.col("encoding"))).alias("stratum"), z.alias("z"))
    return m.select("stratum", bin_of(normal_tail(F.col("z"))).alias("bin"))


def marked(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, base, more): base spans and candidates of every row."""
    d = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    spans = d.select("doc_id", "text", base_spans(F.col("text")).alias("base"))
    none = F.array().cast("array<struct<start:int,end:int,stratum:string,bin:int>>")
    more = F.when(F.regexp_like("text", F.lit(CANDIDATE)), candidates(F.col("text"), F.col("base"))).otherwise(none)
    return spans.select("doc_id", "base", more.alias("more"))


def counted(strings: DataFrame) -> dict[str, dict[int, int]]:
    """Numbers by stratum and bin: at most 27 x BINS rows."""
    out: dict[str, dict[int, int]] = {}
    for r in strings.groupBy("stratum", "bin").count().collect():
        out.setdefault(r["stratum"], {})[r["bin"]] = r["count"]
    return out


def lines(candidate_strings: DataFrame, ordinary_ones: DataFrame, q: float = Q) -> dict[str, int]:
    """Per stratum the last bin whose candidates are reported (-1: none)."""
    tested, null = counted(candidate_strings), counted(ordinary_ones)
    out = {}
    for name, bins in tested.items():
        own, (encoding, band) = dict(null.get(name, {})), name.split(":")
        for shorter in range(int(band) - 1, -1, -1):
            if sum(own.values()) >= LEAST_ORDINARY:
                break
            for b, count in null.get(f"{encoding}:{shorter}", {}).items():
                own[b] = own.get(b, 0) + count
        n, ordinary_n, so_far, like, last = sum(bins.values()), sum(own.values()), 0, 0, -1
        for b in range(BINS):  # from the most like a random string
            so_far, like = so_far + bins.get(b, 0), like + own.get(b, 0)
            if ordinary_n and bins.get(b) and (1 + like) / (1 + ordinary_n) <= q * so_far / n:
                last = b
        out[name] = last
    return out


def scan(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", q: float = Q) -> DataFrame:
    """A row per document: doc_id, base and spans, arrays of (start, kind number, end) by start and kind."""
    m = cut(marked(docs, text_col, id_col))
    last = lines(m.select(F.explode("more").alias("c")).select("c.stratum", "c.bin"), ordinary_strings(docs, text_col), q)
    most = F.create_map(*[y for k, v in last.items() for y in (F.lit(k), F.lit(v))]) if last else F.create_map().cast("map<string,int>")
    random = F.transform(F.filter("more", lambda c: c["bin"] <= most[c["stratum"]]), lambda c: F.struct(c["start"].alias("start"), F.lit(3).alias("kind"), c["end"].alias("end")))
    return m.select("doc_id", "base", F.array_sort(F.concat("base", random)).alias("spans"))


def printed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op4_secrets(spark, sf_dir):
    s = scan(documents(spark, sf_dir))
    n = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    return s.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(printed(F.col("base")), 256).alias("base_sha256"), printed(F.col("spans")).alias("spans"))
