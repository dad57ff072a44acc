"""Small tables with nulls, empty and long texts, ties, repeated rows and clashing names; each operator against brute force."""

import hashlib
import random
import re

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from pulsegrid.llm import bpe, exact_dedup, fingerprint, jaccard, langid, line_dedup, mixing, pii, quality, queries, secrets
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
DIGEST = lambda s: hashlib.sha256(s.encode()).hexdigest()


def words(r, n):
    return [r.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa"]) + str(r.randint(0, 60)) for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    out = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "  \n ", "en", None, 4), (4, "ÄB c", "de", "a", 4), (5, "Äb C", "de", "b", 4), (5, "Äb C", "de", "b", 4), (6, "äb c", "de", "b", 4), (7, "🎉 one", "xx", "c", 5)]
    for g in range(12):
        base = words(r, 150)
        for i in range(5):
            own = list(base)
            for _ in range(i % 4):
                own[r.randrange(150)] = "changed" + str(r.random())
            out.append((100 + g * 10 + i, " ".join(own), "en", r.choice("abc"), 0))
    out.append((900, " ".join(words(r, 30000)), "fr", "a", 0))
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumns({"size": F.lit("clash"), "row": F.lit(1), "part": F.lit(2), "key": F.lit(3), "node": F.lit(4), "base": F.lit(5)})


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def test_exact_dedup(docs, rows):
    got = exact_dedup.exact_groups(docs, first_width=2).select("id", "keep_id", "group_size", "kept").collect()
    by = {}
    for i, t, *_ in rows:
        by.setdefault(lower(t), []).append(i)
    want = sorted((i, max(by[lower(t)]), len(by[lower(t)])) for i, t, *_ in rows)
    assert sorted(tuple(x)[:3] for x in got) == want
    assert sum(x["kept"] for x in got) == len(by)
    assert exact_dedup.keep_one(docs).columns == docs.columns


def test_bpe_round_trip(docs, rows):
    got = bpe.encode(docs)
    want = sorted((i, DIGEST(t or "")) for i, t, *_ in rows)
    assert sorted((x["doc_id"], x["decoded_sha256"]) for x in got.collect()) == want
    raw = {(x["doc_id"], bytes(x["raw"])) for x in bpe.decode(got).collect()}
    assert raw == {(i, (t or "").encode()) for i, t, *_ in rows}


def test_bpe_pieces_do_not_change_ids():
    codec = bpe.Codec.of(*bpe.rank_file())
    text = " ".join(["don't", "x  y", "\n\n z", "12 34", "é🎉"] * 400)
    assert [i for p in bpe.pieces(text, 50) for i in codec.bpe.encode_ordinary(p)] == codec.bpe.encode_ordinary(text)


def test_bpe_long_unbroken_runs(spark):
    codec = bpe.Codec.of(*bpe.rank_file())
    plain = codec.bpe.encode_ordinary
    for run in (" " * 5000, "\n" * 4096, " \n" * 3000, "\u3000" * 4500, " " * 4999 + "\t"):
        for text in (f"a{run}b", f"a {run}", run, f"{run}!", f"a{run}b c{run}\n d{run}"):
            assert codec.encode(text) == plain(text)
    two = 2_000_000
    texts = ["a" + " " * two + "b", "a" + "\n" * two, "x" * two, "7" * two, "!" * two, "é" * (two // 2)]
    got = bpe.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6), keep_ids=False).collect()
    assert {x["doc_id"]: x["decoded_sha256"] for x in got} == {i: DIGEST(t) for i, t in enumerate(texts)}


def test_bpe_digest_of_ids(docs, rows):
    codec = bpe.Codec.of(*bpe.rank_file())
    want = sorted((i, len(x := codec.bpe.encode_ordinary(t or "")), hashlib.sha256(np.asarray(x, "<u4").tobytes()).hexdigest()) for i, t, *_ in rows)
    assert sorted((x["doc_id"], x["n_tokens"], x["ids_sha256"]) for x in bpe.encode(docs, keep_ids=False).collect()) == want


def test_repeated_ids_keep_unrelated_texts(spark):
    a, b, other = (" ".join(f"{p}{i}" for i in range(40)) for p in "abo")
    d = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(tuple(x) for x in jaccard.keep_one(d([(3, a), (7, a), (7, other), (None, a), (9, None)])).collect() if x["doc_id"])
    assert kept == [(3, a), (7, other), (9, None)]
    got = sorted({(x["doc_id"], x["component_id"]) for x in jaccard.groups(d([(3, a), (5, b), (7, a), (7, b)])).collect()})
    assert got == [(3, 3), (5, 3), (7, 3)]
    with pytest.raises(ValueError):
        jaccard.groups(d([(1, "x")]), percent=50)
    both = exact_dedup.exact_groups(d([(7, a), (7, a), (7, other), (None, a), (3, b)])).select("id", "keep_id", "group_size", "kept").collect()
    assert sorted((x["id"] or 0, x["keep_id"], x["group_size"], x["kept"]) for x in both) == [(0, 7, 3, False), (3, 3, 1, True), (7, 7, 1, True), (7, 7, 3, False), (7, 7, 3, True)]


def test_every_link(spark, docs, rows):
    pairs, of = jaccard.links(docs, k=5, percent=80, small=64)
    first = {}
    for i, x in sets(rows, 5):
        if x:
            first[x] = min(i, first.get(x, i))
    each = sorted(first.items(), key=lambda e: e[1])
    want = {(min(i, j), max(i, j)) for n, (x, i) in enumerate(each) for y, j in each[:n] if 100 * len(x & y) >= 80 * len(x | y)}
    assert len(want) > 20 and sorted(map(tuple, pairs.collect())) == sorted(want)
    assert sorted(map(tuple, of.collect())) == sorted((i, first[x]) for i, x in sets(rows, 5) if x)


def sets(rows, k):
    out = []
    for i, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        out.append((i, frozenset(tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))) if w else frozenset()))
    return out


@pytest.mark.parametrize("k, percent, small", [(4, 85, 256), (5, 80, 64), (3, 60, 1000)])
def test_jaccard_components(docs, rows, k, percent, small):
    got = sorted(tuple(x) for x in jaccard.groups(docs, k=k, percent=percent, small=small).collect())
    s = sets(rows, k)
    comp = list(range(len(s)))
    for a in range(len(s)):
        for b in range(a):
            x, y = s[a][1], s[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y) or s[a][0] == s[b][0]:
                old, new = comp[a], comp[b]
                comp = [new if c == old else c for c in comp]
    least = {}
    for c, (i, _) in zip(comp, s):
        least[c] = min(i, least.get(c, i))
    assert got == sorted((i, len(x), least[c]) for c, (i, x) in zip(comp, s))


def test_fingerprints(docs, rows):
    got = fingerprint.fingerprints(docs).collect()
    order = sorted((i, t or "") for i, t, *_ in rows)
    want = []
    for n, (i, t) in enumerate(order):
        after, h = order[(n + 1) % len(order)][1], len(t) // 2
        want.append((i, len(t), DIGEST(t[: len(t) - h] + after[:h])))
    assert sorted((x["doc_id"], x["n_chars"], x["edited_sha256"]) for x in got) == sorted(want)
    assert all(0 <= x["near_edited"] <= 1 and 0 <= x["near_next"] <= 1 for x in got)
    mask = (1 << 64) - 1
    hashes = {}
    for i, t, *_ in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", (t or "").lower()) if x]
        hashes[i] = [w[j : j + 5] for j in range(max(1, len(w) - 4))] if w else []
    flat = [(i, s) for i, ss in hashes.items() for s in ss]
    d = docs.sparkSession.createDataFrame(flat, "doc_id long, w array<string>").select("doc_id", F.xxhash64(F.transform("w", lambda x: F.xxhash64(x))).alias("h"))
    kept = {}
    for x in d.collect():
        if (x["h"] & mask) >> 61 == 0:
            kept.setdefault(x["doc_id"], set()).add(f"{x['h'] & mask:x}")
    for x in got:
        assert set(filter(None, x["fingerprint"].split(","))) == kept.get(x["doc_id"], set())
        a, b = (set(filter(None, x[c].split(","))) for c in ("fingerprint", "edited_fingerprint"))
        if a and b:
            assert x["near_edited"] == pytest.approx(len(a & b) / min(len(a), len(b)))
        else:
            assert x["near_edited"] in (0, 1)


def test_fingerprints_over_many_ranges(spark):
    d = spark.createDataFrame([(i * i, f"text {i}") for i in range(300)], "doc_id long, text string")
    paired, _ = fingerprint.with_next(d, per_range=7)
    got = {x["doc_id"]: x["next_text"] for x in paired.filter("extra = 0").collect()}
    assert got == {i * i: f"text {(i + 1) % 300}" for i in range(300)}


ASSIGN = re.compile(secrets.ASSIGN)


def test_secrets_base_spans_and_random_strings(spark):
    r = random.Random(3)
    b64 = secrets.ALPHABETS["base64"]
    texts = [None, "", "é token = abcdef; token:token:abcdef API_KEY: 'xyzzzz123' passwd=12345", "ü AKIA" + "Q" * 16 + " AKIAAKIA1", "deadbeef" * 4 + "0" * 23]
    texts += ["🎉 " + "".join(r.choice(b64) for _ in range(40)) + " end" for _ in range(30)] + [f"x name_of_the_customer_{i}_in_the_table" for i in range(30)]
    got = secrets.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).select("doc_id", secrets.printed(F.col("base")).alias("b"), secrets.printed(F.col("spans")).alias("s")).collect()
    for x in got:
        t = texts[x["doc_id"]] or ""
        o = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6] + [(m.start(), 1, m.end()) for m in re.finditer(secrets.ACCESS, t) if len(m[0]) >= 20] + [(m.start(), 2, m.end()) for m in re.finditer(secrets.HEX, t) if len(m[0]) >= 24]
        assert x["b"] == ",".join(f"{secrets.KINDS[k]}:{a}:{e}" for a, k, e in sorted(o))


def test_secrets_random_strings_are_discoveries(spark):
    r = random.Random(3)
    b64, hexa = secrets.ALPHABETS["base64"], secrets.ALPHABETS["hex"].upper()
    prose = lambda: " ".join(r.choice("the quick brown fox jumps over lazy dogs while many other animals look on from afar In Paris 1984 and 25 more 1066 300000 98765 47".split()) for _ in range(60))
    texts = [f"{prose()} {''.join(r.choice(b64) for _ in range(40))} end" for _ in range(40)] + [f"{prose()} name_of_the_customer_{i}_in_the_table" for i in range(60)]
    texts += [f"{prose()} {''.join(r.choice(hexa) for _ in range(64))}" for _ in range(20)] + [f"{prose()} {20240101000000 + i}{30000000000 + i * 7}" for i in range(60)] + [f"{prose()}\n{'-' * 60}\n{'=' * 40}" for _ in range(30)]
    got = secrets.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).select("doc_id", secrets.printed(F.col("spans")).alias("s")).collect()
    hit = {x["doc_id"] for x in got if "random" in x["s"]}
    truth = set(range(40)) | set(range(100, 120))
    assert len(hit & truth) > 0.8 * len(truth) and len(hit - truth) <= 0.1 * max(1, len(hit))


def test_secrets_with_very_many_matches(spark):
    text = " ".join(f"token=abcdef{i % 10} x{'q9' * 12}" for i in range(6000))
    got = secrets.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).select(secrets.printed(F.col("base")).alias("b")).first()["b"]
    assert got == ",".join(f"assign:{m.start()}:{m.end()}" for m in ASSIGN.finditer(text))


def plain_pii(t):
    rules = [(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True), (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))), (r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(re.sub(r"\D", "", s)) <= 19 and pii.luhn(re.sub(r"\D", "", s))), (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(re.sub("[^0-9]", "", s)) <= 15)]
    return [(k, m.start(), m.end()) for k, (p, ok) in enumerate(rules) for m in re.finditer(p, t) if ok(m[0])]


def test_pii_base_spans():
    r = random.Random(4)
    for _ in range(5000):
        t = "".join(r.choice("a1.@+-5 (4)9é") for _ in range(r.randint(0, 60)))
        assert pii.base_spans(t) == plain_pii(t)


def test_pii_field_on_generated_texts(docs):
    w = pii.learn(300, 25)
    hit = true_n = 0
    for text, true in pii.sentences(200, 77):
        segs = pii.segments(text)
        found = pii.best(segs, [w[pii.features(text, *s)].sum() for s in segs]) if segs else []
        hit, true_n = hit + len(set(found) & set(true)), true_n + len(true)
    assert hit / true_n > 0.95
    assert pii.find(docs, weights=w).count() == docs.count()


def test_pii_tells_adjacent_data_apart():
    w = pii.learn(300, 25)
    want = {"call 555-123-4567 555-987-6543": ["phone:5:17", "phone:18:30"], "ssn 123-45-6789 2024": ["ssn:4:15"], "tel 555-123-4567 2024-01-05": ["phone:4:16"], "(555) 123-4567 123-45-6789 x": ["phone:0:14", "ssn:15:26"]}
    for text, spans in want.items():
        assert pii.printed(pii.spans(text, w)[1]).split(",") == spans, text
    digits = " ".join(["12-3"] * 5000)
    assert all(e - s <= pii.LONGEST for s, e, _ in pii.segments(digits)) and len(pii.segments(digits)) < 10000 * 3 * 19


def test_mixing(spark, docs, rows):
    sized = docs.drop("size").withColumn("size", mixing.n_words(F.col("text")))
    got = mixing.mix(sized).select("source", "size", "source_size", "target", "taken", "row.doc_id").collect()
    sizes = {}
    for x in got:
        sizes[x["source"]] = sizes.get(x["source"], 0) + x["size"]
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, open_ = {}, set(names)
    budget = 1.5 * sum(sizes.values())
    while True:
        left = budget - sum(target.values())
        level = left / sum(weight[s] for s in open_) if open_ else 0
        over = [s for s in open_ if level * weight[s] > 2 * sizes[s]]
        if not over:
            break
        for s in over:
            target[s] = 2 * sizes[s]
            open_.remove(s)
    target |= {s: level * weight[s] for s in open_}
    taken = {}
    for x in got:
        assert x["source_size"] == sizes[x["source"]] and x["target"] == pytest.approx(target[x["source"]]) and 0 <= x["taken"] <= 2 * x["size"]
        taken[x["source"]] = taken.get(x["source"], 0) + x["taken"]
    assert all(abs(taken[s] - target[s]) <= 1 for s in names)


def test_schedule_integral_is_inverted(spark):
    for a in (0.5, 0.0, -0.5):
        q = spark.range(11).select(mixing.position(F.col("id").cast("double"), F.lit(10.0), F.lit(a)).alias("t")).collect()
        assert [10 * (x["t"] + a * x["t"] - a * x["t"] ** 2) for x in q] == pytest.approx(list(range(11)))


def test_line_dedup(spark):
    rows = [(i, f"Header number {i} that all the pages of this whole set have on top today\nown text {i} {chr(97 + i) * 3} {i * i} {chr(98 + i)} q{chr(99 + i)} w{chr(100 + i)}\n\nshort") for i in range(12)] + [(50, None), (51, ""), (52, "a\nb"), (52, "a\nb")]
    got = {x["doc_id"]: x for x in line_dedup.drop_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0]["n_dropped"] == 0 and all(got[i]["n_dropped"] == 1 and got[i]["text"].startswith("own text") for i in range(1, 12))
    assert got[50]["text"] is None and got[51]["text"] == "" and got[52]["text"] == "a\nb"


def test_line_dedup_keeps_lines_of_other_texts_under_one_id(spark):
    rows = [(1, "Header of the page that all of these share\nown one"), (3, "a\nb\nHeader of the page that all of these share"), (3, "first line of the other text here\nb2\nprecious line never seen anywhere else")]
    got = sorted((x["doc_id"], x["text"], x["n_dropped"]) for x in line_dedup.drop_lines(spark.createDataFrame(rows, "doc_id long, text string"), min_tokens=1).collect())
    assert got == [(1, rows[0][1], 0), (3, "a\nb", 1), (3, rows[2][1], 0)]


def test_line_dedup_short_lines_and_two_documents(spark):
    long = " ".join(f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60))
    rows = [(1, f"All rights reserved.\nfirst\n{long}"), (2, f"second\n{long}"), (3, "All rights reserved.\n \n\n|"), (4, "once\nonce\n \n"), (None, "first"), (None, "only nameless"), (None, "only nameless")]
    got = sorted((x["doc_id"] or 0, x["n_dropped"], x["text"]) for x in line_dedup.drop_lines(spark.createDataFrame(rows, "doc_id long, text string"), min_tokens=1).collect())
    assert got == [(0, 0, "first"), (0, 0, "only nameless"), (0, 0, "only nameless"), (1, 0, rows[0][1]), (2, 1, "second"), (3, 1, " \n\n|"), (4, 0, rows[3][1])]
    more = [(i, "All rights reserved.") for i in range(3)] + [(10 + i, "In four documents") for i in range(4)]
    assert [(x["doc_id"], x["n_dropped"]) for x in line_dedup.drop_lines(spark.createDataFrame(more, "doc_id long, text string"), min_docs=4, min_tokens=1).collect() if x["n_dropped"]] == [(11, 1), (12, 1), (13, 1)]


def test_line_dedup_opens_fields(spark):
    r = random.Random(8)
    name = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(9))
    forms = [lambda: f"Page written by {name()} last week", lambda: f"{name()} has joined this quiet little room", lambda: f"{name()} sent {name()} all of the other files yesterday", lambda: f"The host {name()} was found by us in the list that the office of {name()} keeps for all", lambda: f"| {name()} | {name()} | {name()} | {name()} | {name()} | {name()} |", lambda: " ".join(name() for _ in range(9))]
    rows = [(i, "\n".join(f() for f in forms)) for i in range(6)]
    got = {x["doc_id"]: x for x in line_dedup.drop_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0]["n_dropped"] == 0 and all(got[i]["n_dropped"] == 4 and got[i]["text"] == "\n".join(rows[i][1].split("\n")[4:]) for i in range(1, 6))


def test_language_and_quality_on_held_out_rows(spark):
    p = langid.op2_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out").toPandas()
    assert (p["lang"] == p["lang_pred"]).mean() > 0.95 and p["score"].between(0, 1).all()
    q = quality.op9_quality(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").filter("held_out").toPandas()
    assert (q["quality"] == q["predicted"]).mean() > 0.9


def test_language_edge_cases(docs):
    got = {x["doc_id"]: x for x in langid.identify(docs, langid.learn(docs, F.lit(True))).collect()}
    assert got[1]["lang_pred"] == got[2]["lang_pred"] == got[3]["lang_pred"] == "und" and got[1]["score"] == 0
    assert {x["lang_pred"] for x in langid.identify(docs, None).collect()} == {"und"}


def test_language_learns_every_value(spark):
    r = random.Random(9)
    names = [f"x{i:02d}" for i in range(67)]
    own = {k: ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(4)] for k in names}
    rows = [(100 * j + i, " ".join(r.choice(own[k]) for _ in range(30)), k) for i, k in enumerate(names) for j in range(2)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {x["doc_id"]: x["lang_pred"] for x in langid.identify(d, langid.learn(d, F.lit(True))).collect()}
    assert got == {i: k for i, _, k in rows}


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    sized = none.drop("size").withColumn("size", F.lit(0))
    assert exact_dedup.exact_groups(none).count() == bpe.encode(none).count() == jaccard.groups(none).count() == fingerprint.fingerprints(none).count() == 0
    assert secrets.scan(none).count() == line_dedup.drop_lines(none).count() == mixing.mix(sized).count() == 0
    assert langid.identify(none, langid.learn(none, F.lit(True))).count() == pii.find(none, weights=np.zeros(len(pii.KINDS) * pii.N_FEATURES)).count() == 0
    assert quality.scored(none, quality.learn(none, spark.createDataFrame([], "doc_id long, quality int"), F.lit(True))).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    rel, mine = con.sql(queries.ORACLE_SQL[name]), queries.QUERIES[name](spark, SF)
    cols = sorted(mine.columns)
    assert cols == sorted(rel.columns)
    key = lambda r: r[cols.index("doc_id")]
    a = sorted((tuple(r) for r in mine.select(*cols).collect()), key=key)
    b = sorted(rel.select(*cols).fetchall(), key=key)
    assert len(a) == len(b) and all(x == y or isinstance(x, float) and x == pytest.approx(y, rel=1e-12) for r, q in zip(a, b) for x, y in zip(r, q))


def all_texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_base_spans_of_whole_tables(spark):
    texts = all_texts(spark)
    for r in secrets.op4_secrets(spark, SF).collect():
        t = texts[r["doc_id"]]
        o = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6] + [(m.start(), 1, m.end()) for m in re.finditer(secrets.ACCESS, t) if len(m[0]) >= 20] + [(m.start(), 2, m.end()) for m in re.finditer(secrets.HEX, t) if len(m[0]) >= 24]
        text = ",".join(f"{secrets.KINDS[k]}:{a}:{e}" for a, k, e in sorted(o))
        assert r["base_sha256"] == DIGEST(text) and [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(x[1] == k for x in o) for k in range(3)]
        assert set(text.split(",")) - {""} <= set(r["spans"].split(","))
    for r in pii.op7_pii(spark, SF).collect():
        base = plain_pii(texts[r["doc_id"]])
        text = ",".join(f"{pii.KINDS[k]}:{a}:{e}" for k, a, e in sorted(base))
        assert r["base_sha256"] == DIGEST(text) and [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(x[0] == k for x in base) for k in range(4)]
        assert set(text.split(",")) - {""} <= set(r["spans"].split(","))


def plain_templates(line, min_tokens):
    """Templates of a line as texts: itself with masked digits, and with one or two sixths open where enough words stay."""
    tokens = [t for t in re.split(r"[ \t\x0b-\r]+", re.sub("[0-9]+", "0", line)) if t]
    if len(tokens) < max(1, min_tokens):
        return set()
    w = [t for t in tokens if t != "|"]
    n, out = len(w), {("whole", *tokens)}
    if n < 6:
        return out
    edge = [n * q // 6 for q in range(7)]
    parts = [tuple(w[edge[q] : edge[q + 1]]) for q in range(6)]
    for gone in [(q,) for q in range(6)] + [(p, q) for p in range(6) for q in range(p + 1, 6)]:
        kept = n - sum(len(parts[q]) for q in gone)
        if kept >= 5 and kept * 2 > n and (len(gone) == 2 or n < 9):
            out.add((n, gone, *[parts[q] for q in range(6) if q not in gone]))
    return out


def test_line_dedup_against_a_plain_version(spark):
    r = random.Random(11)
    pool = [" ".join(r.choice(("lorem", "ipsum", "dolor", "sit", "amet", "7", "42")) for _ in range(r.randint(0, 9))) for _ in range(12)]
    rows = [(r.randint(1, 25), "\n".join(r.choice(pool) if r.random() < 0.7 else r.choice(pool) + f" x{r.randint(0, 9)}" for _ in range(r.randint(1, 6)))) for _ in range(40)]
    rows += [(i, t + " " + chr(97 + i)) for i, (_, t) in enumerate(rows[:5])]
    first, many = {}, {}
    for i, t in rows:
        for line in t.split("\n"):
            for x in plain_templates(line, 1):
                first[x] = min(i, first.get(x, i))
                many.setdefault(x, set()).add(i)
    want = []
    for i, t in rows:
        left = []
        for line in t.split("\n"):
            hit = [first[x] for x in plain_templates(line, 1) if len(many[x]) > 1]
            if not hit or min(hit) == i:
                left.append(line)
        want.append((i, "\n".join(left)))
    got = line_dedup.drop_lines(spark.createDataFrame(rows, "doc_id long, text string"), min_tokens=1)
    assert sorted((x["doc_id"], x["text"]) for x in got.collect()) == sorted(want)


def test_pipeline(spark):
    """Each stage on what its predecessor kept, against plain versions."""
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen, outs = docs, [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.cut(stage(spark, docs, SF))
        if name != "tokens":
            assert docs.columns == seen.columns + ["position"] * (name == "mixing")
        outs.append(docs)
    every, good, unique, distinct = ({r["doc_id"]: r["text"] for r in d.collect()} for d in outs[:4])
    assert set(good) <= set(every) and np.mean([(i in good) == bool(q) for i, q in labels.items() if i in every]) > 0.95
    top = {}
    for i, t in good.items():
        top[lower(t)] = max(i, top.get(lower(t), i))
    assert set(unique) == set(top.values())
    s = sets([(i, t) for i, t in sorted(unique.items())], 5)
    comp = {i: i for i, _ in s}
    for n, (i, x) in enumerate(s):
        for j, y in s[:n]:
            if x and y and 100 * len(x & y) >= 80 * len(x | y) and comp[i] != comp[j]:
                low, high = sorted((comp[i], comp[j]))
                comp = {k: low if c == high else c for k, c in comp.items()}
    assert set(distinct) == set(comp.values())
    sized = mixing.mix(outs[3].withColumn("size", mixing.n_words(F.col("text")))).select("row.doc_id", "size", "source_size", "start", "target").collect()
    passes = {r["doc_id"]: sum(r["start"] + e * r["source_size"] < round(r["target"]) for e in range(3)) if r["size"] else 0 for r in sized}
    times = {}
    for r in outs[4].select("doc_id").collect():
        times[r["doc_id"]] = times.get(r["doc_id"], 0) + 1
    assert times == {i: n for i, n in passes.items() if n}
    assert outs[4].filter("position is null or position < 0 or position > 1").isEmpty()
    codec = bpe.Codec.of(*bpe.rank_file())
    for r in docs.limit(50).collect():
        assert r["ids"] == codec.bpe.encode_ordinary(distinct[r["doc_id"]] or "") and r["decoded_sha256"] == DIGEST(distinct[r["doc_id"]] or "")
    assert docs.select("doc_id", "position").exceptAll(outs[4].select("doc_id", "position")).isEmpty()
