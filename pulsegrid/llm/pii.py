"""Personal data by a semi-Markov conditional random field over candidate segments.

Loose patterns propose segments with a type; of a run of digit groups every part that begins and ends with a group, has
7 to 19 digits and is at most LONGEST characters is proposed as a card, a phone and an SSN number, so that data which
follow one another are told apart.  Features of a whole segment (digits, separators, grouping, check digit,
parts, surrounding characters, a cue word before it) score it.  A text's candidates and the gaps between their bounds
form a lattice; a dynamic program over it jointly chooses bounds and types, an entity being at most LONGEST characters.
The weights are learned here by maximum likelihood (forward-backward over the same lattice) on sentences generated
from a seed, with true entities in several spellings and with look-alikes.

Base formats are found by exact rules and always stay; of the field's choice those that overlap no base span are added.
All patterns are linear in the text: runs are entered at their first character only.

Edge cases: null counts as empty; empty texts have no spans; repeated rows get equal results; offsets are code points;
only id and text are looked at.
"""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_batches, documents

KINDS = ("email", "ip", "card", "phone", "ssn")
LONGEST = 80

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9]){15,}")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    odd = [int(c) for c in digits[-1::-2]]
    even = [int(c) * 2 for c in digits[-2::-2]]
    return (sum(odd) + sum(x - 9 if x > 9 else x for x in even)) % 10 == 0


def emails(text: str):
    at, end = text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) by kind, then start."""
    out = [(0, s, e) for s, e in emails(text)]
    if not DIGITS.search(text):
        return out
    out += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(int(p[-4:]) <= 255 and len(p.lstrip("0")) <= 3 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        d = m[0].replace(" ", "").replace("-", "")
        if len(d) <= 19 and luhn(d):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


#: Loose patterns: (kinds, pattern).
LOOSE = [
    ((0,), re.compile(r"(?<![\w.%+-])[\w.%+-]{1,40}+(?:\x20?(?:\(at\)|\[at\])\x20?|@|\x20at\x20(?=[A-Za-z0-9-]{1,30}\x20dot\x20))[A-Za-z0-9-]{1,30}(?:(?:\.|\x20?(?:\(dot\)|\[dot\])\x20?|\x20dot\x20)[A-Za-z]{2,12}){1,3}", re.I)),
    ((1,), re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9])")),
]
#: Digit groups with up to two separators between them.
RUN = re.compile(r"[0-9]++(?:[\x20().-]{1,2}+[0-9]++)*+")
GROUP = re.compile(r"[0-9]+")
#: Words that announce a type.
CUES = (("mail", "contact", "write"), ("ip", "host", "server", "address"), ("card", "visa", "credit", "pay"), ("phone", "call", "tel", "mobile", "fax"), ("ssn", "social", "security"))
LOOK_ALIKE = ("order", "invoice", "id", "no", "number", "serial", "isbn", "date", "version")


def in_word(c: str) -> bool:
    return c.isalnum() or c == "_"


def numbers(text: str):
    """(start, end) of the parts of digit runs; a start takes in a plus sign, and with and without an opening bracket."""
    for run in RUN.finditer(text):
        groups = [m.span() for m in GROUP.finditer(text, run.start(), run.end())]
        for i, (first, _) in enumerate(groups):
            sign = text[first - 1 : first] if first else ""
            for start in [first - 1] if sign == "+" else [first - 1, first] if sign == "(" else [first]:
                before = text[start - 1 : start] if start else ""
                if in_word(before) or before == "+" or before == "." and i == 0:
                    continue
                n = 0
                for a, end in groups[i:]:
                    n += end - a
                    if n > 19 or end - start > LONGEST:
                        break
                    if n >= 7 and not in_word(text[end : end + 1]):
                        yield start, end


def segments(text: str) -> list[tuple[int, int, int]]:
    """Candidate (start, end, kind)."""
    out = []
    has_at = "@" in text or " at " in text or "(at)" in text or "[at]" in text
    has_digit = DIGITS.search(text) is not None
    for kinds, pattern in LOOSE:
        if has_at if kinds == (0,) else has_digit:
            out += [(m.start(), m.end(), k) for m in pattern.finditer(text) if m.end() - m.start() <= LONGEST for k in kinds]
    if has_digit:
        out += [(s, e, k) for s, e in numbers(text) for k in (2, 3, 4)]
    return sorted(out)


def features(text: str, start: int, end: int, kind: int) -> list[int]:
    """Numbers of a segment's binary features, of N_FEATURES for its kind."""
    s, before = text[start:end], text[max(0, start - 24) : start].lower()
    digits = "".join(c for c in s if c.isdigit())
    groups = [len(g) for g in re.findall(r"[0-9]+", s)]
    words = re.findall(r"[a-z]+", before)[-3:]
    n, after = len(digits), text[end : end + 2]
    f = [
        True, 8 <= n <= 15, 16 <= n <= 19, 13 <= n <= 15, n == 9, n in (7, 10, 11),
        s[:1] == "+", "(" in s[:6], len(groups) == 1, len(groups) > 1 and set(groups[:-1]) == {4}, groups == [3, 2, 4],
        groups[-1:] == [4] and len(groups) > 2, n >= 13 and luhn(digits), len(groups) == 4 and max(groups, default=9) <= 3 and "." in s,
        any(g > 3 for g in groups), "@" in s, "dot" in s.lower(), any(c.isalpha() for c in s),
        any(w.startswith(CUES[kind]) for w in words), any(w in LOOK_ALIKE for w in words), " " in s, "-" in s, before[-1:].isalnum(),
    ]
    # Bounds: standing for itself as a whole, or cut out of a longer string.
    f += [
        groups == [3, 3, 4], s[:1] == "+" and groups[1:] == [3, 3, 4], groups == [4] * 4, s.count("(") != s.count(")"),
        before[-1:] in ("-", ".") and before[-2:-1].isdigit(), after[:1] in ("-", ".") and after[1:].isdigit(), before[-1:] in ("(", ")"),
        before[-1:] == " " and (before[-2:-1].isdigit() or before[-2:-1] == ")"), after[:1] == " " and after[1:].isdigit(),
    ]
    base = kind * N_FEATURES
    return [base + i for i, x in enumerate(f) if x]


N_FEATURES = 32


def lattice(segs: list[tuple[int, int, int]]) -> tuple[list[int], list[list[tuple[int, int]]]]:
    """Bounds, and per bound the (segment number, bound where it starts) of the segments that end there."""
    bounds = sorted({x for s in segs for x in s[:2]})
    at = {b: i for i, b in enumerate(bounds)}
    ending: list[list[tuple[int, int]]] = [[] for _ in bounds]
    for i, (s, e, _) in enumerate(segs):
        ending[at[e]].append((i, at[s]))
    return bounds, ending


def best(segs, scores) -> list[tuple[int, int, int]]:
    """The non-overlapping segments with the greatest sum of scores; a gap scores 0."""
    bounds, ending = lattice(segs)
    total, came = [0.0] * len(bounds), [None] * len(bounds)
    for j in range(1, len(bounds)):
        total[j], came[j] = total[j - 1], None
        for i, k in ending[j]:
            if total[k] + scores[i] > total[j]:
                total[j], came[j] = total[k] + scores[i], (i, k)
    out, j = [], len(bounds) - 1
    while j > 0:
        if came[j]:
            out.append(segs[came[j][0]])
            j = came[j][1]
        else:
            j -= 1
    return out[::-1]


def marginals(segs, scores) -> np.ndarray:
    """Chance of each segment under the field."""
    bounds, ending = lattice(segs)
    n = len(bounds)
    ahead, back = np.full(n, -np.inf), np.full(n, -np.inf)
    ahead[0] = back[n - 1] = 0.0
    for j in range(1, n):
        ahead[j] = np.logaddexp.reduce([ahead[j - 1], *(ahead[k] + scores[i] for i, k in ending[j])])
    for j in range(n - 1, 0, -1):
        back[j - 1] = np.logaddexp(back[j - 1], back[j])
        for i, k in ending[j]:
            back[k] = np.logaddexp(back[k], back[j] + scores[i])
    p = np.zeros(len(segs))
    for j in range(n):
        for i, k in ending[j]:
            p[i] = np.exp(ahead[k] + scores[i] + back[j] - ahead[n - 1])
    return p


def sentences(n: int, seed: int) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Generated texts and their true segments."""
    r = random.Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("abcdefghilmnoprstu") for _ in range(r.randint(2, 8)))

    def card(ok: bool) -> str:
        while True:
            x = "4" + d(15)
            if luhn(x) == ok:
                return x if r.random() < 0.5 else r.choice(" -").join(x[i : i + 4] for i in range(0, 16, 4))

    def one() -> tuple[str, int]:
        k = r.randrange(9)
        if k == 0:
            return f"{word()}.{word()}@{word()}.{r.choice(['com', 'org', 'net'])}", 0
        if k == 1:
            a, b = r.choice([(" (at) ", " (dot) "), ("[at]", "[dot]"), (" at ", " dot ")])
            return f"{word()}{a}{word()}{b}{r.choice(['com', 'org'])}", 0
        if k == 2:
            return ".".join(str(r.randint(1, 255)) for _ in range(4)), 1
        if k == 3:
            return card(True), 2
        if k == 4:
            return f"+{r.randint(1, 99)} ({d(3)}) {d(3)}-{d(4)}", 3
        if k == 5:
            return r.choice([f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}"]), 3
        if k == 6:
            return f"{d(3)}-{d(2)}-{d(4)}", 4
        return r.choice([card(False), d(r.randint(7, 20)), f"{r.randint(1900, 2030)}-{d(2)}-{d(2)} {d(2)}", f"{d(4)} {d(4)}", f"{d(3)}.{d(2)}.{d(2)}.{d(4)}"]), -1

    def neighbour() -> tuple[str, int]:
        return one() if r.random() < 0.6 else (r.choice([str(r.randint(1900, 2030)), f"{r.randint(1900, 2030)}-{d(2)}-{d(2)}", d(r.randint(1, 3))]), -1)

    out = []
    for _ in range(n):
        text, true = " ".join(word() for _ in range(r.randint(0, 4))), []
        for _ in range(r.randint(1, 3)):
            e, kind = one()
            cue = r.choice(CUES[kind]) + r.choice([" ", ": "]) if kind >= 0 and r.random() < 0.4 else r.choice(LOOK_ALIKE) + " " if kind < 0 and r.random() < 0.5 else ""
            text += f" {word()} {cue}"
            if kind >= 0:
                true.append((len(text), len(text) + len(e), kind))
            text += e
            while r.random() < 0.25:
                e, kind = neighbour()
                text += " "
                if kind >= 0:
                    true.append((len(text), len(text) + len(e), kind))
                text += e
            text += f" {word()}."
        out.append((text, true))
    return out


def learn(n: int = 600, rounds: int = 40, seed: int = 23, l2: float = 0.002) -> np.ndarray:
    """Weights by gradient ascent on the likelihood of the generated texts' true segments."""
    data = []
    for text, true in sentences(n, seed):
        segs = segments(text)
        if segs:
            data.append((segs, [features(text, *s) for s in segs], np.array([s in true for s in segs], float)))
    w = np.zeros(len(KINDS) * N_FEATURES)
    m = v = np.zeros_like(w)
    for t in range(1, rounds + 1):
        g = -l2 * w * len(data)
        for segs, fs, true in data:
            p = marginals(segs, [w[f].sum() for f in fs])
            for f, x in zip(fs, true - p):
                g[f] += x
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w + 0.3 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w


def spans(text: str, w: np.ndarray) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and base and added ones, as (kind number, start, end) by kind, then start."""
    base = base_spans(text)
    segs = segments(text)
    chosen = best(segs, [w[features(text, *s)].sum() for s in segs]) if segs else []
    taken = sorted((s, e) for _, s, e in base)
    starts = [s for s, _ in taken]
    more = []
    for s, e, k in chosen:
        # Base spans of different kinds may nest, so the nearest ones on both sides are looked at.
        near = taken[max(0, np.searchsorted(starts, s) - 4) : np.searchsorted(starts, e)]
        if not any(a < e and s < b for a, b in near):
            more.append((k, s, e))
    return base, sorted(base + more)


def printed(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in found)


def find(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", weights: np.ndarray | None = None) -> DataFrame:
    """A row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.  Map-only."""
    arrow_batches(docs.sparkSession)
    w = learn() if weights is None else weights

    def run(batches):
        for b in batches:
            counts, digests, all_ = [], [], []
            for x in b.column(1):
                base, every = spans(x.as_py() or "", w)
                counts.append([sum(k == i for k, _, _ in base) for i in range(4)])
                digests.append(hashlib.sha256(printed(base).encode()).hexdigest())
                all_.append(printed(every))
            n = np.array(counts, np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(n[:, i]) for i in range(4)), pa.array(digests, pa.string()), pa.array(all_, pa.string())], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def op7_pii(spark, sf_dir):
    return find(documents(spark, sf_dir))
