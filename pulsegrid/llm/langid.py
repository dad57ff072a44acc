"""Language identification by hierarchical discrimination.

First the language family is predicted, then the language within it; both steps let one-versus-one linear support
vector machines vote (squared hinge loss; ties go to the larger sum of margins).  Features are the square roots of
the shares of hashed byte bigrams and trigrams of the whole lower-cased text, ASCII other than letters as spaces.

Learning takes at most `per_language` documents of each language (fewer where all would pass ROWS_MAX), those with the
smallest hashes; only their feature vectors reach the driver, so its memory is bounded.  Prediction is map-only.

Rows that share an id are one document for learning: of their texts the largest counts, so what reaches the driver stays
bounded however often an id repeats.  A null id is never held out and never learned from.

Edge cases: null text, or text without a letter, is `und` with score 0; a language that is not in the table of
families is a family of its own; with one language learned it is always predicted; with none everything is `und`;
repeated rows are predicted alike; other columns are never looked at.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, crc_mod, documents, unit_hash

#: Families of languages by ISO 639-1 code.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af lb fy yi".split(),
    "romance": "fr es it pt ro ca gl oc".split(),
    "slavic": "ru uk be pl cs sk bg sr hr bs sl mk".split(),
    "uralic": "fi et hu".split(),
    "baltic": "lt lv".split(),
    "celtic": "ga gd cy br".split(),
    "turkic": "tr az kk uz ky".split(),
    "indo-aryan": "hi bn ur pa mr gu ne".split(),
    "semitic": "ar he mt am".split(),
}
FAMILY_OF = {x: f for f, xs in FAMILIES.items() for x in xs}
#: Most rows learned from, over all languages.
ROWS_MAX = 64 * 800
BITS = 12
LETTER = regex.compile(r"\p{L}")
TABLE = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def features(text: str) -> np.ndarray:
    b = np.frombuffer(b" " + text.lower().encode("utf-8", "replace").translate(TABLE) + b" ", np.uint8).astype(np.uint32)
    two = (b[:-1] << 8) | b[1:]
    three = (two[:-1] << 8) | b[2:]
    n = 1 << BITS
    counts = np.bincount((two * np.uint32(2654435761)) >> np.uint32(32 - BITS), minlength=n) + np.bincount((three * np.uint32(2246822519)) >> np.uint32(32 - BITS), minlength=n)
    return np.sqrt(counts / counts.sum()).astype(np.float32)


def svm(x: np.ndarray, y: np.ndarray, c: float = 20.0, rounds: int = 150) -> np.ndarray:
    """Weights (the last is the bias) of a linear machine with squared hinge loss; y is 1 or -1; classes weigh alike."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w = v = np.zeros(x.shape[1], np.float32)
    step = 1.0 / (1.0 / c + 2.0 * 2.0)
    for k in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ v))
        grad = v / c - 2 * x.T @ (weight * y * slack)
        w, old = (v - step * grad).astype(np.float32), w
        v = w + k / (k + 3) * (w - old)
    return w


class Machines:
    """One-versus-one machines over some classes."""

    def __init__(self, x: np.ndarray, labels: list[str]):
        self.classes = sorted(set(labels))
        named = np.array(labels)
        self.pairs = list(combinations(range(len(self.classes)), 2))
        rows = []
        for i, j in self.pairs:
            own = (named == self.classes[i]) | (named == self.classes[j])
            rows.append(svm(x[own], np.where(named[own] == self.classes[i], 1.0, -1.0).astype(np.float32)))
        self.w = np.vstack(rows) if rows else np.zeros((0, x.shape[1] + 1), np.float32)

    def vote(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class numbers, and the winners' least certainty (0.5 to 1) against any other."""
        m = x @ self.w[:, :-1].T + self.w[:, -1]
        votes = np.zeros((len(x), len(self.classes)))
        for k, (i, j) in enumerate(self.pairs):
            squashed = np.tanh(m[:, k])
            votes[:, i] += (m[:, k] > 0) + squashed * 1e-3
            votes[:, j] += (m[:, k] <= 0) - squashed * 1e-3
        best = votes.argmax(1)
        sure = np.ones(len(x))
        for k, (i, j) in enumerate(self.pairs):
            p = 1 / (1 + np.exp(-4 * m[:, k]))
            sure = np.where(best == i, np.minimum(sure, p), np.where(best == j, np.minimum(sure, 1 - p), sure))
        return best, sure


class Model:
    def __init__(self, x: np.ndarray, langs: list[str]):
        family = [FAMILY_OF.get(k, k) for k in langs]
        self.families = Machines(x, family)
        self.within = {f: Machines(x[[g == f for g in family]], [k for k, g in zip(langs, family) if g == f]) for f in self.families.classes}

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        which, sure = self.families.vote(x)
        langs, score = [""] * len(x), np.zeros(len(x))
        for k, f in enumerate(self.families.classes):
            at = np.flatnonzero(which == k)
            if len(at):
                best, s = self.within[f].vote(x[at])
                for i, b in zip(at, best):
                    langs[i] = self.within[f].classes[b]
                score[at] = s * sure[at]
        return langs, score


def learn(docs: DataFrame, usable: Column, per_language: int = 800, seed: int = 5) -> Model | None:
    """docs has doc_id, text and lang.  Every lang value is learned; the more there are, the fewer rows each has."""
    spark = docs.sparkSession
    known = docs.filter(usable & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (F.length("text") > 0))
    counts = known.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("count")).orderBy(F.desc("count"), "lang").collect()  # a row per language
    if not counts:
        return None
    per_language = max(1, min(per_language, ROWS_MAX // len(counts)))
    share = F.create_map(*[y for r in counts for y in (F.lit(r["lang"]), F.lit(min(1.0, 1.2 * per_language / r["count"])))])
    h = unit_hash(F.col("doc_id"), F.lit(seed))
    picked = sorted(known.filter(h < share[F.col("lang")]).select(h.alias("h"), "doc_id", "lang").distinct().collect())
    room = {r["lang"]: per_language for r in counts}
    ids: dict[int, str] = {}
    for r in picked:
        if room[r["lang"]] and r["doc_id"] not in ids:
            room[r["lang"]] -= 1
            ids[r["doc_id"]] = r["lang"]
    if not ids:
        return None
    arrow_batches(spark)
    chosen = spark.createDataFrame(sorted(ids), "long").toDF("chosen")  # at most ROWS_MAX rows, or one a language

    def run(batches):
        for b in batches:
            got = [features(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.tobytes() for x in got], pa.binary())], ["doc_id", "x"])

    found = docs.filter(usable & F.col("text").isNotNull()).join(F.broadcast(chosen), F.col("doc_id") == F.col("chosen"))
    found = found.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("text").alias("text"))
    rows = sorted(found.mapInArrow(run, "doc_id long, x binary").collect())
    return Model(np.vstack([np.frombuffer(r["x"], np.float32) for r in rows]), [ids[r["doc_id"]] for r in rows])


def identify(docs: DataFrame, model: Model | None, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """A row per document: doc_id, lang_pred, score.  Map-only; the model's size depends on the number of languages only."""
    arrow_batches(docs.sparkSession)
    m = model  # travels with the function

    def run(batches):
        for b in batches:
            texts = b.column(1).to_pylist()
            at = [i for i, t in enumerate(texts) if m is not None and t and LETTER.search(t)]
            langs, scores = ["und"] * len(texts), np.zeros(len(texts))
            if at:
                found, s = m.predict(np.vstack([features(texts[i]) for i in at]))
                for i, k in zip(at, found):
                    langs[i] = k
                scores[at] = s
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def op2_language_id(spark, sf_dir):
    """Learns from documents whose crc32(doc_id) mod 5 is not 0."""
    d = documents(spark, sf_dir).select("doc_id", "text", "lang")
    out = F.coalesce(crc_mod(F.col("doc_id"), 5) == 0, F.lit(False))
    return identify(d, learn(d, ~out)).select("doc_id", out.alias("held_out"), "lang_pred", "score")
