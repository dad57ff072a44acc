"""Quality classifier by Bradley-Terry pairwise ranking.

Preference pairs set a document of label 1 over one of label 0; the chance that a beats b is the logistic function of
w (x_a - x_b), and w is fitted by the logistic loss on feature differences.  Features of the whole text: shares and
bigram shares of character classes, word and line statistics.  The raw score w x is then moved and scaled so that a
quantile of the training scores, the one that splits the classes best, comes out as the threshold.

Learning takes at most `per_class` documents of each label, those with the smallest hashes, and `n_pairs` pairs of
them; only feature vectors reach the driver, so its memory is bounded.  Scoring is map-only.

Rows that share an id are one document for learning (the largest text counts), and of an id's unequal labels the larger
counts, so what reaches the driver stays bounded however often an id repeats.  A null id is never held out.

Edge cases: null text counts as empty and is scored like any text; labels other than 0 and 1, and null labels or ids,
are left out; if a class has no labelled document every score is 0.5; repeated rows get equal scores; other columns
are never looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from .common import arrow_batches, crc_mod, documents, unit_hash

#: Character classes of bytes: anything not named here is class 0 (above 127: letters of other alphabets, class 1).
CLASSES = ["", "", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r", ".", ",;:", "!?", "|", "#$%&*@^~", "'\"()-", "<>{}[]/\\=+_"]
N = len(CLASSES)
CLASS_OF = np.array([1 if b > 127 else next((k for k, c in enumerate(CLASSES) if chr(b) in c), 0) for b in range(256)], np.uint8)
THRESHOLD = 0.7


def features(text: str) -> np.ndarray:
    raw = text.encode("utf-8", "replace")
    c = CLASS_OF[np.frombuffer(raw, np.uint8)].astype(np.int64)
    one = np.bincount(c, minlength=N) / max(1, len(c))
    two = np.bincount(c[:-1] * N + c[1:], minlength=N * N)[: N * N] / max(1, len(c) - 1)
    words = raw.split()
    n = len(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    seen = len(set(words))
    lens = np.fromiter(map(len, words), np.int64, n) if n else np.zeros(1)
    more = [np.log1p(len(raw)), np.log1p(n), seen / max(1, n), np.log1p(seen) / np.log(2 + n), lens.mean(), lens.std(), lens.max() ** 0.5, len(set(lines)) / max(1, len(lines)), np.log1p(len(lines)), n / max(1, len(lines)) / 100, sum(w[-1:].isalnum() or w[-1] > 127 for w in words) / max(1, n), sum(w[:1].isupper() for w in words) / max(1, n)]
    return np.concatenate([np.sqrt(one), np.sqrt(two), more]).astype(np.float32)


class Ranker:
    """w, b and scale of a fitted model; features are standardised and held within 6 standard deviations."""

    def __init__(self, x: np.ndarray, y: np.ndarray, n_pairs: int = 20000, l2: float = 1e-3, rounds: int = 300, seed: int = 3):
        self.mean, self.std = x.mean(0), x.std(0) + 1e-3
        z = self.scaled(x)
        good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
        self.w, self.at, self.scale = np.zeros(x.shape[1], np.float32), None, 1.0
        if not len(good) or not len(bad):
            return
        rng = np.random.default_rng(seed)
        a, b = rng.choice(good, n_pairs), rng.choice(bad, n_pairs)
        m = v = np.zeros_like(self.w)
        for k in range(1, rounds + 1):
            r = z @ self.w
            p = 1 / (1 + np.exp(np.clip(r[a] - r[b], -30, 30)))  # what the loss still asks of each pair
            pull = np.bincount(a, p, len(z)) - np.bincount(b, p, len(z))
            g = -(z.T @ pull) / n_pairs + l2 * self.w
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            self.w = (self.w - 0.03 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)).astype(np.float32)
        raw = z @ self.w
        # The quantile of all training scores that splits the classes best, classes weighing alike.
        cuts = np.quantile(raw, np.linspace(0, 1, 1001))
        low, high = np.sort(raw[bad]), np.sort(raw[good])
        fit = np.searchsorted(low, cuts) / len(low) + 1 - np.searchsorted(high, cuts) / len(high)
        best = np.flatnonzero(fit >= fit.max() - 1e-9)
        self.at = float(cuts[best].mean())
        self.scale = float(max(1e-3, np.median(np.abs(raw - self.at))) / 2)

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.std, -6, 6).astype(np.float32)

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.at is None:
            return np.full(len(x), 0.5)
        t = (self.scaled(x) @ self.w - self.at) / self.scale + np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(t, -30, 30)))


def learn(docs: DataFrame, labels: DataFrame, usable: Column, per_class: int = 3000, seed: int = 11) -> Ranker:
    """docs: doc_id, text; labels: doc_id, quality."""
    spark = docs.sparkSession
    known = labels.filter(usable & F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.max("quality").alias("quality")).withColumn("h", unit_hash(F.col("doc_id"), F.lit(seed)))
    ids = {r["doc_id"]: r["quality"] for k in (0, 1) for r in known.filter(F.col("quality") == k).orderBy("h", "doc_id").limit(per_class).collect()}
    arrow_batches(spark)
    chosen = spark.createDataFrame(sorted(ids), "long").toDF("chosen")  # at most 2 x per_class rows

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([features(t or "").tobytes() for t in b.column(1).to_pylist()], pa.binary())], ["doc_id", "x"])

    found = docs.join(F.broadcast(chosen), F.col("doc_id") == F.col("chosen")).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("text").alias("text"))
    rows = sorted(found.mapInArrow(run, "doc_id long, x binary").collect()) if ids else []
    x = np.vstack([np.frombuffer(r["x"], np.float32) for r in rows]) if rows else features("")[None]
    return Ranker(x, np.array([ids[r["doc_id"]] for r in rows] or [1]))


def scored(docs: DataFrame, model: Ranker, text_col: str = "text") -> DataFrame:
    """The rows of docs and `score`, map-only.  An input column of that name is replaced."""
    arrow_batches(docs.sparkSession)
    keep = [c for c in docs.columns if c != "score"]
    at = keep.index(text_col)

    def run(batches):
        for b in batches:
            x = [features(t or "") for t in b.column(at).to_pylist()]
            s = model.score(np.vstack(x)) if x else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64())], [*b.schema.names, "score"])

    rows = docs.select(*[docs[c] for c in keep])
    return rows.mapInArrow(run, StructType([*rows.schema.fields]).add("score", DoubleType()))


def op9_quality(spark, sf_dir):
    """Learns from labels of rows whose crc32(doc_id) mod 4 is not 2."""
    d = documents(spark, sf_dir).select("doc_id", "text")
    out = F.coalesce(crc_mod(F.col("doc_id"), 4) == 2, F.lit(False))
    model = learn(d, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~out)

    return scored(d, model).select("doc_id", out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
