"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Long texts are split beforehand at safe boundaries: before a single space between two characters that are not white
space.  No match of the pattern can reach over such a place (a match that holds a space and other characters begins
with the space), so the pieces' ids, put together, are the whole text's.  Decoding joins the ids' raw bytes.

A run of white space is one match but for its last character, which goes with what follows (at the end of a text the
whole run is the match).  Runs of RUN characters or more are cut out by that rule and encoded as a single match, because the
library's pattern engine takes stack for every character of such a run and ends beyond about a million.

Edge cases: null and empty texts have no ids and decode to nothing; names of special tokens in a text are ordinary
text; an unbroken run of letters, digits or marks stays whole, however long (it is one match); a null id stays null.  The rank file
has a fixed number of lines, so the broadcast is bounded.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

from .common import arrow_batches, documents

#: Texts above so many characters are split.
LONG = 16384
SAFE = regex.compile(r"(?<=\S)\x20(?=\S)")
#: White-space runs of so many characters are cut out.  Entered at their first character only, so the search is linear.
RUN = 4096
RUNS = regex.compile(rf"(?<!\s)\s{{{RUN},}}")


def pieces(text: str, long: int = LONG) -> Iterator[str]:
    """Parts of about `long` characters that end at safe boundaries."""
    at = 0
    while len(text) - at > long:
        m = SAFE.search(text, at + long)
        if not m:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def matches(text: str) -> Iterator[tuple[bool, str]]:
    """Parts of a text in order: (False, text to be split by the pattern) or (True, a single match)."""
    at = 0
    for run in RUNS.finditer(text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        if run.start() > at:
            yield from ((False, p) for p in pieces(text[at : run.start()]))
        yield True, text[run.start() : end]
        at = end
    if at < len(text):
        yield from ((False, p) for p in pieces(text[at:]))


class Codec:
    """tiktoken's encoder for a rank file's bytes; built once in a Python worker."""

    made: dict[tuple[int, str], Codec] = {}

    def __init__(self, ranks: bytes, pattern: str):
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in (x.split() for x in ranks.splitlines() if x)}
        self.bpe = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=table, special_tokens={})

    @classmethod
    def of(cls, ranks: bytes, pattern: str) -> Codec:
        key = (hash(ranks), pattern)
        if key not in cls.made:
            cls.made[key] = cls(ranks, pattern)
        return cls.made[key]

    def encode(self, text: str | None) -> list[int]:
        return [i for single, p in matches(text or "") for i in (self.bpe._encode_single_piece(p) if single else self.bpe.encode_ordinary(p))]

    def decode(self, ids: list[int]) -> bytes:
        return self.bpe.decode_bytes(ids)


def rank_file(path: str | None = None) -> tuple[bytes, str]:
    import public_tokenizers

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return f.read(), public_tokenizers.PATTERN


def encode(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", path: str | None = None, keep_ids: bool = True, carry: list[str] = ()) -> DataFrame:
    """A row per document: id, n_tokens, ids_sha256, decoded_sha256, if keep_ids the ids themselves, and the columns in carry.  Map-only."""
    spark = docs.sparkSession
    arrow_batches(spark)
    sent = spark.sparkContext.broadcast(rank_file(path))

    def run(batches):
        codec = Codec.of(*sent.value)
        for b in batches:
            out: dict[str, list] = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": [], "ids": []}
            for x in b.column(1):
                ids = codec.encode(x.as_py())
                raw = np.asarray(ids, dtype="<u4")
                out["n_tokens"].append(len(ids))
                out["ids_sha256"].append(hashlib.sha256(raw.tobytes()).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(codec.decode(ids)).hexdigest())
                if keep_ids:
                    out["ids"].append(raw.astype(np.int32))
            arrays = [b.column(0), pa.array(out["n_tokens"], pa.int64()), pa.array(out["ids_sha256"], pa.string()), pa.array(out["decoded_sha256"], pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                arrays.append(pa.array(out["ids"], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays([*arrays, *b.columns[2:]], [*names, *carry])

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"), *[docs[c] for c in carry])
    schema = StructType().add("doc_id", "long").add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    if keep_ids:
        schema = schema.add("ids", ArrayType(IntegerType()))
    for c in carry:
        schema = schema.add(rows.schema[c])
    return rows.mapInArrow(run, schema)


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """A row per document: id and the ids' raw bytes."""
    sent = encoded.sparkSession.sparkContext.broadcast(rank_file(path))

    def run(batches):
        codec = Codec.of(*sent.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([codec.decode(x.as_py() or []) for x in b.column(1)], pa.binary())], ["doc_id", "raw"])

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, raw binary")


def op6_bpe(spark, sf_dir):
    return encode(documents(spark, sf_dir), keep_ids=False)
