"""Binary digitizer files: events of a 16-byte header and, per channel of its mask, a 12-byte header and samples.

Event header: the channel mask's low byte is byte 4, its high byte is byte 11.  Channel header, little endian: 22 bits
of size in 32-bit words (header included) with the truncation flag above them, 48 bits of time stamp, 16 bits of
baseline; (size - 3) * 4 bytes of 16-bit samples follow.  A last event that is cut off is left out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

SCHEMA = "file string, event long, channel int, truncated boolean, timestamp long, baseline int, wave array<int>"


def parse(raw: bytes) -> list[tuple]:
    rows, at, event = [], 0, 0
    while at + 16 <= len(raw):
        mask = raw[at + 4] | raw[at + 11] << 8
        at += 16
        own = []
        for channel in (c for c in range(16) if mask >> c & 1):
            if at + 12 > len(raw):
                return rows
            word = int.from_bytes(raw[at : at + 4], "little")
            end = at + (word & 0x3FFFFF) * 4
            if end < at + 12 or end > len(raw):
                return rows
            own.append((event, channel, bool(word >> 22 & 1), int.from_bytes(raw[at + 4 : at + 10], "little"), int.from_bytes(raw[at + 10 : at + 12], "little"), np.frombuffer(raw[at + 12 : end], "<i2").astype(np.int32)))
            at = end
        rows += own
        event += 1
    return rows


def read(spark: SparkSession, path: str) -> DataFrame:
    """A row per event and channel; a file is one task's work."""

    def run(frames):
        for f in frames:
            for name, raw in zip(f["path"], f["content"]):
                rows = parse(bytes(raw))
                yield pd.DataFrame([(name, *r) for r in rows], columns=["file", "event", "channel", "truncated", "timestamp", "baseline", "wave"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, SCHEMA)
