"""Sensor layouts and channel settings: resolved on the driver for a detector's few channels, then a small table to join."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_GAIN = 9.2e6
#: Number, name, place in mm, board and channel of the seven sensors used where no layout is given.
FALLBACK = [
    (1, "LV2389", -26.8, 17.7, 0, 15),
    (2, "LV2387", -1.9, 32.0, 0, 14),
    (3, "LV2380", -24.9, -14.4, 0, 13),
    (4, "LV2332", 0.0, 0.0, 0, 12),
    (5, "LV2391", 24.9, 14.4, 0, 11),
    (6, "LV2364", 1.9, -32.0, 0, 10),
    (7, "LV2319", 26.8, -17.7, 0, 9),
]
POLARITIES = ("positive", "negative")
LAYOUT = "pmt_no int, pmt_id string, x double, y double, board long, channel long, gain double, polarity string"


def fallback_layout(gain: float = DEFAULT_GAIN) -> list[dict]:
    names = ("pmt_no", "pmt_id", "x", "y", "board", "channel")
    return [dict(zip(names, row)) | {"gain": gain, "polarity": "negative"} for row in FALLBACK]


def layout_from_config(config: Mapping, gain: float = DEFAULT_GAIN) -> list[dict] | None:
    """Sensors of config["detector_geometry"]["pmt_mapping"], by number; None if there are none."""
    geometry = config.get("detector_geometry") or {}
    first = lambda d, names, default: next((d[n] for n in names if n in d), default)
    common = geometry.get("default_gain", gain)
    out = []
    for i, pmt in enumerate(geometry.get("pmt_mapping") or [], 1):
        number = pmt.get("pmt_no")
        out.append({
            "pmt_no": i if number is None else int(number), "pmt_id": first(pmt, ("pmt_id", "pmt"), ""),
            "x": float(pmt.get("x_mm", 0.0)), "y": float(pmt.get("y_mm", 0.0)),
            "board": int(first(pmt, ("board", "board_id"), 0)), "channel": int(first(pmt, ("channel", "channel_id"), 0)),
            "gain": float(pmt.get("gain", common)), "polarity": pmt.get("polarity", "negative"),
        })
    return sorted(out, key=lambda e: e["pmt_no"]) or None


def layout_from_run_info(text: str, signal: str | None = "anode", gain: float = DEFAULT_GAIN) -> list[dict] | None:
    """Sensors of the first readout of that signal in a run's JSON; what a sensor lacks comes from the fallback table."""
    try:
        info = json.loads(text)
    except ValueError:
        return None
    known = fallback_layout(gain)
    by_name, by_number = {e["pmt_id"]: e for e in known}, {e["pmt_no"]: e for e in known}
    for readout in info.get("mapping") or []:
        if signal is not None and readout.get("signal") != signal:
            continue
        out = []
        for i, ch in enumerate(readout.get("channels") or [], 1):
            name = ch.get("pmt") or ch.get("pmt_id") or ""
            number = ch.get("pmt_no")
            number = int(number if number is not None else by_name.get(name, {}).get("pmt_no", i))
            like = by_number.get(number, by_name.get(name, {}))
            place = ch.get("pos")
            if place is None or len(place) < 2:
                place = like.get("x", 0.0), like.get("y", 0.0)
            gains = [d[k] for d in (ch, readout) for k in ("gain", "pmt_gain") if d.get(k) is not None]
            out.append({
                "pmt_no": number, "pmt_id": name or like.get("pmt_id", ""), "x": float(place[0]), "y": float(place[1]),
                "board": int(readout["board_id"]), "channel": int(ch["ch"]), "gain": float(gains[0] if gains else gain),
                "polarity": readout.get("polarity") or like.get("polarity", ""),
            })
        if out:
            return sorted(out, key=lambda e: e["pmt_no"])
    return None


def layout(config: Mapping | None = None, run_info: str | None = None, gain: float = DEFAULT_GAIN) -> list[dict]:
    """The layout of the configuration, else of the run's JSON, else the fallback."""
    return (config and layout_from_config(config, gain)) or (run_info and layout_from_run_info(run_info, gain=gain)) or fallback_layout(gain)


def layout_table(spark: SparkSession, entries: list[dict]) -> DataFrame:
    """One row per (board, channel); of several sensors on one channel the last counts.  Marked for broadcast: a detector's sensors."""
    one = {(e["board"], e["channel"]): e for e in entries}
    names = [f.split()[0] for f in LAYOUT.split(", ")]
    rows = [tuple(float(e[n]) if n in ("x", "y", "gain") else e[n] for n in names) for e in one.values()]
    return F.broadcast(spark.createDataFrame(rows, LAYOUT))


def channel_ref(key) -> tuple[int, int]:
    """(board, channel) of a pair or of "board:channel"."""
    try:
        board, channel = key.split(":") if isinstance(key, str) else key
        return int(board), int(channel)
    except (TypeError, ValueError):
        raise ValueError(f"{key!r} is no (board, channel) and no 'board:channel'") from None


def layered(block: Mapping, channel: tuple[int, int], group_key: str = "config") -> dict:
    """Settings of one channel: defaults, then the groups that list it in order, then its own."""
    out = dict(block.get("defaults") or {})
    groups = block.get("groups") or []
    if isinstance(groups, Mapping):
        groups = list(groups.values())
    for group in groups:
        if any(channel_ref(c) == channel for c in group.get("channels") or []):
            values = group.get(group_key)
            out |= (group.get("config") if values is None else values) or {}
    own = block["channels"] if isinstance(block.get("channels"), Mapping) else block
    for key, values in own.items():
        if key not in ("defaults", "groups", "channels") and channel_ref(key) == channel:
            if not isinstance(values, Mapping):
                raise ValueError(f"settings of channel {key!r} must be a mapping")
            out |= values
            break
    return out


def effective(channels: Iterable[tuple[int, int]], base: Mapping | None = None, config: Mapping | None = None, run_id: str = "") -> dict[tuple[int, int], dict]:
    """Settings of channels: base, then the layers of config, or of its block for the run if it has one."""
    block = config or {}
    if isinstance(block.get(run_id), Mapping):
        block = block[run_id]
    return {c: dict(base or {}) | layered(block, c) for c in sorted(set(channels))}


def metadata(channels: Iterable[tuple[int, int]], layers: list[Mapping]) -> dict[tuple[int, int], dict]:
    """Metadata of channels, later layers over earlier ones; an unknown polarity is "unknown", a gain that is not positive is None."""
    out = {}
    for c in sorted(set(channels)):
        own: dict = {}
        for layer in layers:
            own |= layered(layer, c, "metadata")
        number = lambda v: None if v is None else float(v)
        gain = number(own.get("gain_adc_per_pe"))
        out[c] = {
            "polarity": own.get("polarity") if own.get("polarity") in POLARITIES else "unknown", "geometry": own.get("geometry", "unknown"),
            "fixed_baseline": number(own.get("fixed_baseline")), "gain_adc_per_pe": gain if gain and gain > 0 else None, "role": own.get("role", "detector"),
        }
    return out


def settings_table(spark: SparkSession, settings: dict[tuple[int, int], dict], schema: str) -> DataFrame:
    """One row per channel with the settings named in schema ("name type, ..."), marked for broadcast."""
    names = [f.split()[0] for f in schema.split(",")]
    rows = [(b, c, *(v.get(n) for n in names)) for (b, c), v in settings.items()]
    return F.broadcast(spark.createDataFrame(rows, f"board long, channel long, {schema}"))
