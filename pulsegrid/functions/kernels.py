"""Array rules that built-in functions can't express: quantile times, crossings, peak search, filters.  NumPy only, one record at a time or a batch of equal length."""

from __future__ import annotations

import numpy as np

#: Shares of the area whose times are taken.
SHARES = (0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95)


def share_times(wave: np.ndarray, t0: int, dt_ns: int, shares=SHARES) -> np.ndarray:
    """Times (ps, truncated) at which the running area first reaches the shares of the whole; t0 for an empty wave or no positive area."""
    w = np.asarray(wave, np.float64)
    acc = np.cumsum(w)
    if not len(w) or acc[-1] <= 0:
        return np.full(len(shares), t0, np.int64)
    out = np.empty(len(shares))
    # Samples may be negative, so the running area is not sorted; its running maximum is, and reaches a level first where it does.
    top = np.maximum.accumulate(acc)
    for k, share in enumerate(shares):
        target = share * acc[-1]
        i = int(np.searchsorted(top, target, "left"))
        if i >= len(w):
            out[k] = len(w) - 1
        elif i == 0 or acc[i] == target:
            out[k] = i
        else:
            out[k] = i - 1 + (target - acc[i - 1]) / (acc[i] - acc[i - 1])
    return (t0 + out * (dt_ns * 1000)).astype(np.int64)


def pulse_features(wave: np.ndarray, t0: int, t1: int, dt_ns: int) -> tuple:
    """(time_peak, center_time, rise, fall, width_25_75, rise_10_50, range_90p, area, height, width) of a summed wave; times in ps, spans in ns."""
    width = (t1 - t0) / 1000.0
    w = np.asarray(wave, np.float64)
    if not len(w):
        return (t0, t0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)
    area, top = float(np.cumsum(w)[-1]), int(np.argmax(w))
    peak = t0 + top * dt_ns * 1000
    if area <= 0:
        return (peak, t0, (peak - t0) / 1000.0, 0.0, 0.0, 0.0, 0.0, area, float(w[top]), width)
    t05, t10, t25, t50, t75, t90, t95 = map(int, share_times(w, t0, dt_ns))
    return (peak, t50, (peak - t10) / 1000.0, (t90 - t50) / 1000.0, (t75 - t25) / 1000.0, (t50 - t10) / 1000.0, (t95 - t05) / 1000.0, area, float(w[top]), width)


def crossing(wave: np.ndarray, level: float, rising: bool, interpolate: bool) -> float | None:
    """First place at which the wave is at or beyond the level, between samples if asked."""
    at = np.flatnonzero(wave >= level if rising else wave <= level)
    if not len(at):
        return None
    i = int(at[0])
    if not interpolate or i == 0 or abs(wave[i] - wave[i - 1]) < 1e-10:
        return float(i)
    return i - 1 + float((level - wave[i - 1]) / (wave[i] - wave[i - 1]))


def rise_and_fall(wave: np.ndarray, position: int, low: float = 0.1, high: float = 0.9, interpolate: bool = True) -> tuple | None:
    """(rise, fall, total width in samples, height) of a positive peak over the mean of the first 50 samples; None without a peak there."""
    if position >= len(wave):
        return None
    w = np.asarray(wave, np.float64)
    w = w - w[:50].mean()
    top = float(w[position])
    if top <= 0:
        return None
    up = [crossing(w[:position], top * q, True, interpolate) for q in (low, high)]
    down = [crossing(w[position:], top * q, False, interpolate) for q in (high, low)]
    rise = up[1] - up[0] if None not in up else 0.0
    fall = down[1] - down[0] if None not in down else 0.0
    total = position + down[1] - up[0] if up[0] is not None and down[1] is not None else 0.0
    return rise, fall, total, top


def summits(x: np.ndarray) -> np.ndarray:
    """Middles of the plateaus (of one sample or more) that are higher than both neighbours."""
    if len(x) < 3:
        return np.zeros(0, np.int64)
    starts = np.r_[0, np.flatnonzero(np.diff(x) != 0) + 1]
    ends = np.r_[starts[1:] - 1, len(x) - 1]
    v = x[starts]
    inner = np.zeros(len(v), bool)
    inner[1:-1] = (v[1:-1] > v[:-2]) & (v[1:-1] > v[2:])
    return (starts[inner] + ends[inner]) // 2


def apart(at: np.ndarray, heights: np.ndarray, distance: float) -> np.ndarray:
    """Which peaks stay if higher ones (of equal ones the later) remove all nearer than the distance."""
    keep, least = np.ones(len(at), bool), int(np.ceil(distance))
    for i in np.argsort(heights, kind="stable")[::-1]:
        if keep[i]:
            near = np.abs(at - at[i]) < least
            near[i] = False
            keep[near] = False
    return keep


def prominence(x: np.ndarray, p: int) -> tuple[float, int, int]:
    """(prominence, left base, right base): down to the higher of both sides' minima, each side ending before a higher sample."""
    higher = np.flatnonzero(x > x[p])
    left = higher[higher < p]
    right = higher[higher > p]
    lo, hi = int(left[-1]) + 1 if len(left) else 0, int(right[0]) if len(right) else len(x)
    a = p - int(np.argmin(x[lo : p + 1][::-1]))
    b = p + int(np.argmin(x[p:hi]))
    return float(x[p] - max(x[a], x[b])), a, b


def half_width(x: np.ndarray, p: int, prom: float, a: int, b: int, share: float = 0.5) -> tuple[float, float]:
    """Places left and right at which the peak crosses its height less a share of its prominence."""
    level = x[p] - prom * share
    low = np.flatnonzero(x[a : p + 1] <= level)
    i = a + int(low[-1]) if len(low) else a
    left = i + ((level - x[i]) / (x[i + 1] - x[i]) if x[i] < level else 0.0)
    low = np.flatnonzero(x[p : b + 1] <= level)
    j = p + int(low[0]) if len(low) else b
    right = j - ((level - x[j]) / (x[j - 1] - x[j]) if x[j] < level else 0.0)
    return float(left), float(right)


def find_peaks(x: np.ndarray, height: float | None = 30.0, distance: float | None = 2, least_prominence: float | None = 0.7, width: float | None = 4, threshold: float | None = None) -> list[tuple[int, float, float]]:
    """(position, left, right) of the peaks that are high, steep, apart, prominent and wide enough; None asks for nothing."""
    x = np.asarray(x, np.float64)
    at = summits(x)
    if height is not None:
        at = at[x[at] >= height]
    if threshold is not None:
        at = at[np.minimum(x[at] - x[at - 1], x[at] - x[at + 1]) >= threshold]
    if distance is not None and len(at):
        at = at[apart(at, x[at], distance)]
    out = []
    for p in at.tolist():
        prom, a, b = prominence(x, p)
        if least_prominence is not None and prom < least_prominence:
            continue
        left, right = half_width(x, p, prom, a, b)
        if width is None or right - left >= width:
            out.append((p, left, right))
    return out


def peak_height(wave: np.ndarray, left: float, right: float, method: str = "minmax", extend: int = 4) -> float:
    """Height of a pulse of the raw wave within its edges: swing over the widened window, or the sum of its falls."""
    i, j = max(0, int(np.round(left))), min(len(wave) - 1, int(np.round(right)))
    if method == "diff":
        return float(wave[i] - wave[j]) if j > i else 0.0
    if method != "minmax":
        raise ValueError(f"no height method {method}")
    part = wave[max(0, i - extend) : min(len(wave), j + extend)]
    return float(part.max() - part.min())


def find_hits(wave: np.ndarray, baseline: float, threshold: float) -> np.ndarray:
    """Starts of the runs of samples more than the threshold below the baseline."""
    over = baseline - np.asarray(wave, np.float64) > threshold
    return np.flatnonzero(over & ~np.r_[False, over[:-1]])


def smoothing_window(n: int, window: int, order: int) -> int | None:
    """The window, or the largest odd one that fits n samples; None if no polynomial of that order is fitted by it."""
    w = min(window, n if n % 2 else n - 1)
    w -= 1 - w % 2
    return w if w > order else None


def smooth(waves: np.ndarray, window: int = 11, order: int = 2) -> np.ndarray:
    """Least-squares polynomial smoothing along the last axis; the ends take the values of the first and last window's fit."""
    x = np.asarray(waves, np.float64)
    w = smoothing_window(x.shape[-1], window, order)
    if w is None:
        return x.astype(np.float32)
    half = w // 2
    basis = np.vander(np.arange(-half, half + 1) / max(1, half), order + 1)
    fit = basis @ np.linalg.pinv(basis)
    out = np.empty_like(x)
    out[..., half : x.shape[-1] - half] = np.lib.stride_tricks.sliding_window_view(x, w, axis=-1) @ fit[half]
    out[..., :half] = x[..., :w] @ fit[:half].T
    out[..., x.shape[-1] - half :] = x[..., -w:] @ fit[half + 1 :].T
    return out.astype(np.float32)


def band_pass(order: int, low: float, high: float, rate: float) -> np.ndarray:
    """Second-order sections (b0 b1 b2 1 a1 a2) of a Butterworth band pass by the bilinear transform."""
    if not 0 < low < high < rate / 2:
        raise ValueError("a band must lie between 0 and half the sampling rate")
    w1, w2 = (4 * np.tan(np.pi * f / rate) for f in (low, high))
    prototype = -np.exp(1j * np.pi * np.arange(1 - order, order, 2) / (2 * order)) * (w2 - w1) / 2
    root = np.sqrt(prototype**2 - w1 * w2 + 0j)
    poles = np.concatenate([prototype + root, prototype - root])
    gain = (w2 - w1) ** order * np.real(4.0**order / np.prod(4 - poles))
    z = (4 + poles) / (4 - poles)
    real = np.sort(z[np.abs(z.imag) < 1e-12].real)
    pairs = [(-2 * p.real, abs(p) ** 2) for p in z if p.imag >= 1e-12] + [(-(a + b), a * b) for a, b in zip(real[::2], real[1::2])]
    # Sections next to the unit circle come last.
    out = np.array([[1.0, 0.0, -1.0, 1.0, a1, a2] for a1, a2 in sorted(pairs, key=lambda p: p[1])])
    out[0, :3] *= gain
    return out


def run_sections(sections: np.ndarray, x: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Filters the rows of x; start: state of each section (2 values) times each row's first sample."""
    y = x
    for (b0, b1, b2, _, a1, a2), (s0, s1) in zip(sections, start):
        z0, z1 = s0 * x[:, 0], s1 * x[:, 0]
        out = np.empty_like(y)
        for i in range(y.shape[1]):
            v = y[:, i]
            o = b0 * v + z0
            z0 = b1 * v - a1 * o + z1
            z1 = b2 * v - a2 * o
            out[:, i] = o
        y = out
    return y


def steady_state(sections: np.ndarray) -> np.ndarray:
    """States of the sections in which a constant input of 1 gives a constant output."""
    out, scale = [], 1.0
    for b0, b1, b2, _, a1, a2 in sections:
        gain = (b0 + b1 + b2) / (1 + a1 + a2)
        z1 = b2 - a2 * gain
        out.append((scale * (b1 - a1 * gain + z1), scale * z1))
        scale *= gain
    return np.array(out)


def padding(sections: np.ndarray) -> int:
    return 3 * (2 * len(sections) + 1 - min(int((sections[:, 2] == 0).sum()), int((sections[:, 5] == 0).sum())))


def zero_phase(sections: np.ndarray, waves: np.ndarray) -> np.ndarray:
    """Filters rows forwards and backwards over mirrored ends; rows no longer than the padding stay as they are."""
    x, pad = np.asarray(waves, np.float64), padding(sections)
    if x.shape[-1] <= pad:
        return x.astype(np.float32)
    rows = np.atleast_2d(x)
    head, tail = 2 * rows[:, :1] - rows[:, pad:0:-1], 2 * rows[:, -1:] - rows[:, -2 : -pad - 2 : -1]
    ext, state = np.concatenate([head, rows, tail], axis=1), steady_state(sections)
    there = run_sections(sections, ext, state)
    back = run_sections(sections, there[:, ::-1], state)[:, ::-1]
    return back[:, pad:-pad].reshape(x.shape).astype(np.float32)
