"""Probabilistic pitch of a whole recording: several periods a frame, and the likeliest path through them.

A frame's normalised difference has troughs at periods of the signal. For a threshold the first trough
below it counts; thresholds follow a beta distribution, so a trough weighs what the distribution holds between
its value and the least value of the troughs before it. The path runs over voiced and unvoiced states of a
logarithmic grid of frequencies; a step may move a bounded way and seldom changes voicing.
"""

from __future__ import annotations

import numpy as np

from prosodia.functions.signal import HOP, frames

#: Steps to an octave, octaves a second that pitch may move, chance of a change of voicing.
STEPS, SPEED, SWITCH = 60, 18.0, 0.01
#: What the least trough keeps of the thresholds that even it doesn't pass.
REST = 0.01
#: Frames whose differences are held at once.
TOGETHER = 4096


def spread(x: np.ndarray) -> np.ndarray:
    """Share of thresholds at most x: a beta distribution with parameters 2 and 18 (mean 0.1)."""
    x = np.clip(x, 0.0, 1.0)
    return 1 - (1 - x) ** 18 * (1 + 18 * x)


def differences(f: np.ndarray, n: int, most: int) -> np.ndarray:
    """Cumulative-mean normalised differences of frames for lags 0 to ``most``, over windows of n samples."""
    f = f - f.mean(axis=1, keepdims=True)
    size = 1 << int(np.ceil(np.log2(f.shape[1] + n)))
    cross = np.fft.irfft(np.fft.rfft(f, size) * np.conj(np.fft.rfft(f[:, :n], size)), size)[:, : most + 1]
    energy = np.cumsum(np.pad(f**2, ((0, 0), (1, 0))), axis=1)
    diff = np.maximum(energy[:, n : n + 1] + energy[:, n : n + most + 1] - energy[:, : most + 1] - 2 * cross, 0.0)
    out = np.ones_like(diff)
    out[:, 1:] = diff[:, 1:] * np.arange(1, most + 1) / np.maximum(np.cumsum(diff[:, 1:], axis=1), 1e-12)
    return out


def candidates(norm: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Troughs from lag ``least`` on, as (frame, exact lag, weight)."""
    mid = norm[:, 1:-1]
    low = (mid <= norm[:, :-2]) & (mid < norm[:, 2:])
    low[:, : max(0, least - 1)] = False
    value = np.where(low, mid, np.inf)
    before = np.concatenate([np.full((len(norm), 1), np.inf), np.minimum.accumulate(value, axis=1)[:, :-1]], axis=1)
    at, k = np.nonzero(value < before)
    weight = spread(before[at, k]) - spread(value[at, k])
    lowest = np.full(len(norm), np.inf)
    np.minimum.at(lowest, at, value[at, k])
    weight += np.where(value[at, k] == lowest[at], REST * spread(value[at, k]), 0.0)
    a, b, c = norm[at, k], norm[at, k + 1], norm[at, k + 2]
    bend = a - 2 * b + c
    shift = np.where(bend > 1e-12, 0.5 * (a - c) / np.where(bend > 1e-12, bend, 1.0), 0.0)
    return at, k + 1 + np.clip(shift, -0.5, 0.5), weight


def path(voiced: np.ndarray, reach: int) -> np.ndarray:
    """Likeliest states of frames (rows of ``voiced``: weight by frequency); state b is voiced at b, bins + b unvoiced there."""
    n, bins = voiced.shape
    move = np.log(np.concatenate([np.arange(1, reach + 2), np.arange(reach, 0, -1)]) / (reach + 1) ** 2)
    stay, change = np.log(1 - SWITCH), np.log(SWITCH)
    tiny = 1e-12
    back = np.zeros((n, 2, bins), dtype=np.int32)
    score = np.full((2, bins), -np.log(2 * bins))
    columns = np.arange(bins)
    for i in range(n):
        if i:
            padded = np.pad(score, ((0, 0), (reach, reach)), constant_values=-np.inf)
            near = np.lib.stride_tricks.sliding_window_view(padded, 2 * reach + 1, axis=1) + move
            step = near.argmax(axis=2)
            best = np.take_along_axis(near, step[..., None], axis=2)[..., 0]
            source = columns + step - reach
            crossed = best[::-1] + change > best + stay
            score = np.where(crossed, best[::-1] + change, best + stay)
            back[i] = np.where(crossed, source[::-1], source) + bins * np.where(crossed, [[1], [0]], [[0], [1]])
        score = score + np.log(np.stack([voiced[i], np.full(bins, max(0.0, 1 - voiced[i].sum()) / bins)]) + tiny)
        score -= score.max()
    out = np.zeros(n, dtype=np.int64)
    if n:
        out[-1] = int(score.argmax())
        flat = back.reshape(n, 2 * bins)
        for i in range(n - 1, 0, -1):
            out[i - 1] = flat[i, out[i]]
    return out


def track(x: np.ndarray, rate: int, low: float = 65.0, high: float = 450.0, window: float = 0.040, hop: float = HOP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """f0 (0 where unvoiced), voicing and its probability of every frame of a recording, in one pass.

    Frames of near silence are unvoiced. An empty signal gives what its frames give.
    """
    x = np.asarray(x, dtype=np.float64)
    n = int(window * rate)
    most = min(int(np.ceil(rate / low)) + 1, n - 1)
    bins = int(np.ceil(np.log2(high / low) * STEPS)) + 1
    f = frames(x, rate, 2 * window, hop)
    weight = np.zeros((len(f), bins))
    total = np.zeros((len(f), bins))
    for s in range(0, len(f), TOGETHER):
        part = f[s : s + TOGETHER]
        at, lag, w = candidates(differences(part, n, most), max(2, int(rate / high)))
        w = np.where(((part - part.mean(axis=1, keepdims=True)) ** 2).mean(axis=1)[at] > 1e-8, w, 0.0)
        f0 = rate / lag
        fits = (f0 >= low) & (f0 <= high) & (w > 0)
        at, f0, w = at[fits] + s, f0[fits], w[fits]
        b = np.clip(np.rint(np.log2(f0 / low) * STEPS).astype(int), 0, bins - 1)
        np.add.at(weight, (at, b), w)
        np.add.at(total, (at, b), w * f0)
    states = path(weight, max(1, int(round(SPEED * STEPS * hop))))
    bin_, voiced = states % bins, states < bins
    rows = np.arange(len(f))
    own = weight[rows, bin_]
    grid = low * 2.0 ** (bin_ / STEPS)
    f0 = np.where(own > 0, total[rows, bin_] / np.where(own > 0, own, 1.0), grid)
    return np.where(voiced, f0, 0.0), voiced, np.clip(weight.sum(axis=1), 0.0, 1.0)
