"""The pitch path on chirps, octave jumps, noise and silence, and its Viterbi step against all paths."""

from itertools import product

import numpy as np
import pytest

from prosodia.functions import pitch, signal

RATE = 16000


def wave(f0):
    phase = 2 * np.pi * np.cumsum(f0) / RATE
    return 0.4 * np.sin(phase) + 0.25 * np.sin(2 * phase) + 0.15 * np.sin(3 * phase)


def test_chirp_is_followed():
    true = np.linspace(90, 320, 2 * RATE)
    f0, voiced, chance = pitch.track(wave(true), RATE)
    at = np.arange(len(f0)) * signal.HOP
    want = np.interp(at, np.arange(2 * RATE) / RATE, true)
    inside = slice(6, -6)
    assert voiced[inside].all() and (chance[inside] > 0.6).all()
    assert np.abs(f0[inside] / want[inside] - 1).max() < 0.03


def test_octave_jump_of_the_signal_is_kept_and_of_the_evidence_is_not():
    steps = np.concatenate([np.full(RATE // 2, 110.0), np.full(RATE // 2, 220.0)])
    f0, voiced, _ = pitch.track(wave(steps), RATE)
    assert np.median(f0[8:42]) == pytest.approx(110, rel=0.02) and np.median(f0[58:92]) == pytest.approx(220, rel=0.02)
    # a frame whose strongest candidate is an octave off, between frames that agree
    weight = np.zeros((9, 121))
    weight[:, 30] = 0.7
    weight[4, 30], weight[4, 90] = 0.3, 0.6
    assert pitch.path(weight, 11).tolist() == [30] * 9


def test_noise_and_silence_are_unvoiced():
    noise = np.random.default_rng(3).normal(0, 0.2, 2 * RATE)
    f0, voiced, chance = pitch.track(noise, RATE)
    assert voiced.mean() < 0.15 and np.median(chance) < 0.4
    f0, voiced, chance = pitch.track(np.zeros(RATE), RATE)
    assert not voiced.any() and not f0.any() and not chance.any()
    quiet = np.concatenate([np.zeros(RATE // 2), wave(np.full(RATE // 2, 150.0)), np.zeros(RATE // 2)])
    f0, voiced, _ = pitch.track(quiet, RATE)
    assert not voiced[:45].any() and voiced[56:95].all() and not voiced[106:].any()
    assert len(pitch.track(np.zeros(0), RATE)[0]) == len(signal.frames(np.zeros(0), RATE, 0.08))


def test_path_is_the_likeliest():
    rng = np.random.default_rng(4)
    bins, reach = 4, 1
    move = np.log(np.array([1, 2, 1]) / 4)
    for _ in range(20):
        weight = rng.random((4, bins)) * rng.choice([0.02, 0.25], (4, bins))

        def score(states):
            total = 0.0
            for i, s in enumerate(states):
                b, unvoiced = s % bins, s >= bins
                total += np.log((max(0.0, 1 - weight[i].sum()) / bins if unvoiced else weight[i, b]) + 1e-12)
                if i:
                    p, was = states[i - 1] % bins, states[i - 1] >= bins
                    if abs(p - b) > reach:
                        return -np.inf
                    total += move[p - b + reach] + np.log(pitch.SWITCH if was != unvoiced else 1 - pitch.SWITCH)
            return total

        best = max(map(score, product(range(2 * bins), repeat=4)))
        assert score(pitch.path(weight, reach).tolist()) == pytest.approx(best)


def test_weights_are_those_of_a_fine_grid_of_thresholds():
    rng = np.random.default_rng(5)
    norm = rng.random((6, 40)) * 0.6
    at, lag, weight = pitch.candidates(norm, 3)
    grid = (np.arange(20000) + 0.5) / 20000
    density = np.diff(pitch.spread(np.linspace(0, 1, 20001)))
    for r in range(6):
        troughs = [k for k in range(3, 39) if norm[r, k] <= norm[r, k - 1] and norm[r, k] < norm[r, k + 1]]
        want = dict.fromkeys(troughs, 0.0)
        for s, p in zip(grid, density, strict=True):
            below = [k for k in troughs if norm[r, k] < s]
            if below:
                want[below[0]] += p
            elif troughs:
                want[min(troughs, key=lambda k: norm[r, k])] += p * pitch.REST
        got = dict.fromkeys(troughs, 0.0)
        for k, w in zip(np.rint(lag[at == r]).astype(int), weight[at == r], strict=True):
            got[min(troughs, key=lambda t: abs(t - k))] += w
        assert [got[k] for k in troughs] == pytest.approx([want[k] for k in troughs], abs=2e-3)


def test_detector_rests_on_the_path():
    t = np.arange(int(1.4 * RATE)) / RATE
    x = sum(np.exp(-(((t - c) / 0.055) ** 2) / 2) * np.sin(2 * np.pi * f * t) for c, f in ((0.3, 180), (0.7, 220), (1.1, 195)))
    tracks = signal.tracks(x, RATE, signal.PRODUCTION)
    for c, f in ((0.3, 180), (0.7, 220), (1.1, 195)):
        assert tracks["f0"][round(c / signal.HOP)] == pytest.approx(f, rel=0.03)
    assert len(tracks["f0"]) == len(tracks["likelihood"]) and (tracks["periodicity"] <= 1).all()
