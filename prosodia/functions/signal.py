"""Signal kernels in numpy: frames, spectra, peaks, voicing, formants, two detectors of syllable nuclei.

Pitch is an autocorrelation estimate (a difference function with cumulative normalisation), an
approximation of probabilistic trackers; nothing here needs a signal-processing library.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, replace

import numpy as np

from prosodia.operators.windows import gaussian

HOP, FRAME = 0.010, 0.030


# --- frames and spectra ----------------------------------------------------------------------


def frames(x: np.ndarray, rate: int, window: float = FRAME, hop: float = HOP, centred: bool = True) -> np.ndarray:
    n, h = int(round(window * rate)), int(round(hop * rate))
    x = np.asarray(x, dtype=np.float64)
    if centred:
        x = np.pad(x, n // 2)
    if len(x) < n:
        x = np.pad(x, (0, n - len(x)))
    return np.lib.stride_tricks.sliding_window_view(x, n)[::h]


def power_spectrum(x: np.ndarray, rate: int, n_fft: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """|STFT|^2 per frame, and the bins' frequencies."""
    f = frames(x, rate)
    n_fft = max(n_fft, f.shape[1])
    return np.abs(np.fft.rfft(f * np.hanning(f.shape[1] + 1)[:-1], n_fft)) ** 2, np.fft.rfftfreq(n_fft, 1 / rate)


def lowpass(x: np.ndarray, rate: int, cutoff: float = 1000.0) -> np.ndarray:
    """Zero-phase low pass with the squared response of a fourth-order Butterworth; very short signals pass."""
    if len(x) < 27:
        return np.asarray(x, dtype=np.float64)
    pad = min(len(x) - 1, int(0.02 * rate))
    y = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
    f = np.fft.rfftfreq(len(y), 1 / rate)
    return np.fft.irfft(np.fft.rfft(y) / (1 + (f / cutoff) ** 8), len(y))[pad : pad + len(x)]


def mel_filters(rate: int, n_fft: int, count: int = 40) -> np.ndarray:
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(0, mel(rate / 2), count + 2) / 2595) - 1)
    f = np.fft.rfftfreq(n_fft, 1 / rate)
    up = (f[None, :] - edges[:-2, None]) / np.diff(edges)[:-1, None]
    down = (edges[2:, None] - f[None, :]) / np.diff(edges)[1:, None]
    return np.maximum(0, np.minimum(up, down)) * (2 / (edges[2:] - edges[:-2]))[:, None]


def mfcc(power: np.ndarray, rate: int, count: int = 13) -> np.ndarray:
    """Cepstra per frame from power spectra."""
    mel = power @ mel_filters(rate, 2 * (power.shape[1] - 1)).T
    log = 10 * np.log10(np.maximum(mel, 1e-10))
    log = np.maximum(log, log.max(initial=-100.0) - 80)
    n = log.shape[1]
    basis = np.cos(np.pi / n * (np.arange(n) + 0.5)[:, None] * np.arange(count)) * np.sqrt(2 / n)
    basis[:, 0] /= np.sqrt(2)
    return log @ basis


def rms_db(x: np.ndarray, rate: int) -> np.ndarray:
    return 20 * np.log10(np.sqrt((frames(x, rate) ** 2).mean(axis=1)) + 1e-10)


def zero_crossings(x: np.ndarray, rate: int) -> np.ndarray:
    f = frames(x, rate)
    return (np.signbit(f[:, 1:]) != np.signbit(f[:, :-1])).mean(axis=1)


# --- peaks and voicing -----------------------------------------------------------------------


def find_peaks(x: np.ndarray, prominence: float | None = None, distance: int = 1, height: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Local maxima (the middle of a plateau) and their prominences.

    First lower peaks give way within ``distance``, from the highest down; then height and prominence are asked.
    """
    x = np.asarray(x, dtype=float)
    peaks, i = [], 1
    while i < len(x) - 1:
        if x[i - 1] < x[i]:
            j = i
            while j < len(x) - 1 and x[j + 1] == x[i]:
                j += 1
            if j < len(x) - 1 and x[j + 1] < x[i]:
                peaks.append((i + j) // 2)
            i = j + 1
        else:
            i += 1
    p = np.array([k for k in peaks if height is None or x[k] >= height], dtype=int)
    if distance > 1 and len(p):
        keep = np.ones(len(p), dtype=bool)
        for k in np.argsort(x[p], kind="stable")[::-1]:
            if keep[k]:
                near = np.abs(p - p[k]) < distance
                near[k] = False
                keep &= ~near
        p = p[keep]
    prom = np.zeros(len(p))
    for k, at in enumerate(p):
        left = x[: at + 1][::-1]
        right = x[at:]
        a = np.flatnonzero(left > x[at])
        b = np.flatnonzero(right > x[at])
        prom[k] = x[at] - max(left[: a[0] if len(a) else None].min(), right[: b[0] if len(b) else None].min())
    ok = prom >= prominence if prominence is not None else np.ones(len(p), dtype=bool)
    return p[ok], prom[ok]


def pitch(x: np.ndarray, rate: int, low: float = 65.0, high: float = 450.0, window: float = 0.040, hop: float = HOP) -> tuple[np.ndarray, np.ndarray]:
    """f0 (0 where unvoiced) and periodicity per frame."""
    n = int(window * rate)
    f = frames(x, rate, 2 * window, hop)
    f = f - f.mean(axis=1, keepdims=True)
    lags = np.arange(int(rate / high), min(int(rate / low) + 1, n))
    size = 1 << int(np.ceil(np.log2(f.shape[1] + n)))
    head = f[:, :n]
    cross = np.fft.irfft(np.fft.rfft(f, size) * np.conj(np.fft.rfft(head, size)), size)[:, : lags[-1] + 1]
    energy = np.cumsum(np.pad(f**2, ((0, 0), (1, 0))), axis=1)
    tail = energy[:, n : n + lags[-1] + 1] - energy[:, : lags[-1] + 1]
    diff = energy[:, n : n + 1] + tail - 2 * cross
    norm = diff[:, 1:] * np.arange(1, lags[-1] + 1) / np.maximum(np.cumsum(diff[:, 1:], axis=1), 1e-12)
    part = norm[:, lags - 1]
    best = part.argmin(axis=1)
    below = part < 0.15
    first = np.where(below.any(axis=1), below.argmax(axis=1), best)
    for r in np.flatnonzero(below.any(axis=1)):
        while first[r] + 1 < part.shape[1] and part[r, first[r] + 1] < part[r, first[r]]:
            first[r] += 1
    value = part[np.arange(len(part)), first]
    loud = (f**2).mean(axis=1) > 1e-8
    periodicity = np.where(loud, np.clip(1 - value, 0, 1), 0.0)
    return np.where(periodicity > 0.55, rate / lags[first], 0.0), periodicity


def stability(f0: np.ndarray) -> np.ndarray:
    """1 - |f0 - mean of five| / 40 from 0 to 1; the outer two frames are 0."""
    out = np.zeros(len(f0))
    for i in range(2, len(f0) - 2):
        v = f0[i - 2 : i + 3]
        v = v[np.isfinite(v) & (v > 0)]
        if len(v) and f0[i] > 0:
            out[i] = np.clip(1 - abs(f0[i] - v.mean()) / 40, 0, 1)
    return out


def slice_median(times: np.ndarray, f0: np.ndarray, start: float, end: float) -> float:
    """Median of known pitch in [start, end), 0 without any."""
    v = f0[(times >= start) & (times < end)]
    v = v[np.isfinite(v) & (v > 0)]
    return float(np.median(v)) if len(v) else 0.0


def formants(x: np.ndarray, rate: int) -> list[float]:
    """Resonances from linear prediction, lowest first: narrower than 400 Hz, above 90 Hz and away from the band's end."""
    order = 2 + rate // 1000
    if len(x) <= order + 2 or not np.any(x):
        return []
    y = np.append(x[0], x[1:] - 0.97 * x[:-1]) * np.hamming(len(x))
    r = np.correlate(y, y, "full")[len(y) - 1 : len(y) + order]
    a, e = np.array([1.0]), r[0] * (1 + 1e-9)
    for i in range(1, order + 1):
        k = -(a @ r[i:0:-1][: len(a)]) / e
        a = np.append(a, 0.0) + k * np.append(a, 0.0)[::-1]
        e *= 1 - k * k
        if e <= 0:
            return []
    z = np.roots(a)
    z = z[np.imag(z) > 0]
    f, bw = np.angle(z) * rate / (2 * np.pi), -np.log(np.maximum(np.abs(z), 1e-12)) * rate / np.pi
    return sorted(f[(f > 90) & (f < rate / 2 - 100) & (bw < 400)].tolist())


def central(f: list[float]) -> float:
    """Distance of two formants from (500, 1500), -1 without two."""
    return round(float(np.hypot(f[0] - 500, f[1] - 1500)), 1) if len(f) >= 2 else -1.0


def trim_bounds(x: np.ndarray, rate: int, below_db: float = 40.0) -> tuple[int, int]:
    """Samples between which a signal is louder than its peak less ``below_db``; never cuts more than half."""
    if not len(x):
        return 0, 0
    db = rms_db(x, rate)
    loud = np.flatnonzero(db > db.max() - below_db)
    hop = int(HOP * rate)
    a, b = int(loud[0]) * hop, min(len(x), (int(loud[-1]) + 1) * hop)
    return (a, b) if b - a >= len(x) / 2 else (0, len(x))


# --- first detector: energy peaks within a word ----------------------------------------------


def norm01(v: np.ndarray) -> np.ndarray:
    v = np.asarray(v, dtype=float)
    return np.zeros_like(v) if not len(v) or v.max() - v.min() <= 1e-9 else (v - v.min()) / (v.max() - v.min())


def contours(x: np.ndarray, rate: int) -> dict[str, np.ndarray]:
    """Low-band level, voicing and vowel likeness of a word's frames."""
    low = lowpass(x, rate)
    energy, full = rms_db(low, rate), rms_db(x, rate)
    ratio = 10 ** ((energy - full) / 20)
    voiced = (ratio >= 0.45) & (zero_crossings(x, rate) <= 0.18)
    power, f = power_spectrum(x, rate)
    n = min(len(energy), len(power))
    total = power.sum(axis=1) + 1e-12
    mid = power[:, (f >= 300) & (f < 3000)].sum(axis=1) / total
    c = mfcc(power, rate)
    vowel = 0.6 * norm01(mid) + 0.4 * norm01(c[:, 0])
    return {"energy": energy[:n], "voiced": voiced[:n], "vowel": vowel[:n], "mfcc": c[:n]}


def select_nuclei(c: dict[str, np.ndarray], expected: int, prominence: float = 2.0, distance: int = 6, floor: float = 20.0, gain: float = 0.0) -> tuple[int, list[int]]:
    """The number of clear peaks, and the ``expected`` best candidate frames in time order."""
    contour = c["energy"] + gain * c["vowel"]
    contour = np.where(c["voiced"], contour, contour.min() - 10)
    height = c["energy"].max() - floor
    padded = np.pad(contour, 1, constant_values=contour.min() - 1)
    clear, _ = find_peaks(padded, prominence, distance, height)
    peaks, prom = find_peaks(padded, 0.5, distance, height)
    peaks = peaks - 1
    if not len(peaks):
        return len(clear), [int(np.argmax(contour))]
    score = norm01(c["energy"][peaks]) + norm01(prom) + 0.8 * norm01(c["vowel"][peaks])
    best = sorted(range(len(peaks)), key=lambda k: (-score[k], -peaks[k]))[:expected]
    return len(clear), sorted(int(peaks[k]) for k in best)


def boundaries(energy: np.ndarray, nuclei: list[int], expected: int, hop: float = HOP, least: float = 0.020) -> list[tuple[float, float]]:
    """Syllables between the quietest frames of neighbouring nuclei; the longest are halved until there are enough."""
    end = len(energy) * hop
    cuts = [0.0] + [(a + int(np.argmin(energy[a : b + 1]))) * hop for a, b in zip(nuclei, nuclei[1:], strict=False)] + [end]
    while len(cuts) - 1 < expected:
        k = max(range(len(cuts) - 1), key=lambda i: (cuts[i + 1] - cuts[i], -i))
        cuts.insert(k + 1, (cuts[k] + cuts[k + 1]) / 2)
    for i in range(1, len(cuts)):
        cuts[i] = max(cuts[i], cuts[i - 1] + least)
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def vowel_core(c: dict[str, np.ndarray], a: int, b: int, f0: np.ndarray | None = None) -> tuple[int, int] | None:
    """The longest stretch of frames [a, b) whose vowel score stays high, at least 30 ms."""
    if b - a < 3:
        return None
    e, v, flat = norm01(c["energy"][a:b]), norm01(c["vowel"][a:b]), 1 - norm01(np.abs(np.gradient(c["energy"][a:b])))
    score = 0.35 * e + 0.35 * v + 0.30 * flat if f0 is None else 0.22 * e + 0.22 * v + 0.18 * flat + 0.38 * stability(f0[a:b])
    on = score >= max(0.30, 0.55 * score.max())
    edge = np.flatnonzero(np.diff(np.concatenate([[0], on.astype(int), [0]])))
    runs = list(zip(edge[::2], edge[1::2], strict=True))
    s, t = max(runs, key=lambda r: (r[1] - r[0], -r[0]))
    return (a + int(s), a + int(t)) if t - s >= 3 else None


def features(x: np.ndarray, rate: int) -> dict:
    """Acoustics of a stretch of signal; empty for a tiny one."""
    if len(x) < int(0.01 * rate):
        return {}
    power, _ = power_spectrum(x, rate)
    f = formants(x, rate)
    return {"mfcc": np.round(mfcc(power, rate).mean(axis=0), 4).tolist(), "energyMean": round(float(np.sqrt(np.mean(np.square(x)))), 6), "zcrMean": round(float(zero_crossings(x, rate).mean()), 6), "formants": [round(v, 1) for v in f[:4]], "central": central(f), "duration": round(len(x) / rate, 4)}


def analyse_word(x: np.ndarray, rate: int, syllables: list[str], nuclei: int) -> tuple[list[dict], int]:
    """Records of a word's syllables, and the number of clear peaks."""
    a, b = trim_bounds(x, rate)
    y = x[a:b]
    c = contours(y, rate)
    f0, _ = pitch(y, rate)
    n = min(len(c["energy"]), len(f0))
    found, picked = select_nuclei(c, max(1, nuclei))
    out = []
    for name, (s, t) in zip(syllables, boundaries(c["energy"], picked, len(syllables)), strict=False):
        seg = y[int(s * rate) : int(t * rate)]
        acoustics = features(seg, rate)
        if acoustics:
            core = vowel_core(c, int(s / HOP), min(n, int(t / HOP)), f0)
            acoustics["core"] = None
            if core:
                own = features(y[int(core[0] * HOP * rate) : int(core[1] * HOP * rate)], rate)
                if own:
                    acoustics["core"] = {k: own[k] for k in ("duration", "energyMean", "formants", "central")} | {"startInSyl": round(core[0] * HOP - s, 4), "endInSyl": round(core[1] * HOP - s, 4)}
        quiet = bool(acoustics) and acoustics["energyMean"] < 0.004
        out.append({"syllable": name, "startSec": round(s + a / rate, 3), "endSec": round(t + a / rate, 3), "acoustics": acoustics, "isProblematic": quiet, "remarks": ["тихо"] if quiet else []})
    return out, found


#: Weights of pitch, duration, energy, first formant and 1 - |first cepstrum|: by known pitch and cores.
STRESS_WEIGHTS = {(True, True): (0.30, 0.30, 0.18, 0.15, 0.07), (True, False): (0.30, 0.25, 0.20, 0.15, 0.10), (False, True): (0.0, 0.40, 0.25, 0.20, 0.15), (False, False): (0.0, 0.35, 0.30, 0.20, 0.15)}


def acoustic_stress(syllables: list[dict], f0: list[float] | None = None) -> tuple[int, list[float]]:
    """The syllable that stands out most, the first of equals, and all scores."""
    if len(syllables) < 2:
        return 0, [1.0] * len(syllables)
    whole = [s["acoustics"] or {} for s in syllables]
    cores = all(w.get("core") for w in whole)
    use = [w["core"] for w in whole] if cores else whole
    pitched = bool(f0) and any(v > 0 for v in f0)
    parts = [f0 if pitched else [0.0] * len(use), [u.get("duration", 0.0) for u in use], [u.get("energyMean", 0.0) for u in use], [(u.get("formants") or [0.0])[0] for u in use], [1 - abs((w.get("mfcc") or [0, 0])[1]) for w in whole]]
    score = sum(w * norm01(p) for w, p in zip(STRESS_WEIGHTS[pitched, cores], parts, strict=True))
    return int(np.argmax(score)), score.tolist()


# --- second detector: nuclei without a text --------------------------------------------------


@dataclass(frozen=True)
class Settings:
    """What a search may change; names are those of the settings files that tools exchange."""

    strong_prominence: float = 0.60
    weak_prominence: float = 0.20
    strong_min_confidence: float = 0.43
    weak_min_confidence: float = 0.60
    strong_min_periodicity: float = 0.0
    strong_min_strength: float = 0.0
    strong_min_vowel_likeness: float = 0.30
    min_distance_seconds: float = 0.055
    smoothing_seconds: float = 0.022
    speech_floor_db: float = 34.0
    name: str = "baseline"

    def with_(self, **changes) -> Settings:
        return replace(self, **changes)


def _preset(name: str, strong: float, weak: float, strong_conf: float, weak_conf: float, **more) -> Settings:
    return Settings(strong_prominence=strong, weak_prominence=weak, strong_min_confidence=strong_conf, weak_min_confidence=weak_conf, name=name, **more)


# The presets of the search, and what production runs use (recall-oriented, gated against noise).
PRESETS = (
    Settings(),
    _preset("recall_1", 0.50, 0.16, 0.40, 0.56),
    _preset("recall_2", 0.45, 0.12, 0.38, 0.52),
    _preset("recall_3", 0.40, 0.10, 0.36, 0.50),
    _preset("recall_4", 0.35, 0.08, 0.34, 0.48),
    _preset("weak_vowels_1", 0.50, 0.10, 0.40, 0.48),
    _preset("close_nuclei_1", 0.45, 0.12, 0.38, 0.52, min_distance_seconds=0.045),
    _preset("close_nuclei_2", 0.35, 0.08, 0.34, 0.48, min_distance_seconds=0.045),
)
PRODUCTION = _preset("recall_4_noise_gate", 0.35, 0.08, 0.34, 0.48, strong_min_periodicity=0.0, strong_min_strength=0.4, strong_min_vowel_likeness=0.45)

# Band edges in Hz and their weights, and what a weak candidate must show besides its confidence.
BANDS = ((60, 370), (370, 800), (800, 1400), (1400, 2250), (2250, 3450), (3450, 5130), (5130, 7500))
BAND_WEIGHTS = (0.20, 0.95, 1.00, 0.62, 0.18, -0.08, -0.12)
PEAK_DISTANCE, WEAK_VOWEL, WEAK_PERIODICITY = 0.035, 0.52, 0.32

# What each sum of evidence in a frame weighs ("one" is the constant).
EVIDENCE = {
    "voicing": {"voiced": 0.35},
    "texture": {"calm": 0.1925, "tonal": 0.1575},
    "sonorant": {"low": 1.4, "first": -1.4, "one": -0.91},
    "vowel": {"mid": 0.62, "high": -0.28, "periodic": 1.15, "calm": 0.38, "tonal": 0.30, "sonorant": -0.50, "one": -0.46},
    "envelope": {"sonority": 1.0, "periodic": 0.42, "vowel": 0.30, "rise": -0.12, "one": -0.36},
    "likelihood": {"height": 1.15, "vowel": 1.00, "periodic": 0.65, "one": -0.825},
}


def robust_z(v: np.ndarray, mask: np.ndarray) -> np.ndarray:
    own = v[mask] if mask.any() else v
    q1, m, q3 = np.percentile(own, [25, 50, 75])
    scale = (q3 - q1) / 1.349
    if scale < 1e-6:
        scale = max(own.std(), 1e-6)
    return np.clip((v - m) / scale, -5, 5)


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def tracks(x: np.ndarray, rate: int, s: Settings) -> dict[str, np.ndarray]:
    """Frame tracks of the second detector."""
    x = np.asarray(x, dtype=np.float64)
    peak = np.abs(x).max(initial=0.0)
    x = x / peak if peak > 1 else x
    power, f = power_spectrum(x, rate)
    level = rms_db(x, rate)
    speech = level >= np.percentile(level, 95) - s.speech_floor_db
    votes = np.pad(speech.astype(int), 1, mode="edge")
    speech = votes[:-2] + votes[1:-1] + votes[2:] >= 2
    bands = np.stack([10 * np.log10(power[:, (f >= a) & (f < b)].mean(axis=1) + 1e-10) if ((f >= a) & (f < b)).any() else np.full(len(power), -100.0) for a, b in BANDS])
    z = np.stack([robust_z(b, speech) for b in bands])
    w = np.array(BAND_WEIGHTS)
    sonority = w @ z / np.abs(w).sum()
    zcr = 1 - np.clip(zero_crossings(x, rate) / 0.24, 0, 1)
    flat = np.exp(-10 * np.exp(np.log(power + 1e-12).mean(axis=1)) / (power.mean(axis=1) + 1e-12))
    mag = np.sqrt(power)
    mag = mag / (mag.sum(axis=1, keepdims=True) + 1e-12)
    flux = robust_z(np.concatenate([[0.0], np.linalg.norm(np.diff(mag, axis=0), axis=1)]), speech)
    from prosodia.functions.pitch import track

    f0, voiced, chance = track(x, rate)
    n = min(len(level), len(power), len(f0))
    speech = speech[:n]
    # the terms that the sums of EVIDENCE weigh, in the order in which one needs another
    term = {"one": np.ones(n), "voiced": voiced[:n].astype(float), "low": z[0, :n], "first": z[1:3, :n].mean(axis=0), "mid": z[1:4, :n].mean(axis=0), "high": z[4:7, :n].mean(axis=0), "calm": zcr[:n], "tonal": flat[:n], "sonority": sonority[:n], "rise": np.maximum(flux[:n], 0)}
    total = lambda name: sum(w * term[k] for k, w in EVIDENCE[name].items())
    term["periodic"] = np.clip(np.maximum.reduce([chance[:n], total("voicing"), total("texture")]), 0.0, 1.0)
    term["sonorant"] = sigmoid(total("sonorant"))
    term["vowel"] = sigmoid(total("vowel"))
    envelope = gaussian(total("envelope"), max(0.5, s.smoothing_seconds / HOP))
    envelope = np.where(speech, envelope, (envelope[speech].min() if speech.any() else envelope.min()) - 2)
    term["height"] = robust_z(envelope, speech)
    likelihood = np.where(speech, sigmoid(total("likelihood")), 0.0)
    periodic, vowel, sonorant = term["periodic"], term["vowel"], term["sonorant"]
    return {"envelope": envelope, "likelihood": likelihood, "periodicity": periodic, "vowel": vowel, "sonorant": sonorant, "flux": sigmoid(1 - flux[:n]), "speech": speech, "bands": bands[:, :n], "f0": f0[:n], "mfcc": mfcc(power, rate)[:n]}


def suppress(found: list[dict], apart: int) -> list[dict]:
    kept: list[dict] = []
    for c in sorted(found, key=lambda c: -c["confidence"]):
        if all(abs(c["frame"] - k["frame"]) >= apart for k in kept):
            kept.append(c)
    return sorted(kept, key=lambda c: c["frame"])


def detect_nuclei(x: np.ndarray, rate: int, s: Settings = PRODUCTION) -> tuple[list[dict], dict[str, np.ndarray]]:
    """Nuclei of a signal with their evidence, six decimals, and the tracks."""
    t = tracks(x, rate, s)
    env, speech = t["envelope"], t["speech"]
    if not speech.any() or np.ptp(env[speech]) < 1e-9:
        return [], t
    apart = max(1, round(PEAK_DISTANCE / HOP))
    padded = np.pad(env, 1, constant_values=env.min() - 1e-6)
    strong, strong_prom = find_peaks(padded, s.strong_prominence, apart)
    weak, weak_prom = find_peaks(padded, s.weak_prominence, apart)
    prom = np.zeros(len(env))
    for p, v in ((strong - 1, strong_prom), (weak - 1, weak_prom)):
        prom[p] = np.maximum(prom[p], v)
    own = env[speech]
    spread = max(np.subtract(*np.percentile(own, [75, 25])), 0.25)
    found = []
    for k in sorted({*(strong - 1).tolist(), *(weak - 1).tolist()}):
        if not speech[k]:
            continue
        strength, jut = float(sigmoid((env[k] - np.median(own)) / spread)), float(sigmoid((prom[k] - 0.28) / 0.22))
        per, vow, son = float(t["periodicity"][k]), float(t["vowel"][k]), float(t["sonorant"][k])
        conf = 0.20 * strength + 0.22 * jut + 0.27 * vow + 0.22 * per + 0.09 * float(t["flux"][k]) - 0.12 * son
        recovered = k not in set((strong - 1).tolist())
        if recovered:
            ok = conf >= s.weak_min_confidence and vow >= WEAK_VOWEL and per >= WEAK_PERIODICITY
        else:
            ok = conf >= s.strong_min_confidence and per >= s.strong_min_periodicity and strength >= s.strong_min_strength and vow >= s.strong_min_vowel_likeness
        if ok:
            found.append({"frame": k, "time_seconds": round(k * HOP, 6), "confidence": round(conf, 6), "prominence": round(float(prom[k]), 6), "strength": round(strength, 6), "periodicity": round(per, 6), "vowel_likeness": round(vow, 6), "sonorant_penalty": round(son, 6), "weak_recovery": recovered})
    return suppress(found, max(1, round(s.min_distance_seconds / HOP))), t


def best_time(t: dict[str, np.ndarray], start: float, end: float) -> float:
    """The time of the greatest likelihood in an interval, its middle without a frame."""
    a, b = max(0, int(np.ceil(start / HOP))), min(len(t["likelihood"]), int(np.floor(end / HOP)) + 1)
    at = (a + int(np.argmax(t["likelihood"][a:b]))) * HOP if b > a else (start + end) / 2
    return float(np.clip(at, start, end))


def describe(s: Settings) -> dict:
    return asdict(s)


# --- features of candidates ------------------------------------------------------------------


def candidate_pool(t: dict[str, np.ndarray], apart: int = 3) -> np.ndarray:
    """Frames that any of three tracks has as a local peak: many, so that few nuclei are missed."""
    pools = [find_peaks(np.pad(t[k], 1, constant_values=t[k].min() - 1), 0.01, apart)[0] - 1 for k in ("envelope", "likelihood", "vowel")]
    return np.unique(np.concatenate(pools))


def prominence_at(v: np.ndarray, k: int, radius: int) -> float:
    return max(0.0, float(v[k] - max(v[max(0, k - radius) : k + 1].min(), v[k : k + radius + 1].min())))


def shape(v: np.ndarray, k: int, radius: int = 8, points: int = 9) -> np.ndarray:
    """A track around a frame, resampled and scaled by its range."""
    from prosodia.functions.arrays import resample

    own = resample(v[max(0, k - radius) : k + radius + 1], points)
    return (own - own.min()) / max(np.ptp(own), 1e-9)


OFFSETS = (-10, -7, -4, -2, 0, 2, 4, 7, 10)


def candidate_matrix(t: dict[str, np.ndarray], at: np.ndarray) -> np.ndarray:
    """A row of features a candidate: tracks in context, shapes, prominences and gaps to its neighbours."""
    names = ("envelope", "likelihood", "periodicity", "vowel", "sonorant", "flux")
    n = len(t["envelope"])
    gaps = np.diff(at)
    before, after = np.concatenate([[50], gaps]), np.concatenate([gaps, [50]])
    rows = []
    for i, k in enumerate(at):
        around = np.clip(k + np.array(OFFSETS), 0, n - 1)
        rows.append(np.concatenate([*(t[c][around] for c in names), shape(t["envelope"], k), shape(t["likelihood"], k), [prominence_at(t[c], k, 12) for c in ("envelope", "likelihood")], t["bands"][:, k], t["mfcc"][k], [before[i], after[i]]]))
    return np.array(rows) if rows else np.zeros((0, 0))


def segment_matrix(t: dict[str, np.ndarray], segments: list[tuple[float, float]], states: np.ndarray | None = None, rate: float = 50.0) -> np.ndarray:
    """A row of features a segment: duration, and mean, greatest, least and deviation of tracks and of the states' norm."""
    rows = []
    for a, b in segments:
        i, j = int(a / HOP), max(int(a / HOP) + 1, int(b / HOP))
        parts = [t[c][i:j] for c in ("envelope", "likelihood", "periodicity", "vowel")]
        if states is not None:
            parts.append(np.linalg.norm(states[int(a * rate) : max(int(a * rate) + 1, int(b * rate))], axis=1))
        rows.append([b - a, *(f(p) if len(p) else 0.0 for p in parts for f in (np.mean, np.max, np.min, np.std))])
    return np.array(rows)


def votes(states: np.ndarray, norms: list[float], merges: list[float], rate: float = 50.0, sigma: float = 1.0) -> np.ndarray:
    """How many of all segmentations (norm x merge) have a middle near each frame, smoothed."""
    from prosodia.operators.windows import segments_by_similarity

    out = np.zeros(len(states))
    for a in norms:
        for b in merges:
            for s, e in segments_by_similarity(states, a, b):
                out[min(len(out) - 1, (s + e) // 2)] += 1
    return gaussian(out, sigma) if len(out) else out


def soft_target(times: np.ndarray, events: np.ndarray, sigma: float = 0.025) -> np.ndarray:
    """The greatest Gaussian of any event at each time."""
    if not len(events):
        return np.zeros(len(times))
    return np.exp(-0.5 * ((np.asarray(times)[:, None] - np.asarray(events)[None, :]) / sigma) ** 2).max(axis=1)
