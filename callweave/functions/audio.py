"""Features of waveforms in NumPy, for use inside Arrow UDFs. Constant tables are built once a worker."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np


def frames(x: np.ndarray, length: int, hop: int) -> np.ndarray:
    """Frames x length; a signal shorter than one frame is padded to it."""
    if len(x) < length:
        x = np.pad(x, (0, length - len(x)))
    return np.lib.stride_tricks.sliding_window_view(x, length)[::hop]


def hz_to_mel(f):
    """The scale that is linear up to 1 kHz and logarithmic above."""
    f = np.asarray(f, dtype=float)
    return np.where(f < 1000, f * 3 / 200, 15 + np.log(np.maximum(f, 1e-9) / 1000) * 27 / np.log(6.4))


def mel_to_hz(m):
    m = np.asarray(m, dtype=float)
    return np.where(m < 15, m * 200 / 3, 1000 * np.exp((m - 15) * np.log(6.4) / 27))


@lru_cache(maxsize=16)
def mel_filters(rate: int, n_fft: int, n_mels: int, low: float, high: float) -> np.ndarray:
    """Triangles of equal area: n_mels x (n_fft / 2 + 1)."""
    at = np.fft.rfftfreq(n_fft, 1 / rate)
    edge = mel_to_hz(np.linspace(hz_to_mel(low), hz_to_mel(high), n_mels + 2))
    rise = (at - edge[:-2, None]) / np.diff(edge)[:-1, None]
    fall = (edge[2:, None] - at) / np.diff(edge)[1:, None]
    return np.maximum(0, np.minimum(rise, fall)) * (2 / (edge[2:] - edge[:-2]))[:, None]


@lru_cache(maxsize=16)
def cosines(n_out: int, n: int) -> np.ndarray:
    """The orthonormal DCT-II."""
    m = np.cos(np.pi * np.arange(n_out)[:, None] * (2 * np.arange(n) + 1) / (2 * n)) * np.sqrt(2 / n)
    m[0] /= np.sqrt(2)
    return m


def power_spectrum(x: np.ndarray, n_fft: int, win: int, hop: int, window: str = "hann") -> np.ndarray:
    w = {"hann": np.hanning(win + 1)[:-1], "hamming": np.hamming(win)}[window]
    return np.abs(np.fft.rfft(frames(x, win, hop) * w, n_fft)) ** 2


def mfcc(x, rate: int = 8000, n: int = 13, n_mels: int = 26, n_fft: int = 256, win: int = 200, hop: int = 80, low: float = 50, high: float = 3800, emphasis: float = 0.97) -> np.ndarray:
    """n x frames."""
    x = np.asarray(x, dtype=float)
    y = np.concatenate([x[:1], x[1:] - emphasis * x[:-1]])
    mel = power_spectrum(y, n_fft, win, hop, "hamming") @ mel_filters(rate, n_fft, n_mels, low, high).T
    return cosines(n, n_mels) @ np.log(np.maximum(mel, 1e-10)).T


def mfcc_summary(x, rate: int = 8000) -> np.ndarray:
    """Mean and population deviation of every coefficient over time: 26 values."""
    c = mfcc(x, rate)
    return np.concatenate([c.mean(axis=1), c.std(axis=1)])


def mel_power(x, rate: int = 22050, n_mels: int = 128, n_fft: int = 2048, hop: int = 512, center: bool = True) -> np.ndarray:
    """Mel power spectrum, n_mels x frames; ``center`` pads both ends with silence."""
    x = np.asarray(x, dtype=float)
    x = np.pad(x, n_fft // 2) if center else x
    return mel_filters(rate, n_fft, n_mels, 0, rate / 2) @ power_spectrum(x, n_fft, n_fft, hop).T


def mfcc_db(x, rate: int = 22050, n: int = 20, n_mels: int = 128, n_fft: int = 2048, hop: int = 512, center: bool = True, top_db: float = 80.0) -> np.ndarray:
    """Coefficients of the Mel spectrum in decibels, cut ``top_db`` below its largest value: n x frames."""
    db = 10 * np.log10(np.maximum(mel_power(x, rate, n_mels, n_fft, hop, center), 1e-10))
    return cosines(n, n_mels) @ np.maximum(db, db.max() - top_db)


def log_mel(x, rate: int = 8000, n_mels: int = 64, n_fft: int = 256, hop: int = 80) -> np.ndarray:
    """Decibels against the largest value, from -80 to 0."""
    x = np.asarray(x, dtype=float)
    mel = power_spectrum(np.pad(x, n_fft // 2, mode="reflect" if len(x) > n_fft // 2 else "constant"), n_fft, n_fft, hop) @ mel_filters(rate, n_fft, n_mels, 0, rate / 2).T
    db = 10 * np.log10(np.maximum(mel.T, 1e-10))
    return np.maximum(db - db.max(), -80)


def unit_scale(db: np.ndarray) -> np.ndarray:
    return np.clip((db + 80) / 80, 0, 1)


def pool(m: np.ndarray, bins: int) -> np.ndarray:
    """Means along the last axis between rounded, evenly spaced boundaries, by one prefix sum."""
    n = m.shape[-1]
    edge = np.rint(np.linspace(0, n, bins + 1)).astype(int)
    lo = np.minimum(edge[:-1], n - 1)
    hi = np.maximum(edge[1:], lo + 1)
    total = np.concatenate([np.zeros((*m.shape[:-1], 1)), np.cumsum(m, axis=-1)], axis=-1)
    return (total[..., hi] - total[..., lo]) / (hi - lo)


def two_views(x, rate: int = 8000, bins: int = 24, head_s: float = 1.5) -> np.ndarray:
    """Scaled log-Mel of the first seconds beside that of the whole, each pooled to ``bins``: 64 x 2 bins, 8 bit."""
    x = np.asarray(x, dtype=float)
    first = np.pad(x[: int(head_s * rate)], (0, max(0, int(head_s * rate) - len(x))))
    both = [pool(unit_scale(log_mel(y, rate)), bins) for y in (first, x if len(x) else first)]
    return np.rint(np.concatenate(both, axis=1) * 255).astype(np.uint8)


def level_quality(x, rate: int = 8000, frame_ms: int = 20, silent: float = 0.001, clipped: float = 0.999) -> dict[str, float]:
    """Share of silent frames, of clipped and of zero samples, peak and RMS; all NaN for an empty signal."""
    x = np.asarray(x, dtype=float)
    if not len(x):
        return dict.fromkeys(("silence_ratio", "clipping_ratio", "zero_ratio", "peak", "rms"), float("nan"))
    rms = np.sqrt((frames(x, rate * frame_ms // 1000, rate * frame_ms // 1000) ** 2).mean(axis=1))
    return {
        "silence_ratio": float((rms < silent).mean()),
        "clipping_ratio": float((np.abs(x) >= clipped).mean()),
        "zero_ratio": float((x == 0).mean()),
        "peak": float(np.abs(x).max()),
        "rms": float(np.sqrt((x**2).mean())),
    }


def _lag_correlations(f: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Autocorrelation of windowed frames, normalised by that of the window (Boersma 1993); and which frames have any
    energy."""
    win = f.shape[1]
    size = 1 << (2 * win - 1).bit_length()
    ac = np.fft.irfft(np.abs(np.fft.rfft(f * window, size)) ** 2)[:, :win]
    ref = np.fft.irfft(np.abs(np.fft.rfft(window, size)) ** 2)[:win]
    alive = ac[:, 0] > 1e-12
    with np.errstate(invalid="ignore", divide="ignore"):
        r = ac / np.where(alive, ac[:, 0], 1)[:, None] / np.maximum(ref / ref[0], 1e-6)
    return r, alive


def pitch_track(x, rate: int = 8000, low: float = 50, high: float = 800, hop_ms: int = 10, voiced: float = 0.45, silence: float = 0.03, octave: float = 0.01, jump: float = 0.35, change: float = 0.14, most: int = 15) -> np.ndarray:
    """Fundamental frequency a frame by the autocorrelation method (Boersma 1993), 0 where unvoiced: up to ``most``
    candidates a frame, one of them unvoiced, and the path through them that pays least for octave jumps and for changes
    of voicing. A window is three periods of ``low``; a signal shorter than that has no frame."""
    x = np.asarray(x, dtype=float)
    win, hop = int(3 * rate / low), rate * hop_ms // 1000
    if len(x) < win:
        return np.zeros(0)
    x = x - x.mean()
    n = (len(x) - win) // hop + 1
    first = (len(x) - win - (n - 1) * hop) // 2  # frames lie symmetrically
    f = np.lib.stride_tricks.sliding_window_view(x, win)[first::hop][:n]
    loud = np.abs(x).max()
    f = f - f.mean(axis=1, keepdims=True)
    r, alive = _lag_correlations(f, np.hanning(win + 2)[1:-1])
    local = np.abs(f).max(axis=1) / loud if loud > 0 else np.zeros(n)
    lo, hi = max(2, int(rate / high)), min(int(rate / low) + 1, win // 2)
    part = r[:, lo - 1 : hi + 1]
    peak = (part[:, 1:-1] > part[:, :-2]) & (part[:, 1:-1] >= part[:, 2:]) & (part[:, 1:-1] > 0.5 * voiced) & alive[:, None]
    a, b, c = part[:, :-2], part[:, 1:-1], part[:, 2:]
    with np.errstate(invalid="ignore", divide="ignore"):
        shift = np.where(peak, np.clip(np.nan_to_num((a - c) / (2 * (a - 2 * b + c))), -0.5, 0.5), 0)
    top = b - 0.25 * (a - c) * shift
    hz = rate / (np.arange(lo, hi) + shift)
    strength = np.where(peak, np.minimum(top, 2 - np.maximum(top, 1)) - octave * np.log2(low / hz), -np.inf)
    k = min(most - 1, strength.shape[1])
    best = np.argpartition(-strength, k - 1, axis=1)[:, :k]
    row = np.arange(n)[:, None]
    score, freq = strength[row, best], hz[row, best]
    freq = np.where(np.isfinite(score) & (freq >= low) & (freq <= high), freq, 0.0)
    score = np.where(freq > 0, score, -np.inf)
    quiet = voiced + np.maximum(0, 2 - local * (1 + voiced) / silence)
    score, freq = np.column_stack([quiet, score]), np.column_stack([np.zeros(n), freq])
    # the cheapest path; costs are those of frames of 10 ms
    scale = 10 / hop_ms
    back = np.zeros((n, k + 1), dtype=int)
    total, cols = score[0], np.arange(k + 1)
    logs = np.log2(np.where(freq > 0, freq, 1))
    for start in range(1, n, 4096):  # costs of many frames at once
        end = min(n, start + 4096)
        was, now = freq[start - 1 : end - 1, :, None] > 0, freq[start:end, None, :] > 0
        far = jump * np.abs(logs[start - 1 : end - 1, :, None] - logs[start:end, None, :])
        cost = np.where(was & now, far, np.where(was != now, change, 0.0)) * scale
        for i in range(start, end):
            reach = total[:, None] - cost[i - start]
            back[i] = reach.argmax(axis=0)
            total = reach[back[i], cols] + score[i]
    path = np.zeros(n, dtype=int)
    path[-1] = total.argmax()
    for i in range(n - 1, 0, -1):
        path[i - 1] = back[i, path[i]]
    return freq[np.arange(n), path]


def tone(x, rate: int = 8000, low: float = 50, high: float = 1000) -> tuple[float, float, float]:
    """Zero crossings, centroid and concentration (the strongest line's part) between ``low`` and ``high``, of the whole
    segment under one window; NaN where there is nothing to measure."""
    x = np.asarray(x, dtype=float)
    if len(x) < 2:
        return (float("nan"),) * 3
    crossings = float((np.diff(np.signbit(x)) != 0).mean())
    p, at = np.abs(np.fft.rfft(x * np.hanning(len(x)))) ** 2, np.fft.rfftfreq(len(x), 1 / rate)
    band = (at >= low) & (at <= min(high, rate / 2))
    total = p[band].sum()
    if total <= np.finfo(float).eps:
        return crossings, float("nan"), float("nan")
    return crossings, float((at[band] * p[band]).sum() / total), float(p[band].max() / total)


def acoustic_summary(x, rate: int = 8000, keep: tuple[float, float] = (60, 400), frames_least: int = 3, ratio_least: float = 0.1, tone_most: float = 0.9) -> dict[str, float]:
    """Pitch, level, zero crossings and centroid of one segment. Pitch counts as reliable, and is given, with at least
    three frames in the range of speech, a tenth of all frames, and no single line of nine tenths of the energy."""
    x = np.asarray(x, dtype=float)
    rms = float(np.sqrt((x**2).mean())) if len(x) else float("nan")
    crossings, centroid, concentration = tone(x, rate)
    track = pitch_track(x, rate) if len(x) and rms > 0 else np.zeros(0)
    f0 = track[(track >= keep[0]) & (track <= keep[1])]
    ratio = len(f0) / len(track) if len(track) else 0.0
    reliable = len(f0) >= frames_least and ratio >= ratio_least and not concentration >= tone_most
    some = lambda g: float(g(f0)) if reliable else float("nan")
    return {
        "f0_mean": some(np.mean),
        "f0_median": some(np.median),
        "f0_std": some(np.std),
        "voiced_ratio": ratio,
        "tone_concentration": concentration,
        "reliable": float(reliable),
        "rms": rms,
        "zcr": crossings,
        "centroid": centroid,
    }


def choose_windows(segments: list[tuple[float, float]], duration: float, key: str, most: int = 3, shortest: float = 0.5, longest: float = 3.0) -> list[tuple[float, float]]:
    """Up to ``most`` segments of at least ``shortest`` seconds, in the order of a hash of ``key`` and the segment, each cut
    to ``longest`` at a place that the hash gives: the same at every run."""
    out = []
    for a, b in segments:
        if b - a >= shortest and a < duration:
            h = int.from_bytes(hashlib.sha256(f"{key}\0{a!r}\0{b!r}".encode()).digest()[:8], "big")
            end = min(b, duration)
            start = a + (h & 0xFFFFFFFF) / 2**32 * max(0.0, end - a - longest)
            out.append((h, start, min(end, start + longest)))
    return [(a, b) for _, a, b in sorted(out)[:most]]


def window_summary(x, windows: list[tuple[float, float]], rate: int = 8000) -> dict[str, float]:
    """Pitch quartiles, voiced part, centroid, level and coefficients over the chosen windows of a recording; windows of
    under 512 samples are left out."""
    x = np.asarray(x, dtype=float)
    parts = [p for a, b in windows if len(p := x[round(a * rate) : round(b * rate)]) >= 512]
    out: dict[str, float] = {}
    tracks = [pitch_track(p, rate, 65, min(650, rate / 2 - 1), 20) for p in parts]
    every = np.concatenate(tracks) if tracks else np.zeros(0)
    f0 = every[every > 0]
    out["voiced_ratio"] = float((every > 0).mean()) if len(every) else float("nan")
    for name, q in (("f0_q25", 25), ("f0_median", 50), ("f0_q75", 75)):
        out[name] = float(np.percentile(f0, q)) if len(f0) else float("nan")
    mags = [np.sqrt(power_spectrum(p, 512, 512, 160)) for p in parts]
    at = np.fft.rfftfreq(512, 1 / rate)
    cents = np.concatenate([(m @ at) / np.maximum(m.sum(axis=1), 1e-12) for m in mags]) if mags else np.zeros(0)
    level = np.concatenate([np.sqrt((frames(p, 512, 160) ** 2).mean(axis=1)) for p in parts]) if parts else np.zeros(0)
    out["centroid"] = float(cents.mean()) if len(cents) else float("nan")
    out["rms"] = float(level.mean()) if len(level) else float("nan")
    c = np.concatenate([mfcc_db(p, rate, 13, 40, 512, 160, center=False) for p in parts], axis=1) if parts else np.full((13, 1), np.nan)
    for i in range(13):
        out[f"mfcc_{i + 1}_mean"], out[f"mfcc_{i + 1}_std"] = float(c[i].mean()), float(c[i].std())
    return out


def band_shares(x, rate: int = 8000, edges=(0, 250, 500, 1000, 2000, 4000)) -> np.ndarray:
    """Shares of the averaged power spectrum in bands."""
    p = power_spectrum(np.asarray(x, dtype=float), 512, 512, 256).mean(axis=0)
    at = np.fft.rfftfreq(512, 1 / rate)
    s = np.array([p[(at >= a) & (at < b)].sum() for a, b in zip(edges, edges[1:])])
    return s / s.sum() if s.sum() else s


def resample_up(x, factor: int = 2, half: int = 10, beta: float = 5.0) -> np.ndarray:
    """Polyphase interpolation with a Kaiser-windowed sinc of unit gain; output is ``factor`` times as long."""
    x = np.asarray(x, dtype=float)
    taps = np.arange(-half * factor, half * factor + 1)
    h = np.sinc(taps / factor) * np.kaiser(len(taps), beta)
    h *= factor / h.sum()
    y = np.zeros(len(x) * factor)
    y[::factor] = x
    return np.convolve(y, h)[half * factor : half * factor + len(y)]


def crop_strict(x: np.ndarray, start_s: float, end_s: float, rate: int) -> np.ndarray:
    """Samples of an interval that has to lie inside the signal."""
    a, b = round(start_s * rate), round(end_s * rate)
    if a < 0 or b > len(x) or b <= a:
        raise ValueError(f"Invalid crop: {start_s}-{end_s} s of {len(x) / rate} s")
    return x[a:b]


def masked_mean(states: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Mean of the rows that the mask keeps."""
    m = np.asarray(mask, dtype=float)[:, None]
    return (np.asarray(states, dtype=float) * m).sum(axis=0) / np.maximum(m.sum(), 1)
