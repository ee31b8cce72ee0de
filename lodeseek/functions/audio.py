"""Audio features: mono 16 kHz samples and log-mel spectra."""

from __future__ import annotations

import numpy as np

#: Sample rate, window, hop, mel bands and their upper edge.
RATE, WINDOW, HOP, BANDS, TOP_HZ = 16_000, 400, 160, 128, 8000.0


def resample(samples: np.ndarray, rate: int) -> np.ndarray:
    """Channels (rows) averaged, then interpolated to 16 kHz."""
    mono = samples.mean(0) if samples.ndim == 2 else samples
    n = int(len(mono) * RATE / rate)
    return np.interp(np.arange(n) * rate / RATE, np.arange(len(mono)), mono).astype(np.float32)


def _mel(hz):
    """Slaney's scale: linear below 1 kHz, logarithmic above."""
    hz = np.asarray(hz, np.float64)
    return np.where(hz < 1000, hz * 3 / 200, 15 + np.log(np.maximum(hz, 1e-9) / 1000) * 27 / np.log(6.4))


def _hz(mel):
    return np.where(mel < 15, mel * 200 / 3, 1000 * np.exp((mel - 15) * np.log(6.4) / 27))


def filters() -> np.ndarray:
    """Triangular filters, bands x frequencies, of equal area."""
    edges = _hz(np.linspace(_mel(0.0), _mel(TOP_HZ), BANDS + 2))
    at = np.linspace(0, RATE / 2, WINDOW // 2 + 1)
    rise = (at - edges[:-2, None]) / (edges[1:-1] - edges[:-2])[:, None]
    fall = (edges[2:, None] - at) / (edges[2:] - edges[1:-1])[:, None]
    return np.maximum(0, np.minimum(rise, fall)) * (2 / (edges[2:] - edges[:-2]))[:, None]


def log_mel(samples: np.ndarray) -> np.ndarray | None:
    """Bands x frames; none for less than three frames."""
    if len(samples) <= WINDOW // 2:
        return None
    padded = np.pad(samples, WINDOW // 2, mode="reflect")
    frames = np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::HOP][: len(samples) // HOP]
    if len(frames) < 3:
        return None
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(WINDOW) / WINDOW)
    power = np.abs(np.fft.rfft(frames * hann, axis=1)) ** 2
    logs = np.log10(np.maximum(filters() @ power.T, 1e-10))
    return ((np.maximum(logs, logs.max() - 8) + 4) / 4).astype(np.float32)
