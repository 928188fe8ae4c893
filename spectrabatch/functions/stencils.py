"""Coefficients of the spectral steps and their NumPy form for Arrow batches.

Baseline, smoothing and derivative are linear in the spectrum, which
:func:`folded_weights` uses to move a fitted model in front of them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def savgol_taps(window: int, order: int) -> dict[int, float]:
    """Smoothing weights of the least-squares polynomial at the window centre."""
    if window % 2 == 0 or not 0 <= order < window:
        raise ValueError("window has to be odd and larger than the polynomial order")
    half = window // 2
    offsets = np.arange(-half, half + 1)
    design = np.vander(offsets.astype(float), order + 1, increasing=True)
    weights = np.linalg.pinv(design)[0]
    return {int(o): float(w) for o, w in zip(offsets, weights)}


def segment_taps(segment: int) -> dict[int, float]:
    """Moving mean over an odd number of points."""
    if segment % 2 == 0:
        raise ValueError("segment has to be odd")
    half = segment // 2
    return {o: 1.0 / segment for o in range(-half, half + 1)}


def gap_taps(gap: int) -> dict[int, float]:
    """Central difference over ``gap`` points to either side."""
    return {-gap: -1.0 / (2 * gap), gap: 1.0 / (2 * gap)}


@dataclass(frozen=True)
class SpectralSteps:
    """Parameters of the preprocessing chain; the published data fix only the range."""

    low: float = 350.0
    high: float = 1750.0
    window: int = 5
    order: int = 2
    segment: int = 3
    gap: int = 2

    def tap_sequence(self) -> list[dict[int, float]]:
        return [savgol_taps(self.window, self.order), segment_taps(self.segment), gap_taps(self.gap)]


def apply_taps(block: np.ndarray, taps: dict[int, float]) -> np.ndarray:
    margin = max(abs(o) for o in taps)
    points = block.shape[1]
    padded = np.pad(block, ((0, 0), (margin, margin)), mode="edge")
    out = np.zeros_like(block)
    for offset, tap in sorted(taps.items()):
        out += tap * padded[:, margin + offset : margin + offset + points]
    return out


def remove_end_line(block: np.ndarray) -> np.ndarray:
    ramp = np.linspace(0.0, 1.0, block.shape[1])
    return block - (block[:, :1] * (1.0 - ramp) + block[:, -1:] * ramp)


def apply_steps(block: np.ndarray, start: int, stop: int, steps: SpectralSteps) -> np.ndarray:
    """Range cut, baseline, smoothing and derivative of a (samples x points) block."""
    out = remove_end_line(np.ascontiguousarray(block[:, start:stop]))
    for taps in steps.tap_sequence():
        out = apply_taps(out, taps)
    return out


def folded_weights(points: int, start: int, stop: int, steps: SpectralSteps, weights: np.ndarray) -> np.ndarray:
    """Weights ``w`` on the raw spectrum with ``x . w == steps(x) . weights`` for every ``x``.

    The chain is a matrix; its rows are the responses to the unit spectra.
    """
    response = apply_steps(np.eye(points), start, stop, steps)
    return response @ np.asarray(weights, dtype=float)
