"""Temporal bases, lags and window bounds: small matrices made on the driver."""

from __future__ import annotations

import math

import numpy as np


def window_bounds(window: tuple[float, float], dt: float) -> tuple[int, int]:
    """First bin and exclusive last bin of a window, in binary floating point.

    A window that covers no bin covers one.
    """
    start, stop = window
    if stop < start:
        raise ValueError(f"window {window!r} ends before it starts")
    first, end = math.floor(start / dt), math.ceil(stop / dt)
    return first, max(end, first + 1)


def lags_of(window: tuple[float, float], dt: float) -> np.ndarray:
    """The lags, in bins, that a kernel over ``window`` has."""
    return np.arange(*window_bounds(window, dt))


def _bumps(position: np.ndarray, n_basis: int) -> np.ndarray:
    """Raised cosines over ``position``, evenly spaced, each two spacings to either side."""
    centers = np.linspace(position[0], position[-1], n_basis)
    reach = 2 * (centers[1] - centers[0])
    angle = np.pi * (position[:, None] - centers[None, :]) / reach
    return np.where(np.abs(angle) <= np.pi, 0.5 + 0.5 * np.cos(angle), 0.0)


def linear_cosine_basis(n_basis: int, n_lags: int) -> np.ndarray:
    return _cosines(np.arange(n_lags, dtype=float), n_basis)


def log_cosine_basis(n_basis: int, n_lags: int, log_offset: float = 1.0) -> np.ndarray:
    return _cosines(np.log(np.arange(n_lags, dtype=float) + log_offset), n_basis)


def _cosines(position: np.ndarray, n_basis: int) -> np.ndarray:
    if n_basis < 1:
        raise ValueError("a basis needs at least one function")
    return np.ones((len(position), 1)) if n_basis == 1 else _bumps(position, n_basis)


def make_basis(name: str, n_basis: int, n_lags: int) -> np.ndarray:
    """A (lags, functions) matrix: ``cosine``, ``log_cosine`` or ``identity``."""
    if n_lags == 1 and n_basis != 1:
        raise ValueError("one lag takes exactly one basis function")
    if name == "identity":
        if n_basis != n_lags:
            raise ValueError(f"an identity basis over {n_lags} lags has {n_lags} functions, not {n_basis}")
        return np.eye(n_lags)
    makers = {"cosine": linear_cosine_basis, "log_cosine": log_cosine_basis}
    if name not in makers:
        raise ValueError(f"no basis is called {name!r}")
    return makers[name](n_basis, n_lags)


def gaussian_kernel(sigma_bins: float) -> np.ndarray:
    """Normalised Gaussian weights out to four sigmas, one bin at least."""
    radius = max(1, math.ceil(4 * sigma_bins))
    weights = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma_bins) ** 2)
    return weights / weights.sum()
