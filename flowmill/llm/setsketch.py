"""SetSketch: registers of exponentially spaced, truncated minima.

Register i of a set is ``floor(1 - log_b(min h_i))`` over its elements, with h_i exponential of rate ``a``, cut to
16 bits.  Sketches of two sets merge by the larger register, agree in a register with a probability near the Jaccard
similarity (b is near 1), and give a joint likelihood of the similarity once both sizes are known.
"""

from __future__ import annotations

import numpy as np

M, B, A, Q = 96, 1.001, 20.0, (1 << 16) - 2
ROWS = 4  # registers a band: four of 16 bits are one 64-bit key
_rng = np.random.default_rng(20240229)
_XOR = _rng.integers(0, 1 << 63, M, dtype=np.uint64)
_MUL = _rng.integers(0, 1 << 63, M, dtype=np.uint64) | np.uint64(1)
_GRID = np.linspace(0.0, 1.0, 201)


def sketch(elements: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Registers (n, M) of n sets of well-mixed 64-bit hashes; set k is ``elements[first[k]:first[k+1]]``, not empty."""
    out = np.empty((len(first), M), np.uint64)
    for i in range(M):
        out[:, i] = np.minimum.reduceat((elements ^ _XOR[i]) * _MUL[i], first)
    u = (out.astype(np.float64) + 0.5) / 2.0**64
    h = -np.log1p(-np.minimum(u, 1 - 2.0**-53)) / A
    return np.clip(np.floor(1 - np.log(h) / np.log(B)), 0, Q + 1).astype(np.uint16)


def merge(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum(x, y)


def bands(registers: np.ndarray) -> np.ndarray:
    """(n, M / ROWS) keys; they hold the registers themselves."""
    return np.ascontiguousarray(registers).view(np.int64)


def registers(keys: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(keys).view(np.uint16)


def similarity(x: np.ndarray, y: np.ndarray, n_x: np.ndarray, n_y: np.ndarray) -> np.ndarray:
    """Jaccard similarity of greatest joint likelihood for rows of registers and set sizes."""
    more, less = (x > y).sum(1)[:, None], (x < y).sum(1)[:, None]
    same = x.shape[1] - more - less
    total = (n_x + n_y).astype(np.float64)
    u, v = (n_x / total)[:, None], (n_y / total)[:, None]
    j = np.minimum(_GRID[None, :], np.minimum(u / v, v / u))

    def p(t):
        return np.clip(-np.log1p(-np.clip(t, 0, 1) * (B - 1) / B) / np.log(B), 1e-12, 1)

    up, down = p(u - v * j), p(v - u * j)
    ll = more * np.log(up) + less * np.log(down) + same * np.log(np.clip(1 - up - down, 1e-12, 1))
    return j[np.arange(len(j)), ll.argmax(1)]


def may_reach(x: np.ndarray, y: np.ndarray, n_x: np.ndarray, n_y: np.ndarray, least: float) -> np.ndarray:
    """Whether the similarity of greatest joint likelihood is at least ``least``, by the slope of the likelihood there: it
    is concave, so a slope of zero or more puts its top at or beyond that point."""
    more, less = (x > y).sum(1), (x < y).sum(1)
    same = x.shape[1] - more - less
    total = (n_x + n_y).astype(np.float64)
    u, v = n_x / total, n_y / total
    fits = least <= np.minimum(u / v, v / u)
    c = (B - 1) / B

    def p(t):
        t = np.maximum(t, 1e-9)
        return -np.log1p(-t * c) / np.log(B), c / np.log(B) / (1 - t * c)

    (up, d_up), (down, d_down) = p(u - v * least), p(v - u * least)
    slope = -more * v * d_up / up - less * u * d_down / down + same * (v * d_up + u * d_down) / np.maximum(1 - up - down, 1e-9)
    return fits & (slope >= 0)
