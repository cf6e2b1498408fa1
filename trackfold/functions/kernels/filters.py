"""Filters of images and of series."""

from __future__ import annotations

import functools

import numpy as np


def convolve(a: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Correlation with reflected borders, the border pixel not repeated."""
    kh, kw = kernel.shape
    p = np.pad(a.astype(np.float64), ((kh // 2,) * 2, (kw // 2,) * 2), mode="reflect" if min(a.shape) > max(kh, kw) // 2 else "edge")
    out = np.zeros(a.shape)
    for i in range(kh):
        for j in range(kw):
            if kernel[i, j]:
                out += kernel[i, j] * p[i : i + a.shape[0], j : j + a.shape[1]]
    return out


@functools.cache
def gaussian_1d(sigma: float, size: int) -> np.ndarray:
    x = np.arange(size) - (size - 1) / 2
    g = np.exp(-x * x / (2 * sigma * sigma))
    return g / g.sum()


def gaussian(a: np.ndarray, sigma: float, size: int | None = None) -> np.ndarray:
    size = size or 2 * int(4 * sigma + 0.5) + 1
    g = gaussian_1d(sigma, size)
    return convolve(convolve(a, g[:, None]), g[None, :])


LAPLACE = np.array([[0.0, 1.0, 0.0], [1.0, -4.0, 1.0], [0.0, 1.0, 0.0]])


def laplacian(a: np.ndarray) -> np.ndarray:
    return convolve(a, LAPLACE)


@functools.cache
def _laplace_kernel(size: int) -> np.ndarray:
    """Second derivatives of a binomial smoothing of `size` taps, in both directions, added up."""
    smooth = np.array([1.0])
    for _ in range(size - 1):
        smooth = np.convolve(smooth, [1.0, 1.0])
    second = np.array([1.0, -2.0, 1.0])
    for _ in range(size - 3):
        second = np.convolve(second, [1.0, 1.0])
    return np.outer(second, smooth) + np.outer(smooth, second)


def laplacian_of_gaussian(a: np.ndarray, sigma: float, size: int = 7) -> np.ndarray:
    """I4."""
    return convolve(gaussian(a, sigma), _laplace_kernel(size))


def sobel(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    k = np.array([[-1.0, 0.0, 1.0], [-2.0, 0.0, 2.0], [-1.0, 0.0, 1.0]]) / 4
    return convolve(a, k), convolve(a, k.T)


def canny(a: np.ndarray, sigma: float = 1.0, low: float = 0.1, high: float = 0.2) -> np.ndarray:
    """Edges: gradient of the smoothed image, thinned to its ridge, kept where high or joined to high. Thresholds are shares of the image's type range."""
    top = 255.0 if a.dtype == np.uint8 else 65535.0 if a.dtype == np.uint16 else 1.0
    gx, gy = sobel(gaussian(a.astype(np.float64), sigma))
    m = np.hypot(gx, gy)
    p = np.pad(m, 1)
    ax, ay = np.abs(gx), np.abs(gy)
    mid = p[1:-1, 1:-1]

    horizontal, diagonal_same = ax >= ay, gx * gy > 0
    at = lambda y, x: p[1 + y : 1 + y + m.shape[0], 1 + x : 1 + x + m.shape[1]]
    w = np.where(horizontal, np.divide(ay, ax, out=np.zeros_like(ax), where=ax > 0), np.divide(ax, ay, out=np.zeros_like(ax), where=ay > 0))
    side = np.where(diagonal_same, 1, -1)
    diag_a = np.where(side > 0, at(1, 1), np.where(horizontal, at(-1, 1), at(1, -1)))
    diag_b = np.where(side > 0, at(-1, -1), np.where(horizontal, at(1, -1), at(-1, 1)))
    straight_a = np.where(horizontal, at(0, 1), at(1, 0))
    straight_b = np.where(horizontal, at(0, -1), at(-1, 0))
    ridge = (mid >= diag_a * w + straight_a * (1 - w)) & (mid >= diag_b * w + straight_b * (1 - w)) & (m > 0)
    weak, strong = ridge & (m >= low * top), ridge & (m >= high * top)
    from trackfold.functions.kernels.morph import label

    lab, n = label(weak, 8)
    keep = np.zeros(n + 1, dtype=bool)
    keep[np.unique(lab[strong])] = True
    keep[0] = False
    return keep[lab]


def normalise(a: np.ndarray, dtype=np.uint8) -> np.ndarray:
    """The range of values stretched to that of the type; a flat image is 0."""
    top = np.iinfo(dtype).max
    lo, hi = float(a.min()), float(a.max())
    if hi == lo:
        return np.zeros(a.shape, dtype)
    return np.round((a.astype(np.float64) - lo) * (top / (hi - lo))).astype(dtype)


def to_uint8(a: np.ndarray) -> np.ndarray:
    """Any pixel type as bytes: unsigned and signed integers by their high bits, fractions of 1 by 255, booleans as 0 and 255."""
    if a.dtype == np.uint8:
        return a
    if a.dtype == bool:
        return a.astype(np.uint8) * np.uint8(255)
    if np.issubdtype(a.dtype, np.floating):
        return np.clip(np.nan_to_num(a) * 255, 0, 255).astype(np.uint8)
    info = np.iinfo(a.dtype)
    return ((a.astype(np.float64) - info.min) * (255 / (float(info.max) - info.min))).astype(np.uint8)


def clip(a: np.ndarray, percentile: float = 0.001) -> np.ndarray:
    """A16."""
    lo, hi = np.percentile(a, [percentile, 100 - percentile])
    return np.clip(a, lo, hi)


def low_pass(x: np.ndarray, wn: float = 0.1) -> np.ndarray:
    """K1: a first-order Butterworth filter run both ways, the series extended at both ends by 6 points turned about the end point, from steady initial states."""
    k = np.tan(np.pi * wn / 2)
    b = np.array([k, k]) / (1 + k)
    a1 = (k - 1) / (k + 1)
    n = 6
    if len(x) <= n:
        raise ValueError("too short")
    e = np.concatenate([2 * x[0] - x[n:0:-1], x, 2 * x[-1] - x[-2 : -n - 2 : -1]])
    z = b[1] - a1 * b[0]
    z = z / (1 + a1)

    def run(v):
        out, state = np.empty(len(v)), z * v[0]
        for i, y in enumerate(v):
            out[i] = b[0] * y + state
            state = b[1] * y - a1 * out[i]
        return out

    return run(run(e)[::-1])[::-1][n:-n]
