"""Frames to contours (I1-I3), and stacks to frames."""

from __future__ import annotations

import numpy as np

from trackfold.functions.kernels import filters, morph
from trackfold.schema import MIN_COLONY_AREA, UM_PER_PIXEL


def colonies(frame: np.ndarray) -> list[np.ndarray]:
    """Edges, closed twice, clear of the border, as outer contours over the least area."""
    m = morph.clear_border(morph.close(filters.canny(frame, 1.0), morph.ellipse(7), 2), 20)
    return [c for c in morph.contours(m) if morph.area(c) * UM_PER_PIXEL**2 > MIN_COLONY_AREA]


def cells(frame: np.ndarray, colony: list[np.ndarray], sigma: float, threshold: float, factor: float, least: int) -> list[np.ndarray]:
    """Pixels of strongly negative curvature inside colonies, as contours, cut at pinches and grown back."""
    inside = np.zeros(frame.shape, dtype=bool)
    for c in colony:
        inside |= morph.mask_of(c, frame.shape)
    m = (filters.laplacian_of_gaussian(frame.astype(np.float64), sigma, 7) < threshold) & inside
    out = []
    for c in morph.contours(m):
        if morph.area(c) >= least:
            out += [morph.dilated(x) for x in morph.split(c, factor, least)]
    return out


def segment(frame: np.ndarray, sigma: float, threshold: float, factor: float, least: int) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """I1, P22."""
    if not (frame.dtype == np.uint8 and frame.size and frame.min() == 0 and frame.max() >= 254):
        frame = filters.normalise(frame)
    c = colonies(frame)
    return frame, c, cells(frame, c, sigma, threshold, factor, least)


def sharpness(frame: np.ndarray) -> float:
    """I16: mean absolute Laplacian."""
    return float(np.abs(filters.laplacian(frame)).mean())


def fourier_sharpness(frame: np.ndarray) -> float:
    """I16 in frequencies: the share of power beyond a quarter of the band."""
    p = np.abs(np.fft.fft2(frame.astype(float))) ** 2
    p[0, 0] = 0
    fy, fx = np.fft.fftfreq(frame.shape[0])[:, None], np.fft.fftfreq(frame.shape[1])[None, :]
    return float(p[np.hypot(fy, fx) > 0.25].sum() / max(p.sum(), 1e-300))


def _tiles(shape: tuple[int, int], size: int) -> tuple[np.ndarray, np.ndarray]:
    return np.arange(shape[0]) // size, np.arange(shape[1]) // size


def tile_scores(stack: np.ndarray, size: int) -> np.ndarray:
    """Mean absolute Laplacian of each tile: depth, tile row, tile column."""
    ty, tx = _tiles(stack.shape[1:], size)
    out = np.zeros((len(stack), ty[-1] + 1, tx[-1] + 1))
    n = np.zeros(out.shape[1:])
    np.add.at(n, (ty[:, None], tx[None, :]), 1)
    for z, f in enumerate(stack):
        np.add.at(out[z], (ty[:, None], tx[None, :]), np.abs(filters.laplacian(f)))
    return out / n


def by_tiles(stack: np.ndarray, size: int = 200) -> np.ndarray:
    """Each tile from its sharpest depth, scores smoothed over neighbours, seams blended."""
    s = np.array([filters.convolve(x, np.ones((3, 3)) / 9) for x in tile_scores(stack, size)])
    best = s.argmax(axis=0)
    ty, tx = _tiles(stack.shape[1:], size)
    weight = np.zeros(stack.shape)
    for z in range(len(stack)):
        weight[z] = (best[ty[:, None], tx[None, :]] == z).astype(float)
    sigma = size / 8
    weight = np.array([filters.gaussian(w, sigma, 2 * int(2 * sigma) + 1) for w in weight])
    return (stack * weight).sum(axis=0) / np.maximum(weight.sum(axis=0), 1e-12)


def tilt(best: np.ndarray) -> tuple[float, float, float]:
    """A15 for tiles: z = a row + b column + c, missing tiles left out; a flat plane for fewer than three."""
    y, x = np.nonzero(~np.isnan(best))
    if not len(y):
        raise ValueError("no tile has a preferred depth")
    z = best[y, x]
    if len(y) < 3:
        return 0.0, 0.0, float(z.mean())
    return tuple(np.linalg.lstsq(np.stack([y, x, np.ones(len(y))], axis=1), z, rcond=None)[0])


def by_plane(stack: np.ndarray, size: int = 256) -> np.ndarray:
    """Tiles of clear focus give a plane; each pixel is a mean over depths, weighed by a tent around the plane."""
    s = tile_scores(stack, size)
    clear = s.max(axis=0) > 1.05 * s.mean(axis=0)
    best = np.where(clear, s.argmax(axis=0).astype(float), np.nan)
    a, b, c = tilt(best)
    y, x = np.arange(stack.shape[1])[:, None] / size - 0.5, np.arange(stack.shape[2])[None, :] / size - 0.5
    z = np.clip(a * y + b * x + c, 0, len(stack) - 1)
    w = np.maximum(0.0, 1 - np.abs(np.arange(len(stack))[:, None, None] - z[None]))
    return (stack * w).sum(axis=0) / np.maximum(w.sum(axis=0), 1e-12)


def flatten(stack: np.ndarray, large_backlash: bool = False) -> np.ndarray:
    """One frame of a stack: itself, by tiles or by a plane; clipped, smoothed and normalised."""
    if len(stack) == 1:
        f = stack[0].astype(float)
    elif large_backlash:
        f = by_tiles(stack)
    else:
        try:
            f = by_plane(stack)
        except ValueError:
            f = by_tiles(stack)
    return filters.normalise(filters.gaussian(filters.clip(f), 0.8, 3))


def edge_profile(frame: np.ndarray, contour: np.ndarray, reach: int = 10) -> np.ndarray:
    """Sums of the Laplacian on rings around a contour, from inside out, over the whole frame's size."""
    m = morph.mask_of(contour, frame.shape)
    inner, outer = morph.distance(m), morph.distance(~m)
    d = np.where(m, -inner, outer)
    lap = filters.laplacian(frame)
    return np.array([lap[(d > k - 1) & (d <= k)].sum() / frame.size for k in range(-reach, reach + 1)])
