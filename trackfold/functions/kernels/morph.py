"""Morphology, labels, distances and contours of masks."""

from __future__ import annotations

import functools

import numpy as np


@functools.cache
def ellipse(size: int) -> np.ndarray:
    """An elliptic structuring element."""
    r = size // 2
    out = np.zeros((size, size), dtype=bool)
    for i in range(size):
        dy = i - r
        dx = int(round(r * np.sqrt(max(0.0, (r * r - dy * dy) / (r * r))))) if r else 0
        out[i, max(r - dx, 0) : r + dx + 1] = True
    return out


def dilate(m: np.ndarray, element: np.ndarray) -> np.ndarray:
    h, w = element.shape[0] // 2, element.shape[1] // 2
    p = np.pad(m, ((h, h), (w, w)))
    out = np.zeros_like(m)
    for i, j in zip(*np.nonzero(element), strict=True):
        out |= p[i : i + m.shape[0], j : j + m.shape[1]]
    return out


def erode(m: np.ndarray, element: np.ndarray) -> np.ndarray:
    return ~dilate(~m, element[::-1, ::-1]) if m.size else m


def close(m: np.ndarray, element: np.ndarray, times: int = 1) -> np.ndarray:
    pad = max(element.shape) * times
    p = np.pad(m, pad)
    for _ in range(times):
        p = dilate(p, element)
    for _ in range(times):
        p = erode(p, element)
    return p[pad:-pad, pad:-pad]


def opened(m: np.ndarray, element: np.ndarray) -> np.ndarray:
    return dilate(erode(m, element), element)


def label(m: np.ndarray, connect: int = 8) -> tuple[np.ndarray, int]:
    """Connected areas numbered from 1 in reading order. Runs of rows are joined by union-find."""
    h, w = m.shape
    edge = np.diff(np.pad(m.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    rows, starts = np.nonzero(edge == 1)
    ends = np.nonzero(edge == -1)[1]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    first = np.searchsorted(rows, np.arange(h + 1))
    slack = 1 if connect == 8 else 0
    for y in range(1, h):
        i, j = first[y - 1], first[y]
        while i < first[y] and j < first[y + 1]:
            if starts[i] < ends[j] + slack and starts[j] < ends[i] + slack:
                a, b = find(i), find(j)
                if a != b:
                    up[max(a, b)] = min(a, b)
            if ends[i] < ends[j]:
                i += 1
            else:
                j += 1
    out = np.zeros((h, w), dtype=np.int32)
    number: dict[int, int] = {}
    for k in range(len(rows)):
        n = number.setdefault(find(k), len(number) + 1)
        out[rows[k], starts[k] : ends[k]] = n
    return out, len(number)


def fill_holes(m: np.ndarray) -> np.ndarray:
    p = np.pad(~m, 1, constant_values=True)
    lab, _ = label(p, 4)
    return ~(lab == lab[0, 0])[1:-1, 1:-1]


def clear_border(m: np.ndarray, inset: int) -> np.ndarray:
    """Areas that come within `inset` of the border go."""
    lab, n = label(m, 8)
    edge = np.ones(m.shape, dtype=bool)
    if min(m.shape) > 2 * inset:
        edge[inset:-inset or None, inset:-inset or None] = False
    keep = np.ones(n + 1, dtype=bool)
    keep[np.unique(lab[edge])] = False
    keep[0] = False
    return keep[lab]


def distance(m: np.ndarray) -> np.ndarray:
    """I8: exact Euclidean distance of each pixel to the nearest one outside; outside the frame does not count, unless there is nothing else."""
    h, w = m.shape
    if m.all():
        m = np.pad(m, 1)
        return distance(m)[1:-1, 1:-1]
    far = h + w
    up = np.where(m, far, 0).astype(np.int64)
    for y in range(1, h):
        up[y] = np.minimum(up[y], up[y - 1] + 1)
    for y in range(h - 2, -1, -1):
        up[y] = np.minimum(up[y], up[y + 1] + 1)
    d2 = up.astype(np.float64) ** 2
    out = d2.copy()
    reach = int(np.sqrt(d2[d2 < far * far].max())) + 1 if (d2 < far * far).any() else w
    for s in range(1, min(w, max(reach, w if (d2 >= far * far).any() else reach))):
        np.minimum(out[:, s:], d2[:, :-s] + s * s, out=out[:, s:])
        np.minimum(out[:, :-s], d2[:, s:] + s * s, out=out[:, :-s])
    return np.sqrt(out)


def mask_of(contour: np.ndarray, shape: tuple[int, int] | None = None, origin: tuple[int, int] = (0, 0)) -> np.ndarray:
    """The filled polygon of points (x, y), its outline included; on its bounding box, or on a frame."""
    c = np.asarray(contour, dtype=np.int64).reshape(-1, 2)
    if shape is None:
        origin = tuple(c.min(axis=0))
        shape = tuple((c.max(axis=0) - c.min(axis=0) + 1)[::-1])
    c = c - np.array(origin)
    h, w = shape
    out = np.zeros((h, w), dtype=bool)
    nxt = np.roll(c, -1, axis=0)
    ys = np.arange(h)
    for y in ys:
        a, b = c[:, 1], nxt[:, 1]
        cross = ((a <= y) & (b > y)) | ((b <= y) & (a > y))
        if cross.any():
            x = np.sort(c[cross, 0] + (y - a[cross]) * (nxt[cross, 0] - c[cross, 0]) / (b[cross] - a[cross]))
            for p, q in zip(x[::2], x[1::2], strict=False):
                out[y, max(int(np.ceil(p)), 0) : max(min(int(np.floor(q)) + 1, w), 0)] = True
    for p, q in zip(c, nxt, strict=True):
        n = int(np.abs(q - p).max()) + 1
        line = np.rint(np.linspace(p, q, n)).astype(int)
        ok = (line[:, 0] >= 0) & (line[:, 0] < w) & (line[:, 1] >= 0) & (line[:, 1] < h)
        out[line[ok, 1], line[ok, 0]] = True
    return out


_AROUND = [(1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1)]


def trace(m: np.ndarray) -> np.ndarray:
    """The outer border of the one area in a mask, points (x, y) clockwise on the screen from its first pixel in reading order."""
    p = np.pad(m, 1)
    ys, xs = np.nonzero(p)
    if not len(ys):
        return np.zeros((0, 2), dtype=np.int32)
    start = (int(xs[0]), int(ys[0]))
    out, at, come = [start], start, 4
    first = None
    while True:
        for k in range(1, 9):
            d = (come + k) % 8
            nx, ny = at[0] + _AROUND[d][0], at[1] + _AROUND[d][1]
            if p[ny, nx]:
                break
        else:
            break
        if first is None:
            first = (at, d)
        elif (at, d) == first:
            out.pop()
            break
        at, come = (nx, ny), (d + 4) % 8
        out.append(at)
    return np.array(out, dtype=np.int32) - 1


def contours(m: np.ndarray) -> list[np.ndarray]:
    """Outer borders of all areas."""
    lab, n = label(m, 8)
    out = []
    ys, xs = np.nonzero(lab)
    order = np.argsort(lab[ys, xs], kind="stable")
    ys, xs = ys[order], xs[order]
    cuts = np.searchsorted(lab[ys, xs], np.arange(1, n + 2))
    for k in range(n):
        y, x = ys[cuts[k] : cuts[k + 1]], xs[cuts[k] : cuts[k + 1]]
        box = lab[y.min() : y.max() + 1, x.min() : x.max() + 1] == k + 1
        out.append(trace(box) + np.array([x.min(), y.min()], dtype=np.int32))
    return out


def area(c: np.ndarray) -> float:
    x, y = np.asarray(c, dtype=np.float64).reshape(-1, 2).T
    return float(abs((x * np.roll(y, -1) - np.roll(x, -1) * y).sum()) / 2)


def arc_length(c: np.ndarray) -> float:
    p = np.asarray(c, dtype=np.float64).reshape(-1, 2)
    return float(np.hypot(*(np.roll(p, -1, axis=0) - p).T).sum())


def centroid(c: np.ndarray) -> tuple[int, int]:
    """Row and column of the polygon's centre, cut to whole pixels; of a line, the mean point."""
    x, y = np.asarray(c, dtype=np.float64).reshape(-1, 2).T
    cross = x * np.roll(y, -1) - np.roll(x, -1) * y
    a = cross.sum()
    if a == 0:
        return int(y.mean()), int(x.mean())
    return int(((y + np.roll(y, -1)) * cross).sum() / (3 * a)), int(((x + np.roll(x, -1)) * cross).sum() / (3 * a))


def inner_point(c: np.ndarray) -> tuple[int, int]:
    """x, y of the pixel of a polygon farthest from its outline (the pole of inaccessibility, to a pixel)."""
    m = np.pad(mask_of(c), 1)
    d = distance(m)
    y, x = np.unravel_index(int(d.argmax()), d.shape)
    lo = np.asarray(c).reshape(-1, 2).min(axis=0)
    return int(x - 1 + lo[0]), int(y - 1 + lo[1])


def dilated(c: np.ndarray, size: int = 5) -> np.ndarray:
    """A contour grown by a structuring element and smoothed."""
    pad = 2 * size
    lo = np.asarray(c).reshape(-1, 2).min(axis=0)
    m = np.pad(mask_of(c), pad)
    grown = close(dilate(m, ellipse(size)), ellipse(size))
    found = contours(grown)
    return max(found, key=area) - pad + lo if found else np.asarray(c)


def curvature(c: np.ndarray, smooth: float = 2.0) -> np.ndarray:
    """Signed curvature along a closed contour, of its points smoothed by a Gaussian around the ring."""
    p = np.asarray(c, dtype=np.float64).reshape(-1, 2)
    n = len(p)
    f = np.fft.fftfreq(n) * 2 * np.pi
    g = np.fft.fft(p, axis=0) * np.exp(-((f * smooth) ** 2) / 2)[:, None]
    d1, d2 = np.fft.ifft(g * (1j * f)[:, None], axis=0).real, np.fft.ifft(g * (-(f**2))[:, None], axis=0).real
    speed = np.hypot(*d1.T)
    return (d1[:, 0] * d2[:, 1] - d1[:, 1] * d2[:, 0]) / np.maximum(speed**3, 1e-9)


def pinches(k: np.ndarray, height: float = 0.1, apart: int = 10) -> np.ndarray:
    """Peaks of inward curvature on a ring, the higher ones first in keeping their distance."""
    v = -k
    peak = np.flatnonzero((v > np.roll(v, 1)) & (v >= np.roll(v, -1)) & (v >= height))
    keep: list[int] = []
    for i in sorted(peak, key=lambda j: -v[j]):
        if all(min(abs(i - j), len(v) - abs(i - j)) >= apart for j in keep):
            keep.append(int(i))
    return np.array(sorted(keep), dtype=int)


def across(c: np.ndarray, i: int, reach: float, apart: int, around: int = 5) -> tuple[float, int, int] | None:
    """From point i of a contour to the nearest one within reach that is more than `apart` away along the ring, both then moved by up to `around` places, not past the contour's ends, to where they are nearest: distance and indices."""
    n = len(c)
    d = np.hypot(*(c - c[i]).T)
    along = np.abs(np.arange(n) - i)
    far = np.flatnonzero((d <= reach) & (np.minimum(along, n - along) > apart))
    if not len(far):
        return None
    j = int(far[d[far].argmin()])
    p, q = (np.arange(max(0, k - around), min(n, k + around + 1)) for k in (i, j))
    between = np.hypot(*(c[p][:, None] - c[q][None]).transpose(2, 0, 1))
    at = np.unravel_index(int(between.argmin()), between.shape)
    i, j = sorted((int(p[at[0]]), int(q[at[1]])))
    return None if min(j - i, n - j + i) < apart else (float(between[at]), i, j)


def _cut(c: np.ndarray, factor: float, least: float) -> tuple[np.ndarray, np.ndarray] | None:
    n = len(c)
    if n < 20:
        return None
    sign = 1 if ((c[:, 0] * np.roll(c[:, 1], -1) - np.roll(c[:, 0], -1) * c[:, 1]).sum()) > 0 else -1
    at = pinches(sign * curvature(c))
    if not len(at):
        return None
    reach = 2 * float(distance(np.pad(mask_of(c), 1)).max()) * factor
    pairs = [across(c, int(i), reach, max(n // 5, 10)) for i in at]
    for _, i, j in sorted((p for p in pairs if p), key=lambda p: p[0]):
        one, two = np.concatenate([c[:i], c[j + 1 :]]), c[i + 1 : j]
        if len(one) > 2 and len(two) > 2 and area(one) >= least and area(two) >= least:
            return one, two
    return None


def split(c: np.ndarray, factor: float, least: float) -> list[np.ndarray]:
    """A contour cut in two between a pinch and the near contour on its other side, if both parts are large enough, again and again until nothing can be cut."""
    left, out = [np.asarray(c).reshape(-1, 2)], []
    while left:
        c = left.pop()
        parts = _cut(c, factor, least)
        if parts is None:
            out.append(c)
        else:
            left += parts[::-1]
    return out


def watershed(m: np.ndarray, h: float = 1.0) -> np.ndarray:
    """Labels of a mask by flooding its distances from the maxima that stand out by h."""
    import heapq

    d = distance(m) if m.any() else np.zeros(m.shape)
    seed = np.where(m, d - h, -np.inf)
    rec = seed.copy()
    for _ in range(m.size):  # reconstruction of d - h under d
        p = np.pad(rec, 1, constant_values=-np.inf)
        grown = np.max([p[1 + y : 1 + y + m.shape[0], 1 + x : 1 + x + m.shape[1]] for x in (-1, 0, 1) for y in (-1, 0, 1)], axis=0)
        new = np.where(m, np.minimum(grown, d), -np.inf)
        if np.array_equal(new, rec):
            break
        rec = new
    lab, _ = label(m & (d - np.where(m, rec, 0) >= h - 1e-9), 8)
    heap = [(-d[y, x], int(y), int(x)) for y, x in zip(*np.nonzero(lab), strict=True)]
    heapq.heapify(heap)
    while heap:
        _, y, x = heapq.heappop(heap)
        for dx, dy in _AROUND:
            a, b = y + dy, x + dx
            if 0 <= a < m.shape[0] and 0 <= b < m.shape[1] and m[a, b] and not lab[a, b]:
                lab[a, b] = lab[y, x]
                heapq.heappush(heap, (-d[a, b], a, b))
    return lab


def band(n: int, k: int = 0) -> np.ndarray:
    """Pairs (i, j) of n points on a ring, i before j, at least k apart either way round."""
    apart = np.arange(n)[None, :] - np.arange(n)[:, None]
    return (apart >= k) & (apart < n - k)
