"""Gaussian processes for derivatives of noisy series."""

from __future__ import annotations

import numpy as np


class SquaredExponential:
    """K12. Parameters are logarithms: amplitude, inverse squared length."""

    bounds = ((-5, 5), (-6, 2))

    def k(self, x, y, p, dx=0, dy=0):
        """Derivatives of order dx in x and dy in y, up to 2 each."""
        a, b = np.exp(p[0]), np.exp(p[1])
        r = x[:, None] - y[None, :]
        u = b * r * r
        base = a * np.exp(-u / 2)
        n = dx + dy
        if n == 0:
            return base
        herm = {1: lambda: -b * r, 2: lambda: b * (u - 1), 3: lambda: b * b * r * (3 - u), 4: lambda: b * b * (u * u - 6 * u + 3)}[n]()
        return base * herm * (-1) ** dy

    def grad(self, x, p):
        k = self.k(x, x, p)
        r = x[:, None] - x[None, :]
        return [k, -k * np.exp(p[1]) * r * r / 2]


class Matern52:
    """K14."""

    bounds = ((-5, 5), (-6, 2))

    def k(self, x, y, p, dx=0, dy=0):
        a, s = np.exp(p[0]), np.sqrt(5.0 * np.exp(p[1]))
        r = x[:, None] - y[None, :]
        q, sign = s * np.abs(r), np.sign(r)
        e = a * np.exp(-q)
        n = dx + dy
        d = {0: 1 + q + q * q / 3, 1: -s * sign * q * (1 + q) / 3, 2: -s * s * (1 + q - q * q) / 3, 3: s**3 * sign * q * (3 - q) / 3, 4: s**4 * (3 - 5 * q + q * q) / 3}[n]
        return e * d * (-1) ** dy

    def grad(self, x, p):
        return _numeric(self, x, p)


class Linear:
    """A + b x y."""

    bounds = ((-5, 5), (-5, 5))

    def k(self, x, y, p, dx=0, dy=0):
        a, b = np.exp(p[0]), np.exp(p[1])
        one = np.ones((len(x), len(y)))
        if dx > 1 or dy > 1:
            return 0 * one
        if dx and dy:
            return b * one
        if dx:
            return b * one * y[None, :]
        if dy:
            return b * one * x[:, None]
        return a + b * x[:, None] * y[None, :]

    def grad(self, x, p):
        return [np.exp(p[0]) * np.ones((len(x), len(x))), np.exp(p[1]) * x[:, None] * x[None, :]]


class SquaredExponentialLinear:
    """K13."""

    bounds = SquaredExponential.bounds + Linear.bounds

    def k(self, x, y, p, dx=0, dy=0):
        return SquaredExponential().k(x, y, p[:2], dx, dy) + Linear().k(x, y, p[2:], dx, dy)

    def grad(self, x, p):
        return SquaredExponential().grad(x, p[:2]) + Linear().grad(x, p[2:])


class NeuralNetwork:
    """asin(2 (a + b x y) / sqrt((1 + 2 (a + b x^2)) (1 + 2 (a + b y^2)))). Derivatives by central differences."""

    bounds = ((-1, 5), (-5, 5))

    def k(self, x, y, p, dx=0, dy=0):
        a, b = np.exp(p[0]), np.exp(p[1])

        def f(u, v):
            top = 2 * (a + b * u[:, None] * v[None, :])
            return np.arcsin(np.clip(top / np.sqrt((1 + 2 * (a + b * u * u))[:, None] * (1 + 2 * (a + b * v * v))[None, :]), -1, 1))

        h = 1e-2
        steps = {0: ((0, 1.0),), 1: ((-1, -0.5 / h), (1, 0.5 / h)), 2: ((-1, 1 / h**2), (0, -2 / h**2), (1, 1 / h**2))}
        return sum(wi * wj * f(x + i * h, y + j * h) for i, wi in steps[dx] for j, wj in steps[dy])

    def grad(self, x, p):
        return _numeric(self, x, p)


def _numeric(kernel, x, p, h=1e-5):
    out = []
    for i in range(len(p)):
        q = np.array(p, dtype=float)
        q[i] += h
        up = kernel.k(x, x, q)
        q[i] -= 2 * h
        out.append((up - kernel.k(x, x, q)) / (2 * h))
    return out


KERNELS = {"sqexp": SquaredExponential, "matern": Matern52, "nn": NeuralNetwork, "lin": Linear, "sqexplin": SquaredExponentialLinear}
NOISE = (-5, 2)


class Process:
    def __init__(self, x: np.ndarray, y: np.ndarray, kernel: str = "sqexp"):
        self.x, self.y, self.kernel = np.asarray(x, float), np.asarray(y, float), KERNELS[kernel]()
        self.bounds = np.array([*self.kernel.bounds, NOISE], float) * np.log(10)

    def likelihood(self, p: np.ndarray) -> tuple[float, np.ndarray]:
        """K5, K6: minus the log marginal likelihood, and its gradient."""
        n = len(self.x)
        noise = np.exp(p[-1])
        k = self.kernel.k(self.x, self.x, p[:-1]) + noise * np.eye(n)
        low = np.linalg.cholesky(k)
        inv = np.linalg.inv(low)
        inv = inv.T @ inv
        a = inv @ self.y
        value = 0.5 * self.y @ a + np.log(np.diag(low)).sum() + n * np.log(2 * np.pi) / 2
        w = inv - np.outer(a, a)
        return float(value), np.array([0.5 * (w * g).sum() for g in [*self.kernel.grad(self.x, p[:-1]), noise * np.eye(n)]])

    def fit(self, runs: int = 5, seed: int = 0) -> np.ndarray:
        """K7: the best of several descents from drawn starts within bounds. None that converges is an error."""
        if not fit_all([self], runs, [seed])[0]:
            raise ValueError("no descent converged")
        return self.p

    def predict(self, at: np.ndarray, orders: tuple[int, ...] = (0, 1, 2)) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """K8: mean, variance and covariance of the function and its derivatives."""
        at, p = np.asarray(at, float), self.p[:-1]
        k = self.kernel.k(self.x, self.x, p) + np.exp(self.p[-1]) * np.eye(len(self.x))
        low = _inverse(np.linalg.cholesky(k)[None])[0]
        a = low.T @ (low @ self.y)
        out = []
        for d in orders:
            cross = self.kernel.k(at, self.x, p, d, 0)
            half = cross @ low.T
            cov = self.kernel.k(at, at, p, d, d) - half @ half.T
            out.append((cross @ a, np.maximum(np.diag(cov), 0), cov))
        return out

    def sample(self, at: np.ndarray, n: int, seed: int = 0, order: int = 0) -> np.ndarray:
        """K4, K9: draws from the posterior."""
        mean, _, cov = self.predict(at, (order,))[0]
        return np.random.default_rng(seed).multivariate_normal(mean, (cov + cov.T) / 2 + 1e-10 * np.eye(len(at)), size=n, method="eigh")


def _padded(n: int) -> tuple[int, int]:
    """The least size from n on that halves down to blocks of about fifteen, and how often it does."""
    times = max(0, round(np.log2(max(n, 1) / 15)))
    return -(-n >> times) << times, times


def _inverse(low: np.ndarray) -> np.ndarray:
    """The inverse of a stack of lower triangular matrices: blocks on the diagonal first, then twice as large ones from them."""
    n = low.shape[-1]
    size, times = _padded(n)
    if not times:
        return np.linalg.inv(low)
    if size > n:
        wide = np.zeros((len(low), size, size))
        wide[:, :n, :n] = low
        wide[:, range(n, size), range(n, size)] = 1
        return _inverse(wide)[:, :n, :n]
    out, of = np.zeros(low.shape), n >> times
    shape = (len(low), n // of, of, n // of, of)
    np.einsum("iajak->iajk", out.reshape(shape))[:] = np.linalg.inv(np.einsum("iajak->iajk", low.reshape(shape)))
    while of < n:
        new, old = (m.reshape(len(low), n // of // 2, 2, of, n // of // 2, 2, of) for m in (out, low))
        first, last, below, given = (np.einsum("iajak->iajk", m[:, :, x, :, :, y]) for m, x, y in ((new, 0, 0), (new, 1, 1), (new, 1, 0), (old, 1, 0)))
        np.negative(last @ (given @ first), out=below)
        of *= 2
    return out


def _cholesky(k: np.ndarray) -> np.ndarray:
    """Factors of a stack of matrices; of those that are not positive definite, NaN."""
    try:
        return np.linalg.cholesky(k)
    except np.linalg.LinAlgError:
        if len(k) == 1:
            return np.full(k.shape, np.nan)
        return np.concatenate([_cholesky(m[None]) for m in k])


#: Chebyshev nodes, and the greatest b (T / 2)^2 for which they give exp(-b (x - y)^2 / 2) on an interval of length T to rounding.
NODES = ((20, 1.0), (32, 6.0))
#: Points of a block, where b is so great that points fall into blocks.
BLOCKS = (4, 8, 16, 32)
#: Beyond this order a form with eigenvalues takes longer than it saves.
EIGEN = 128
#: An entry of exp(-u / 2) with a greater u is nothing beside the diagonal's 1 in double precision, by ten orders.
LEAST = 120.0
#: Nor is one with a greater u than this, by one order; there the matrix may be cut.
APART = 80.0


def _through(x: np.ndarray, r: int) -> tuple[np.ndarray, np.ndarray]:
    """Chebyshev nodes of the range of x, and the matrix that takes values there to the interpolating polynomial's at x."""
    angle = np.pi * (np.arange(r) + 0.5) / r
    mid, half = (x.max() + x.min()) / 2, (x.max() - x.min()) / 2
    nodes = mid + half * np.cos(angle)
    gap = x[:, None] - nodes
    hit = gap == 0
    w = (-1.0) ** np.arange(r) * np.sin(angle) / np.where(hit, 1, gap)
    w = np.where(hit.any(axis=1)[:, None], hit, w)
    return nodes, w / w.sum(axis=1, keepdims=True)


class _Squares:
    """K5, K6 of many series under the squared exponential. A series of n points has forms, and a point p takes the first whose range holds p's b: the covariance is
    Q (a R C R' + s) Q' + s (1 - QQ') with orthonormal columns Q and C the kernel between r nodes. Nodes are the distinct points (R = 1 if no point repeats) or, where
    b is small, Chebyshev nodes, which give the kernel to rounding. At the least b, C has its eigenvalues ready; where b is great, C falls into blocks."""

    def __init__(self, all_: list[Process]):
        found, groups = [], {}
        for p in all_:
            u, at = np.unique(p.x, return_inverse=True)
            least, n, nodes = p.bounds[1, 0], len(p.x), []
            for r, most in NODES:
                if len(u) > 1.25 * r:
                    nodes.append((np.log(most / ((u[-1] - u[0]) / 2) ** 2), *_projected(*_through(p.x, r), p.y)))
            nodes.append((np.inf, *_projected(u, np.eye(len(u))[at], p.y)) if len(u) < n else (np.inf, p.x, None, p.y, 0.0))
            forms = []
            first = next(x for x in nodes if x[0] >= least)
            if len(first[1]) <= EIGEN:
                forms.append((-np.inf, least, (_Fixed, len(first[1]), np.exp(least)), (*first[1:], n)))
            dense = [(-np.inf, x[0], (_Dense, _padded(len(x[1]))[0], x[2] is None), (*x[1:], n)) for x in nodes]
            forms += [*dense[:-1], *_runs(p.x, p.y), dense[-1]]
            found.append([])
            for low, high, key, data in forms:
                g = groups.setdefault(key, (len(groups), []))
                found[-1].append((low, high, g[0], len(g[1])))
                g[1].append(data)
        self.groups = [make(size, more, g) for (make, size, more), (_, g) in groups.items()]
        wide = max(map(len, found))
        found = [[*x, *[(np.inf, -np.inf, 0, 0)] * (wide - len(x))] for x in found]
        self.low, self.high, self.form, self.row = (np.array([[y[k] for y in x] for x in found]) for k in range(4))

    def __call__(self, at: np.ndarray, p: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values of series `at` at p, infinite where there is none, and gradients of those within the limit."""
        value, slope = np.full(len(at), np.inf), np.zeros(p.shape)
        j = ((p[:, 1:2] >= self.low[at]) & (p[:, 1:2] <= self.high[at])).argmax(axis=1)
        form, row = self.form[at, j], self.row[at, j]
        order = np.lexsort((p[:, 1], form))  # those with as many cells that count stand together
        for lanes in np.split(order, np.flatnonzero(np.diff(form[order])) + 1):
            group = self.groups[form[lanes[0]]]
            for b in range(0, len(lanes), group.lanes):
                c = lanes[b : b + group.lanes]
                value[c], slope[c] = group(row[c], p[c], limit[c])
        return value, slope


def _projected(nodes: np.ndarray, to: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Nodes, R, Q'y and the square of what of y is beside Q, where QR takes values at the nodes to the points."""
    q, factor = np.linalg.qr(to)
    z = q.T @ y
    return nodes, factor, z, ((y - q @ z) ** 2).sum()


def _runs(x: np.ndarray, y: np.ndarray) -> list[tuple]:
    """Forms of runs: cut where points are so far apart that nothing is between them, runs that fit are joined to blocks."""
    order = np.argsort(x, kind="stable")
    x, y = x[order], y[order]
    gaps, out = np.diff(x), []
    for size in BLOCKS:
        if len(x) < 2 * size:
            break
        far = np.lib.stride_tricks.sliding_window_view(gaps, size).max(axis=1).min()
        if far <= 0:
            continue
        cuts, starts = [*(np.flatnonzero(gaps >= far) + 1).tolist(), len(x)], [0]
        for before, after in zip(cuts, cuts[1:]):
            if after - starts[-1] > size:
                starts.append(before)
        count = np.diff([*starts, len(x)])
        at = np.repeat(np.arange(len(starts)), count), np.concatenate([np.arange(k) for k in count])
        t, z = np.tile(1e150 * np.arange(1, size + 1), (len(starts), 1)), np.zeros((len(starts), size))
        t[at], z[at] = x, y
        out.append((np.log(APART / far**2), np.inf, (_Blocks, size, None), ((t[:, :, None] - t[:, None]) ** 2, z, count)))
    return out


def _slopes(p: np.ndarray, r, n, rest, trace, qq, ww, middle) -> np.ndarray:
    s = np.exp(p[:, 2])
    return 0.5 * np.stack([r - s * trace - qq + s * ww, middle, s * (trace - ww) + n - r - rest / s], axis=1)


class _Dense:
    """Covariances on r nodes, by their Cholesky factors. Cells stand by the gap between their nodes, as those far apart hold nothing."""

    def __init__(self, size: int, _, forms: list):
        self.lanes = max(1, 160000 // max(1, size) ** 2)
        row, col = np.tril_indices(size, -1)
        out = []
        for nodes, factor, z, rest, n in forms:
            r = len(nodes)
            gaps = np.full(len(row), np.inf)
            inside = row < r
            gaps[inside] = (nodes[row[inside]] - nodes[col[inside]]) ** 2
            order = np.argsort(gaps)
            wide, full = np.zeros(size), np.zeros((size, size))
            wide[:r] = z
            if factor is not None:
                full[:r, :r] = factor
            out.append((gaps[order], row[order], col[order], full, wide, rest, r, n))
        gaps, row, col, factor, *more = (np.array(v) for v in zip(*out))
        self.all = size, gaps.min(axis=0), gaps, row, col, None if forms[0][1] is None else factor, *more

    def __call__(self, i: np.ndarray, p: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size, least, gaps, row, col, factor, z, rest, r, n = self.all
        (a, b, s), z, rest, r, n = np.exp(p.T), z[i], rest[i], r[i], n[i]
        lanes = len(i)
        many = np.searchsorted(least, LEAST / b.min())
        u, most = gaps[i, :many], LEAST / b[:, None]
        near = u < most
        u = b[:, None] * np.minimum(u, most)
        c = np.exp(u / -2)
        c *= a[:, None]
        c *= near
        row = row[i, :many]
        row += (np.arange(lanes) * size)[:, None]
        cells = row * size
        cells += col[i, :many]
        k = np.zeros((lanes, size, size))
        k.reshape(-1)[cells] = c
        diagonal = k.reshape(lanes, -1)[:, :: size + 1]
        if factor is None:
            diagonal += (a + s)[:, None]
        else:
            diagonal += a[:, None]
            factor = factor[i]
            k = factor @ (k + np.swapaxes(np.tril(k, -1), 1, 2)) @ np.swapaxes(factor, 1, 2)
            diagonal = k.reshape(lanes, -1)[:, :: size + 1]
            diagonal += s[:, None]
        if r.min() < size:
            diagonal[np.arange(size) >= r[:, None]] = 1
        root = _cholesky(k)
        inv = _inverse(root)
        q = (inv @ z[:, :, None])[:, :, 0]
        qq = np.einsum("ij,ij->i", q, q)
        v = 0.5 * (qq + rest / s) + np.log(root.reshape(lanes, -1)[:, :: size + 1]).sum(axis=1) + 0.5 * (n - r) * np.log(s) + n * np.log(2 * np.pi) / 2
        v[~np.isfinite(v)] = np.inf
        slope = np.zeros(p.shape)
        ok = np.flatnonzero((v <= limit) & (v < np.inf))
        if not len(ok):
            return v, slope
        if len(ok) < lanes:
            inv, q, qq, c, u, r, n, rest = inv[ok], q[ok], qq[ok], c[ok], u[ok], r[ok], n[ok], rest[ok]
            row, col = row[ok] - ((ok - np.arange(len(ok))) * size)[:, None], col[i[ok], :many]
            cells = row * size + col
            factor = None if factor is None else factor[ok]
        else:
            col = cells - row * size
        w = (q[:, None, :] @ inv)[:, 0]
        ww = np.einsum("ij,ij->i", w, w)
        if factor is None:
            m = np.swapaxes(inv, 1, 2) @ inv
            trace = np.einsum("ijj->i", m) - (size - r)
        else:
            trace = np.einsum("ijk,ijk->i", inv, inv) - (size - r)
            inv, w = inv @ factor, (w[:, None, :] @ factor)[:, 0]
            m = np.swapaxes(inv, 1, 2) @ inv
        c *= u
        col = col + (np.arange(len(ok)) * size)[:, None]
        w = w.reshape(-1)
        c *= m.reshape(-1)[cells] - w[row] * w[col]
        middle = -np.cumsum(c, axis=1)[:, -1] if many else np.zeros(len(ok))  # one after the other: zeros at the end, as many as the chunk has, change no digit
        slope[ok] = _slopes(p[ok], r, n, rest, trace, qq, ww, middle)
        return v, slope


class _Fixed:
    """Covariances of one b, by their eigenvalues."""

    def __init__(self, size: int, b: float, forms: list):
        self.lanes, out = max(1, 160000 // max(1, size) ** 2 * 4), []
        for nodes, factor, z, rest, n in forms:
            u = b * (nodes[:, None] - nodes) ** 2
            c = np.exp(u / -2)
            e = c * u / -2
            if factor is not None:
                c, e = factor @ c @ factor.T, factor @ e @ factor.T
            values, q = np.linalg.eigh(c)
            out.append((values, q.T @ e @ q, q.T @ z, rest, n))
        self.values, self.e, self.z, self.rest, self.n = (np.array(v) for v in zip(*out))

    def __call__(self, i: np.ndarray, p: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        (a, b, s), z, e, rest, n, r = np.exp(p.T), self.z[i], self.e[i], self.rest[i], self.n[i], self.z.shape[1]
        values = a[:, None] * self.values[i] + s[:, None]
        values[~(values > 0).all(axis=1)] = np.nan
        w = z / values
        qq = (w * z).sum(axis=1)
        v = 0.5 * (qq + rest / s + np.log(values).sum(axis=1) + (n - r) * np.log(s) + n * np.log(2 * np.pi))
        v[~np.isfinite(v)] = np.inf
        middle = a * (np.einsum("ijj,ij->i", e, 1 / values) - np.einsum("ij,ij->i", w, (e @ w[:, :, None])[:, :, 0]))
        return v, _slopes(p, r, n, rest, (1 / values).sum(axis=1), qq, (w * w).sum(axis=1), middle)


class _Blocks:
    """Covariances that fall into blocks."""

    def __init__(self, size: int, _, forms: list):
        self.count = np.array([len(f[2]) for f in forms])
        self.start = np.cumsum(self.count) - self.count
        self.gaps, self.z, real = (np.concatenate(v) for v in zip(*forms))
        self.n = np.add.reduceat(real, self.start)
        self.pad = np.arange(size) >= real[:, None]
        self.lanes = max(1, int(160000 / size**2 / self.count.mean()))

    def __call__(self, i: np.ndarray, p: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        (a, b, s), n, count = np.exp(p.T), self.n[i], self.count[i]
        start = np.cumsum(count) - count
        lane = np.repeat(np.arange(len(i)), count)
        at = np.repeat(self.start[i] - start, count) + np.arange(len(lane))
        u, pad = self.gaps[at], self.pad[at]
        size = u.shape[1]
        u *= b[lane, None, None]
        np.minimum(u, LEAST, out=u)
        c = u / -2
        np.exp(c, out=c)
        c *= a[lane, None, None]
        k = c.copy()
        diagonal = k.reshape(-1, size * size)[:, :: size + 1]
        diagonal += s[lane, None]
        diagonal[pad] = 1
        root = _cholesky(k)
        inv = _inverse(root)
        q = (inv @ self.z[at][:, :, None])[:, :, 0]
        total = lambda m: np.add.reduceat(m, start)
        qq = total((q * q).sum(axis=1))
        v = 0.5 * qq + total(np.log(root.reshape(-1, size * size)[:, :: size + 1]).sum(axis=1)) + n * np.log(2 * np.pi) / 2
        v[~np.isfinite(v)] = np.inf
        w = (q[:, None, :] @ inv)[:, 0]
        m = np.swapaxes(inv, 1, 2) @ inv
        trace = total(np.einsum("ijj->i", m) - pad.sum(axis=1))
        m -= w[:, :, None] * w[:, None, :]
        c *= u
        return v, _slopes(p, n, n, 0.0, trace, qq, total((w * w).sum(axis=1)), total(np.einsum("ijk,ijk->i", m, c)) / -2)


class _Each:
    """The same of any kernel, one by one."""

    def __init__(self, all_: list[Process]):
        self.all = all_

    def __call__(self, at, p, limit):
        value, slope = np.full(len(at), np.inf), np.zeros(p.shape)
        for i, k in enumerate(at):
            try:
                v, g = self.all[k].likelihood(p[i])
            except np.linalg.LinAlgError:
                continue
            if np.isfinite(v):
                value[i], slope[i] = v, g
        return value, slope


def fit_all(all_: list[Process], runs: int, seeds: list[int]) -> np.ndarray:
    """K7 of many series of one kernel in step: p of each is the best of its descents. Returns which have one."""
    found = np.zeros(len(all_), bool)
    able = [i for i, p in enumerate(all_) if np.isfinite(p.x).all() and np.isfinite(p.y).all()]
    if not able:
        return found
    bounds = all_[0].bounds
    f = (_Squares if isinstance(all_[0].kernel, SquaredExponential) else _Each)([all_[i] for i in able])
    draws = [np.random.default_rng(seeds[i]) for i in able]
    at = np.repeat(np.arange(len(able)), runs)
    x = np.array([d.uniform(*bounds.T) for d in draws for _ in range(runs)]).reshape(len(at), len(bounds))
    v, g = f(at, x, np.full(len(at), np.inf))
    for k in np.unique(at[~np.isfinite(v)]):  # a start may fail: that series draws again, up to five times a run
        rng = np.random.default_rng(seeds[able[k]])
        for lane in np.flatnonzero(at == k):
            for _ in range(5):
                x[lane] = rng.uniform(*bounds.T)
                v[lane : lane + 1], g[lane : lane + 1] = f(at[lane : lane + 1], x[lane : lane + 1], np.array([np.inf]))
                if np.isfinite(v[lane]):
                    break
    x, v = _descend(f, at, x, v, g, bounds)
    for k, i in enumerate(able):
        lane = k * runs + v[k * runs : (k + 1) * runs].argmin()
        if np.isfinite(v[lane]):
            all_[i].p, found[i] = x[lane], True
    return found


def _descend(f, at: np.ndarray, x: np.ndarray, v: np.ndarray, g: np.ndarray, bounds: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Quasi-Newton descents whose steps are projected on a box, all in step: each round evaluates one point of each."""
    n = x.shape[1]
    x, v, g = x.copy(), v.copy(), g.copy()
    h, d, size, turns = np.tile(np.eye(n), (len(x), 1, 1)), np.zeros(x.shape), np.zeros(len(x)), np.zeros(len(x), int)
    live = turning = np.flatnonzero(np.isfinite(v))  # of those that live, the turning ones need a direction
    while len(live):
        t = turning
        free = ~(((x[t] <= bounds[:, 0]) & (g[t] > 0)) | ((x[t] >= bounds[:, 1]) & (g[t] < 0)))
        go = (np.where(free, np.abs(g[t]), 0).max(axis=1) >= 1e-6) & (turns[t] < rounds)
        stopped, t, free = t[~go], t[go], free[go]
        turns[t] += 1
        e = np.where(free, -(h[t] @ np.where(free, g[t], 0)[:, :, None])[:, :, 0], 0)
        up = (e * g[t]).sum(axis=1) >= 0
        h[t[up]] = np.eye(n)
        d[t] = np.where(up[:, None], np.where(free, -g[t], 0), e)
        size[t] = np.minimum(1.0, 2.0 / np.abs(d[t]).max(axis=1))
        live = np.setdiff1d(live, stopped, assume_unique=True)
        if not len(live):
            break
        y = np.clip(x[live] + size[live, None] * d[live], *bounds.T)
        limit = v[live] + 1e-4 * (g[live] * (y - x[live])).sum(axis=1)
        w, k = f(at[live], y, limit)
        ok = w <= limit
        back = live[~ok]
        size[back] /= 2
        back = back[size[back] > 1e-12]
        t, y, w, k = live[ok], y[ok], w[ok], k[ok]
        s, u = y - x[t], k - g[t]
        done = v[t] - w < 1e-10 * np.maximum(1.0, np.abs(v[t]))
        x[t], v[t], g[t] = y, w, k
        su = (s * u).sum(axis=1)
        c = np.flatnonzero(su > 1e-12)
        s, u, r, o = s[c], u[c], 1 / su[c], t[c]
        a = np.eye(n) - r[:, None, None] * s[:, :, None] * u[:, None, :]
        h[o] = a @ h[o] @ np.swapaxes(a, 1, 2) + r[:, None, None] * s[:, :, None] * s[:, None, :]
        turning = t[~done]
        live = np.concatenate([turning, back])
    return x, v


def _process(t: np.ndarray, y: np.ndarray, kernel: str, logs: bool) -> Process:
    """Of the points that are no gaps. Logarithms are taken unless a value is negative; zero is an error."""
    ok = ~np.isnan(y)
    t, y = t[ok], y[ok]
    if logs and not (y < 0).any():
        if (y == 0).any():
            raise ValueError("zero has no logarithm")
        y = np.log(y)
    return Process(t, y, kernel)


def derivatives(t: np.ndarray, y: np.ndarray, kernel: str = "sqexp", logs: bool = True, runs: int = 5, seed: int = 0) -> dict[str, np.ndarray]:
    """K3: f, df, ddf and variances at all t, from points that are no gaps. Logarithms are taken unless a value is negative; zero is an error."""
    t, y = np.asarray(t, float), np.asarray(y, float)
    p = _process(t, y, kernel, logs)
    p.fit(runs, seed)
    (f, fv, _), (d, dv, _), (dd, ddv, _) = p.predict(t)
    return {"f": f, "f_var": fv, "df": d, "df_var": dv, "ddf": dd, "ddf_var": ddv}


def slopes(series: list[tuple[np.ndarray, np.ndarray]], kernel: str, runs: int, seeds: list[int]) -> list[tuple[np.ndarray, np.ndarray] | None]:
    """df and df_var of `derivatives` for many series, fitted together; None where there is no fit."""
    out, some = [None] * len(series), []
    for i, (t, y) in enumerate(series):
        try:
            some.append((i, _process(t, y, kernel, True)))
        except ValueError:
            pass
    if some:
        found = fit_all([p for _, p in some], runs, [seeds[i] for i, _ in some])
        for (i, p), ok in zip(some, found):
            if ok:
                try:
                    out[i] = p.predict(series[i][0], (1,))[0][:2]
                except np.linalg.LinAlgError:
                    pass
    return out


def statistics(t: np.ndarray, y: np.ndarray, draws: int = 100, seed: int = 0, kernel: str = "sqexp") -> dict[str, float]:
    """Mean and variance over posterior draws of the greatest slope, its time, the doubling time, the greatest value and the lag."""
    t, y = np.asarray(t, float), np.log(np.asarray(y, float))
    p = Process(t, y, kernel)
    p.fit(seed=seed)
    f, d = p.sample(t, draws, seed), p.sample(t, draws, seed, 1)
    at = d.argmax(axis=1)
    slope, value = d[np.arange(draws), at], f[np.arange(draws), at]
    found = {"max_df": slope, "max_df_time": t[at], "doubling_time": np.log(2) / slope, "max_f": f.max(axis=1), "lag_time": t[at] + (f[:, 0] - value) / slope}
    return {f"{k}_{n}": float(v) for k, x in found.items() for n, v in (("mean", x.mean()), ("var", x.var()), ("std", x.std()), ("stderr", x.std() / np.sqrt(draws)))}
