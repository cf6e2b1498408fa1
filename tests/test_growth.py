"""Gaussian processes fitted many at a time."""

import numpy as np
import pytest

from trackfold.functions.kernels import gp
from trackfold.operators import growth


def drawn(n, seed=0, repeats=1):
    rng = np.random.default_rng(seed)
    t = np.repeat(np.sort(rng.uniform(0, 700, n)), repeats)
    return t, np.exp(rng.normal(1, 1, n * repeats))


@pytest.mark.parametrize("n, repeats", [(6, 1), (30, 1), (67, 1), (150, 1), (40, 3), (1, 7)])
def test_forms_give_the_likelihood(n, repeats):
    p = gp.Process(*drawn(n, 1, repeats))
    f = gp._Squares([p])
    rng = np.random.default_rng(2)
    for b in [p.bounds[1, 0], *rng.uniform(*p.bounds[1], 60), p.bounds[1, 1]]:
        at = np.array([rng.uniform(-2, 3), b, rng.uniform(-3, 3)])
        value, slope = p.likelihood(at)
        got, got_slope = f(np.array([0]), at[None], np.array([np.inf]))
        assert got[0] == pytest.approx(value, rel=1e-9, abs=1e-8)
        assert got_slope[0] == pytest.approx(slope, rel=1e-6, abs=1e-6)


def test_series_fitted_together_or_alone_agree():
    series = [drawn(n, n) for n in (6, 8, 23, 45, 67, 67, 99)] + [drawn(20, 5, 3)]
    seeds = list(range(len(series)))
    for (t, y), seed, got in zip(series, seeds, gp.slopes(series, "sqexp", 5, seeds)):
        alone = gp.derivatives(t, y, seed=seed)
        assert got[0] == pytest.approx(alone["df"], rel=1e-6, abs=1e-9) and got[1] == pytest.approx(alone["df_var"], rel=1e-6, abs=1e-9)


def test_the_series_beside_it_change_no_digit_of_a_fit():
    """A digit can send a descent elsewhere, and partitions decide which series are fitted together."""

    def fit(seeds):
        some = [gp._process(*drawn(67, k), "sqexp", True) for k in seeds]
        assert gp.fit_all(some, 5, seeds).all()
        return some

    together = fit(list(range(40)))
    few = [p for k in range(0, 40, 8) for p in fit(list(range(k, k + 8)))]
    assert all((a.p == b.p).all() for a, b in zip(together, few))


def test_what_cannot_be_fitted_leaves_the_rest_alone():
    t, y = drawn(12)
    bad = [np.where(t > 300, x, y) for x in (0.0, np.inf)] + [y]
    got = gp.slopes([*((t, x) for x in bad), (np.where(t > 300, np.nan, t), y)], "sqexp", 5, [0, 0, 0, 0])
    assert got[0] is None and got[1] is None and got[3] is None and np.isfinite(got[2][0]).all()
    gone = np.where(t > 300, np.nan, y)
    assert np.isfinite(gp.slopes([(t, gone)], "sqexp", 5, [0])[0][0]).all()


def test_a_start_that_fails_is_drawn_again(monkeypatch):
    first, call = [True], gp._Squares.__call__

    def failing(self, at, p, limit):
        value, slope = call(self, at, p, limit)
        if first.pop() if first else False:
            value[0] = np.inf
        return value, slope

    monkeypatch.setattr(gp._Squares, "__call__", failing)
    t, y = drawn(12)
    assert np.isfinite(gp.derivatives(t, y)["df"]).all() and not first


def test_factors_of_what_is_not_positive_definite_are_nan():
    k = np.stack([np.eye(20), -np.eye(20), 4 * np.eye(20)])
    low = gp._cholesky(k)
    assert np.isnan(low[1]).all() and (low[0] == np.eye(20)).all() and (gp._inverse(low)[2] == np.eye(20) / 2).all()


def test_a_fit_factors_few_whole_matrices(monkeypatch):
    """Ten series of 60 points with five starts each: one by one and whole they take 1206 factors of whole matrices."""
    work, cholesky = [0], np.linalg.cholesky

    def counted(k):
        work[0] += k.size * k.shape[-1]
        return cholesky(k)

    monkeypatch.setattr(np.linalg, "cholesky", counted)
    for seed in range(10):
        t, y = drawn(60, seed)
        gp.derivatives(t, y, seed=seed)
    assert work[0] / 60**3 < 500


def test_growth_rates_take_many_series_in_a_task(spark, monkeypatch):
    """Series that lie across Arrow batches come whole, with all rows and columns, short ones and those with gaps included."""
    data, want = [], {}
    for k in range(12):
        t, y = drawn(3 if k == 5 else 10 + k, k)
        v = [None if k == 7 and i < 2 else float(x) for i, x in enumerate(y)]
        data += [(f"s{k}" if k else None, i, float(a), x) for i, (a, x) in enumerate(zip(t, v))]
        want[f"s{k}" if k else None] = len(t)
    df = spark.createDataFrame(data, "s string, i long, h double, v double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = growth.growth_rates(df, ["s"], "h", ["v"]).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted((r.s or "", r.i, r.h, r.v or 0.0) for r in got) == sorted((s or "", i, h, v or 0.0) for s, i, h, v in data)
    for key in want:
        rows = sorted((r for r in got if r.s == key), key=lambda r: r.h)
        if want[key] < growth.LEAST_GROWTH:
            assert all(r.v_growth_rate is None for r in rows)
            continue
        seed = growth.zlib.crc32(repr((str(key),)).encode())
        alone = gp.derivatives(np.array([r.h for r in rows]), np.array([np.nan if r.v is None else r.v for r in rows]), seed=seed)
        assert [r.v_growth_rate for r in rows] == pytest.approx(alone["df"], rel=1e-6, abs=1e-9)
        assert [r.v_growth_rate_var for r in rows] == pytest.approx(alone["df_var"], rel=1e-6, abs=1e-9)
