"""Cox regression against a plain likelihood: tied deaths, real-valued times, penalties, fits that cannot settle."""

import numpy as np
import pytest

from visitframe.operators import survival


def sample(n, seed, decimals):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 2))
    t = np.round(rng.exponential(np.exp(-x[:, 0])) * 5, decimals)
    return x, t, (rng.random(n) < 0.7).astype(int)


def frame(spark, x, t, e):
    return spark.createDataFrame([(float(a), float(b), float(c), int(d)) for (a, b), c, d in zip(x, t, e)], "a double, b double, time double, event int")


def plain(x, t, e, beta, ridge=0.0):
    """Efron's log likelihood, written as it is defined."""
    eta = x @ beta
    total = 0.0
    for when in np.unique(t[e == 1]):
        dead, risk = (t == when) & (e == 1), np.exp(eta[t >= when]).sum()
        tied, d = np.exp(eta[dead]).sum(), dead.sum()
        total += eta[dead].sum() - sum(np.log(risk - l / d * tied) for l in range(d))
    return total - 0.5 * len(t) * ridge * beta @ beta


@pytest.mark.parametrize("decimals, ridge, ties", [(0, 0.0, 10_000), (0, 0.05, 3), (3, 0.05, 10_000)])
def test_fit_is_the_top_of_the_plain_likelihood(spark, monkeypatch, decimals, ridge, ties):
    monkeypatch.setattr(survival, "TIES", ties)
    x, t, e = sample(120, 4, decimals)
    m = survival.fit_cox(frame(spark, x, t, e), ["a", "b"], ridge=ridge)
    assert np.max(np.abs(m.gradient)) < 1e-5 and m.events == e.sum() and m.times == len(np.unique(t))
    assert m.loglik == pytest.approx(plain(x, t, e, m.beta), abs=1e-6)
    step, shift = 1e-4, np.eye(2)
    for i in range(2):
        slope = (plain(x, t, e, m.beta + step * shift[i], ridge) - plain(x, t, e, m.beta - step * shift[i], ridge)) / (2 * step)
        assert abs(slope) < 1e-3
    f = lambda a, b: plain(x, t, e, m.beta + a * step * shift[0] + b * step * shift[1], ridge)
    hessian = np.array([[2 * f(0, 0) - f(1, 0) - f(-1, 0), (f(1, -1) + f(-1, 1) - f(1, 1) - f(-1, -1)) / 4], [0, 2 * f(0, 0) - f(0, 1) - f(0, -1)]]) / step**2
    hessian[1, 0] = hessian[0, 1]
    assert np.linalg.inv(m.cov) == pytest.approx(hessian, rel=1e-2, abs=0.05)


def test_many_distinct_times_run_in_buckets(spark, monkeypatch):
    x, t, e = sample(400, 5, 9)
    df = frame(spark, x, t, e)
    whole = survival.fit_cox(df, ["a", "b"])
    monkeypatch.setattr(survival, "CELLS_PER_TASK", 50)
    monkeypatch.setattr("visitframe.scaling.CELLS_PER_TASK", 50)
    assert survival.fit_cox(df, ["a", "b"]).beta == pytest.approx(whole.beta, abs=1e-8)


def test_fits_that_cannot_settle_raise(spark):
    rows = spark.createDataFrame([(float(i), float(i), float(10 - i), 1) for i in range(8)], "a double, b double, time double, event int")
    with pytest.raises((RuntimeError, np.linalg.LinAlgError)):
        survival.fit_cox(rows, ["a"], ridge=0.0, steps=4)
    with pytest.raises(ValueError, match="no event"):
        survival.fit_cox(rows.selectExpr("a", "time", "0 AS event"), ["a"])
