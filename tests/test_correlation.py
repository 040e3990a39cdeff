"""Correlation matrices against pairwise complete pandas results."""

import numpy as np
import pandas as pd
import pytest

from visitframe.operators import correlation


@pytest.fixture(scope="module")
def table(spark):
    """Five columns: `a`, `b` known together, `c` with holes of its own, `d` nearly constant, `e` known only where `c` is not."""
    rng = np.random.default_rng(3)
    n = 3000
    a = rng.integers(0, 40, n) / 4
    b = np.round(a + rng.normal(0, 2, n), 1) + 1e6
    c = np.where(rng.random(n) < 0.3, np.nan, np.round(-a + rng.normal(0, 3, n), 2))
    d = np.where(rng.random(n) < 0.9, 7.0, rng.integers(0, 3, n))
    e = np.where(np.isnan(c), rng.integers(0, 9, n), np.nan)
    lost = rng.random(n) < 0.2
    pdf = pd.DataFrame({"a": np.where(lost, np.nan, a), "b": np.where(lost, np.nan, b), "c": c, "d": d, "e": e})
    rows = [tuple(None if np.isnan(v) else float(v) for v in r) for r in pdf.to_numpy()]
    return spark.createDataFrame(rows, "a double, b double, c double, d double, e double").repartition(5), pdf


def wanted(pdf, method):
    out = {}
    for i, x in enumerate(pdf.columns):
        for y in pdf.columns[i + 1:]:
            both = pdf[[x, y]].dropna().rank() if method == "spearman" else pdf[[x, y]].dropna()
            if len(both):
                out[x, y] = (len(both), both[x].corr(both[y]))
    return out


@pytest.mark.parametrize("method, cells", [("pearson", None), ("spearman", None), ("spearman", 60), ("spearman", 0)])
def test_matrix_equals_pairwise_complete_results(table, monkeypatch, method, cells):
    if cells is not None:  # some or all columns are joined to their ranks
        monkeypatch.setattr(correlation, "RANK_CELLS", cells)
    df, pdf = table
    out = {(r["a"], r["b"]): (r["n"], r["r"]) for r in correlation.corr_matrix(df, list(pdf.columns), method).collect()}
    want = wanted(pdf, method)
    assert set(out) == set(want) and ("c", "e") not in out
    for k, (n, r) in want.items():
        assert out[k][0] == n and out[k][1] == pytest.approx(r, abs=1e-9)


@pytest.mark.parametrize("method", ["pearson", "spearman"])
def test_matrix_of_constants_unknowns_and_nothing(spark, method):
    rows = [(1.0, 5.0, None, 1), (1.0, 6.0, None, 2), (1.0, None, None, 3)]
    df = spark.createDataFrame(rows, "x double, y double, z double, w int")
    out = {(r["a"], r["b"]): (r["n"], r["r"]) for r in correlation.corr_matrix(df, ["x", "y", "z", "w"], method).collect()}
    assert out == {("x", "y"): (2, None), ("x", "w"): (3, None), ("y", "w"): (2, pytest.approx(1.0))}
    assert correlation.corr_matrix(df.limit(0), ["x", "y"], method).count() == 0


def test_values_that_are_not_a_number(spark):
    nan = float("nan")
    df = spark.createDataFrame([(1.0, 1.0), (2.0, nan), (3.0, 3.0), (4.0, 2.0), (float("inf"), None)], "x double, y double")
    assert correlation.corr_matrix(df, ["x", "y"], "pearson").first()["n"] == 3
    top = correlation.corr_matrix(df, ["x", "y"]).first()
    assert top["n"] == 4 and top["r"] == pytest.approx(pd.Series([1, 2, 3, 4]).corr(pd.Series([1, 4, 3, 2])))


def test_no_row_per_pair_of_columns(table):
    df, pdf = table
    plan = correlation.pearson_matrix(df, list(pdf.columns))._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and plan.count("MapInArrow") == 1
