"""Adjusted scores: regression norms per test, and standardisation within groups."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitframe.functions.columns import clip, row_mean
from visitframe.operators.profile import unpivot
from visitframe.scaling import small_side


def fit_norms(df: DataFrame, tests: Sequence[str], covs: Sequence[str], where: Column | None = None) -> DataFrame:
    """One regression per test on the covariates in the reference rows: n, coefficients, residual sd.

    The data are reduced to sums of products per test by a grouped aggregation;
    only those few numbers per test reach the small solve.
    """
    ref = df if where is None else df.where(where)
    long = unpivot(ref, covs, tests, name="test", value="y").dropna(subset=[*covs, "y"])
    # a shift near the data keeps the sums of squares well conditioned
    shifts = ref.agg(*[F.avg(c).alias(c) for c in covs])
    long = long.withColumn("__s", shifts.select(F.struct(*covs)).scalar())
    x = [F.lit(1.0), *[F.col(c).cast("double") - F.col(f"__s.{c}") for c in covs], F.col("y")]
    k = len(covs) + 1
    sums = [F.sum(x[i] * x[j]).alias(f"m_{i}_{j}") for i in range(k + 1) for j in range(i, k + 1)]
    agg = long.groupBy("test").agg(*sums, *[F.first(F.col(f"__s.{c}")).alias(f"s_{c}") for c in covs])
    schema = "test string, n long, intercept double, " + "".join(f"{c} double, " for c in covs) + "resid_sd double"

    def solve(batches):
        for pdf in batches:
            out = []
            for _, r in pdf.iterrows():
                m = np.array([[r[f"m_{min(i, j)}_{max(i, j)}"] for j in range(k + 1)] for i in range(k + 1)], dtype=float)
                beta = np.linalg.lstsq(m[:k, :k], m[:k, k], rcond=None)[0]
                rss = max(m[k, k] - 2 * beta @ m[:k, k] + beta @ m[:k, :k] @ beta, 0.0)
                n = int(m[0, 0])
                intercept = beta[0] - sum(b * r[f"s_{c}"] for b, c in zip(beta[1:], covs))
                sd = float(np.sqrt(rss / (n - k))) if n > k else None
                out.append([r["test"], n, float(intercept), *map(float, beta[1:]), sd])
            yield pd.DataFrame(out, columns=["test", "n", "intercept", *covs, "resid_sd"])

    return agg.mapInPandas(solve, schema)


def apply_norms(df: DataFrame, norms: DataFrame, keys: Sequence[str], domains: dict[str, Sequence[str]], covs: Sequence[str],
                higher_is_worse: Sequence[str] = (), limit: float = 5.0) -> DataFrame:
    """`z_<test>` (signed, clipped) and `z_<domain>` (mean of the known tests).

    Norms hold one row per test; they travel as one map in a scalar subquery.
    """
    tests = [t for ts in domains.values() for t in ts]
    table = norms.agg(F.map_from_entries(F.collect_list(F.struct("test", F.struct("intercept", *covs, "resid_sd")))).alias("m"))
    df = df.withColumn("__m", table.scalar())
    z = {}
    for t in tests:
        n = F.col("__m")[t]
        expected = n["intercept"]
        for c in covs:
            expected = expected + n[c] * F.col(c)
        raw = (F.col(t) - expected) / n["resid_sd"]
        z[f"z_{t}"] = clip(-raw if t in higher_is_worse else raw, -limit, limit)
    df = df.withColumns(z).drop("__m")
    return df.withColumns({f"z_{d}": row_mean([f"z_{t}" for t in ts]) for d, ts in domains.items()})


def fit_group_z(df: DataFrame, group: str, cols: Sequence[str], where: Column | None = None) -> DataFrame:
    ref = df if where is None else df.where(where)
    return ref.groupBy(group).agg(*[a for c in cols for a in (F.avg(c).alias(f"mean_{c}"), F.stddev_samp(c).alias(f"sd_{c}"))])


def apply_group_z(df: DataFrame, params: DataFrame, group: str, cols: Sequence[str]) -> DataFrame:
    j = df.join(small_side(params, "group-z"), group, "left").withColumns({f"{c}_z": F.try_divide(F.col(c) - F.col(f"mean_{c}"), F.col(f"sd_{c}")) for c in cols})
    return j.drop(*[f"{p}_{c}" for c in cols for p in ("mean", "sd")])
