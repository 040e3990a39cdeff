"""Cox proportional hazards from risk-set sums."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitframe.scaling import CELLS_PER_TASK, prefix_sums
from visitframe.session import stage


class CoxModel:
    """Coefficients with their covariance; `table` gives hazard ratios with 95% limits."""

    def __init__(self, features: Sequence[str], beta: np.ndarray, cov: np.ndarray, loglik: float, gradient: np.ndarray,
                 n: int = 0, events: int = 0, times: int = 0):
        self.features, self.beta, self.cov, self.loglik, self.gradient = list(features), beta, cov, loglik, gradient
        self.n, self.events, self.times = n, events, times

    def table(self, spark) -> DataFrame:
        se = np.sqrt(np.diag(self.cov))
        rows = [(f, float(b), float(np.exp(b)), float(np.exp(b - 1.96 * s)), float(np.exp(b + 1.96 * s))) for f, b, s in zip(self.features, self.beta, se)]
        return spark.createDataFrame(rows, "feature string, coef double, hazard_ratio double, lower double, upper double")

    def risk(self):
        """Partial hazard as a column expression."""
        out = F.lit(0.0)
        for f, b in zip(self.features, self.beta):
            out = out + F.col(f) * F.lit(float(b))
        return F.exp(out)


#: tied deaths that one row of a risk set stands for
TIES = 10_000


def _tie_sums(ties: str) -> list:
    """Per risk set, over its d deaths with shares a = 0, 1/d, ... of tied risk: sums of ln(s0 - a d0) and of a^k / (s0 - a d0)^m.

    A time with many deaths is cut into chunks of `TIES`; the sums are additive over them.
    """
    if ties == "breslow":
        shares = F.array(F.struct(F.lit(0.0).alias("a"), F.col("d").cast("double").alias("n")))
    else:
        last = F.least(F.col("d"), (F.col("chunk") + 1) * TIES) - 1
        shares = F.transform(F.sequence(F.col("chunk") * TIES, last), lambda l: F.struct((l / F.col("d")).alias("a"), F.lit(1.0).alias("n")))
    left = lambda s: F.col("r_s0") - s["a"] * F.col("d0")
    term = {"L": lambda s: F.ln(left(s)), "A0": lambda s: 1 / left(s), "A1": lambda s: s["a"] / left(s),
            "B0": lambda s: 1 / left(s) ** 2, "B1": lambda s: s["a"] / left(s) ** 2, "B2": lambda s: s["a"] ** 2 / left(s) ** 2}
    return [F.aggregate(shares, F.lit(0.0), lambda acc, s: acc + s["n"] * f(s)).alias(k) for k, f in term.items()]


def fit_cox(df: DataFrame, features: Sequence[str], time: str = "time", event: str = "event", ridge: float = 0.05,
            steps: int = 50, tol: float = 1e-8, ties: str = "efron") -> CoxModel:
    """Newton steps on the partial likelihood, with a ridge penalty on the mean log likelihood.

    Each step reduces the rows to one row of sums per distinct time, forms the risk sets by a prefix sum and brings
    back one gradient and Hessian, whose size depends on the features only. Times are real numbers; where one task cannot
    hold the distinct ones, the prefix sum runs in buckets. `ties` is `efron` or `breslow`. A step that lowers the
    likelihood is halved; a fit that has not settled after `steps` evaluations raises an error (without a ridge, a feature
    that separates the events has no finite coefficient). Rows with an unknown value are left out.
    """
    if ties not in ("efron", "breslow"):
        raise ValueError(f"unknown handling of ties: {ties}")
    p = len(features)
    d = stage(df.select(*[F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)], F.col(time).cast("double").alias("t"),
                        F.col(event).cast("double").alias("e")).dropna(), "cox")
    size = d.agg(F.count("*").alias("n"), F.sum("e").alias("events"), F.count_distinct("t").alias("times")).first()
    n = size["n"]
    if not size["events"]:
        raise ValueError("no event among the rows")
    bounded = size["times"] <= CELLS_PER_TASK
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    names = ["s0", *[f"s1_{i}" for i in range(p)], *[f"s2_{i}_{j}" for i, j in pairs]]

    def at(beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Penalised log likelihood, its gradient and its negative Hessian."""
        eta = F.lit(0.0)
        for i, b in enumerate(beta):
            eta = eta + F.col(f"x{i}") * F.lit(float(b))
        h, e = F.exp(eta), F.col("e")
        values = {"s0": h} | {f"s1_{i}": h * F.col(f"x{i}") for i in range(p)} | {f"s2_{i}_{j}": h * F.col(f"x{i}") * F.col(f"x{j}") for i, j in pairs}
        sums = [F.sum("e").alias("d"), F.sum(e * eta).alias("de"), *[F.sum(e * F.col(f"x{i}")).alias(f"ex_{i}") for i in range(p)]]
        sums += [F.sum(v).alias(c) for c, v in values.items()] + [F.sum(e * v).alias(f"d{c[1:]}") for c, v in values.items()]
        sets = prefix_sums(d.groupBy("t").agg(*sums), [], "t", names, bounded=bounded).where("d > 0")
        sets = sets.select("t", F.col("d").cast("long").alias("d"), "de", *[f"ex_{i}" for i in range(p)], *[f"d{c[1:]}" for c in names],
                           *[(F.col(f"{c}_total") - F.col(f"{c}_before")).alias(f"r_{c}") for c in names])
        if ties == "efron":
            sets = sets.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("d") - 1) / TIES)))).repartition("t", "chunk")
        else:
            sets = sets.withColumn("chunk", F.lit(0).cast("long"))
        sets = sets.select("*", *_tie_sums(ties))
        once = lambda c: F.when(F.col("chunk") == 0, F.col(c)).otherwise(0.0)
        C = F.col
        out = sets.agg(
            F.sum(once("de") - C("L")).alias("ll"),
            *[F.sum(once(f"ex_{i}") - C(f"r_s1_{i}") * C("A0") + C(f"d1_{i}") * C("A1")).alias(f"g_{i}") for i in range(p)],
            *[F.sum(C(f"r_s2_{i}_{j}") * C("A0") - C(f"d2_{i}_{j}") * C("A1") - C(f"r_s1_{i}") * C(f"r_s1_{j}") * C("B0")
                    + (C(f"r_s1_{i}") * C(f"d1_{j}") + C(f"d1_{i}") * C(f"r_s1_{j}")) * C("B1") - C(f"d1_{i}") * C(f"d1_{j}") * C("B2")).alias(f"h_{i}_{j}")
              for i, j in pairs]).first()
        g = np.array([out[f"g_{i}"] for i in range(p)]) - n * ridge * beta
        H = np.array([[out[f"h_{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)]) + n * ridge * np.eye(p)
        return float(out["ll"]) - 0.5 * n * ridge * float(beta @ beta), g, H

    beta, before = np.zeros(p), None
    for _ in range(steps):
        ll, g, H = at(beta)
        if before is not None and not ll >= before[1] - 1e-10 * abs(before[1]):
            beta = (beta + before[0]) / 2
            continue
        step = np.linalg.solve(H, g)
        if np.max(np.abs(step)) < tol:
            return CoxModel(features, beta, np.linalg.inv(H), ll + 0.5 * n * ridge * float(beta @ beta), g, n, int(size["events"]), size["times"])
        before = (beta, ll)
        beta = beta + step
    raise RuntimeError(f"the hazard model did not settle in {steps} evaluations")
