"""Additive contributions of a linear model and what can be read from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from visitframe.functions.columns import edge_bin, quantile_edges
from visitframe.operators.correlation import weighted_corr
from visitframe.scaling import small_side


def contributions(df: DataFrame, coefs: dict[str, float], keys: Sequence[str], raw: dict[str, str] | None = None) -> DataFrame:
    """(row, feature, value, contribution): coefficient × standardised value, in place."""
    items = [F.struct(F.lit(f).alias("feature"), F.col((raw or {}).get(f, f)).cast("double").alias("value"),
                      (F.col(f) * F.lit(float(c))).alias("contribution")) for f, c in coefs.items()]
    return df.select(*keys, F.inline(F.array(*items)))


def linear_coefs(score) -> dict[str, float]:
    """Names and coefficients of a fitted logistic scorer."""
    return dict(zip(score.design.prep.columns, map(float, score.model.coefficients)))


def importance(contrib: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean absolute contribution per feature."""
    return contrib.groupBy(*by, "feature").agg(F.avg(F.abs("contribution")).alias("importance"))


def group_of(groups: dict[str, Sequence[str]]) -> Column:
    out = F
    for g, fs in groups.items():
        out = out.when(F.col("feature").isin(list(fs)), g)
    return out


def group_importance(imp: DataFrame, groups: dict[str, Sequence[str]], by: Sequence[str] = ()) -> DataFrame:
    """Importance summed over the features of each group."""
    return imp.groupBy(*by, group_of(groups).alias("grp")).agg(F.sum("importance").alias("importance"))


def ranks(imp: DataFrame, by: Sequence[str]) -> DataFrame:
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    return imp.withColumn("rank", F.row_number().over(w.orderBy(F.col("importance").desc(), "feature")))


def stability(main: DataFrame, refits: DataFrame, refit: str = "refit", top: int = 10) -> DataFrame:
    """Per refit: rank correlation with the main model and overlap of the leading features.

    Tables here have one row per feature (and refit), so they are short.
    """
    m = ranks(main, []).select("feature", F.col("rank").alias("r0"))
    j = ranks(refits, [refit]).join(m, "feature").withColumn("one", F.lit(1))
    rho = weighted_corr(j, [refit], "rank", "r0", "one").select(refit, F.col("r").alias("spearman"))
    overlap = j.groupBy(refit).agg(F.count_if((F.col("rank") <= top) & (F.col("r0") <= top)).alias("top_overlap"))
    return rho.join(overlap, refit)


def rank_range(refits: DataFrame, refit: str = "refit") -> DataFrame:
    return ranks(refits, [refit]).groupBy("feature").agg(F.min("rank").alias("best_rank"), F.max("rank").alias("worst_rank"))


def group_share_range(refits: DataFrame, groups: dict[str, Sequence[str]], refit: str = "refit") -> DataFrame:
    g = group_importance(refits, groups, [refit])
    share = g.withColumn("share", F.col("importance") / F.sum("importance").over(Window.partitionBy(refit)))
    return share.groupBy("grp").agg(F.min("share").alias("min_share"), F.max("share").alias("max_share"))


def dependence(contrib: DataFrame, q: int = 8, few: int = 5, min_n: int = 20) -> DataFrame:
    """Mean contribution by value bin: single values if there are few, else quantile bins; a row for missing values.

    All features share one pass for the edges and one for the bins.
    """
    known = contrib.where("value IS NOT NULL")
    distinct = known.groupBy("feature", "value").agg(F.lit(1).alias("one")).groupBy("feature").agg(F.sum("one").alias("n_values"))
    edges = quantile_edges(known, "value", q, ["feature"])
    facts = distinct.join(edges, "feature")
    d = contrib.join(small_side(facts, "dependence"), "feature", "left")
    b = F.when(F.col("value").isNull(), F.lit(-1.0)).when(F.col("n_values") <= few, F.col("value")).otherwise(edge_bin(F.col("value"), F.col("edges")).cast("double"))
    t = d.groupBy("feature", F.col("value").isNull().alias("missing"), b.alias("bin")).agg(
        F.count("*").alias("n"), F.avg("value").alias("mean_value"), F.avg("contribution").alias("mean_contribution"))
    return t.where((F.col("n") >= min_n) | F.col("missing"))
