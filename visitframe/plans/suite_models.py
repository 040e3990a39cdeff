"""Model, fusion, scoring and explanation queries (I1-I16)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from visitframe.operators.boosting import Booster, Settings
from visitframe.operators import explain, metrics, models, splits, survival
from visitframe.operators.profile import reference_vector
from visitframe.plans.fixtures import FEATURES, PRED
from visitframe.plans.suite import query
from visitframe.plans.suite_metrics import survival_rows
from visitframe.session import stage

GROUPS = {"money": ["acctbal", "mean_score"], "history": ["n_visits", "share_f"], "sparse": ["score_f"]}
FEATS = [f for fs in GROUPS.values() for f in fs]


def model_table(t):
    """One row per customer with features, target and split."""
    f = t.features()
    s = splits.stratified_split(f.withColumn("stratum", F.col("y")), "stratum", "models")
    return stage(f.join(s.select("entity_id", "split"), "entity_id"), "model-table")


def held_out(df, scorer):
    return metrics.ranking_metrics(metrics.score_cells(scorer(df.where("split IN ('test', 'external')")), ["split"]), ["split"])


@query("i1_logistic", None, "auroc auprc brier")
def _(t):
    df = model_table(t)
    return held_out(df, models.fit_logistic(df, FEATS))


@query("i2_random_forest", None, "auroc auprc brier")
def _(t):
    df = model_table(t)
    return held_out(df, models.fit_forest(df, FEATS))


@query("i3_boosted_trees", None, "auroc auprc brier")
def _(t):
    df = model_table(t)
    return held_out(df, models.fit_boosted(df, FEATS))


#: fixed cuts per feature: first edge, last edge, step
CUTS = {"acctbal": (-1000, 10000, 500), "n_visits": (1, 40, 1), "score_f": (0, 50, 1)}
EDGES = " UNION ALL ".join(f"SELECT {i} AS fi, '{f}' AS feature, CAST(unnest(range({a}, {b + 1}, {s})) AS DOUBLE) AS edge" for i, (f, (a, b, s)) in enumerate(CUTS.items()))
LONG = " UNION ALL ".join(f"SELECT {i} AS fi, CAST({f} AS DOUBLE) AS x, g, h FROM tr" for i, f in enumerate(CUTS))


@query("i3_first_split", f"""WITH {FEATURES}, m AS (SELECT avg(y) AS m FROM f WHERE entity_id % 3 <> 0), tr AS (SELECT f.*, m - y AS g, m * (1 - m) AS h FROM f, m WHERE entity_id % 3 <> 0),
 tot AS (SELECT sum(g) AS gt, sum(h) AS ht FROM tr), e AS ({EDGES}), l AS ({LONG}),
 c AS (SELECT fi, feature, edge, missing_left, sum(CASE WHEN x <= edge OR (x IS NULL AND missing_left) THEN g ELSE 0 END) AS gl, sum(CASE WHEN x <= edge OR (x IS NULL AND missing_left) THEN h ELSE 0 END) AS hl
  FROM e JOIN l USING (fi), (VALUES (true), (false)) s(missing_left) GROUP BY ALL),
 k AS (SELECT *, gl ^ 2 / (hl + 2) + (gt - gl) ^ 2 / (ht - hl + 2) - gt ^ 2 / (ht + 2) AS gain FROM c, tot WHERE hl >= 5 AND ht - hl >= 5)
 SELECT feature, edge, missing_left, gain, -0.03 * gl / (hl + 2) AS left_value, -0.03 * (gt - gl) / (ht - hl + 2) AS right_value, ln(m / (1 - m)) AS base
 FROM k, m ORDER BY round(gain, 9) DESC, fi, missing_left DESC, edge LIMIT 1""", "gain left_value right_value base")
def _(t):
    """The first split over all training rows, with fixed cuts and no draws."""
    df = t.features().withColumn("split", F.when(F.col("entity_id") % 3 != 0, "train").otherwise("val"))
    edges = [np.arange(a, b + 1, s, dtype=float) for a, b, s in CUTS.values()]
    model, = Booster(df, list(CUTS), "y", Settings(rows=1, columns=1), edges).fit([1], rounds=1, trim=False)
    tree = model.trees[0]
    f = int(tree.feature[0])
    row = (list(CUTS)[f], float(edges[f][tree.cut[0] - 1]), bool(tree.missing_left[0]), float(tree.gain[0]), float(tree.value[1]), float(tree.value[2]), model.base)
    return t.spark.createDataFrame([row], "feature string, edge double, missing_left boolean, gain double, left_value double, right_value double, base double")


@query("i4_neural_network", None, "auroc auprc brier")
def _(t):
    df = model_table(t)
    return held_out(df, models.fit_mlp(df, FEATS))


@query("i5_change_regression", None, "mae mae_no_change rmse r2 spearman")
def _(t):
    df = model_table(t).withColumn("change", F.col("mean_score") - 25)
    p = models.fit_change(df, ["acctbal", "n_visits", "share_f", "score_f"], "change")(df.where("split IN ('test', 'external')"))
    return metrics.regression_metrics(p, ["split"], y="change").drop("mae_train_median", "mean_change", "share_le0", "rmse_no_change")


def standard_rows(t):
    s = survival_rows(t)
    stats = s.agg(*[a for c in ("risk", "score") for a in (F.avg(c).alias(f"m_{c}"), F.stddev_samp(c).alias(f"s_{c}"))]).first()
    return s.select("time", "event", *[((F.col(c) - stats[f"m_{c}"]) / stats[f"s_{c}"]).alias(c) for c in ("risk", "score")])


@query("i6_cox", None, "coef hazard_ratio lower upper")
def _(t):
    return survival.fit_cox(standard_rows(t), ["risk", "score"]).table(t.spark)


PARAMS = {"cols": ["a", "b"], "median": {"a": 5.0, "b": 0.5}, "columns": ["clin_logit", "d_a", "a_missing", "d_b"], "mean": [0.1, 4.0, 0.2, 0.5], "sd": [1.5, 2.0, 0.4, 0.3],
          "coef": [0.9, 0.4, -0.2, 0.3], "intercept": -0.5}


@query("i7_apply_fusion", f"""WITH {PRED}, d AS (SELECT row_id, ln(p / (1 - p)) AS lg, CASE WHEN segment <> 'BUILDING' THEN price / 50000 END AS a, p_ref AS b FROM p)
 SELECT row_id, 1 / (1 + exp(-(-0.5 + (lg - 0.1) / 1.5 * 0.9 + (coalesce(a, 5.0) - 4.0) / 2.0 * 0.4 + (CAST(a IS NULL AS INT) - 0.2) / 0.4 * -0.2 + (b - 0.5) / 0.3 * 0.3))) AS p_fused FROM d""", "p_fused")
def _(t):
    d = models.clinical_logit(t.predictions()).withColumns({"a": F.when(F.col("segment") != "BUILDING", F.col("price") / 50000), "b": F.col("p_ref")})
    return models.apply_fusion(d, PARAMS).select("row_id", "p_fused")


@query("i7_fit_fusion", None, "auroc auprc brier")
def _(t):
    df = model_table(t)
    clinical = models.fit_logistic(df, ["acctbal", "n_visits"])
    scored = models.clinical_logit(clinical(df))
    params = models.fit_fusion(scored.where("split IN ('train', 'val')"), ["mean_score", "score_f"])
    fused = models.apply_fusion(scored.where("split IN ('test', 'external')"), params)
    return metrics.ranking_metrics(metrics.score_cells(fused, ["split"], p="p_fused"), ["split"])


@query("i9_group_ablation", None, "auroc delta_from_all delta_auroc_lo delta_auroc_hi")
def _(t):
    return models.ablate(model_table(t), models.ablation_sets(GROUPS, early=["money"]), models.fit_logistic, draws=1000)


@query("i10_variants_by_group", None, "auroc delta_from_all delta_auroc_lo delta_auroc_hi")
def _(t):
    sets = {"all": FEATS, "money only": GROUPS["money"]}
    df = model_table(t).withColumn("grp", F.when(F.col("n_visits") >= 10, "many visits").otherwise("few visits"))
    return models.by_group(df, sets, models.fit_logistic, "grp", draws=1000)


@query("i11_missing_patterns", None, "auroc auprc brier delta_auroc_lo delta_auroc_hi")
def _(t):
    optional = {"history": GROUPS["history"], "sparse": GROUPS["sparse"]}
    return models.compare_patterns(model_table(t), optional, {"Everything": ["history", "sparse"], "No history": ["sparse"], "No sparse": ["history"], "Money only": []}, GROUPS["money"], models.fit_logistic, draws=1000)


@query("i12_score_flags", f"""WITH {FEATURES}, x AS (SELECT entity_id, CASE WHEN acctbal > 2000 THEN acctbal END AS a, CASE WHEN segment <> 'BUILDING' THEN n_visits END AS n, score_f, 1 / (1 + exp(-(mean_score - 25) / 5)) AS p FROM f),
 q AS (SELECT quantile_cont(p, [i / 20.0 FOR i IN range(0, 21)]) AS e FROM x)
 SELECT entity_id, p, CAST(len([z FOR z IN e IF z < p]) * 5 AS BIGINT) AS percentile, concat_ws(', ', CASE WHEN a IS NOT NULL THEN 'money' END, CASE WHEN n IS NOT NULL OR score_f IS NOT NULL THEN 'history' END) AS used,
 concat_ws(', ', CASE WHEN a IS NULL THEN 'money' END, CASE WHEN n IS NULL AND score_f IS NULL THEN 'history' END) AS missing,
 CAST((a IS NOT NULL)::INT + (n IS NOT NULL)::INT + (score_f IS NOT NULL)::INT AS BIGINT) AS features_filled, n IS NULL AND score_f IS NULL AS no_cognitive_information FROM x, q""", "p")
def _(t):
    x = t.features().select("entity_id", F.when(F.col("acctbal") > 2000, F.col("acctbal")).alias("a"), F.when(F.col("segment") != "BUILDING", F.col("n_visits")).alias("n"),
                            "score_f", (1 / (1 + F.exp(-(F.col("mean_score") - 25) / 5))).alias("p"))
    s = models.score_flags(x, {"money": ["a"], "history": ["n", "score_f"]}, reference_vector(x, "p").scalar(), ["history"])
    return s.select("entity_id", "p", "percentile", "used", "missing", "features_filled", "no_cognitive_information")


COEFS = {"f_acctbal": 0.8, "f_score_f": -0.5, "na_score_f": 0.2}
CT = FEATURES + """, m AS (SELECT quantile_cont(acctbal, 0.5) AS a, quantile_cont(score_f, 0.5) AS s FROM f),
 x AS (SELECT entity_id, segment, acctbal, score_f, coalesce(acctbal, a) AS fa, coalesce(score_f, s) AS fs, CAST(score_f IS NULL AS DOUBLE) AS na FROM f, m),
 d AS (SELECT avg(fa) AS ma, stddev_pop(fa) + 1e-6 AS sa, avg(fs) AS ms, stddev_pop(fs) + 1e-6 AS ss, avg(na) AS mn, stddev_pop(na) + 1e-6 AS sn FROM x),
 ct AS (SELECT entity_id, segment, unnest(['f_acctbal', 'f_score_f', 'na_score_f']) AS feature, unnest([acctbal, score_f, CASE WHEN score_f IS NULL THEN 1.0 ELSE 0.0 END]) AS value,
 unnest([0.8 * (fa - ma) / sa, -0.5 * (fs - ms) / ss, 0.2 * (na - mn) / sn]) AS contribution FROM x, d)"""


def contribs(t):
    f = t.features().withColumn("na_raw", F.col("score_f").isNull().cast("double"))
    z = splits.Prep(["acctbal", "score_f"]).fit(f).transform(f)
    return explain.contributions(z, COEFS, ["entity_id", "segment"], {"f_acctbal": "acctbal", "f_score_f": "score_f", "na_score_f": "na_raw"})


@query("i13_contributions", f"WITH {CT} SELECT * FROM ct", "value contribution", digits=10)
def _(t):
    return contribs(t)


@query("i13_fitted_contributions", None, "value contribution", digits=5)
def _(t):
    df = model_table(t)
    s = models.fit_logistic(df, FEATS)
    z = s.design.prep.transform(df)
    return explain.contributions(z, explain.linear_coefs(s), ["entity_id"]).groupBy("feature").agg(F.avg(F.abs("contribution")).alias("contribution"), F.avg("value").alias("value"))


IMPG = "CASE WHEN feature = 'f_acctbal' THEN 'money' ELSE 'score' END"


@query("i14_importance", f"""WITH {CT}, i AS (SELECT segment, feature, avg(abs(contribution)) AS importance FROM ct GROUP BY 1, 2) SELECT segment, {IMPG} AS grp, sum(importance) AS importance FROM i GROUP BY 1, 2""", "importance")
def _(t):
    return explain.group_importance(explain.importance(contribs(t), ["segment"]), {"money": ["f_acctbal"], "score": ["f_score_f", "na_score_f"]}, ["segment"])


@query("i15_stability", f"""WITH {CT}, m0 AS (SELECT feature, row_number() OVER (ORDER BY avg(abs(contribution)) DESC, feature) AS r0 FROM ct GROUP BY 1),
 r AS (SELECT segment AS refit, feature, row_number() OVER (PARTITION BY segment ORDER BY avg(abs(contribution)) DESC, feature) AS r1 FROM ct GROUP BY 1, 2)
 SELECT refit, corr(r1, r0) AS spearman, count(*) FILTER (WHERE r1 <= 2 AND r0 <= 2) AS top_overlap FROM r JOIN m0 USING (feature) GROUP BY 1""", "spearman")
def _(t):
    c = stage(contribs(t), "contributions")
    return explain.stability(explain.importance(c), explain.importance(c.withColumnRenamed("segment", "refit"), ["refit"]), top=2)


@query("i15_rank_and_share_range", f"""WITH {CT}, r AS (SELECT segment, {IMPG} AS grp, sum(imp) AS imp FROM (SELECT segment, feature, avg(abs(contribution)) AS imp FROM ct GROUP BY 1, 2) GROUP BY 1, 2),
 s AS (SELECT grp, imp / sum(imp) OVER (PARTITION BY segment) AS share FROM r) SELECT grp, min(share) AS min_share, max(share) AS max_share FROM s GROUP BY 1""", "min_share max_share")
def _(t):
    refits = explain.importance(contribs(t).withColumnRenamed("segment", "refit"), ["refit"])
    return explain.group_share_range(refits, {"money": ["f_acctbal"], "score": ["f_score_f", "na_score_f"]})


@query("i16_dependence", f"""WITH {CT}, e AS (SELECT feature, list_sort(list_distinct(quantile_cont(value, [i / 8.0 FOR i IN range(0, 9)]))) AS e, count(DISTINCT value) AS k FROM ct WHERE value IS NOT NULL GROUP BY 1),
 b AS (SELECT feature, value, contribution, CASE WHEN value IS NULL THEN -1.0 WHEN k <= 5 THEN value ELSE greatest(len([x FOR x IN e IF x < value]), 1) END::DOUBLE AS bin FROM ct JOIN e USING (feature))
 SELECT feature, value IS NULL AS missing, bin, count(*) AS n, avg(value) AS mean_value, avg(contribution) AS mean_contribution FROM b GROUP BY 1, 2, 3 HAVING count(*) >= 20 OR value IS NULL""", "mean_value mean_contribution", digits=5)
def _(t):
    return explain.dependence(contribs(t))
