"""Evaluation queries (J1-J15, I8, H7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from visitframe.functions.columns import cut
from visitframe.operators import joins, metrics
from visitframe.plans.fixtures import LABELLED, PRED, VISITS
from visitframe.plans.suite import query
from visitframe.plans.suite_columns import FEATS, checked_entries
from visitframe.plans.suite_pit import labelled
from visitframe.scaling import Run, Timeline, exact_quantiles, small_side

AUC = """(sum(r) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y)))"""


def ranked(src: str, by: str, p: str = "p") -> str:
    return f"SELECT *, rank() OVER (PARTITION BY {by} ORDER BY {p}) + (count(*) OVER (PARTITION BY {by}, {p}) - 1) / 2.0 AS r FROM {src}"


@query("j1_auroc", f"WITH {PRED}, k AS ({ranked('p', 'priority')}) SELECT priority, count(*) AS n, CAST(sum(y) AS BIGINT) AS events, {AUC} AS auroc FROM k GROUP BY 1", "auroc")
def _(t):
    return metrics.auroc(t.predictions(), ["priority"])


@query("j1_auroc_overall", f"WITH {PRED}, k AS ({ranked('p', '1')}) SELECT count(*) AS n, CAST(sum(y) AS BIGINT) AS events, {AUC} AS auroc FROM k", "auroc")
def _(t):
    return metrics.auroc(t.predictions())


@query("j2_average_precision", f"""WITH {PRED}, c AS (SELECT segment, p, sum(y) AS pos, count(*) AS n FROM p GROUP BY 1, 2),
 k AS (SELECT *, sum(pos) OVER w AS tp, sum(n) OVER w AS m, sum(pos) OVER (PARTITION BY segment) AS tot FROM c WINDOW w AS (PARTITION BY segment ORDER BY p DESC))
 SELECT segment, CAST(sum(n) AS BIGINT) AS n, CAST(sum(pos) AS BIGINT) AS events, sum(pos / tot * tp / m) AS auprc FROM k GROUP BY 1""", "auprc")
def _(t):
    return metrics.average_precision(t.predictions(), ["segment"])


@query("j3_brier", f"""WITH {PRED} SELECT segment, avg((p - y) ^ 2) AS brier, avg(((SELECT avg(y) FROM p) - y) ^ 2) AS brier_base FROM p GROUP BY 1""", "brier brier_base")
def _(t):
    p = t.predictions()
    return metrics.brier(p, ["segment"], p.agg(F.avg("y")).scalar())


BOOT = PRED + """, rk AS (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY md5(concat_ws('|', row_id, 'boot')), row_id) - 1 AS idx, count(*) OVER (PARTITION BY segment) AS n FROM p),
 dr AS (SELECT segment, b AS rep, ('0x' || substr(md5(concat_ws('|', segment, b, idx, 'boot')), 1, 15))::BIGINT % n AS idx FROM rk, range(1, 1001) t(b)),
 sm AS (SELECT dr.rep, rk.segment, rk.y, rk.p, rk.p_ref FROM dr JOIN rk ON dr.segment = rk.segment AND dr.idx = rk.idx),
 a1 AS (SELECT segment, rep, AUCX AS auroc, avg((p - y) ^ 2) AS brier FROM (RANKP) GROUP BY 1, 2),
 a2 AS (SELECT segment, rep, AUCX AS ref FROM (RANKR) GROUP BY 1, 2),
 ap AS (SELECT segment, rep, sum(pos / tot * tp / m) AS auprc FROM (SELECT *, sum(pos) OVER w AS tp, sum(n) OVER w AS m, sum(pos) OVER (PARTITION BY segment, rep) AS tot
  FROM (SELECT segment, rep, p, sum(y) AS pos, count(*) AS n FROM sm GROUP BY 1, 2, 3) WINDOW w AS (PARTITION BY segment, rep ORDER BY p DESC)) GROUP BY 1, 2),
 bt AS (SELECT a1.*, auprc, auroc - ref AS d FROM a1 JOIN a2 USING (segment, rep) JOIN ap USING (segment, rep)),
 pt AS (SELECT segment, count(*) AS n, CAST(sum(y) AS BIGINT) AS events, AUCX AS auroc, avg((p - y) ^ 2) AS brier FROM (RANK0) GROUP BY 1),
 pr AS (SELECT segment, AUCX AS ref FROM (RANK1) GROUP BY 1)""".replace("AUCX", AUC).replace("RANKP", ranked("sm", "segment, rep")).replace(
    "RANKR", ranked("sm", "segment, rep", "p_ref")).replace("RANK0", ranked("p", "segment")).replace("RANK1", ranked("p", "segment", "p_ref"))


def boot_facts(df, by, n="n"):
    """What is certain about an interval: its point values, that every replicate drew exactly n rows, and that it holds the point."""
    return df.select(*by, "n", "events", "auroc", "brier", *[c for c in ("delta_auroc",) if c in df.columns], "replicates", (F.col("min_drawn") == F.col("n")).alias("all_drawn"),
                     (F.col("max_drawn") == F.col("n")).alias("none_over"), *[((F.col(f"{c}_lo") < F.col(c)) & (F.col(c) < F.col(f"{c}_hi"))).alias(f"{c}_inside") for c in ("auroc", "brier")])


DRAWN = f"""WITH {BOOT} SELECT segment, n, events, pt.auroc, pt.brier, pt.auroc - pr.ref AS delta_auroc, count(*) AS replicates,
 quantile_cont(bt.auroc, 0.025) AS auroc_lo, quantile_cont(bt.auroc, 0.975) AS auroc_hi, quantile_cont(bt.auprc, 0.025) AS auprc_lo, quantile_cont(bt.auprc, 0.975) AS auprc_hi,
 quantile_cont(bt.brier, 0.025) AS brier_lo, quantile_cont(bt.brier, 0.975) AS brier_hi, quantile_cont(d, 0.025) AS delta_auroc_lo, quantile_cont(d, 0.975) AS delta_auroc_hi
 FROM pt JOIN pr USING (segment) JOIN bt USING (segment) GROUP BY ALL"""
DRAWN_ROUNDED = "auroc brier delta_auroc auroc_lo auroc_hi auprc_lo auprc_hi brier_lo brier_hi delta_auroc_lo delta_auroc_hi"


def drawn(t):
    return metrics.bootstrap(t.predictions(), ["segment"], "row_id", draws=1000, p_ref="p_ref", method="draws").drop("auprc", "min_drawn", "max_drawn")


@query("j4_bootstrap", DRAWN, DRAWN_ROUNDED)
def _(t):
    return drawn(t)


@query("j4_bootstrap_facts", f"""WITH {PRED}, pt AS (SELECT segment, count(*) AS n, CAST(sum(y) AS BIGINT) AS events, {AUC} AS auroc, avg((p - y) ^ 2) AS brier FROM ({ranked('p', 'segment')}) GROUP BY 1),
 pr AS (SELECT segment, {AUC} AS ref FROM ({ranked('p', 'segment', 'p_ref')}) GROUP BY 1)
 SELECT segment, n, events, auroc, brier, auroc - ref AS delta_auroc, CAST(1000 AS BIGINT) AS replicates, true AS all_drawn, true AS none_over, true AS auroc_inside, true AS brier_inside
 FROM pt JOIN pr USING (segment)""", "auroc brier delta_auroc")
def _(t):
    return boot_facts(metrics.bootstrap(t.predictions(), ["segment"], "row_id", draws=1000, p_ref="p_ref"), ["segment"])


@query("j4_bootstrap_intervals", None, "auroc auprc brier delta_auroc auroc_lo auroc_hi auprc_lo auprc_hi brier_lo brier_hi delta_auroc_lo delta_auroc_hi")
def _(t):
    return metrics.bootstrap(t.predictions(), ["segment"], "row_id", draws=1000, p_ref="p_ref")


@query("j4_bootstrap_draws", DRAWN, DRAWN_ROUNDED)
def _(t):
    return drawn(t)


@query("j4_bootstrap_poisson", None, "auroc auprc brier auroc_lo auroc_hi auprc_lo auprc_hi brier_lo brier_hi")
def _(t):
    return metrics.bootstrap(t.predictions(), ["segment"], "row_id", draws=1000, method="poisson cells")


@query("j5_calibration_bins", f"""WITH {PRED}, q AS (SELECT list_sort(list_distinct(quantile_cont(p, [i / 10.0 FOR i IN range(0, 11)]))) AS e FROM p)
 SELECT greatest(len([x FOR x IN e IF x < p]), 1)::BIGINT AS bin, count(*) AS n, avg(p) AS predicted, avg(y) AS observed FROM p, q GROUP BY 1""", "predicted observed")
def _(t):
    return metrics.calibration_bins(t.predictions())


@query("j6_calibration_fit", None, "slope intercept observed_rate mean_predicted")
def _(t):
    return metrics.calibration_fit(t.predictions(), ["segment"])


@query("j6_calibration_equations", f"""WITH {PRED} SELECT segment, avg(y) AS observed_rate, avg(p) AS mean_predicted, avg(y) AS mean_fitted, avg(y * ln(p / (1 - p))) AS x_fitted, true AS settled
 FROM p GROUP BY 1""", "observed_rate mean_predicted mean_fitted x_fitted")
def _(t):
    """The score equations at the fitted slope and intercept: fitted and observed outcomes agree in mean and along the logit."""
    p = t.predictions()
    fit = metrics.calibration_fit(p, ["segment"])
    x = F.ln(F.col("p") / (1 - F.col("p")))
    q = 1 / (1 + F.exp(-(F.col("intercept") + F.col("slope") * x)))
    sums = p.join(small_side(fit, "calibration-fit"), "segment").groupBy("segment").agg(F.avg(q).alias("mean_fitted"), F.avg(q * x).alias("x_fitted"))
    return fit.select("segment", "observed_rate", "mean_predicted", "settled").join(sums, "segment")


TH = """count(*) FILTER (WHERE p >= t AND y = 1) AS tp, count(*) FILTER (WHERE p >= t AND y = 0) AS fp, count(*) FILTER (WHERE p < t AND y = 1) AS fn, count(*) FILTER (WHERE p < t AND y = 0) AS tn"""


@query("j7_thresholds", f"""WITH {PRED}, c AS (SELECT t AS threshold, {TH} FROM p, (VALUES (0.05::DOUBLE), (0.1), (0.2), (0.3), (0.5)) g(t) GROUP BY 1)
 SELECT threshold, 100.0 * (tp + fp) / (tp + fp + fn + tn) AS flagged_pct, tp / (tp + fn) AS sensitivity, tn / (tn + fp) AS specificity, tp / greatest(tp + fp, 1) AS ppv, tn / greatest(tn + fn, 1) AS npv FROM c""",
       "flagged_pct sensitivity specificity ppv npv")
def _(t):
    return metrics.thresholds(t.predictions(), [0.05, 0.1, 0.2, 0.3, 0.5])


@query("j8_decision_curve", f"""WITH {PRED}, c AS (SELECT t AS threshold, {TH}, count(*) AS n FROM p, (SELECT round(i * 0.02, 2)::DOUBLE AS t FROM range(1, 31) x(i)) g GROUP BY 1)
 SELECT threshold, tp / n - fp / n * threshold / (1 - threshold) AS model, (tp + fn) / n - (1 - (tp + fn) / n) * threshold / (1 - threshold) AS treat_all FROM c""", "model treat_all")
def _(t):
    return metrics.decision_curve(t.predictions())


@query("j9_subgroups", f"""WITH {PRED}, l AS (SELECT y, p, unnest(['priority', 'segment', 'price']) AS subgroup, unnest([priority, segment, CASE WHEN price < 20000 THEN 'small' WHEN price < 250000 THEN 'medium' WHEN price < 9999999 THEN 'large' END]) AS level FROM p),
 k AS ({ranked('l', 'subgroup, level')}) SELECT subgroup, level, count(*) AS n, CAST(sum(y) AS BIGINT) AS events, avg(y) AS observed, avg(p) AS predicted,
 CASE WHEN sum(y) >= 15 AND count(*) - sum(y) >= 15 THEN {AUC} END AS auroc FROM k GROUP BY 1, 2""", "observed predicted auroc")
def _(t):
    p = t.predictions().withColumn("price", cut("price", [-1, 20000, 250000, 9999999], ["small", "medium", "large"], right=False))
    return metrics.subgroups(p, ["priority", "segment", "price"])


@query("j9_subgroup_intervals", None, "observed predicted auroc auroc_lo auroc_hi")
def _(t):
    return metrics.subgroups(t.predictions(), ["priority", "segment"], key="row_id", draws=500)


@query("j12_history_intervals", None, "auroc auprc brier auroc_lo auroc_hi auprc_lo auprc_hi brier_lo brier_hi")
def _(t):
    return metrics.bootstrap(with_history(t), ["history"], "row_id", draws=500)


def survival_rows(t):
    first = labelled(t).df.where("visit_no = 1 AND event_time > 0")
    return first.select("entity_id", "segment", F.col("event_time").alias("time"), "event", F.col("acctbal").alias("risk"),
                        (F.col("site") * 1.0).alias("risk_ref"), "score", "status")


SURV = """sv AS (SELECT a.entity_id, segment, acctbal AS risk, CAST(site AS DOUBLE) AS risk_ref, a.event, a.event_time AS time FROM ev a WHERE rn = 1 AND event_time > 0)"""
PAIR = """sum(CAST(a.risk > b.risk AS INT)) AS c, sum(CAST(a.risk = b.risk AS INT)) AS t, count(*) AS n FROM sv a JOIN sv b ON a.segment = b.segment AND a.event = 1 AND (b.time > a.time OR (b.time = a.time AND b.event = 0))"""


@query("j10_c_index", f"""WITH {LABELLED}, {SURV} SELECT segment, CAST(c AS BIGINT) AS concordant, CAST(t AS BIGINT) AS tied, n AS comparable, (c + t / 2.0) / n AS c_index FROM (SELECT a.segment, {PAIR} GROUP BY 1)""", "c_index")
def _(t):
    return metrics.c_index(survival_rows(t), ["segment"])


@query("j10_c_index_gain", None, "c_index c_index_ref gain gain_lo gain_hi")
def _(t):
    return metrics.c_index_gain(survival_rows(t), "entity_id", draws=200)


def with_history(t):
    """Predictions with the number of earlier visits in two strata."""
    tl = Timeline(t.predictions(), "entity_id", "order_date", ("row_id",), hot=t.hot("orders", "o_custkey")).runs(prior=Run("count", F.lit(1), "before"))
    return tl.df.withColumn("history", F.when(F.col("prior").between(2, 3), "2-3").when(F.col("prior") >= 4, "4+")).where(F.col("history").isNotNull())


@query("j11_regression_metrics", f"""WITH {PRED}, rg AS (SELECT segment, (price - 250000) / 100000 AS y, p_ref * 2 - 1 AS p FROM p),
 m AS (SELECT quantile_cont(y, 0.5) AS md FROM rg), k AS (SELECT *, rank() OVER (PARTITION BY segment ORDER BY y) + (count(*) OVER (PARTITION BY segment, y) - 1) / 2.0 AS ry,
 rank() OVER (PARTITION BY segment ORDER BY p) + (count(*) OVER (PARTITION BY segment, p) - 1) / 2.0 AS rp FROM rg)
 SELECT segment, count(*) AS n, avg(y) AS mean_change, avg(CAST(y <= 0 AS INT)) AS share_le0, avg(abs(y - p)) AS mae, avg(abs(y)) AS mae_no_change, avg(abs(y - md)) AS mae_train_median,
 sqrt(avg((y - p) ^ 2)) AS rmse, sqrt(avg(y ^ 2)) AS rmse_no_change, 1 - sum((y - p) ^ 2) / (var_pop(y) * count(*)) AS r2, corr(ry, rp) AS spearman FROM k, m GROUP BY 1""",
       "mean_change share_le0 mae mae_no_change mae_train_median rmse rmse_no_change r2 spearman")
def _(t):
    d = t.predictions().select("segment", ((F.col("price") - 250000) / 100000).alias("y"), (F.col("p_ref") * 2 - 1).alias("p"))
    return metrics.regression_metrics(d, ["segment"], train_median=exact_quantiles(d, [], "y", {"m": 0.5}).scalar())


@query("j12_by_history", f"""WITH {PRED}, h AS (SELECT *, CASE WHEN prior BETWEEN 2 AND 3 THEN '2-3' WHEN prior >= 4 THEN '4+' END AS history
 FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY order_date, row_id) - 1 AS prior FROM p)), k AS (SELECT * FROM h WHERE history IS NOT NULL), r AS ({ranked('k', 'history')})
 SELECT history, count(*) AS n, CAST(sum(y) AS BIGINT) AS events, {AUC} AS auroc FROM r GROUP BY 1""", "auroc")
def _(t):
    return metrics.auroc(with_history(t), ["history"])


SWEEP = VISITS + """, sw AS (SELECT visit_id, segment, k, 1 / (1 + exp(-(x / 20 + acctbal / 10000 - 2 - CASE WHEN x = 40 AND status = 5 THEN 1.5 ELSE 0 END))) AS p
 FROM v, (VALUES (0, 5.0::DOUBLE), (1, 10.0), (2, 20.0), (3, 40.0)) g(k, x))"""


@query("j13_monotone_sweep", f"""WITH {SWEEP}, d AS (SELECT segment, (lag(p) OVER (PARTITION BY visit_id ORDER BY k) - p) * 100 AS d FROM sw)
 SELECT segment, greatest(max(d), 0) AS largest_drop, greatest(max(d), 0) <= 1 AS passed FROM d GROUP BY 1""", "largest_drop")
def _(t):
    s = joins.sweep(t.visits().drop("score"), "x", [5.0, 10.0, 20.0, 40.0])
    z = F.col("x") / 20 + F.col("acctbal") / 10000 - 2 - F.when((F.col("x") == 40) & (F.col("status") == 5), 1.5).otherwise(0.0)
    return metrics.check_monotone(s.withColumn("p", 1 / (1 + F.exp(-z))), ["segment"], "visit_id", "step", "p")


@query("j14_calibration_gap", f"""WITH {PRED}, c AS (SELECT segment, priority, count(*) AS n, avg(y) AS observed, avg(p) AS predicted FROM p GROUP BY 1, 2 HAVING count(*) >= 50)
 SELECT *, abs(predicted - observed) AS gap, abs(predicted - observed) < 0.08 AS passed FROM c""", "observed predicted gap")
def _(t):
    return metrics.check_gap(t.predictions(), ["segment", "priority"])


@query("j15_status_order", f"""WITH {PRED}, m AS (SELECT priority, avg(p_ref) AS mean_p, count(*) AS n, list_position(['1-URGENT', '2-HIGH', '3-MEDIUM'], priority) AS position FROM p WHERE priority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') GROUP BY 1)
 SELECT priority, mean_p, n, CAST(position AS BIGINT) AS position, coalesce(mean_p > lag(mean_p) OVER (ORDER BY position), true) AS rises FROM m""", "mean_p")
def _(t):
    return metrics.check_order(t.predictions().drop("p").withColumnRenamed("p_ref", "p"), "priority", ["1-URGENT", "2-HIGH", "3-MEDIUM"])


@query("j15_rule_rates", f"""WITH {FEATS} SELECT event_type, count(*) AS n, avg(CAST(coalesce(status = 'Normal' AND 3 - score < -2, false) OR coalesce(score > 4, false) OR coalesce(bp_sys <= bp_dia, false)
 OR coalesce(smoke_years > 0 AND smoke_years > age - 8, false) AS INT)) AS check_rate, avg(CAST(coalesce(status = 'MCI' AND score = 0, false) OR (status IS NULL) <> (score IS NULL) OR coalesce(3 - score <= -5, false)
 OR age NOT BETWEEN 40 AND 95 OR educ_years < 6 AS INT)) AS note_rate FROM ft JOIN (SELECT event_id, event_type FROM events) USING (event_id) GROUP BY 1""", "check_rate note_rate")
def _(t):
    return metrics.rule_rates(checked_entries(t), "event_type")


ENS = PRED + """, en AS (SELECT row_id, y, unnest([0, 1, 2]) AS seed, unnest([p, (p + p_ref) / 2, p_ref]) AS p FROM p)"""


def seeds(t):
    item = lambda s, c: F.struct(F.lit(s).alias("seed"), c.alias("p"))
    return t.predictions().select("row_id", "y", F.lit("m").alias("model"), F.inline(F.array(
        item(0, F.col("p")), item(1, (F.col("p") + F.col("p_ref")) / 2), item(2, F.col("p_ref")))))


@query("i8_seed_ensemble", f"WITH {ENS} SELECT 'm' AS model, row_id, CAST(any_value(y) AS BIGINT) AS y, avg(p) AS p, count(DISTINCT seed) AS seeds FROM en GROUP BY row_id", "p")
def _(t):
    return metrics.ensemble(seeds(t), ["row_id"])


@query("i8_auroc_per_seed", f"WITH {ENS}, k AS ({ranked('en', 'seed')}) SELECT CAST(seed AS BIGINT) AS seed, count(*) AS n, CAST(sum(y) AS BIGINT) AS events, {AUC} AS auroc FROM k GROUP BY 1", "auroc")
def _(t):
    return metrics.auroc(seeds(t), ["seed"])


@query("h7_check_metrics", f"""WITH {PRED}, k AS ({ranked('p', 'priority')}) SELECT priority AS name, {AUC} AS value, true AS passed FROM k GROUP BY 1""", "value")
def _(t):
    p = t.predictions()
    one = metrics.auroc(p, ["priority"]).select(F.col("priority").alias("name"), F.col("auroc").alias("value"))
    report = metrics.auroc(p.withColumn("p", F.col("p") * 2), ["priority"]).select(F.col("priority").alias("name"), F.col("auroc").alias("reported"))
    return one.join(report, "name").select("name", "value", (F.abs(F.col("value") - F.col("reported")) < 1e-9).alias("passed"))


@query("h7_check_metrics_with_faults", f"""WITH {PRED}, k AS ({ranked('p', 'priority')}) SELECT priority AS name, {AUC} AS value, priority <> '1-URGENT' AS passed FROM k GROUP BY 1""", "value")
def _(t):
    one = metrics.auroc(t.predictions(), ["priority"]).select(F.col("priority").alias("name"), F.col("auroc").alias("value"))
    report = one.select("name", (F.col("value") + F.when(F.col("name") == "1-URGENT", 0.01).otherwise(0.0)).alias("reported"))
    return one.join(report, "name").select("name", "value", (F.abs(F.col("value") - F.col("reported")) < 1e-9).alias("passed"))
