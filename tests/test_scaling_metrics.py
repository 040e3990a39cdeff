"""Ranks, quantiles, metrics and survival against brute force; bucketed and plain paths must agree."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from visitframe import scaling
from visitframe.operators import correlation, metrics, norms, profile, splits, survival


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(3)
    rows = [(i, "g" if i % 3 else "h", int(rng.random() < 0.3), round(rng.random(), 2), round(rng.random(), 1)) for i in range(600)]
    return spark.createDataFrame(rows, "id long, grp string, y int, p double, p_ref double"), rows


def brute_auc(ys, ps):
    pos, neg = [p for y, p in zip(ys, ps) if y], [p for y, p in zip(ys, ps) if not y]
    return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))


def brute_ap(ys, ps):
    out, tp, n, total = 0.0, 0, 0, sum(ys)
    for s in sorted(set(ps), reverse=True):
        k = [y for y, p in zip(ys, ps) if p == s]
        tp, n = tp + sum(k), n + len(k)
        out += sum(k) / total * tp / n
    return out


@pytest.mark.parametrize("cells", [None, 7])
def test_auroc_and_average_precision_match_pair_counting(scored, cells):
    df, rows = scored
    out = {r["grp"]: r for r in metrics.ranking_metrics(metrics.score_cells(df, ["grp"]), ["grp"], cells_per_task=cells).collect()}
    for g in ("g", "h"):
        ys, ps = [r[2] for r in rows if r[1] == g], [r[3] for r in rows if r[1] == g]
        assert out[g]["auroc"] == pytest.approx(brute_auc(ys, ps))
        assert out[g]["auprc"] == pytest.approx(brute_ap(ys, ps))
        assert out[g]["brier"] == pytest.approx(np.mean([(p - y) ** 2 for y, p in zip(ys, ps)]))


def test_one_class_and_all_tied(spark):
    one = spark.createDataFrame([(1, 0.2), (1, 0.4)], "y int, p double")
    assert metrics.auroc(one).first()["auroc"] is None
    tied = spark.createDataFrame([(1, 0.5), (0, 0.5), (0, 0.5)], "y int, p double")
    assert metrics.auroc(tied).first()["auroc"] == 0.5


@pytest.mark.parametrize("cells", [None, 5])
def test_exact_quantiles_match_numpy(spark, cells):
    rng = random.Random(1)
    vals = [rng.choice([1.0, 2.5, 2.5, 7.0, 1e9, -4.0]) + rng.randint(0, 50) for _ in range(500)]
    df = spark.createDataFrame([("a" if i % 4 else "b", v) for i, v in enumerate(vals)], "g string, v double")
    out = {r["g"]: r for r in scaling.exact_quantiles(df, ["g"], "v", {"q1": 0.1, "q5": 0.5, "q9": 0.93}, cells_per_task=cells).collect()}
    for g in "ab":
        a = [v for i, v in enumerate(vals) if ("a" if i % 4 else "b") == g]
        assert [out[g][k] for k in ("q1", "q5", "q9")] == pytest.approx(list(np.percentile(a, [10, 50, 93])))


def test_spearman_with_ties(scored):
    df, rows = scored
    rank = lambda xs: [sum(b < a for b in xs) + (sum(b == a for b in xs) + 1) / 2 for a in xs]
    want = np.corrcoef(rank([r[3] for r in rows]), rank([r[4] for r in rows]))[0, 1]
    assert correlation.spearman(df, "p", "p_ref").first()["r"] == pytest.approx(want)


@pytest.mark.parametrize("cells", [None, 9])
def test_concordance_matches_pair_counting(spark, cells):
    rng = random.Random(5)
    rows = [(rng.randint(1, 30) / 1.0, int(rng.random() < 0.6), float(rng.randint(0, 12))) for _ in range(300)]
    df = spark.createDataFrame(rows, "time double, event int, risk double")
    c = t = n = 0
    for ti, ei, ri in rows:
        for tj, ej, rj in rows:
            if ei and (tj > ti or (tj == ti and not ej)):
                n, c, t = n + 1, c + (ri > rj), t + (ri == rj)
    got = metrics.c_index(df, cells_per_task=cells).first()
    assert (got["concordant"], got["tied"], got["comparable"]) == (c, t, n)


def test_md5_rank_is_a_permutation_and_total(spark):
    df = spark.range(5000).withColumn("g", F.col("id") % 2)
    out = scaling.rank_by_md5(df, ["g"], "id", "s", total="n")
    rows = out.groupBy("g").agg(F.count_distinct("rk").alias("k"), F.max("rk").alias("m"), F.max("n").alias("n")).collect()
    assert all(r["k"] == 2500 and r["m"] == 2499 and r["n"] == 2500 for r in rows)


def test_bootstrap_draws_sum_to_n_and_poisson_is_close(scored):
    df, rows = scored
    s = metrics.resample(df, ["grp"], "id", 5, "x")
    sizes = {(r["grp"], r["rep"]): r["w"] for r in s.groupBy("grp", "rep").agg(F.sum("w").alias("w")).collect()}
    assert len(sizes) == 10 and all(v == (400 if g == "g" else 200) for (g, _), v in sizes.items())
    w = metrics.resample(df, [], "id", 50, "x", "poisson").agg(F.sum("w")).first()[0] / 50
    assert abs(w - 600) < 30
    b = metrics.bootstrap(df, ["grp"], "id", draws=30, p_ref="p_ref").collect()
    assert all(r["auroc_lo"] <= r["auroc"] <= r["auroc_hi"] and r["replicates"] == 30 for r in b)


def test_calibration_fit_solves_the_score_equations(scored):
    df, rows = scored
    r = metrics.calibration_fit(df.withColumn("p", F.greatest(F.least("p", F.lit(0.99)), F.lit(0.01)))).first()
    p = np.clip([x[3] for x in rows], 0.01, 0.99)
    y, x = np.array([v[2] for v in rows]), np.log(p / (1 - p))
    q = 1 / (1 + np.exp(-(r["intercept"] + r["slope"] * x)))
    assert abs((y - q).sum()) < 1e-6 and abs(((y - q) * x).sum()) < 1e-6


def test_calibration_fit_tells_what_has_no_fit(spark):
    rows = [("mixed", i / 20, int(i % 3 == 0)) for i in range(1, 20)] + [("one", i / 20, 1) for i in range(1, 20)] + [("apart", i / 20, int(i > 10)) for i in range(1, 20)]
    out = {r["grp"]: r["settled"] for r in metrics.calibration_fit(spark.createDataFrame(rows, "grp string, p double, y int"), ["grp"], steps=12).collect()}
    assert out == {"mixed": True, "one": False, "apart": False}


def test_norms_match_least_squares(spark):
    rng = np.random.default_rng(0)
    X = rng.normal(size=(200, 3)) * [10, 1, 3] + [70, 0.5, 14]
    y = 5 + X @ [0.3, -1.0, 0.2] + rng.normal(size=200)
    df = spark.createDataFrame([(float(v), *map(float, r)) for v, r in zip(y, X)], "t1 double, age double, female double, educ double")
    r = norms.fit_norms(df, ["t1"], ["age", "female", "educ"]).first()
    A = np.column_stack([np.ones(200), X])
    beta = np.linalg.lstsq(A, y, rcond=None)[0]
    assert [r["intercept"], r["age"], r["female"], r["educ"]] == pytest.approx(list(beta), rel=1e-6)
    assert r["resid_sd"] == pytest.approx((y - A @ beta).std(ddof=0) * np.sqrt(200 / 196), rel=1e-6)


def test_cox_gradient_vanishes_and_matches_direct_likelihood(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(150, 2))
    t = np.ceil(rng.exponential(np.exp(-x[:, 0])) * 20)
    e = (rng.random(150) < 0.7).astype(int)
    df = spark.createDataFrame([(float(a), float(b), float(c), int(d)) for (a, b), c, d in zip(x, t, e)], "a double, b double, time double, event int")
    m = survival.fit_cox(df, ["a", "b"], ridge=0.0, ties="breslow")
    assert np.max(np.abs(m.gradient)) < 1e-5

    def loglik(beta):
        eta = x @ beta
        return sum(eta[i] - np.log(np.exp(eta[t >= t[i]]).sum()) for i in range(150) if e[i])

    best = loglik(m.beta)
    assert all(best >= loglik(m.beta + d) for d in ([0.01, 0], [-0.01, 0], [0, 0.01], [0, -0.01]))


def test_splits_keep_entities_and_sites_apart(tables):
    from visitframe.plans.suite_profile import split_of
    s = split_of(tables)
    assert {r["split"] for r in s.select("split").distinct().collect()} <= set(splits.SPLITS)
    v = tables.visits().join(s.select("entity_id", "split"), "entity_id")
    assert all(r["passed"] for r in splits.check_splits(v, s).collect())


def test_shuffled_labels_give_chance(tables):
    p = tables.predictions().withColumn("p", F.col("y") * 1.0)
    assert metrics.auroc(p).first()["auroc"] == 1.0
    assert 0.4 < metrics.auroc(splits.shuffle_labels(p, "y", "s", "row_id").drop("y").withColumnRenamed("y_shuffled", "y")).first()["auroc"] < 0.6


def test_group_tables_broadcast_only_within_the_bound(spark):
    small, big = spark.range(10), spark.range(100)
    plan = lambda right: spark.range(1000).join(right, "id")._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan(scaling.small_side(small, "t", 50))
    hinted = scaling.small_side(big, "t", 50)
    assert "ResolvedHint" not in hinted._jdf.queryExecution().analyzed().toString()


def test_similar_cell_falls_back_to_the_whole_group(spark):
    from visitframe.operators.joins import similar_cell
    cells = spark.createDataFrame([("old", "a", 10, 2), ("old", "b", 30, 3)], "grp string, status string, n long, events long")
    rows = spark.createDataFrame([(1, "old", "a"), (2, "old", "z"), (3, "new", "a")], "id long, grp string, status string")
    out = {r["id"]: (r["cell_found"], r["cell_n"], r["cell_events"]) for r in similar_cell(rows, cells, "grp", "status").collect()}
    assert out == {1: (True, 10, 2), 2: (False, 40, 5), 3: (False, None, None)}


def test_static_mean_uses_window_then_late_frames_then_all(spark):
    from visitframe.operators.voxels import frames_to_use
    rows = [("in", k, "PiB", float(m), 1.0) for k, m in enumerate([10, 50, 60, 80])]
    rows += [("late", k, "PiB", float(m), 1.0) for k, m in enumerate(range(1, 41, 4))]
    rows += [("few", k, "none", float(m), 1.0) for k, m in enumerate([1, 2, 3])]
    used = frames_to_use(spark.createDataFrame(rows, "image_id string, frame int, tracer string, mid double, duration double"))
    out = {}
    for r in used.collect():
        out.setdefault(r["image_id"], set()).add(r["frame"])
    assert out["in"] == {1, 2} and out["few"] == {0, 1, 2} and out["late"] == {4, 5, 6, 7, 8, 9}
