"""Histogram boosting against a plain version, and bootstrap draws dealt to cells."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from visitframe.operators import boosting, metrics
from visitframe.operators.boosting import Booster, Settings, Tree, best_cuts, to_bins


def table(spark, n=1500, seed=1):
    rng = np.random.default_rng(seed)
    x = pd.DataFrame({"a": rng.normal(size=n).round(2), "b": rng.integers(0, 9, n).astype(float), "c": rng.normal(size=n)})
    x.loc[rng.random(n) < 0.2, "c"] = np.nan
    z = 1.5 * (x["a"] > 0.3) * (x["b"] > 4) + np.where(x["c"].isna(), 0.8, 0)
    x["y"] = (rng.random(n) < 1 / (1 + np.exp(1 - 2 * z))).astype(int)
    x["change"] = 3 * z + rng.normal(size=n) ** 3
    x["split"] = np.where(np.arange(n) % 4 == 0, "val", np.where(np.arange(n) % 4 == 1, "test", "train"))
    return x, spark.createDataFrame(x)


def plain_tree(bins, g, h, depth, s):
    """Best cuts node by node over plain row masks."""
    tree = Tree(depth)

    def grow(node, rows, level):
        if level == depth:
            return
        best = None
        for f in range(len(bins)):
            for left in (True, False):
                for cut in range(1, 255):
                    on = rows & np.where(bins[f] == 0, left, bins[f] <= cut)
                    gl, hl, gt, ht = g[on].sum(), h[on].sum(), g[rows].sum(), h[rows].sum()
                    if hl < s.child_weight or ht - hl < s.child_weight:
                        continue
                    gain = gl**2 / (hl + s.ridge) + (gt - gl) ** 2 / (ht - hl + s.ridge) - gt**2 / (ht + s.ridge)
                    if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                        best = (gain, f, cut, left, on, gl, hl, gt - gl, ht - hl)
        if best is None:
            return
        _, tree.feature[node], tree.cut[node], tree.missing_left[node], on, gl, hl, gr, hr = best
        tree.value[2 * node + 1], tree.value[2 * node + 2] = -s.step * gl / (hl + s.ridge), -s.step * gr / (hr + s.ridge)
        grow(2 * node + 1, rows & on, level + 1)
        grow(2 * node + 2, rows & ~on, level + 1)

    grow(0, np.ones(bins.shape[1], bool), 0)
    return tree


@pytest.mark.parametrize("block_rows", [300, 1 << 16])
def test_first_tree_equals_a_plain_one(spark, monkeypatch, block_rows):
    monkeypatch.setattr(boosting, "BLOCK_ROWS", block_rows)
    x, df = table(spark, 800)
    edges = [np.arange(-2, 2, 0.25), np.arange(9.0), np.arange(-2, 2, 0.5)]
    s = Settings(rows=1, columns=1)
    model, = Booster(df, ["a", "b", "c"], "y", s, edges).fit([2], rounds=1, trim=False)
    train = x[x["split"] == "train"]
    p = train["y"].mean()
    bins = np.stack([to_bins(train[c].to_numpy(), e) for c, e in zip("abc", edges)])
    want, got = plain_tree(bins, p - train["y"].to_numpy(), np.full(len(train), p * (1 - p)), 2, s), model.trees[0]
    assert got.feature.tolist() == want.feature.tolist() and got.value == pytest.approx(want.value)
    assert got.place(bins).tolist() == want.place(bins).tolist()


def test_boosting_learns_stops_and_repeats(spark):
    x, df = table(spark)
    one, two = (Booster(df, ["a", "b", "c"], "y", Settings(step=0.2)).fit([1, 3], rounds=60, patience=8) for _ in range(2))
    assert [m.score for m in one] == [m.score for m in two]
    best = max(one, key=lambda m: m.score)
    assert best.score > 0.6 and len(best.trees) == best.best_round <= 60
    t = boosting.scorer(best, True)(df.where("split = 'test'")).toPandas()
    assert t["p"].between(0, 1).all()
    truth = 1.5 * (t["a"] > 0.3) * (t["b"] > 4) + np.where(t["c"].isna(), 0.8, 0)

    def area(p):
        p1, p0 = p[t["y"] == 1].to_numpy()[:, None], p[t["y"] == 0].to_numpy()[None, :]
        return ((p1 > p0) + (p1 == p0) / 2).mean()

    assert area(t["p"]) > area(truth) - 0.06  # the truth's own ranking is the best one


def test_absolute_error_beats_the_median(spark):
    x, df = table(spark)
    model, = Booster(df, ["a", "b", "c"], "change", Settings(step=0.2, absolute=True)).fit([3], rounds=30, patience=8)
    p = boosting.scorer(model, False)(df.where("split = 'test'")).select("change", "p").toPandas()
    assert (p["change"] - p["p"]).abs().mean() < 0.95 * (p["change"] - model.base).abs().mean()


def test_constant_and_missing_features(spark):
    df = spark.range(400).select(F.lit(1.0).alias("a"), F.lit(None).cast("double").alias("b"), (F.col("id") % 2).alias("y"), F.when(F.col("id") % 4 < 2, "train").otherwise("val").alias("split"))
    model, = Booster(df, ["a", "b"], "y", Settings()).fit([2], rounds=3, patience=2)
    assert model.trees == [] and boosting.scorer(model, True)(df).agg(F.min("p"), F.max("p")).first() == (0.5, 0.5)
    with pytest.raises(ValueError):
        Booster(df.where("split = 'val'"), ["a"], "y", Settings())


def test_best_cuts_leave_small_children_alone():
    sums = np.zeros((1, 2, 256))
    sums[0, 0, 1:3], sums[0, 1, 1:3] = (-4, 4), (4, 40)
    assert best_cuts(sums, Settings(child_weight=5))[0][0] == -np.inf
    assert best_cuts(sums, Settings(child_weight=4))[0][1:3] == (1, True)


# --- bootstrap ---------------------------------------------------------------

def scored(spark, n=3000, seed=3):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2, n)
    rows = pd.DataFrame({"id": np.arange(n), "g": rng.choice(["u", "v"], n, p=[0.9, 0.1]), "y": y, "p": (0.5 + 0.2 * (y - 0.5) + rng.normal(0, 0.2, n)).clip(0, 1).round(3), "p_ref": rng.random(n).round(2)})
    return rows, spark.createDataFrame(rows)


@pytest.mark.parametrize("per_node", [4, 512])
def test_every_replicate_has_exactly_n_rows(spark, per_node):
    rows, df = scored(spark)
    cells = df.groupBy("g", "y", "p").agg(F.count("*").alias("n")).cache()
    dealt = metrics.explode_weights(metrics.deal_cells(cells, ["g"], 40, "s", per_node))
    assert {r["n"] for r in dealt.where("g = 'u'").groupBy("rep").agg(F.sum("w").alias("n")).collect()} == {int((rows["g"] == "u").sum())}
    assert dealt.select("rep").distinct().count() == 41
    # weights of a cell scatter like binomial counts
    w = dealt.where("rep > 0").groupBy("g", "y", "p").agg(F.sum("w").alias("w")).join(cells, ["g", "y", "p"], "right").fillna(0).toPandas()
    assert ((w["w"] / 40 - w["n"]) / np.sqrt(w["n"] / 40)).std() == pytest.approx(1, abs=0.15)
    again = metrics.explode_weights(metrics.deal_cells(cells.repartition(3), ["g"], 40, "s", per_node))
    assert dealt.exceptAll(again).count() == 0


@pytest.mark.parametrize("chunk", [50, 2000])
def test_replicate_metrics_equal_those_of_the_rows(spark, monkeypatch, chunk):
    monkeypatch.setattr(metrics, "CHUNK_CELLS", chunk)
    _, df = scored(spark, 600)
    cells = df.groupBy("g", "y", "p").agg(F.count("*").alias("n"))
    dealt = metrics.deal_cells(cells, ["g"], 6, "s").cache()
    group = ["g", "rep"]
    want = metrics.ranking_metrics(metrics.score_cells(metrics.explode_weights(dealt), group, w=F.col("w")), group).toPandas().set_index(group).sort_index()
    got = metrics.replicate_metrics(dealt, ["g"], "p").toPandas().set_index(group).sort_index()
    for c in ("n", "events", "auroc", "auprc", "brier"):
        assert got[c].to_numpy(float) == pytest.approx(want[c].to_numpy(float), nan_ok=True)


def test_intervals_agree_with_drawn_rows(spark):
    _, df = scored(spark, 500)
    a = metrics.bootstrap(df, [], "id", 300, p_ref="p_ref").first()
    b = metrics.bootstrap(df, [], "id", 300, p_ref="p_ref", method="draws").first()
    assert a["min_drawn"] == a["max_drawn"] == 500 and a["auroc"] == pytest.approx(b["auroc"]) and a["delta_auroc"] == pytest.approx(b["delta_auroc"])
    for c in ("auroc", "auprc", "brier", "delta_auroc"):
        width = b[f"{c}_hi"] - b[f"{c}_lo"]
        assert abs(a[f"{c}_lo"] - b[f"{c}_lo"]) < 0.25 * width and abs(a[f"{c}_hi"] - b[f"{c}_hi"]) < 0.25 * width


def test_one_class_groups_have_no_area(spark):
    df = spark.createDataFrame([(i, "x", 1, 0.5) for i in range(5)] + [(9, "z", None, 0.1)], "id long, g string, y int, p double")
    r, = metrics.bootstrap(df, ["g"], "id", 10).collect()
    assert (r["g"], r["n"], r["auroc"], r["replicates"]) == ("x", 5, None, 0)
