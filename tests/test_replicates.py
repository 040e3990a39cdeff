"""Replicate weights by cell: row draws, and concordance of all replicates at once."""

import hashlib

import numpy as np
from pyspark.sql import functions as F

from visitframe.functions.md5 import leading_draws
from visitframe.operators import metrics


def test_md5_of_numbered_texts():
    for head, tail in ((b"BUILDING|7|", b"|boot"), ("ä".encode(), b""), (b"x" * 60, b"|long")):
        want = [int(hashlib.md5(head + str(i).encode() + tail).hexdigest()[:15], 16) for i in range(95, 1_020)]
        assert leading_draws(head, 95, 1_020, tail).tolist() == want


def test_row_draws_by_cell_are_those_of_the_rows(spark, monkeypatch):
    monkeypatch.setattr(metrics, "POSITIONS", 16)
    monkeypatch.setattr(metrics, "HELD_WEIGHTS", 100)
    rng = np.random.default_rng(1)
    rows = [(g, i, int(rng.integers(2)), float(rng.integers(20)) / 20) for g, n in (("a", 70), (None, 45), ("c", 1)) for i in range(n)]
    df = spark.createDataFrame([*rows, ("a", 3, 1, 0.5)], "g string, id long, y int, p double")
    dealt = metrics.draw_cells(df, ["g"], "id", 40, "s")
    got = {tuple(r[:4]): r["w"] for r in metrics.explode_weights(dealt).where("rep > 0").select("g", "rep", "y", "p", "w").collect()}
    want = {tuple(r[:4]): r["w"] for r in metrics.resample(df, ["g"], "id", 40, "s").groupBy("g", "rep", "y", "p").agg(F.sum("w").alias("w")).collect()}
    assert got == want and len(want) > 100
    own = {tuple(r[:3]): r["w"] for r in metrics.explode_weights(dealt).where("rep = 0").select("g", "y", "p", "w").collect()}
    assert own == {tuple(r[:3]): r["n"] for r in df.groupBy("g", "y", "p").agg(F.count("*").alias("n")).collect()}


def test_concordance_of_all_replicates_is_that_of_each(spark, monkeypatch):
    monkeypatch.setattr(metrics, "RISK_CELLS", 60)     # blocks are cut by risk
    rng = np.random.default_rng(2)
    rows = [(float(t) / 7, int(rng.integers(2)), float(r) / 4, int(rng.integers(1, 4))) for t, r in zip(rng.integers(1, 500, 600), rng.integers(0, 90, 600))]
    rows += [(1.0, 1, float("nan"), 2), (2.0, 0, None, 1), (None, 1, 3.0, 1), (1.0, None, 3.0, 1), (1.0, 1, 0.0, 1), (1.0, 0, -0.0, 1)]
    cells = spark.createDataFrame(rows, "time double, event int, risk double, n long").groupBy("time", "event", "risk").agg(F.sum("n").alias("n"))
    dealt = metrics.stage(metrics.deal_cells(cells, [], 6, "s"), "dealt")
    want = metrics.concordance_counts(metrics.explode_weights(dealt), ["rep"], w="w").collect()
    got = metrics.replicate_concordance(dealt, "time", "event", "risk").select("rep", "concordant", "tied", "comparable").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) == 7


def test_registered_bootstrap_returns_its_intervals():
    from visitframe.plans import registry

    assert "auprc_lo" in registry.ORACLES["j4_bootstrap"] and "md5" in registry.ORACLES["j4_bootstrap"]


def test_paired_gain_leaves_out_the_precision(spark):
    from visitframe.operators import models

    rng = np.random.default_rng(5)
    rows = [(i, "a" if i % 3 else "b", int(rng.integers(2)), float(rng.integers(30)) / 30, float(rng.integers(9)) / 9) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, g string, y int, p double, p_ref double")
    whole = metrics.bootstrap(df, ["g"], "id", 50, p_ref="p_ref")
    short = metrics.bootstrap(df, ["g"], "id", 50, p_ref="p_ref", precision=False)
    assert set(whole.columns) - set(short.columns) == {"auprc", "auprc_lo", "auprc_hi"}
    assert sorted(map(tuple, whole.select(*short.columns).collect())) == sorted(map(tuple, short.collect()))
    gain = models.paired_gain(df.select("id", "g", "y", "p"), df.select("id", F.col("p_ref").alias("p")), "id", ["g"], 50)
    assert sorted(map(tuple, gain.collect())) == sorted(map(tuple, whole.select("g", "delta_auroc_lo", "delta_auroc_hi").collect()))
