"""The second way to a horizon label: range frames, with and without hot entities."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from visitframe.operators import pit
from visitframe.scaling import Timeline


def test_recount_needs_no_join_and_agrees_with_the_daily_counts(spark):
    rng = np.random.default_rng(3)
    rows = [(int(e), dt.date(2000, 1, 1) + dt.timedelta(int(d)), i, int(s)) for i, (e, d, s) in enumerate(zip(rng.integers(0, 8, 300), rng.integers(0, 1500, 300), rng.integers(1, 6, 300)))]
    rows += [(1, None, 900, 1), (2, dt.date(2000, 5, 1), 901, None), (2, dt.date(2000, 5, 1), 902, 1)]
    df = spark.createDataFrame(rows, "entity_id long, visit_date date, visit_id long, status int")
    out = []
    for hot in ([], [1, 2, 5]):
        tl = pit.add_years(Timeline(df, hot=hot))
        found = pit.label_recount(tl, F.col("status") == 1, 1.0)
        if not hot:
            assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
        out.append({r["visit_id"]: r["label_recount"] for r in found.collect()})
    assert out[0] == out[1] and set(out[0].values()) == {None, 0, 1}


def test_first_scan_is_sent_once_and_gaps_are_found_once(spark, tables):
    from visitframe.operators import joins

    first = joins.first_scan(tables.scans(), ["source"])
    assert "min_by" not in first._jdf.queryExecution().optimizedPlan().toString()
    plan = joins.linkage_summary(tables.scans(), tables.visits())._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan
    rows = [(1, "b", 2), (1, "a", 1), (1, None, 0), (2, "c", None)]
    df = spark.createDataFrame(rows, "entity_id long, scan_id string, source int").withColumn("scan_date", F.lit("2000-01-01").cast("date"))
    for last, want in ((False, {1: (None, 0), 2: ("c", None)}), (True, {1: ("b", 2), 2: ("c", None)})):
        got = pit.first_row(df, ["scan_id", "source", "scan_date"], order=("scan_date", "scan_id"), last=last).collect()
        assert {r["entity_id"]: (r["scan_id"], r["source"]) for r in got} == want
