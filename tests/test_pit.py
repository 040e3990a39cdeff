"""Time semantics on hand-made frames, and the chunked scan against the plain one."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from visitframe.operators import pit
from visitframe.plans.suite_pit import event_now
from visitframe.scaling import Run, Timeline

D = lambda days: dt.date(2000, 1, 1) + dt.timedelta(days=days)


def frame(spark, rows):
    return spark.createDataFrame([(e, D(d), i, s, sc) for e, d, i, s, sc in rows],
                                 "entity_id long, visit_date date, visit_id long, status int, score double")


def by_visit(df, *cols):
    return {r["visit_id"]: tuple(r[c] for c in cols) for r in df.collect()}


def test_ever_is_null_before_any_report_then_sticky(spark):
    tl = Timeline(frame(spark, [(1, 0, 1, 1, None), (1, 10, 2, 1, 0.0), (1, 20, 3, 1, 1.0), (1, 30, 4, 1, None), (1, 40, 5, 1, 0.0)]))
    out = by_visit(pit.ever(tl, e=F.col("score").cast("int")).df, "e")
    assert [out[i][0] for i in range(1, 6)] == [None, 0, 1, 1, 1]


def test_delta_uses_last_known_earlier_value(spark):
    tl = Timeline(frame(spark, [(1, 0, 1, 1, None), (1, 10, 2, 1, 5.0), (1, 20, 3, 1, None), (1, 30, 4, 1, 7.0)]))
    out = by_visit(pit.delta(tl, "score").df, "delta_score")
    assert [out[i][0] for i in (1, 2, 3, 4)] == [None, None, None, 2.0]


def test_slope_needs_two_known_values_and_spread_in_time(spark):
    tl = pit.add_years(Timeline(frame(spark, [(1, 0, 1, 1, 1.0), (1, 0, 2, 1, 3.0), (2, 0, 3, 1, 1.0), (2, 365, 4, 1, None), (2, 731, 5, 1, 3.0)])))
    out = by_visit(pit.running_slope(tl, "score").df, "slope_score")
    assert out[1][0] is None and out[2][0] is None       # identical times
    assert out[3][0] is None and out[4][0] is None       # one value; current value unknown
    assert out[5][0] == pytest.approx(2 / (731 / 365.25))


def test_label_order_horizon_and_same_day_rows(spark):
    rows = [(1, 0, 1, 2, 0.0), (1, 0, 2, 1, 0.0),            # a later row on the same day counts as later
            (2, 0, 3, 2, 0.0), (2, 400, 4, 2, 0.0),          # followed beyond one year, no event
            (3, 0, 5, 2, 0.0), (3, 100, 6, 2, 0.0),          # censored
            (4, 0, 7, 2, 0.0), (4, 500, 8, 1, 0.0),          # event after the horizon
            (5, 0, 9, 2, 0.0)]                               # single visit
    tl = pit.next_event(pit.add_years(Timeline(frame(spark, rows))), event_now())
    tl = pit.eligible(tl.with_columns({"label": pit.horizon_label(1.0)}), [2, 3], event_now())
    out = by_visit(tl.df, "label", "eligible", "event")
    assert out[1][:2] == (1, True) and out[2][1] is False and out[3][0] == 0 and out[5][0] is None
    assert out[7] == (0, True, 1) and out[9] == (None, True, 0)


def test_max_future_excludes_the_row_itself_and_respects_the_horizon(spark):
    tl = pit.add_years(Timeline(frame(spark, [(1, 0, 1, 1, 9.0), (1, 0, 2, 1, 4.0), (1, 1095, 3, 1, 6.0), (1, 1096, 4, 1, 8.0)])))
    out = by_visit(pit.max_future(tl, "score", 3.0).df, "max_future")
    assert out == {1: (6.0,), 2: (6.0,), 3: (8.0,), 4: (None,)}


def test_first_row_and_first_known_differ(spark):
    df = frame(spark, [(1, 0, 1, 1, None), (1, 10, 2, 2, 5.0)])
    assert pit.first_row(df, ["status", "score"]).first()[1:] == (1, None)
    assert pit.first_known(df, ["status", "score"]).first()[1:] == (1, 5.0)


def test_kaplan_meier_reaches_zero_survival(spark):
    tte = spark.createDataFrame([(1.0, 1), (1.0, 1), (2.0, 1)], "time double, event int")
    out = {r["years"]: r["incidence_pct"] for r in pit.kaplan_meier(tte, [0.5, 1.0, 3.0]).collect()}
    assert out == {0.5: 0.0, 1.0: pytest.approx(200 / 3), 3.0: 100.0}


def test_label_recount_agrees_with_brute_force(spark, tables):
    tl = pit.add_years(tables.timeline())
    rows = sorted(tl.df.select("entity_id", "visit_date", "visit_id", "years", "status").collect(), key=lambda r: (r[0], r[1], r[2]))
    got = by_visit(pit.label_recount(tl, event_now(), 1.0), "label_recount")
    for i, r in enumerate(rows):
        later = [(x["years"] - r["years"], x["status"]) for x in rows[i + 1:] if x["entity_id"] == r["entity_id"]]
        hit = [t for t, s in later if s == 1]
        want = 1 if hit and min(hit) <= 1 else (0 if later and max(t for t, _ in later) >= 1 else None)
        assert got[r["visit_id"]][0] == want


FULL = ["n_before", "s_upto", "mx_after", "mn_all", "last_b", "next_a", "first_all", "last_all", "cnt_u"]


def all_runs(tl):
    sc = F.col("score")
    return tl.runs(n_before=Run("count", F.lit(1), "before"), s_upto=Run("sum", sc), mx_after=Run("max", sc, "after"), mn_all=Run("min", sc, "all"),
                   last_b=Run("last", sc, "before"), next_a=Run("last", sc, "after"), first_all=Run("first", sc, "all"), last_all=Run("last", sc, "all"),
                   cnt_u=Run("count", sc, "upto"))


def rounded(rows):
    return {k: tuple(round(x, 6) if isinstance(x, float) else x for x in v) for k, v in rows.items()}


def test_hot_entities_are_scanned_in_chunks_with_the_same_result(spark, tables):
    df = tables.sparse()
    # one entity holds a third of all rows, several of them on one day
    hot = df.withColumn("entity_id", F.when(F.col("visit_id") % 3 == 0, 999_999).otherwise(F.col("entity_id")))
    plain = rounded(by_visit(all_runs(Timeline(hot, hot=[])).df, *FULL))
    chunked = rounded(by_visit(all_runs(Timeline(hot, hot=[999_999])).df, *FULL))
    assert plain == chunked
    monthly = rounded(by_visit(all_runs(Timeline(hot, hot=[999_999], chunk=F.trunc("visit_date", "month"))).df, *FULL))
    assert plain == monthly


def test_hot_keys_are_found_and_null_keys_form_one_group(spark):
    rows = [(None if i % 2 else i, D(i), i, 1, float(i)) for i in range(40)]
    df = spark.createDataFrame(rows, "entity_id long, visit_date date, visit_id long, status int, score double")
    from visitframe.scaling import hot_keys
    assert [r[0] for r in hot_keys(df, "entity_id", 5).collect()] == [None]
    out = by_visit(all_runs(Timeline(df, hot=[None])).df, *FULL)
    assert rounded(out) == rounded(by_visit(all_runs(Timeline(df, hot=[])).df, *FULL))


def test_visit_sequence_same_for_hot_entities(spark, tables):
    df = tables.sparse().withColumn("entity_id", F.when(F.col("visit_id") % 3 == 0, 999_999).otherwise(F.col("entity_id")))
    seq = lambda hot: {r["visit_id"]: r["s"] for r in pit.visit_sequence(pit.add_years(Timeline(df, hot=hot)), ["score"])
                       .select("visit_id", F.to_json("sequence").alias("s")).collect()}
    assert seq([]) == seq([999_999])


def test_no_future_property(spark, tables):
    from visitframe.operators.splits import check_no_future
    from visitframe.plans.suite_splits import trajectory_features
    v = pit.visit_index(pit.add_years(tables.timeline(tables.sparse()))).df.select("entity_id", "visit_date", "visit_id", "score", "visit_no")
    for k in (1, 2, 4):
        out = check_no_future(v, lambda d: trajectory_features(d.drop("visit_no")), k, ["ever_high", "carried", "slope_score", "delta_score"])
        assert all(r["n_changed"] == 0 and r["n_compared"] > 0 for r in out.collect())


def test_half_year_rounds_to_even(spark):
    from visitframe.functions.columns import year_bin
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,)], "y double")
    assert [r[0] for r in df.select(year_bin("y")).collect()] == [0, 2, 2]
    assert math.isclose(365 / 365.25, df.select(F.lit(365) / F.lit(365.25)).first()[0])
