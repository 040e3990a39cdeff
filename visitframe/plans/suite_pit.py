"""Window and point-in-time queries (E1-E19) and the flagship query."""

from __future__ import annotations

from pyspark.sql import functions as F

from visitframe.operators import pit
from visitframe.plans.fixtures import LABELLED, SPARSE, TIMED, VISITS
from visitframe.plans.suite import query

def event_now():
    return F.col("status") == 1

KEYS = ["entity_id", "visit_date", "visit_id"]
SPARSE_TIMED = SPARSE + """, st AS (SELECT *, date_diff('day', min(visit_date) OVER (PARTITION BY entity_id), visit_date) AS days,
 date_diff('day', min(visit_date) OVER (PARTITION BY entity_id), visit_date) / 365.25::DOUBLE AS years,
 row_number() OVER (PARTITION BY entity_id ORDER BY visit_date, visit_id) AS rn FROM sp)"""
W_UPTO = "(PARTITION BY entity_id ORDER BY visit_date, visit_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
W_BEFORE = "(PARTITION BY entity_id ORDER BY visit_date, visit_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


def timed(t, sparse=False):
    return pit.add_years(t.timeline(t.sparse() if sparse else t.visits()))


def labelled(t):
    """Visits with time, visit number, eligibility, survival pair and the one-year label."""
    tl = pit.visit_index(timed(t))
    tl = pit.eligible(tl, [2, 3, 4, 5], event_now())
    tl = pit.next_event(tl, event_now())
    return tl.with_columns({"label": pit.horizon_label(1.0)})


@query("entry_labels_by_site", f"""WITH {LABELLED} SELECT site, count(*) AS eligible_visits,
 count(*) FILTER (WHERE label = 1) AS n_yes, count(*) FILTER (WHERE label = 0) AS n_no,
 count(*) FILTER (WHERE label IS NULL) AS n_unknown FROM ev WHERE eligible GROUP BY site""")
def _(t):
    v = labelled(t).df.where("eligible")
    return v.groupBy("site").agg(F.count("*").alias("eligible_visits"), F.count_if(F.col("label") == 1).alias("n_yes"),
                                 F.count_if(F.col("label") == 0).alias("n_no"),
                                 F.count_if(F.col("label").isNull()).alias("n_unknown"))


@query("b3_years_since_first", f"WITH {TIMED} SELECT entity_id, visit_id, days, years FROM tv", "years")
def _(t):
    return timed(t).df.select("entity_id", "visit_id", F.col("days").cast("long"), "years")


@query("e1_ever_so_far", f"""WITH {SPARSE} SELECT entity_id, visit_id,
 max(CAST(score > 30 AS BIGINT)) OVER {W_UPTO} AS ever_high FROM sp""")
def _(t):
    tl = pit.ever(t.timeline(t.sparse()), ever_high=(F.col("score") > 30).cast("int"))
    return tl.df.select("entity_id", "visit_id", "ever_high")


@query("e2_carry_forward", f"""WITH {SPARSE}, c AS (SELECT entity_id, visit_id,
 last_value(score IGNORE NULLS) OVER {W_UPTO} AS carried,
 max(CAST(status <= 2 AS BIGINT)) OVER {W_UPTO} AS flag FROM sp)
 SELECT entity_id, visit_id, CASE WHEN flag = 0 THEN 0.0 ELSE carried END AS carried FROM c""", "carried")
def _(t):
    tl = pit.carry(t.timeline(t.sparse()), carried=F.col("score"))
    tl = pit.ever(tl, flag=(F.col("status") <= 2).cast("int"))
    return tl.df.select("entity_id", "visit_id", F.when(F.col("flag") == 0, 0.0).otherwise(F.col("carried")).alias("carried"))


@query("e3_spread_invariant", f"""WITH {SPARSE}, g AS (SELECT entity_id,
 arg_min(score, (visit_date, visit_id)) FILTER (WHERE score IS NOT NULL) AS fact FROM sp GROUP BY entity_id)
 SELECT entity_id, visit_id, fact, CAST(fact IS NULL AS BIGINT) AS fact_unknown FROM sp JOIN g USING (entity_id)""", "fact")
def _(t):
    return pit.spread(t.timeline(t.sparse()), F.col("score"), "fact").df.select("entity_id", "visit_id", "fact", "fact_unknown")


SLOPE_SQL = f"""WITH {SPARSE_TIMED}, r AS (SELECT *, count(score) OVER w AS n,
 sum(CASE WHEN score IS NOT NULL THEN years END) OVER w AS sx, sum(score) OVER w AS sy,
 sum(CASE WHEN score IS NOT NULL THEN years * years END) OVER w AS sxx, sum(years * score) OVER w AS sxy
 FROM st WINDOW w AS {W_UPTO})
 SELECT entity_id, visit_id, CASE WHEN n >= 2 AND score IS NOT NULL AND n * sxx - sx * sx > 1e-9
 THEN greatest(least((n * sxy - sx * sy) / (n * sxx - sx * sx), 10.0), -10.0) END AS slope_score FROM r"""


@query("e4_running_slope", SLOPE_SQL, "slope_score", digits=4)
def _(t):
    return pit.running_slope(timed(t, True), "score").df.select("entity_id", "visit_id", "slope_score")


@query("e5_delta_since_known", f"""WITH {SPARSE} SELECT entity_id, visit_id,
 score - last_value(score IGNORE NULLS) OVER {W_BEFORE} AS delta_score FROM sp""", "delta_score")
def _(t):
    return pit.delta(t.timeline(t.sparse()), "score").df.select("entity_id", "visit_id", "delta_score")


@query("e6_visit_index", f"WITH {TIMED} SELECT entity_id, visit_id, rn AS visit_no, rn - 1 AS n_prior_visits, years AS years_of_history FROM tv",
       "years_of_history")
def _(t):
    return pit.visit_index(timed(t)).df.select("entity_id", "visit_id", F.col("visit_no").cast("long"), "n_prior_visits", "years_of_history")


@query("e7_next_event", f"""WITH {LABELLED} SELECT entity_id, visit_id, time_to_event, followup_after, event_time, event FROM ev""",
       "time_to_event followup_after event_time")
def _(t):
    return labelled(t).df.select("entity_id", "visit_id", "time_to_event", "followup_after", "event_time", "event")


@query("e8_horizon_labels", f"""WITH {LABELLED} SELECT entity_id, visit_id,
 CAST(CASE WHEN time_to_event <= 1 THEN 1 WHEN followup_after >= 1 THEN 0 END AS BIGINT) AS y_1y,
 CAST(CASE WHEN time_to_event <= 2 THEN 1 WHEN followup_after >= 2 THEN 0 END AS BIGINT) AS y_2y,
 CAST(CASE WHEN time_to_event <= 3 THEN 1 WHEN followup_after >= 3 THEN 0 END AS BIGINT) AS y_3y FROM ev""")
def _(t):
    df = labelled(t).df
    return df.select("entity_id", "visit_id", *[pit.horizon_label(float(h)).alias(f"y_{h}y") for h in (1, 2, 3)])


FUTURE = SPARSE_TIMED + """, fut AS (SELECT a.entity_id, a.visit_id, a.score, a.rn, a.years, max(b.score) AS max_future
 FROM st a LEFT JOIN st b ON a.entity_id = b.entity_id AND b.rn > a.rn AND b.years - a.years <= 3 GROUP BY ALL)"""


@query("e9_max_future", f"WITH {FUTURE} SELECT entity_id, visit_id, max_future FROM fut", "max_future")
def _(t):
    return pit.max_future(timed(t, True), "score", 3.0).df.select("entity_id", "visit_id", "max_future")


@query("e10_rise_label", f"""WITH {FUTURE}, fw AS (SELECT *, max(years) OVER (PARTITION BY entity_id) - years AS followup FROM fut)
 SELECT entity_id, visit_id, CAST(CASE WHEN score IS NOT NULL THEN CASE WHEN max_future - score >= 1 THEN 1
 WHEN followup >= 3 THEN 0 END END AS BIGINT) AS y_rise FROM fw""")
def _(t):
    tl = pit.max_future(pit.next_event(timed(t, True), event_now()), "score", 3.0)
    return tl.df.select("entity_id", "visit_id", pit.rise_label("score", "max_future", 1.0, 3.0).alias("y_rise"))


@query("e11_eligible", f"WITH {LABELLED} SELECT entity_id, visit_id, eligible AND packet IN ('F', 'O') AS eligible FROM ev")
def _(t):
    tl = pit.eligible(t.timeline(), [2, 3, 4, 5], event_now(), F.col("packet").isin("F", "O"))
    return tl.df.select("entity_id", "visit_id", "eligible")


@query("e12_visit_gaps", f"""WITH {VISITS} SELECT entity_id, visit_id, date_diff('day', lag(visit_date) OVER
 (PARTITION BY entity_id ORDER BY visit_date, visit_id), visit_date) / 30.44::DOUBLE AS gap_months FROM v""", "gap_months")
def _(t):
    return pit.visit_gaps(t.timeline()).df.select("entity_id", "visit_id", "gap_months")


@query("e13_first_last_state", f"""WITH {VISITS} SELECT entity_id, CAST(arg_min(status, (visit_date, visit_id)) AS BIGINT) AS first_status,
 CAST(arg_max(status, (visit_date, visit_id)) AS BIGINT) AS last_status FROM v GROUP BY entity_id""")
def _(t):
    v = t.visits()
    first = pit.first_row(v, ["status"]).withColumnRenamed("status", "first_status")
    return first.join(pit.first_row(v, ["status"], last=True).withColumnRenamed("status", "last_status"), "entity_id")


@query("e14_change_at_horizons", f"""WITH {SPARSE_TIMED}, k AS (SELECT * FROM st WHERE score IS NOT NULL),
 g AS (SELECT entity_id, arg_min(score, (visit_date, visit_id)) FILTER (WHERE years = 0) AS base,
 arg_min(score, (abs(years - 1), visit_date, visit_id)) FILTER (WHERE abs(years - 1) <= 0.5) AS a1,
 arg_min(score, (abs(years - 3), visit_date, visit_id)) FILTER (WHERE abs(years - 3) <= 0.5) AS a3 FROM k GROUP BY entity_id)
 SELECT entity_id, a1 - base AS change_1, a3 - base AS change_3 FROM g""", "change_1 change_3")
def _(t):
    return pit.change_at(timed(t, True).df, "score", [1.0, 3.0])


@query("e14_change_shares", f"""WITH {SPARSE_TIMED}, k AS (SELECT * FROM st WHERE score IS NOT NULL),
 g AS (SELECT entity_id, arg_min(score, (visit_date, visit_id)) FILTER (WHERE years = 0) AS base,
 arg_min(score, (abs(years - 1), visit_date, visit_id)) FILTER (WHERE abs(years - 1) <= 0.5) AS a1,
 arg_min(score, (abs(years - 3), visit_date, visit_id)) FILTER (WHERE abs(years - 3) <= 0.5) AS a3 FROM k GROUP BY entity_id),
 l AS (SELECT 1.0::DOUBLE AS horizon, a1 - base AS c FROM g UNION ALL SELECT 3.0, a3 - base FROM g)
 SELECT horizon, count(c) AS n, avg(CAST(c <= 0 AS INT)) FILTER (WHERE c IS NOT NULL) AS share_le0,
 avg(CAST(c >= 1 AS INT)) AS share_ge1, avg(CAST(c >= 2 AS INT)) AS share_ge2 FROM l GROUP BY horizon""", "share_le0 share_ge1 share_ge2")
def _(t):
    c = pit.change_at(timed(t, True).df, "score", [1.0, 3.0])
    long = c.select(F.explode(F.array(F.struct(F.lit(1.0).alias("horizon"), F.col("change_1").alias("c")),
                                      F.struct(F.lit(3.0).alias("horizon"), F.col("change_3").alias("c")))).alias("x")).select("x.*")
    share = lambda cond: F.avg(cond.cast("int"))
    return long.groupBy("horizon").agg(F.count("c").alias("n"), share(F.col("c") <= 0).alias("share_le0"),
                                       share(F.col("c") >= 1).alias("share_ge1"), share(F.col("c") >= 2).alias("share_ge2"))


TTE = TIMED + """, tte AS (SELECT entity_id, segment, CAST(coalesce(ev, last) AS DOUBLE) AS time, CAST(ev IS NOT NULL AS BIGINT) AS event FROM (
 SELECT entity_id, any_value(segment) AS segment, arg_min(status, (visit_date, visit_id)) AS s0,
 min(CASE WHEN years > 0 AND status = 1 THEN years END) AS ev, max(CASE WHEN years > 0 THEN years END) AS last
 FROM tv GROUP BY entity_id) WHERE s0 IN (2, 3) AND last IS NOT NULL)"""


@query("e15_time_to_event", f"WITH {TTE} SELECT entity_id, time, event FROM tte", "time")
def _(t):
    return pit.time_to_event(timed(t).df, [2, 3], [1])


KM_SQL = TTE + """, c AS (SELECT segment, time, sum(event) AS d, count(*) AS n FROM tte GROUP BY 1, 2),
 r AS (SELECT *, sum(n) OVER (PARTITION BY segment ORDER BY time ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS risk FROM c),
 sv AS (SELECT *, product(1 - d / CAST(risk AS DOUBLE)) OVER (PARTITION BY segment ORDER BY time) AS surv FROM r)"""


@query("e16_kaplan_meier", f"""WITH {KM_SQL} SELECT segment, g.y AS years,
 (1 - coalesce(min(CASE WHEN time <= g.y THEN surv END), 1.0)) * 100 AS incidence_pct
 FROM sv, (SELECT i * 0.5::DOUBLE AS y FROM range(0, 13) t(i)) g GROUP BY 1, 2""", "incidence_pct")
def _(t):
    tte = with_segment(t)
    return pit.kaplan_meier(tte, [i * 0.5 for i in range(13)], ["segment"])


def with_segment(t):
    tte = pit.time_to_event(timed(t).df, [2, 3], [1])
    return tte.join(t.customer.select(F.col("c_custkey").alias("entity_id"), F.col("c_mktsegment").alias("segment")), "entity_id")


@query("e16_horizon_counts", f"""WITH {TTE} SELECT segment, h AS horizon, count(*) AS n,
 count(*) FILTER (WHERE (event = 1 AND time <= h) OR time >= h) AS known, count(*) FILTER (WHERE event = 1 AND time <= h) AS events
 FROM tte, (VALUES (2.0::DOUBLE), (3.0), (5.0)) g(h) GROUP BY 1, 2""")
def _(t):
    return pit.horizon_counts(with_segment(t), [2.0, 3.0, 5.0], ["segment"])


@query("e17_landmarks", f"""WITH {LABELLED}, lm AS (SELECT * FROM ev WHERE eligible AND rn >= 3 AND label IS NOT NULL)
 SELECT entity_id, arg_min(visit_id, (md5(concat_ws('|', entity_id, visit_date, visit_id, 'landmark')), visit_date, visit_id)) AS visit_id,
 CAST(arg_min(label, (md5(concat_ws('|', entity_id, visit_date, visit_id, 'landmark')), visit_date, visit_id)) AS BIGINT) AS label
 FROM lm GROUP BY entity_id""")
def _(t):
    return pit.one_landmark(pit.landmarks(labelled(t).df), ["visit_id", "label"], "landmark")


@query("e18_visit_sequence", f"""WITH {SPARSE_TIMED} SELECT a.entity_id, a.visit_id, g.k AS step,
 CAST(b.rn IS NULL AS BIGINT) AS padding, coalesce(a.years - b.years, 0) AS lag_years, coalesce(b.score, 0) AS score,
 CAST(b.rn IS NOT NULL AND b.score IS NULL AS BIGINT) AS score_missing
 FROM st a CROSS JOIN range(0, 6) g(k) LEFT JOIN st b ON a.entity_id = b.entity_id AND b.rn = a.rn - 5 + g.k""", "lag_years score")
def _(t):
    seq = pit.visit_sequence(timed(t, True), ["score"])
    return (seq.select("entity_id", "visit_id", F.posexplode("sequence").alias("step", "x"))
            .select("entity_id", "visit_id", "step", "x.padding", "x.lag_years", "x.score", "x.score_missing"))


@query("e19_percentile_of_score", f"""WITH {VISITS}, q AS (SELECT quantile_cont(score, [i / 20.0 FOR i IN range(0, 21)]) AS edges FROM v)
 SELECT visit_id, CAST(len([x FOR x IN edges IF x < score]) * 5 AS BIGINT) AS percentile FROM v, q""")
def _(t):
    from visitframe.operators.profile import reference_vector
    v = t.visits()
    v = v.withColumn("edges", reference_vector(v, "score").scalar())
    return v.select("visit_id", pit.percentile_of(F.col("score"), F.col("edges")).alias("percentile"))
