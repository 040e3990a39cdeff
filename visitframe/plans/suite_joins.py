"""Join queries (C1-C13) and the linkage summary."""

from __future__ import annotations

from pyspark.sql import functions as F

from visitframe.operators import joins, pit
from visitframe.plans.fixtures import LABELLED, SCANS, TIMED, VISITS
from visitframe.plans.suite import query
from visitframe.plans.suite_pit import event_now, labelled, timed

FIRST_SCAN = SCANS + ", fs AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY scan_date, scan_id) = 1)"
INDEX = VISITS + ", " + FIRST_SCAN + """, ix AS (SELECT fs.entity_id, scan_date, scan_id, measure,
 abs(date_diff('day', scan_date, visit_date)) AS gap_days, visit_date AS i_visit_date, visit_id AS i_visit_id, status AS i_status, score AS i_score
 FROM fs JOIN v USING (entity_id) WHERE abs(date_diff('day', scan_date, visit_date)) <= 365
 QUALIFY row_number() OVER (PARTITION BY fs.entity_id ORDER BY abs(date_diff('day', scan_date, visit_date)), visit_date, visit_id) = 1)"""


def index_visits(t):
    return joins.nearest_visit(t.scans(), t.visits(), ["status", "score"], ["measure"])


@query("c1_left_lookup", """WITH r AS (SELECT p_partkey, min(p_brand) AS brand FROM part WHERE p_size > 10 GROUP BY 1)
 SELECT l_returnflag, count(*) AS n, count(brand) AS hits FROM lineitem LEFT JOIN r ON l_partkey = p_partkey GROUP BY 1""")
def _(t):
    right = t.part.where("p_size > 10").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("brand"))
    j = joins.left_lookup(t.lineitem, right, "l_partkey", [F.col("brand")], ["brand"])
    return j.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.count_if("hit").alias("hits"))


@query("c2_exists_in", f"""WITH {VISITS}, {SCANS} SELECT CAST(tracer AS BIGINT) AS tracer, count(*) AS n_matched FROM s
 WHERE (entity_id, scan_date) IN (SELECT (entity_id, visit_date) FROM v) GROUP BY 1""")
def _(t):
    visits = t.visits().withColumnRenamed("visit_date", "scan_date")
    return joins.exists_in(t.scans(), visits, ["entity_id", "scan_date"]).groupBy("tracer").agg(F.count("*").alias("n_matched"))


@query("c3_nearest_visit", f"""WITH {INDEX} SELECT entity_id, scan_id, gap_days, i_visit_id, CAST(i_status AS BIGINT) AS i_status, i_score, measure FROM ix""",
       "i_score")
def _(t):
    return index_visits(t).select("entity_id", "scan_id", "gap_days", "i_visit_id", "i_status", "i_score", "measure")


ANCHOR = LABELLED + ", " + SCANS + """, qs AS (SELECT * FROM s WHERE qc),
 an AS (SELECT entity_id, min(scan_date) AS anchor FROM qs GROUP BY 1),
 aw AS (SELECT ev.entity_id, visit_date, visit_id, anchor, date_diff('day', anchor, visit_date) AS gap FROM ev JOIN an USING (entity_id)
  WHERE eligible AND date_diff('day', anchor, visit_date) BETWEEN 0 AND 365
  QUALIFY row_number() OVER (PARTITION BY ev.entity_id ORDER BY date_diff('day', anchor, visit_date), visit_date, visit_id) = 1)"""


def asof_index(t):
    scans = t.scans().where("qc")
    anchor = scans.groupBy("entity_id").agg(F.min("scan_date").alias("anchor"))
    return joins.asof_forward(anchor, labelled(t).df.where("eligible").select("entity_id", "visit_date", "visit_id"), [])


@query("c4_asof_forward", f"WITH {ANCHOR} SELECT entity_id, visit_id, gap FROM aw")
def _(t):
    return asof_index(t).select("entity_id", "visit_id", "gap")


@query("c5_attach_measures", f"""WITH {ANCHOR}, q1 AS (SELECT * FROM qs WHERE source = 'a'
  QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY scan_date, scan_id) = 1),
 m AS (SELECT aw.entity_id, aw.visit_id, measure, date_diff('day', visit_date, scan_date) AS g FROM aw LEFT JOIN q1 USING (entity_id))
 SELECT entity_id, visit_id, CASE WHEN g BETWEEN -365 AND 0 THEN measure END AS a_measure,
 CASE WHEN g BETWEEN -365 AND 0 THEN g END AS a_gap_days, CAST(coalesce(g BETWEEN -365 AND 0, false) AS BIGINT) AS has_a FROM m""")
def _(t):
    scans = t.scans().where("qc AND source = 'a'")
    return joins.attach(asof_index(t).select("entity_id", "visit_date", "visit_id"), scans, ["measure"], -365, 0, "a").select(
        "entity_id", "visit_id", "a_measure", "a_gap_days", "has_a")


FOLLOW = INDEX + """, fe AS (SELECT ix.entity_id, any_value(i_status) AS i_status,
 max(date_diff('day', i_visit_date, visit_date) / 365.25::DOUBLE) AS followup_years, max(status) AS worst_status, max(score - i_score) AS max_rise
 FROM ix JOIN v USING (entity_id) WHERE date_diff('day', i_visit_date, visit_date) / 365.25::DOUBLE > 0.25 GROUP BY 1)"""


@query("c6_followup_events", f"""WITH {FOLLOW} SELECT entity_id, CAST(i_status AS BIGINT) AS i_status, followup_years,
 CAST(worst_status AS BIGINT) AS worst_status, max_rise FROM fe""", "followup_years max_rise")
def _(t):
    return joins.followup_events(index_visits(t), t.visits())


@query("c7_semi_anti", f"""WITH {VISITS}, {SCANS} SELECT segment, count(*) FILTER (WHERE k) AS kept, count(*) FILTER (WHERE NOT k) AS dropped
 FROM (SELECT segment, entity_id IN (SELECT entity_id FROM s WHERE tracer = 7 AND source = 'a' AND measure > 45) AS k FROM v) GROUP BY 1""")
def _(t):
    ids = t.scans().where("tracer = 7 AND source = 'a' AND measure > 45")
    v = t.visits()
    kept = joins.keep_ids(v, ids).groupBy("segment").agg(F.count("*").alias("kept"))
    dropped = joins.drop_ids(v, ids).groupBy("segment").agg(F.count("*").alias("dropped"))
    return (kept.join(dropped, "segment", "full").select("segment", F.coalesce("kept", F.lit(0)).alias("kept"),
                                                         F.coalesce("dropped", F.lit(0)).alias("dropped")))


@query("c8_with_split", f"""WITH {VISITS}, b AS (SELECT entity_id, arg_min(status, (visit_date, visit_id)) AS base FROM v GROUP BY 1)
 SELECT CAST(base AS BIGINT) AS base_status, count(*) AS n_visits, avg(score) AS mean_score FROM v JOIN b USING (entity_id) GROUP BY 1""", "mean_score")
def _(t):
    v = t.visits()
    base = pit.first_row(v, ["status"]).withColumnRenamed("status", "split")
    return joins.with_split(v, base).groupBy(F.col("split").alias("base_status")).agg(
        F.count("*").alias("n_visits"), F.avg("score").alias("mean_score"))


@query("c9_similar_cell", f"""WITH {LABELLED}, g AS (SELECT *, CASE WHEN acctbal < 2000 THEN 'low' WHEN acctbal < 6000 THEN 'mid' ELSE 'high' END AS grp FROM ev
  WHERE eligible AND rn = 1), cells AS (SELECT grp, segment, count(*) AS n, sum(label) AS events FROM g
  WHERE label IS NOT NULL AND segment IN ('BUILDING', 'MACHINERY', 'FURNITURE') GROUP BY 1, 2),
 whole AS (SELECT grp, sum(n) AS n, sum(events) AS events FROM cells GROUP BY 1)
 SELECT g.entity_id, c.n IS NOT NULL AS cell_found, CAST(coalesce(c.n, w.n) AS BIGINT) AS cell_n,
 CAST(coalesce(c.events, w.events) AS BIGINT) AS cell_events, coalesce(c.events, w.events) / coalesce(c.n, w.n) AS cell_rate
 FROM g LEFT JOIN cells c ON g.grp = c.grp AND g.segment = c.segment LEFT JOIN whole w ON g.grp = w.grp""", "cell_rate")
def _(t):
    grp = F.when(F.col("acctbal") < 2000, "low").when(F.col("acctbal") < 6000, "mid").otherwise("high")
    g = labelled(t).df.where("eligible AND n_prior_visits = 0").withColumn("grp", grp)
    cells = (g.where(F.col("label").isNotNull() & F.col("segment").isin("BUILDING", "MACHINERY", "FURNITURE"))
             .groupBy("grp", "segment").agg(F.count("*").alias("n"), F.sum("label").alias("events")))
    return joins.similar_cell(g, cells, "grp", "segment").select("entity_id", "cell_found", "cell_n", "cell_events", "cell_rate")


@query("c10_first_row", f"WITH {FIRST_SCAN} SELECT entity_id, scan_id, measure, measure2 FROM fs")
def _(t):
    return joins.first_scan(t.scans(), ["measure", "measure2"]).select("entity_id", "scan_id", "measure", "measure2")


@query("c10_first_known", f"""WITH {SCANS} SELECT entity_id,
 arg_min(measure, (scan_date, scan_id)) FILTER (WHERE qc) AS measure, arg_min(measure2, (scan_date, scan_id)) FILTER (WHERE tracer > 3) AS measure2
 FROM s GROUP BY 1""")
def _(t):
    s = t.scans().withColumns({"measure": F.when(F.col("qc"), F.col("measure")), "measure2": F.when(F.col("tracer") > 3, F.col("measure2"))})
    return pit.first_known(s, ["measure", "measure2"], order=("scan_date", "scan_id"))


@query("c11_sweep", f"""WITH {VISITS} SELECT g.k AS step, g.x AS score, count(*) AS n, avg(1 / (1 + exp(-(g.x / 10 + acctbal / 10000 - 2)))) AS mean_risk
 FROM v, (VALUES (0::BIGINT, 5.0::DOUBLE), (1, 10.0), (2, 20.0), (3, 40.0)) g(k, x) GROUP BY 1, 2""", "mean_risk")
def _(t):
    s = joins.sweep(t.visits().drop("score"), "score", [5.0, 10.0, 20.0, 40.0])
    risk = 1 / (1 + F.exp(-(F.col("score") / 10 + F.col("acctbal") / 10000 - 2)))
    return s.groupBy("step", "score").agg(F.count("*").alias("n"), F.avg(risk).alias("mean_risk"))


@query("c12_label_recount", f"""WITH {LABELLED} SELECT a.entity_id, a.visit_id, CAST(CASE
 WHEN bool_or(b.status = 1 AND b.years - a.years <= 1) THEN 1 WHEN max(b.years) - a.years >= 1 THEN 0 END AS BIGINT) AS label_recount
 FROM ev a LEFT JOIN ev b ON a.entity_id = b.entity_id AND b.rn > a.rn GROUP BY a.entity_id, a.visit_id, a.years""")
def _(t):
    return pit.label_recount(timed(t), event_now(), 1.0).select("entity_id", "visit_id", "label_recount")


@query("c12_label_disagreements", f"""WITH {LABELLED} SELECT count(*) AS n_visits, CAST(0 AS BIGINT) AS n_wrong FROM ev""")
def _(t):
    tl = labelled(t)
    return pit.label_recount(tl, event_now(), 1.0).agg(
        F.count("*").alias("n_visits"), F.count_if(~F.col("label").eqNullSafe(F.col("label_recount"))).alias("n_wrong"))


CONFIRM = TIMED + """, fe AS (SELECT entity_id, min(years) AS t FROM tv WHERE status = 1 GROUP BY 1),
 co AS (SELECT entity_id, CASE WHEN bool_or(years > t AND status <> 1) THEN 'reverted' WHEN bool_or(years > t AND status = 1) THEN 'confirmed'
  ELSE 'not checked' END AS outcome FROM tv JOIN fe USING (entity_id) GROUP BY 1)"""


@query("c13_confirm_outcome", f"WITH {CONFIRM} SELECT outcome, count(*) AS n FROM co GROUP BY 1")
def _(t):
    return joins.confirm_outcome(timed(t), event_now()).groupBy("outcome").agg(F.count("*").alias("n"))


@query("c13_cohort_without_reverted", f"""WITH {CONFIRM}, lab AS{LABELLED.split(', lab AS', 1)[1]}
 SELECT count(*) AS n, CAST(sum(label) AS BIGINT) AS events FROM ev WHERE eligible AND rn = 1 AND label IS NOT NULL
 AND NOT (label = 1 AND entity_id IN (SELECT entity_id FROM co WHERE outcome = 'reverted'))""")
def _(t):
    first = labelled(t).df.where("eligible AND n_prior_visits = 0 AND label IS NOT NULL").select("entity_id", "label")
    reverted = joins.confirm_outcome(timed(t), event_now()).where("outcome = 'reverted'").withColumn("reverted", F.lit(True))
    kept = first.join(reverted, "entity_id", "left").where(~((F.col("label") == 1) & F.coalesce("reverted", F.lit(False))))
    return kept.agg(F.count("*").alias("n"), F.sum("label").alias("events"))


@query("d29_linkage_summary", f"""WITH {VISITS}, {FIRST_SCAN}, g AS (SELECT fs.entity_id, source, min(abs(date_diff('day', scan_date, visit_date))) AS gap
 FROM fs JOIN v USING (entity_id) GROUP BY 1, 2)
 SELECT source, count(*) AS n, count(*) FILTER (WHERE gap <= 90) AS within_90, count(*) FILTER (WHERE gap <= 180) AS within_180,
 count(*) FILTER (WHERE gap <= 365) AS within_365, min(gap) AS min_gap, avg(gap) AS mean_gap, max(gap) AS max_gap,
 quantile_cont(gap, 0.25) AS p25_gap, quantile_cont(gap, 0.5) AS median_gap, quantile_cont(gap, 0.75) AS p75_gap FROM g GROUP BY 1""", "mean_gap p25_gap median_gap p75_gap")
def _(t):
    return joins.linkage_summary(t.scans(), t.visits())


@query("d33_events_by_source", f"""WITH {VISITS}, {SCANS}, src AS (SELECT source AS grp, * FROM s UNION ALL SELECT 'any' AS grp, * FROM s),
 fs AS (SELECT * FROM src QUALIFY row_number() OVER (PARTITION BY grp, entity_id ORDER BY scan_date, scan_id) = 1),
 ix AS (SELECT grp, fs.entity_id, visit_date AS i_visit_date, status AS i_status, score AS i_score
 FROM fs JOIN v USING (entity_id) WHERE abs(date_diff('day', scan_date, visit_date)) <= 365
 QUALIFY row_number() OVER (PARTITION BY grp, fs.entity_id ORDER BY abs(date_diff('day', scan_date, visit_date)), visit_date, visit_id) = 1),
 fe AS (SELECT grp, ix.entity_id, any_value(i_status) AS i_status, max(date_diff('day', i_visit_date, visit_date) / 365.25::DOUBLE) AS fy,
  min(status) AS reached, max(score - i_score) AS rise FROM ix JOIN v USING (entity_id)
  WHERE date_diff('day', i_visit_date, visit_date) / 365.25::DOUBLE > 0.25 GROUP BY 1, 2)
 SELECT ix.grp AS source, count(*) AS with_index, count(*) FILTER (WHERE ix.i_status > 1) AS no_event_at_index,
 count(*) FILTER (WHERE ix.i_status > 1 AND fe.fy IS NOT NULL) AS followed, count(*) FILTER (WHERE ix.i_status > 1 AND fy >= 2) AS followed_2y,
 count(*) FILTER (WHERE ix.i_status > 1 AND reached = 1) AS converted, count(*) FILTER (WHERE ix.i_status > 1 AND rise >= 1) AS rose
 FROM ix LEFT JOIN fe ON ix.grp = fe.grp AND ix.entity_id = fe.entity_id GROUP BY 1""")
def _(t):
    # here code 1 is the event, so the negated code rises with severity
    s, v = t.scans(), t.visits().withColumn("status", -F.col("status"))
    rows = None
    for name, part in [("a", s.where("source = 'a'")), ("b", s.where("source = 'b'")), ("any", s)]:
        ix = joins.nearest_visit(part, v, ["status", "score"])
        fe = joins.followup_events(ix, v).drop("i_status")
        free = F.col("i_status") < -1
        one = ix.join(fe, "entity_id", "left").agg(
            F.count("*").alias("with_index"), F.count_if(free).alias("no_event_at_index"),
            F.count_if(free & F.col("followup_years").isNotNull()).alias("followed"),
            F.count_if(free & (F.col("followup_years") >= 2)).alias("followed_2y"),
            F.count_if(free & (F.col("worst_status") == -1)).alias("converted"),
            F.count_if(free & (F.col("max_rise") >= 1)).alias("rose")).withColumn("source", F.lit(name))
        rows = one if rows is None else rows.unionByName(one)
    return rows
