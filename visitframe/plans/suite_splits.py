"""Ordering, set, split, preparation and verification queries (F1-F4, G1-G3, H1-H13, D36)."""

from __future__ import annotations

from pyspark.sql import functions as F

from visitframe.operators import pit, profile, ranking, splits
from visitframe.plans.fixtures import FEATURES, LABELLED, SCANS, VISITS
from visitframe.plans.suite import query
from visitframe.plans.suite_pit import SLOPE_SQL, SPARSE_TIMED, event_now, labelled, timed
from visitframe.plans.suite_profile import NORM1, norm_input, norms_one, split_of
from visitframe.operators.norms import apply_norms
from visitframe.plans.fixtures import SPARSE
from visitframe.scaling import Timeline

FIRST = VISITS + """, fv AS (SELECT entity_id, site, arg_min(status, (visit_date, visit_id)) AS stratum FROM v GROUP BY 1, 2)"""
SPLIT = FIRST + """, sx AS (SELECT site FROM (SELECT site, row_number() OVER (ORDER BY md5(concat_ws('|', site, '2026')), site) - 1 AS rk, count(*) OVER () AS n
  FROM (SELECT DISTINCT site FROM fv)) WHERE rk < round_even(n * 0.2, 0)),
 rs AS (SELECT *, row_number() OVER w - 1 AS rk, count(*) OVER (PARTITION BY stratum) AS n FROM fv WHERE site NOT IN (SELECT site FROM sx)
  WINDOW w AS (PARTITION BY stratum ORDER BY md5(concat_ws('|', entity_id, '2026')), entity_id)),
 spl AS (SELECT entity_id, site, stratum, CASE WHEN rk < floor(n * 0.70::DOUBLE) THEN 'train' WHEN rk < floor(n * 0.85::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM rs
  UNION ALL SELECT entity_id, site, stratum, 'external' FROM fv WHERE site IN (SELECT site FROM sx))"""


@query("f1_total_order", f"WITH {VISITS} SELECT entity_id, visit_id, row_number() OVER (PARTITION BY entity_id ORDER BY visit_date, visit_id) AS position FROM v")
def _(t):
    tl = t.timeline().runs(k=pit.Run("count", F.lit(1)))
    return tl.df.orderBy("entity_id", "visit_date", "visit_id").select("entity_id", "visit_id", F.col("k").alias("position"))


CONTRIB = """ct AS (SELECT o_orderkey AS row_id, unnest(['a', 'b', 'c', 'd']) AS feature,
 unnest([(o_totalprice - 250000) / 7e5, (o_custkey % 100 - 50) / 500.0, (day(o_orderdate) - 15) / 100.0, CASE WHEN o_orderstatus = 'F' THEN 0.03 ELSE -0.07 END]) AS contribution FROM orders)"""


def contributions(t):
    d = F.lit
    item = lambda n, c: F.struct(F.lit(n).alias("feature"), c.cast("double").alias("contribution"))
    return t.orders.select(F.col("o_orderkey").alias("row_id"), F.inline(F.array(
        item("a", (F.col("o_totalprice") - 250000) / d(7e5)), item("b", (F.col("o_custkey") % 100 - 50) / d(500.0)),
        item("c", (F.dayofmonth("o_orderdate") - 15) / d(100.0)), item("d", F.when(F.col("o_orderstatus") == "F", 0.03).otherwise(-0.07)))))


@query("f2_top_contributions", f"""WITH {CONTRIB} SELECT row_id, feature, contribution, row_number() OVER (PARTITION BY row_id ORDER BY abs(contribution) DESC, feature) AS rank
 FROM ct WHERE abs(contribution) > 0.02 QUALIFY rank <= 3""", "contribution", digits=10)
def _(t):
    return ranking.top_contrib(contributions(t), ["row_id"], 3)


@query("f2_top_signed", f"""WITH {CONTRIB}, x AS (SELECT row_id, feature, contribution, CASE WHEN contribution > 0 THEN 1 ELSE -1 END AS sign FROM ct WHERE abs(contribution) > 0.05)
 SELECT row_id, feature, contribution, CAST(sign AS BIGINT) AS sign, row_number() OVER (PARTITION BY row_id, sign ORDER BY abs(contribution) DESC, feature) AS rank FROM x
 QUALIFY rank <= CASE WHEN sign > 0 THEN 3 ELSE 2 END""", "contribution", digits=10)
def _(t):
    return ranking.top_signed(contributions(t), ["row_id"])


@query("f3_top_text", """WITH c AS (SELECT l_returnflag AS grp, l_linenumber AS label, count(*) AS n FROM lineitem GROUP BY 1, 2),
 r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY n DESC, label) AS rk, count(*) OVER (PARTITION BY grp) AS k FROM c)
 SELECT grp, string_agg(label || ' (' || n || ')', ', ' ORDER BY rk) || CASE WHEN any_value(k) > 3 THEN ', +' || (any_value(k) - 3) || ' more' ELSE '' END AS text FROM r WHERE rk <= 3 GROUP BY 1""")
def _(t):
    c = t.lineitem.groupBy(F.col("l_returnflag").alias("grp"), F.col("l_linenumber").alias("label")).agg(F.count("*").alias("n"))
    return ranking.top_text(c, ["grp"], "label", "n", 3)


@query("f3_top_n", """SELECT l_partkey, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1 ORDER BY quantity DESC, l_partkey LIMIT 12""", "quantity")
def _(t):
    parts = t.lineitem.groupBy("l_partkey").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))
    return ranking.top_n(parts, [F.col("quantity").desc(), F.col("l_partkey")], 12)


@query("f4_upsert_last", f"""WITH {SCANS}, u AS (SELECT entity_id, measure, scan_date, scan_id, CAST(source = 'b' AS INT) AS gen FROM s)
 SELECT entity_id, arg_max(measure, (gen, scan_date, scan_id)) AS measure, arg_max(scan_id, (gen, scan_date, scan_id)) AS scan_id FROM u GROUP BY 1""")
def _(t):
    s = t.scans().select("entity_id", "measure", "scan_date", "scan_id", "source")
    old, new = s.where("source = 'a'").drop("source"), s.where("source = 'b'").drop("source")
    return ranking.upsert_last(old, new, ["entity_id"], ["scan_date", "scan_id"]).select("entity_id", "measure", "scan_id")


def id_sets(t):
    s = t.scans()
    return s.where("source = 'a' AND measure > 30"), s.where("source = 'b' AND measure > 30"), s.where("tracer = 7")


IDS = SCANS + """, a AS (SELECT DISTINCT entity_id FROM s WHERE source = 'a' AND measure > 30), b AS (SELECT DISTINCT entity_id FROM s WHERE source = 'b' AND measure > 30), c AS (SELECT DISTINCT entity_id FROM s WHERE tracer = 7)"""


@query("g2_entity_intersection", f"WITH {IDS} SELECT entity_id FROM a INTERSECT SELECT entity_id FROM b INTERSECT SELECT entity_id FROM c")
def _(t):
    return ranking.ids_intersect(*id_sets(t))


@query("g3_entity_difference", f"WITH {IDS} SELECT entity_id FROM a EXCEPT SELECT entity_id FROM b EXCEPT SELECT entity_id FROM c")
def _(t):
    return ranking.ids_except(*id_sets(t))


@query("h1_holdout_sites", f"WITH {SPLIT} SELECT site FROM sx")
def _(t):
    return splits.holdout_sites(pit.first_row(t.visits(), ["site"]), 0.2, "2026")


@query("h2_stratified_split", f"WITH {SPLIT} SELECT entity_id, site, stratum, split FROM spl")
def _(t):
    return split_of(t)


@query("h3_check_splits", f"""WITH {SPLIT} SELECT 'entity in one split' AS check_name, count(*) AS n_bad, count(*) = 0 AS passed FROM (SELECT entity_id FROM v JOIN spl USING (entity_id) GROUP BY 1 HAVING count(DISTINCT split) > 1)
 UNION ALL SELECT 'external sites unseen', count(*), count(*) = 0 FROM (SELECT site FROM spl WHERE split = 'external' INTERSECT SELECT site FROM spl WHERE split <> 'external')
 UNION ALL SELECT 'saved splits agree', 0, true""")
def _(t):
    s = split_of(t)
    return splits.check_splits(t.visits().join(s.select("entity_id", "split"), "entity_id"), s)


@query("h3_check_splits_with_faults", f"""WITH {SPLIT} SELECT 'entity in one split' AS check_name, count(*) AS n_bad, count(*) = 0 AS passed FROM (SELECT entity_id FROM v WHERE visit_id % 5 = 0 INTERSECT SELECT entity_id FROM v WHERE visit_id % 5 <> 0)
 UNION ALL SELECT 'external sites unseen', count(*), count(*) = 0 FROM (SELECT site FROM v WHERE visit_id % 5 = 0 INTERSECT SELECT site FROM v WHERE visit_id % 5 <> 0)
 UNION ALL SELECT 'saved splits agree', count(*), count(*) = 0 FROM (SELECT entity_id, min(CASE WHEN visit_id % 5 = 0 THEN 'external' ELSE 'train' END) AS split FROM v GROUP BY 1) m
  JOIN spl USING (entity_id) WHERE m.split <> spl.split""")
def _(t):
    mixed = t.visits().withColumn("split", F.when(F.col("visit_id") % 5 == 0, "external").otherwise("train"))
    return splits.check_splits(mixed, split_of(t))


@query("d36_split_table", f"""WITH {SPLIT} SELECT split, count(*) AS entities, count(DISTINCT site) AS sites, avg(CAST(stratum = 1 AS INT)) * 100 AS pct_1, avg(CAST(stratum = 2 AS INT)) * 100 AS pct_2,
 avg(CAST(stratum = 3 AS INT)) * 100 AS pct_3 FROM spl GROUP BY 1""", "pct_1 pct_2 pct_3")
def _(t):
    return profile.split_table(split_of(t), "site", "stratum")


def trajectory_features(v):
    """The feature build used by the no-future check."""
    from visitframe.scaling import Timeline
    tl = pit.visit_index(pit.add_years(Timeline(v)))
    tl = pit.carry(pit.ever(tl, ever_high=(F.col("score") > 30).cast("int")), carried=F.col("score"))
    return pit.delta(pit.running_slope(tl, "score"), "score").df


@query("h4_no_future_check", f"""WITH {SPARSE_TIMED}, n AS (SELECT count(*) AS k FROM st WHERE rn = 3) SELECT unnest(['ever_high', 'carried', 'slope_score', 'delta_score', 'years']) AS variable, k AS n_compared, CAST(0 AS BIGINT) AS n_changed FROM n""")
def _(t):
    v = pit.visit_index(timed(t, True)).df
    base = v.select("entity_id", "visit_date", "visit_id", "score", "visit_no")
    return splits.check_no_future(base, lambda d: trajectory_features(d.drop("visit_no")), 3,
                                  ["ever_high", "carried", "slope_score", "delta_score", "years"])


@query("h4_no_future_check_first_visit", f"""WITH {SPARSE_TIMED}, n AS (SELECT count(*) AS k FROM st WHERE rn = 1) SELECT unnest(['ever_high', 'carried', 'slope_score', 'delta_score', 'years']) AS variable, k AS n_compared, CAST(0 AS BIGINT) AS n_changed FROM n""")
def _(t):
    v = pit.visit_index(timed(t, True)).df
    base = v.select("entity_id", "visit_date", "visit_id", "score", "visit_no")
    return splits.check_no_future(base, lambda d: trajectory_features(d.drop("visit_no")), 1, ["ever_high", "carried", "slope_score", "delta_score", "years"])


@query("h4_no_future_check_with_leak", f"""WITH {SPARSE_TIMED}, m AS (SELECT *, max(score) OVER (PARTITION BY entity_id) AS peak, max(score) OVER (PARTITION BY entity_id ORDER BY rn) AS peak_so_far FROM st)
 SELECT 'peak' AS variable, count(*) AS n_compared, count(*) FILTER (WHERE peak IS DISTINCT FROM peak_so_far) AS n_changed FROM m WHERE rn = 3""")
def _(t):
    base = pit.visit_index(timed(t, True)).df.select("entity_id", "visit_date", "visit_id", "score", "visit_no")
    peak = lambda d: d.join(d.groupBy("entity_id").agg(F.max("score").alias("peak")), "entity_id")
    return splits.check_no_future(base, peak, 3, ["peak"])


@query("h5_shuffled_labels", """WITH p AS (SELECT o_orderkey AS row_id, CAST(o_orderstatus = 'F' AS BIGINT) AS y FROM orders),
 a AS (SELECT row_id, row_number() OVER (ORDER BY md5(concat_ws('|', row_id, 's-rows')), row_id) AS rk FROM p), b AS (SELECT y, row_number() OVER (ORDER BY md5(concat_ws('|', row_id, 's-labels')), row_id) AS rk FROM p)
 SELECT row_id, y AS y_shuffled FROM a JOIN b USING (rk)""")
def _(t):
    return splits.shuffle_labels(t.predictions().select("row_id", "y"), "y", "s", "row_id").select("row_id", "y_shuffled")


@query("h6_check_counts", f"""WITH {LABELLED}, c AS (SELECT 'eligible' AS name, count(*) FILTER (WHERE eligible) AS n FROM ev UNION ALL SELECT 'labelled', count(*) FILTER (WHERE eligible AND label IS NOT NULL) FROM ev)
 SELECT name, n, n AS reported, true AS passed FROM c""")
def _(t):
    v = labelled(t).df
    actual = v.agg(F.array(F.struct(F.lit("eligible").alias("name"), F.count_if("eligible").alias("n")), F.struct(
        F.lit("labelled").alias("name"), F.count_if(F.col("eligible") & F.col("label").isNotNull()).alias("n"))).alias("x")).select(F.inline("x"))
    report = profile.cohort_flow(v, {"eligible": F.col("eligible"), "labelled": F.col("label").isNotNull()}).select("name", "n")
    return splits.check_counts(actual, report)


@query("h6_check_counts_with_faults", """WITH c AS (SELECT o_orderpriority AS name, count(*) AS n FROM orders GROUP BY 1)
 SELECT name, n, CASE WHEN name <> '1-URGENT' THEN n - CAST(name = '2-HIGH' AS BIGINT) END AS reported, name NOT IN ('1-URGENT', '2-HIGH') AS passed FROM c""")
def _(t):
    actual = t.orders.groupBy(F.col("o_orderpriority").alias("name")).agg(F.count("*").alias("n"))
    report = actual.where("name <> '1-URGENT'").withColumn("n", F.col("n") - (F.col("name") == "2-HIGH").cast("long"))
    return splits.check_counts(actual, report)


LATEST_SCAN = f"""WITH {VISITS}, {SCANS}, m AS (SELECT v.*, (SELECT max(scan_date) FROM s WHERE s.entity_id = v.entity_id AND scan_date <= visit_date) AS latest FROM v),
 n AS (SELECT *, CASE WHEN latest IS NOT NULL AND {{late}} THEN visit_date + 3 ELSE latest END AS scan_date FROM m)
 SELECT segment, count(*) AS n, count(*) FILTER (WHERE scan_date > visit_date) AS n_late, max(date_diff('day', visit_date, scan_date)) AS largest_lead,
  count(*) FILTER (WHERE scan_date > visit_date) = 0 AS passed FROM n WHERE scan_date IS NOT NULL GROUP BY 1"""


def latest_scans(t):
    """Visits with the date of the entity's latest scan so far, by one ordered scan over both; scans come before the visits of their day."""
    v = t.visits().select("entity_id", "visit_date", "visit_id", "segment", F.lit(None).cast("date").alias("scan"))
    s = t.scans().select("entity_id", F.col("scan_date").alias("visit_date"), F.lit(-1).cast("long").alias("visit_id"), F.lit(None).cast("string").alias("segment"), F.col("scan_date").alias("scan"))
    return pit.carry(Timeline(v.unionByName(s)), scan_date=F.col("scan")).df.where("visit_id >= 0")


@query("h6_scan_dates", LATEST_SCAN.replace("{late}", "false"))
def _(t):
    return splits.check_scan_dates(latest_scans(t), ["segment"])


@query("h6_scan_dates_with_faults", LATEST_SCAN.replace("{late}", "segment = 'BUILDING' AND visit_id % 50 = 0"))
def _(t):
    late = F.col("scan_date").isNotNull() & (F.col("segment") == "BUILDING") & (F.col("visit_id") % 50 == 0)
    rows = latest_scans(t).withColumn("scan_date", F.when(late, F.date_add("visit_date", 3)).otherwise(F.col("scan_date")))
    return splits.check_scan_dates(rows, ["segment"])


@query("h8_kfold", """WITH g AS (SELECT o_orderkey AS row_id, CAST(o_orderstatus = 'F' AS INT) AS y, o_orderpriority AS grp, count(*) OVER (PARTITION BY o_orderstatus = 'F', o_orderpriority) AS k FROM orders),
 s AS (SELECT row_id, CASE WHEN k >= 990 THEN concat_ws('_', y, grp) ELSE CAST(y AS VARCHAR) END AS stratum FROM g)
 SELECT row_id, stratum, (row_number() OVER (PARTITION BY stratum ORDER BY md5(concat_ws('|', row_id, 'fold')), row_id) - 1) % 5 AS fold FROM s""")
def _(t):
    p = t.predictions().select("row_id", "y", F.col("priority").alias("grp"))
    return splits.kfold(p, "y", "grp", 5, "fold", "row_id", min_size=990).select("row_id", "stratum", "fold")


@query("h9_modality_dropout", f"""WITH {FEATURES}, c AS (SELECT entity_id, CAST(k AS BIGINT) AS copy, acctbal, mean_score, share_f,
  ('0x' || substr(md5(concat_ws('|', entity_id, k, 'money', 'drop')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u1,
  ('0x' || substr(md5(concat_ws('|', entity_id, k, 'score', 'drop')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u2 FROM f, range(0, 5) t(k))
 SELECT entity_id, copy, CASE WHEN copy = 0 OR u1 >= 0.35 THEN acctbal END AS acctbal, CASE WHEN copy = 0 OR u2 >= 0.35 THEN mean_score END AS mean_score,
 CASE WHEN copy = 0 OR u2 >= 0.35 THEN share_f END AS share_f FROM c""", "acctbal mean_score share_f", digits=10)
def _(t):
    f = t.features().select("entity_id", "acctbal", "mean_score", "share_f")
    return splits.modality_dropout(f, {"money": ["acctbal"], "score": ["mean_score", "share_f"]}, "entity_id")


@query("h10_mask_patterns", f"""WITH {FEATURES} SELECT k AS pattern, count(*) AS n, count(CASE WHEN k IN ('All', 'Money only') THEN acctbal END) AS n_acctbal,
 sum(CASE WHEN k IN ('All', 'Score only') THEN mean_score END) AS sum_score FROM f, (VALUES ('All'), ('Money only'), ('Score only'), ('Nothing')) g(k) GROUP BY 1""", "sum_score")
def _(t):
    m = splits.mask_groups(t.features(), {"money": ["acctbal"], "score": ["mean_score"]},
                           {"All": ["money", "score"], "Money only": ["money"], "Score only": ["score"], "Nothing": []})
    return m.groupBy("pattern").agg(F.count("*").alias("n"), F.count("acctbal").alias("n_acctbal"), F.sum("mean_score").alias("sum_score"))


@query("h11_prep", f"""WITH {FEATURES}, m AS (SELECT quantile_cont(acctbal, 0.5) AS a, quantile_cont(score_f, 0.5) AS s FROM f),
 x AS (SELECT entity_id, coalesce(acctbal, a) AS fa, coalesce(score_f, s) AS fs, CAST(score_f IS NULL AS DOUBLE) AS na FROM f, m),
 d AS (SELECT avg(fa) AS ma, stddev_pop(fa) + 1e-6 AS sa, avg(fs) AS ms, stddev_pop(fs) + 1e-6 AS ss, avg(na) AS mn, stddev_pop(na) + 1e-6 AS sn FROM x)
 SELECT entity_id, (fa - ma) / sa AS f_acctbal, (fs - ms) / ss AS f_score_f, (na - mn) / sn AS na_score_f FROM x, d""", "f_acctbal f_score_f na_score_f")
def _(t):
    f = t.features()
    return splits.Prep(["acctbal", "score_f"]).fit(f).transform(f).select("entity_id", "f_acctbal", "f_score_f", "na_score_f")


@query("h12_slope_spot_check", f"""WITH {SPARSE_TIMED}, k AS (SELECT * FROM st WHERE rn <= 3 AND score IS NOT NULL), rs AS ({SLOPE_SQL.replace('WITH ' + SPARSE_TIMED + ',', 'WITH')})
 SELECT k.entity_id, regr_slope(k.score, years) AS by_regression, max(slope_score) FILTER (WHERE rn = 3) AS by_running_sums, count(*) AS n FROM k JOIN rs ON k.visit_id = rs.visit_id GROUP BY 1""",
       "by_regression by_running_sums", digits=4)
def _(t):
    return splits.check_slope(pit.running_slope(pit.visit_index(timed(t, True)), "score").df, "score")


@query("h13_check_harmonised", f"""WITH {SPARSE}, {NORM1}, z AS (SELECT packet, status, (SELECT greatest(least((score - (a + b * acctbal)) / sd, 5), -5) FROM nr WHERE test = 'score') AS z FROM sp WHERE score IS NOT NULL)
 SELECT packet, status, count(*) AS n, avg(z) AS mean_z FROM z GROUP BY 1, 2""", "mean_z", digits=5)
def _(t):
    z = apply_norms(norm_input(t), norms_one(t), ["visit_id"], {"memory": ["score"]}, ["acctbal"])
    return splits.check_harmonised(z, "z_memory", "packet", "status")
