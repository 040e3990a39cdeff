"""Aggregation queries (D1-D38), except those registered next to joins, voxels and retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from visitframe.functions import columns as C
from visitframe.operators import correlation, metrics, norms, pit, profile, splits
from visitframe.plans.fixtures import LABELLED, PRED, SCANS, SPARSE, TIMED, VISITS
from visitframe.plans.suite import query
from visitframe.plans.suite_columns import CODED, coded
from visitframe.plans.suite_joins import INDEX, index_visits
from visitframe.plans.suite_pit import SPARSE_TIMED, event_now, labelled, timed

LINE_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
PROFILE_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS variable, count(*) AS n_rows, count(*) - count({c}) AS n_blank, count(*) FILTER (WHERE CAST({c} AS VARCHAR) IN ('0.0', '50.0', 'A')) AS n_coded FROM lineitem"
    for c in LINE_COLS)


@query("d1_column_profile", f"SELECT *, 100.0 * n_blank / n_rows AS blank_pct, 100.0 * (n_blank + n_coded) / n_rows AS missing_pct FROM ({PROFILE_SQL})", "blank_pct missing_pct")
def _(t):
    return profile.profile(t.lineitem.select(*LINE_COLS), ["0.0", "50.0", "A"])


@query("d1_profile_summary", f"""SELECT count(*) AS n_columns, count(*) FILTER (WHERE m = 0) AS complete, count(*) FILTER (WHERE m > 50) AS over_50,
 count(*) FILTER (WHERE m > 90) AS over_90, count(*) FILTER (WHERE m >= 100) AS empty, 100.0 * sum(n_blank + n_coded) / sum(n_rows) AS overall_missing_pct,
 median(m) AS median_missing_pct FROM (SELECT *, CAST(100.0 * (n_blank + n_coded) / n_rows AS DOUBLE) AS m FROM ({PROFILE_SQL}))""", "overall_missing_pct median_missing_pct")
def _(t):
    return profile.profile_summary(profile.profile(t.lineitem.select(*LINE_COLS), ["0.0", "50.0", "A"]))


@query("d2_rows_per_entity", f"""WITH {VISITS}, c AS (SELECT entity_id, count(*) AS n FROM v GROUP BY 1)
 SELECT CASE WHEN n <= 5 THEN CAST(n AS VARCHAR) WHEN n <= 10 THEN '6-10' ELSE '11+' END AS bucket, count(*) AS n FROM c GROUP BY 1""")
def _(t):
    return profile.rows_histogram(profile.rows_per_entity(t.visits()))


DESC = "count(x) AS n, avg(x) AS mean, min(x) AS min, quantile_cont(x, 0.25) AS p25, quantile_cont(x, 0.5) AS median, quantile_cont(x, 0.75) AS p75, max(x) AS max"


@query("d2_rows_per_entity_describe", f"WITH {VISITS}, c AS (SELECT CAST(count(*) AS DOUBLE) AS x FROM v GROUP BY entity_id) SELECT {DESC} FROM c", "mean p25 median p75")
def _(t):
    return profile.describe(profile.rows_per_entity(t.visits()), "n_visits")


@query("d3_describe", f"SELECT l_returnflag, {DESC} FROM (SELECT l_returnflag, l_extendedprice AS x FROM lineitem) GROUP BY 1", "mean p25 median p75")
def _(t):
    return profile.describe(t.lineitem, "l_extendedprice", ["l_returnflag"])


@query("d4_category_counts", """WITH l AS (SELECT unnest(['l_returnflag', 'l_linestatus', 'l_tax', 'l_partkey']) AS variable,
 unnest([l_returnflag, CASE WHEN l_tax > 0.01 THEN l_linestatus END, CAST(CAST(round(l_tax * 100) AS BIGINT) AS VARCHAR), CAST(l_partkey AS VARCHAR)]) AS value FROM lineitem),
 c AS (SELECT variable, coalesce(value, '(blank)') AS value, count(*) AS n FROM l GROUP BY 1, 2)
 SELECT * FROM c WHERE variable IN (SELECT variable FROM c GROUP BY 1 HAVING count(*) <= 40)""")
def _(t):
    df = t.lineitem.withColumns({"l_linestatus": F.when(F.col("l_tax") > 0.01, F.col("l_linestatus")), "l_tax": F.round(F.col("l_tax") * 100).cast("long")})
    return profile.category_counts(df, ["l_returnflag", "l_linestatus", "l_tax", "l_partkey"])


@query("d5_date_ranges", """SELECT 'o_orderdate' AS variable, strftime(min(o_orderdate), '%Y-%m') AS min_month, strftime(max(o_orderdate), '%Y-%m') AS max_month, 100.0 AS parsed_pct FROM orders
 UNION ALL SELECT 'mixed', strftime(min(o_orderdate) FILTER (WHERE o_orderstatus = 'F'), '%Y-%m'), strftime(max(o_orderdate) FILTER (WHERE o_orderstatus = 'F'), '%Y-%m'),
 100.0 * count(*) FILTER (WHERE o_orderstatus = 'F') / count(*) FROM orders""", "parsed_pct")
def _(t):
    day = F.to_date("o_orderdate").cast("string")
    df = t.orders.select(day.alias("o_orderdate"), F.when(F.col("o_orderstatus") == "F", day).otherwise(F.col("o_orderpriority")).alias("mixed"), "o_orderpriority")
    return profile.date_ranges(df, ["o_orderdate", "mixed", "o_orderpriority"])


@query("d6_coverage", f"""WITH {VISITS}, {SCANS}, b AS (SELECT entity_id, count(*) AS n, max(CAST(score > 45 AS INT)) AS k FROM v GROUP BY 1),
 a AS (SELECT DISTINCT entity_id FROM s WHERE source = 'a' AND measure > 30), bb AS (SELECT DISTINCT entity_id FROM s WHERE source = 'b' AND measure > 40)
 SELECT line, n FROM (SELECT 'any visit' AS line, count(*) AS n FROM b UNION ALL SELECT '2+ visits', count(*) FROM b WHERE n >= 2 UNION ALL
 SELECT '3+ visits', count(*) FROM b WHERE n >= 3 UNION ALL SELECT 'known', count(*) FROM b WHERE k = 1 UNION ALL
 SELECT 'source a', count(*) FROM b SEMI JOIN a USING (entity_id) UNION ALL SELECT 'source b', count(*) FROM b SEMI JOIN bb USING (entity_id) UNION ALL
 SELECT 'all sources', count(*) FROM (SELECT entity_id FROM b INTERSECT SELECT entity_id FROM a INTERSECT SELECT entity_id FROM bb) UNION ALL
 SELECT 'a without visits', count(*) FROM a ANTI JOIN b USING (entity_id) UNION ALL SELECT 'b without visits', count(*) FROM bb ANTI JOIN b USING (entity_id))""")
def _(t):
    s = t.scans()
    return profile.coverage(t.visits(), {"a": s.where("source = 'a' AND measure > 30"), "b": s.where("source = 'b' AND measure > 40")}, F.col("score") > 45)


@query("d7_pivot_share", f"""WITH {SPARSE}, l AS (SELECT segment, unnest(['score', 'high']) AS variable, unnest([score IS NOT NULL, CASE WHEN score > 20 THEN 1 END IS NOT NULL]) AS k FROM sp)
 SELECT variable, avg(CAST(k AS INT)) FILTER (WHERE segment = 'AUTOMOBILE') AS AUTOMOBILE, avg(CAST(k AS INT)) FILTER (WHERE segment = 'BUILDING') AS BUILDING,
 avg(CAST(k AS INT)) FILTER (WHERE segment = 'FURNITURE') AS FURNITURE, avg(CAST(k AS INT)) FILTER (WHERE segment = 'HOUSEHOLD') AS HOUSEHOLD,
 avg(CAST(k AS INT)) FILTER (WHERE segment = 'MACHINERY') AS MACHINERY FROM l GROUP BY 1""", "AUTOMOBILE BUILDING FURNITURE HOUSEHOLD MACHINERY")
def _(t):
    v = t.sparse().withColumn("high", F.when(F.col("score") > 20, 1))
    return profile.pivot_share(v, ["score", "high"], "segment", ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"])


CROSS = """coalesce(a, 'All') AS a, coalesce(b, 'All') AS b, count(*) AS n, 100.0 * count(*) / max(count(*)) OVER (PARTITION BY a) AS row_pct"""


@query("d8_crosstab", f"WITH c AS (SELECT l_returnflag AS a, l_linestatus AS b FROM lineitem) SELECT {CROSS} FROM c GROUP BY CUBE (c.a, c.b)", "row_pct")
def _(t):
    return profile.crosstab(t.lineitem, "l_returnflag", "l_linestatus")


@query("d9_transitions", f"""WITH {VISITS}, c AS (SELECT CAST(arg_min(status, (visit_date, visit_id)) AS VARCHAR) AS a, CAST(arg_max(status, (visit_date, visit_id)) AS VARCHAR) AS b FROM v GROUP BY entity_id)
 SELECT {CROSS} FROM c GROUP BY CUBE (c.a, c.b)""", "row_pct")
def _(t):
    return profile.transitions(t.visits())


@query("d10_rate_by", f"""WITH {LABELLED} SELECT status, CASE WHEN acctbal < 3000 THEN 'low' ELSE 'high' END AS level, count(*) AS n, avg(label) AS rate
 FROM ev WHERE eligible AND label IS NOT NULL GROUP BY 1, 2""", "rate")
def _(t):
    v = labelled(t).df.where("eligible").withColumn("level", F.when(F.col("acctbal") < 3000, "low").otherwise("high"))
    return profile.rate_by(v, "level", "label", ["status"])


@query("d11_agreement", f"""WITH b AS (SELECT CAST(q > 25 AS INT) AS a, CAST(x > 0.04 AS INT) AS c FROM (SELECT nullif(l_quantity, 50) AS q, nullif(l_tax, 0) AS x FROM lineitem)), k AS (SELECT * FROM b WHERE a IS NOT NULL AND c IS NOT NULL)
 SELECT count(*) AS both_known, avg(a) * 100 AS a_yes_pct, avg(c) * 100 AS b_yes_pct, avg(CAST(a = c AS INT)) * 100 AS agree_pct, avg(c) FILTER (WHERE a = 1) * 100 AS confirmed_pct FROM k""",
       "a_yes_pct b_yes_pct agree_pct confirmed_pct")
def _(t):
    c = coded(t).select((F.col("l_quantity") > 25).cast("int").alias("a"), (F.col("l_tax") > 0.04).cast("int").alias("b"))
    return profile.agreement(c, "a", "b")


@query("d12_availability_by_year", f"""WITH {SPARSE}, x AS (SELECT *, CASE WHEN acctbal > 2000 THEN acctbal END AS bal FROM sp)
 SELECT year(visit_date) AS year, count(*) AS n, avg(CAST(score IS NOT NULL AS INT)) AS share_score, avg(CAST(bal IS NOT NULL AS INT)) AS share_bal,
 avg(CAST(score IS NOT NULL OR bal IS NOT NULL AS INT)) AS share_any FROM x GROUP BY 1""", "share_score share_bal share_any")
def _(t):
    v = t.sparse().withColumn("bal", F.when(F.col("acctbal") > 2000, F.col("acctbal")))
    return profile.availability_by_year(v, ["score", "bal"])


@query("d13_trajectories", f"""WITH {TIMED}, b AS (SELECT entity_id, arg_min(status, (visit_date, visit_id)) AS baseline FROM tv GROUP BY 1)
 SELECT baseline, CAST(round_even(years, 0) AS BIGINT) AS year_bin, avg(score) AS mean_value, count(*) AS n FROM tv JOIN b USING (entity_id) GROUP BY 1, 2""", "mean_value")
def _(t):
    tl = timed(t)
    v = pit.spread(tl, F.col("status"), "baseline").df
    return profile.trajectories(v, "score", "baseline")


@query("d14_cohort_flow", f"""WITH {LABELLED}, x AS (SELECT *, rn = 1 AS a, packet IN ('F', 'O') AS b FROM ev)
 SELECT * FROM (SELECT CAST(0 AS BIGINT) AS step, 'first visit' AS name, count(*) AS n FROM x WHERE a UNION ALL SELECT 1, 'in person', count(*) FROM x WHERE a AND b UNION ALL
 SELECT 2, 'eligible', count(*) FROM x WHERE a AND b AND eligible UNION ALL SELECT 3, 'label known', count(*) FROM x WHERE a AND b AND eligible AND label IS NOT NULL UNION ALL
 SELECT 4, 'event', count(*) FROM x WHERE a AND b AND eligible AND label = 1)""")
def _(t):
    return profile.cohort_flow(labelled(t).df, {
        "first visit": F.col("n_prior_visits") == 0, "in person": F.col("packet").isin("F", "O"), "eligible": F.col("eligible"),
        "label known": F.col("label").isNotNull(), "event": F.col("label") == 1})


def split_of(t):
    first = pit.first_row(t.visits(), ["site", "status", "acctbal"])
    return splits.stratified_split(first, "status", "2026")


@query("d15_cohort_table", f"""WITH {LABELLED}, x AS (SELECT *, CASE WHEN time_to_event <= 2 THEN 1 WHEN followup_after >= 2 THEN 0 END AS y2, packet AS split FROM ev),
 l AS (SELECT 'baseline' AS cohort, 'label' AS target, split, label AS y FROM x WHERE eligible AND rn = 1 UNION ALL SELECT 'baseline', 'y2', split, y2 FROM x WHERE eligible AND rn = 1 UNION ALL
 SELECT 'third visit', 'label', split, label FROM x WHERE eligible AND rn = 3 UNION ALL SELECT 'third visit', 'y2', split, y2 FROM x WHERE eligible AND rn = 3)
 SELECT cohort, target, split, count(*) AS n, CAST(sum(y) AS BIGINT) AS events FROM l WHERE y IS NOT NULL GROUP BY 1, 2, 3""")
def _(t):
    v = labelled(t).df.withColumns({"y2": pit.horizon_label(2.0), "split": F.col("packet")})
    return profile.cohort_table(v, {"baseline": F.col("eligible") & (F.col("visit_no") == 1), "third visit": F.col("eligible") & (F.col("visit_no") == 3)}, ["label", "y2"])


@query("d16_selection", f"""WITH {LABELLED} SELECT status, count(*) AS n, avg(CAST(followup_after > 0 AS INT)) * 100 AS followup_pct, avg(acctbal) FILTER (WHERE followup_after > 0) AS age_with,
 avg(acctbal) FILTER (WHERE NOT followup_after > 0) AS age_without FROM ev WHERE rn = 1 GROUP BY 1""", "followup_pct age_with age_without")
def _(t):
    return profile.selection(labelled(t).df.where("visit_no = 1"), F.col("followup_after") > 0, "acctbal")


CORR_BASE = """b AS (SELECT nullif(l_quantity, 50) AS q, nullif(l_discount, 0) AS d, l_extendedprice AS e FROM lineitem)"""
PAIRS = """l AS (SELECT 'q' AS a, 'd' AS b, q AS u, d AS v FROM b UNION ALL SELECT 'q', 'e', q, e FROM b UNION ALL SELECT 'd', 'e', d, e FROM b), k AS (SELECT * FROM l WHERE u IS NOT NULL AND v IS NOT NULL)"""


def corr_input(t):
    return coded(t).select(F.col("l_quantity").alias("q"), F.col("l_discount").alias("d"), F.col("l_extendedprice").alias("e"))


@query("d17_spearman_matrix", f"""WITH {CORR_BASE}, {PAIRS}, r AS (SELECT a, b, rank() OVER (PARTITION BY a, b ORDER BY u) + (count(*) OVER (PARTITION BY a, b, u) - 1) / 2.0 AS ru,
 rank() OVER (PARTITION BY a, b ORDER BY v) + (count(*) OVER (PARTITION BY a, b, v) - 1) / 2.0 AS rv FROM k) SELECT a, b, count(*) AS n, corr(ru, rv) AS r FROM r GROUP BY 1, 2""", "r")
def _(t):
    return correlation.corr_matrix(corr_input(t), ["q", "d", "e"])


@query("d17_pearson_matrix", f"WITH {CORR_BASE}, {PAIRS} SELECT a, b, count(*) AS n, corr(u, v) AS r FROM k GROUP BY 1, 2", "r")
def _(t):
    return correlation.corr_matrix(corr_input(t), ["q", "d", "e"], "pearson")


@query("d18_pca_variance", None, "share cumulative")
def _(t):
    return profile.pca_variance(t.embeddings, "embedding", 15)


@query("d19_combo_counts", """SELECT concat_ws(' + ', 'Base', CASE WHEN l_tax > 0 THEN 'Tax' END, CASE WHEN l_quantity > 25 THEN 'Bulk' END) AS combination, count(*) AS n,
 100.0 * count(*) / sum(count(*)) OVER () AS pool_pct FROM lineitem GROUP BY 1""", "pool_pct")
def _(t):
    from visitframe.functions.rules import combo
    return profile.combo_counts(t.lineitem, combo({"Tax": F.col("l_tax") > 0, "Bulk": F.col("l_quantity") > 25}, "Base"))


NORM1 = """nr AS (SELECT 'score' AS test, regr_slope(score, acctbal) AS b, regr_intercept(score, acctbal) AS a, regr_count(score, acctbal) AS n, sqrt((regr_syy(score, acctbal) - regr_sxy(score, acctbal) ^ 2 / regr_sxx(score, acctbal)) / (regr_count(score, acctbal) - 2)) AS sd FROM sp WHERE segment = 'BUILDING'
 UNION ALL SELECT 'day', regr_slope(day(visit_date), acctbal), regr_intercept(day(visit_date), acctbal), regr_count(day(visit_date), acctbal), sqrt((regr_syy(day(visit_date), acctbal) - regr_sxy(day(visit_date), acctbal) ^ 2 / regr_sxx(day(visit_date), acctbal)) / (regr_count(day(visit_date), acctbal) - 2)) FROM sp WHERE segment = 'BUILDING')"""


def norm_input(t):
    return t.sparse().withColumn("day", F.dayofmonth("visit_date"))


def norms_one(t):
    return norms.fit_norms(norm_input(t), ["score", "day"], ["acctbal"], F.col("segment") == "BUILDING")


@query("d20_norms_one_covariate", f"WITH {SPARSE}, {NORM1} SELECT test, CAST(n AS BIGINT) AS n, a AS intercept, b AS acctbal, sd AS resid_sd FROM nr", "intercept acctbal resid_sd")
def _(t):
    return norms_one(t)


@query("d20_norms_three_covariates", None, "intercept acctbal site status resid_sd")
def _(t):
    return norms.fit_norms(norm_input(t), ["score", "day"], ["acctbal", "site", "status"], F.col("segment") == "BUILDING")


@query("d21_apply_norms", f"""WITH {SPARSE}, {NORM1}, z AS (SELECT visit_id, (SELECT greatest(least((score - (a + b * acctbal)) / sd, 5), -5) FROM nr WHERE test = 'score' AND score IS NOT NULL) AS z_score,
 (SELECT greatest(least(-(day(visit_date) - (a + b * acctbal)) / sd, 5), -5) FROM nr WHERE test = 'day') AS z_day FROM sp)
 SELECT visit_id, z_score, z_day, (coalesce(z_score, 0) + z_day) / (1 + CAST(z_score IS NOT NULL AS INT)) AS z_memory FROM z""", "z_score z_day z_memory", digits=5)
def _(t):
    z = norms.apply_norms(norm_input(t), norms_one(t), ["visit_id"], {"memory": ["score", "day"]}, ["acctbal"], ["day"])
    return z.select("visit_id", "z_score", "z_day", "z_memory")


GZ = SCANS + """, g AS (SELECT tracer, avg(measure) AS m, stddev_samp(measure) AS sd FROM s WHERE qc GROUP BY 1)"""


@query("d22_group_standardise", f"WITH {GZ} SELECT scan_id, (measure - m) / sd AS measure_z FROM s LEFT JOIN g USING (tracer)", "measure_z")
def _(t):
    s = t.scans()
    return norms.apply_group_z(s, norms.fit_group_z(s, "tracer", ["measure"], F.col("qc")), "tracer", ["measure"]).select("scan_id", "measure_z")


@query("d23_reference_ranges", f"""WITH {LABELLED}, x AS (SELECT unnest([CAST(status AS VARCHAR), 'All']) AS grp, score, label FROM ev WHERE eligible AND label IS NOT NULL)
 SELECT grp, count(*) AS n, avg(CAST(score = 0 AS INT)) AS zero_share, avg(label) AS event_rate, quantile_cont(score, 0.01) AS p01, quantile_cont(score, 0.99) AS p99 FROM x GROUP BY 1""",
       "zero_share event_rate p01 p99")
def _(t):
    return profile.reference_ranges(labelled(t).df.where("eligible AND label IS NOT NULL"), "score", "status", "label")


@query("d24_suppress_small_cells", f"""WITH {PRED} SELECT priority, segment, count(*) AS n, CAST(sum(y) AS BIGINT) AS events FROM p GROUP BY 1, 2
 HAVING sum(y) >= 190 AND count(*) - sum(y) >= 190""")
def _(t):
    table = t.predictions().groupBy("priority", "segment").agg(F.count("*").alias("n"), F.sum("y").alias("events"))
    return profile.suppress(table, (F.col("events") >= 190) & (F.col("n") - F.col("events") >= 190))


AGREE = SCANS + """, ag AS (SELECT tracer, measure2 / 1000 AS a, measure AS b, CAST(source = 'a' AS INT) AS y FROM s),
 rk AS (SELECT *, rank() OVER (PARTITION BY tracer ORDER BY a) + (count(*) OVER (PARTITION BY tracer, a) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY tracer ORDER BY b) + (count(*) OVER (PARTITION BY tracer, b) - 1) / 2.0 AS rb FROM ag)"""


@query("d25_method_agreement", f"""WITH {AGREE} SELECT tracer, count(*) AS n, corr(a, b) AS pearson, regr_slope(a, b) AS slope, regr_intercept(a, b) AS intercept, avg(a - b) AS mean_diff,
 avg(a - b) - 1.96 * stddev_samp(a - b) AS lower, avg(a - b) + 1.96 * stddev_samp(a - b) AS upper, corr(ra, rb) AS spearman,
 (sum(ra) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))) AS auroc FROM rk GROUP BY 1""", "pearson slope intercept mean_diff lower upper spearman auroc")
def _(t):
    s = t.scans().select("tracer", (F.col("measure2") / 1000).alias("a"), F.col("measure").alias("b"), (F.col("source") == "a").cast("int").alias("y"))
    return metrics.method_agreement(s, "a", "b", "y", ["tracer"])


@query("d26_binned_means", """WITH q AS (SELECT list_sort(list_distinct(quantile_cont(l_extendedprice, [i / 12.0 FOR i IN range(0, 13)]))) AS e FROM lineitem)
 SELECT greatest(len([x FOR x IN e IF x < l_extendedprice]), 1)::BIGINT AS bin, count(*) AS n, avg(l_extendedprice) AS mean_x, avg(l_quantity) AS mean_y, stddev_samp(l_quantity) AS sd_y FROM lineitem, q GROUP BY 1""",
       "mean_x mean_y sd_y")
def _(t):
    return profile.binned(t.lineitem.select("l_extendedprice", "l_quantity"), "l_extendedprice", "l_quantity", 12)


@query("d27_code_share", """WITH l AS (SELECT l_returnflag, unnest(['l_linenumber', 'l_quantity']) AS variable, unnest([CAST(l_linenumber AS DOUBLE), l_quantity]) AS v FROM lineitem)
 SELECT l_returnflag, variable, count(*) FILTER (WHERE v IS DISTINCT FROM 7) AS n_given, avg(CAST(v IN (1, 2) AS INT)) FILTER (WHERE v IS DISTINCT FROM 7) AS share FROM l GROUP BY 1, 2""", "share")
def _(t):
    return profile.code_share(t.lineitem, ["l_linenumber", "l_quantity"], [1.0, 2.0], 7.0, ["l_returnflag"])


@query("d28_inventory_summary", """WITH l AS (SELECT l_returnflag AS folder, unnest(['status', 'line']) AS field, unnest([l_linestatus, CAST(l_linenumber AS VARCHAR)]) AS value FROM lineitem)
 SELECT folder, field, value, count(*) AS n FROM l GROUP BY 1, 2, 3""")
def _(t):
    inv = t.lineitem.select(F.col("l_returnflag").alias("folder"), F.col("l_linestatus").alias("status"), F.col("l_linenumber").alias("line"))
    return profile.inventory_summary(inv, "folder", ["status", "line"])


@query("d34_valid_pct", f"""WITH {SPARSE_TIMED} SELECT 'score' AS variable, avg(CAST(score IS NOT NULL AS INT)) * 100 AS all_pct, avg(CAST(score IS NOT NULL AS INT)) FILTER (WHERE rn = 1) * 100 AS first_pct FROM st
 UNION ALL SELECT 'acctbal', avg(CAST(acctbal > 0 AS INT)) * 100, avg(CAST(acctbal > 0 AS INT)) FILTER (WHERE rn = 1) * 100 FROM st""", "all_pct first_pct")
def _(t):
    v = pit.visit_index(timed(t, True)).df.withColumn("acctbal", F.when(F.col("acctbal") > 0, F.col("acctbal")))
    return profile.valid_pct(v, ["score", "acctbal"], F.col("visit_no") == 1)


@query("d35_prevalence", """WITH l AS (SELECT unnest(['l_linenumber', 'tax_pct']) AS variable, unnest([CAST(l_linenumber AS DOUBLE), nullif(round(l_tax * 100), 0)]) AS value FROM lineitem)
 SELECT variable, value, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY variable) AS share FROM l WHERE value IS NOT NULL GROUP BY 1, 2""", "share")
def _(t):
    tax = F.round(F.col("l_tax") * 100)
    return profile.prevalence(t.lineitem.withColumn("tax_pct", F.when(tax != 0, tax)), ["l_linenumber", "tax_pct"])


@query("d37_coverage_gain", f"""WITH {SPARSE}, c AS (SELECT score, last_value(score IGNORE NULLS) OVER (PARTITION BY entity_id ORDER BY visit_date, visit_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS f FROM sp)
 SELECT 'score' AS variable, avg(CAST(score IS NOT NULL AS INT)) * 100 AS before_pct, avg(CAST(f IS NOT NULL AS INT)) * 100 AS after_pct, 100 - avg(CAST(f IS NOT NULL AS INT)) * 100 AS missing_pct FROM c""",
       "before_pct after_pct missing_pct")
def _(t):
    v = pit.carry(t.timeline(t.sparse()), carried=F.col("score")).df
    return profile.coverage_gain(v, {"score": ("score", "carried")})


@query("d38_compare_groups", f"""WITH {INDEX}, x AS (SELECT ix.*, v.site, v.acctbal, s.source FROM ix JOIN v ON ix.i_visit_id = v.visit_id JOIN fs s ON ix.entity_id = s.entity_id)
 SELECT source, count(*) AS n, count(DISTINCT site) AS sites, avg(CAST(i_status IN (1, 2, 3) AS INT)) * 100 AS known_pct,
 avg(CAST(i_status = 1 AS INT)) FILTER (WHERE i_status IN (1, 2, 3)) * 100 AS carrier_pct, quantile_cont(acctbal, 0.5) AS median_age FROM x GROUP BY 1""", "known_pct carrier_pct median_age")
def _(t):
    from visitframe.operators.joins import nearest_visit
    ix = nearest_visit(t.scans(), t.visits(), ["status", "site", "acctbal"], ["source"])
    return profile.compare_groups(ix, "source", "i_acctbal", F.col("i_status").isin(1, 2, 3), F.col("i_status") == 1, "i_site")
