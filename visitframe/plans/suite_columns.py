"""Projection, filter and scalar queries (B1-B28)."""

from __future__ import annotations

from pyspark.sql import functions as F

from visitframe.functions import columns as C
from visitframe.functions import rules as R
from visitframe.plans.fixtures import ENTRIES, SPARSE, TIMED, VISITS
from visitframe.plans.suite import query
from visitframe.plans.suite_pit import timed

VARMAP = {"l_quantity": {"kind": "count", "missing": [50.0]}, "l_discount": {"kind": "continuous", "missing": [0.0]},
          "l_tax": {"kind": "continuous", "missing": [0.0]}, "l_orderkey": {"kind": "id", "missing": [0]},
          "l_returnflag": {"kind": "categorical", "missing": ["A"]}}
CODED = """c AS (SELECT l_orderkey, l_returnflag, l_linestatus, nullif(l_quantity, 50) AS q, nullif(l_discount, 0) AS d, nullif(l_tax, 0) AS x FROM lineitem)"""


def coded(t):
    return C.clean(t.lineitem, VARMAP)


@query("b1_clean_codes", f"""WITH {CODED} SELECT l_returnflag, count(*) AS n, count(q) AS n_q, count(d) AS n_d, count(x) AS n_x,
 sum(q) AS sum_q, sum(d) AS sum_d, sum(x) AS sum_x FROM c GROUP BY 1""", "sum_q sum_d sum_x")
def _(t):
    return coded(t).groupBy("l_returnflag").agg(
        F.count("*").alias("n"), F.count("l_quantity").alias("n_q"), F.count("l_discount").alias("n_d"), F.count("l_tax").alias("n_x"),
        F.sum("l_quantity").alias("sum_q"), F.sum("l_discount").alias("sum_d"), F.sum("l_tax").alias("sum_x"))


@query("b2_code_counts", """SELECT variable, n_rows, n_coded, n_coded / n_rows AS share FROM (
 SELECT 'l_quantity' AS variable, count(*) AS n_rows, count(*) FILTER (WHERE l_quantity = 50) AS n_coded FROM lineitem UNION ALL
 SELECT 'l_discount', count(*), count(*) FILTER (WHERE l_discount = 0) FROM lineitem UNION ALL
 SELECT 'l_tax', count(*), count(*) FILTER (WHERE l_tax = 0) FROM lineitem)""", "share")
def _(t):
    return C.code_counts(t.lineitem, {k: VARMAP[k]["missing"] for k in ("l_quantity", "l_discount", "l_tax")})


@query("b4_label_map", f"""WITH {VISITS} SELECT visit_id, CASE status WHEN 1 THEN 'Urgent' WHEN 2 THEN 'High' WHEN 3 THEN 'Medium' END AS status_name FROM v""")
def _(t):
    return t.visits().select("visit_id", C.label("status", {1: "Urgent", 2: "High", 3: "Medium"}).alias("status_name"))


@query("b5_indicators", f"""WITH {CODED} SELECT l_linestatus, sum(CAST(q = 10 AS BIGINT))::BIGINT AS kept_hits, count(q = 10) AS kept_known,
 sum(CAST(coalesce(q = 10, false) AS BIGINT))::BIGINT AS zero_hits, count(coalesce(q = 10, false)) AS zero_known FROM c GROUP BY 1""")
def _(t):
    keep, zero = C.indicator("l_quantity", 10), C.indicator("l_quantity", 10, null_as_zero=True)
    return coded(t).groupBy("l_linestatus").agg(F.sum(keep).alias("kept_hits"), F.count(keep).alias("kept_known"),
                                                F.sum(zero).alias("zero_hits"), F.count(zero).alias("zero_known"))


@query("b6_coalesce_forms", """WITH a AS (SELECT l_linestatus, CASE WHEN l_linenumber <= 2 THEN l_linenumber END AS f1, nullif(l_tax, 0) * 50 AS f2 FROM lineitem)
 SELECT l_linestatus, coalesce(CASE WHEN f1 = 0 THEN 0 WHEN f1 IN (1, 2) THEN 1 END, CAST(f2 >= 1 AS BIGINT)) AS reported, count(*) AS n FROM a GROUP BY 1, 2""")
def _(t):
    a = t.lineitem.select("l_linestatus", F.when(F.col("l_linenumber") <= 2, F.col("l_linenumber")).alias("f1"),
                          (F.when(F.col("l_tax") != 0, F.col("l_tax")) * 50).alias("f2"))
    return a.groupBy("l_linestatus", C.coalesce_forms("f1", "f2").alias("reported")).agg(F.count("*").alias("n"))


@query("b7_event_by_year", f"""WITH {VISITS}, y AS (SELECT *, CASE WHEN packet = 'P' THEN 8888 WHEN packet = 'F' THEN 1990 + status * 2 END AS ey FROM v)
 SELECT packet, coalesce(CASE WHEN ey = 8888 THEN 0 WHEN ey > 1900 AND ey <= year(visit_date) THEN 1 END,
 CASE WHEN status = 1 THEN 1 WHEN status = 2 THEN 0 END)::BIGINT AS flag, count(*) AS n FROM y GROUP BY 1, 2""")
def _(t):
    v = t.visits().withColumn("ey", F.when(F.col("packet") == "P", 8888).when(F.col("packet") == "F", 1990 + F.col("status") * 2))
    fallback = F.when(F.col("status") == 1, 1).when(F.col("status") == 2, 0)
    return v.groupBy("packet", C.event_by_year("ey", "visit_date", fallback).alias("flag")).agg(F.count("*").alias("n"))


@query("b8_clip", f"""WITH {SPARSE} SELECT visit_id, CASE WHEN score IS NOT NULL THEN greatest(least(score, 40), 5) END AS clipped FROM sp""", "clipped")
def _(t):
    return t.sparse().select("visit_id", C.clip("score", 5.0, 40.0).alias("clipped"))


B9 = """(q IS NOT NULL)::INT + (d IS NOT NULL)::INT + (x IS NOT NULL)::INT"""


@query("b9_row_sum", f"""WITH {CODED}, r AS (SELECT l_linestatus, CASE WHEN {B9} >= 2 THEN coalesce(q, 0) + coalesce(d, 0) + coalesce(x, 0) END AS s FROM c)
 SELECT l_linestatus, count(s) AS n_known, sum(s) AS total FROM r GROUP BY 1""", "total")
def _(t):
    s = C.row_sum(["l_quantity", "l_discount", "l_tax"], 2)
    return coded(t).select("l_linestatus", s.alias("s")).groupBy("l_linestatus").agg(F.count("s").alias("n_known"), F.sum("s").alias("total"))


@query("b10_row_mean_min", f"""WITH {CODED}, r AS (SELECT l_linestatus, (coalesce(q, 0) + coalesce(d, 0) + coalesce(x, 0)) / nullif({B9}, 0) AS m, least(q, d, x) AS lo FROM c)
 SELECT l_linestatus, count(m) AS n, sum(m) AS sum_mean, sum(lo) AS sum_min FROM r GROUP BY 1""", "sum_mean sum_min")
def _(t):
    cols = ["l_quantity", "l_discount", "l_tax"]
    r = coded(t).select("l_linestatus", C.row_mean(cols).alias("m"), C.row_min(cols).alias("lo"))
    return r.groupBy("l_linestatus").agg(F.count("m").alias("n"), F.sum("m").alias("sum_mean"), F.sum("lo").alias("sum_min"))


@query("b11_row_count_codes", """WITH r AS (SELECT l_returnflag, CASE WHEN l_linenumber IS DISTINCT FROM 7 OR CAST(l_quantity AS INT) IS DISTINCT FROM 7
  THEN CAST(coalesce(l_linenumber IN (1, 2), false) AS INT) + CAST(coalesce(CAST(l_quantity AS INT) IN (1, 2), false) AS INT) END AS k FROM lineitem)
 SELECT l_returnflag, CAST(k AS BIGINT) AS n_failed, count(*) AS n FROM r GROUP BY 1, 2""")
def _(t):
    k = C.row_count_codes(["l_linenumber", F.col("l_quantity").cast("int")], [1, 2], not_given=7)
    return t.lineitem.groupBy("l_returnflag", k.alias("n_failed")).agg(F.count("*").alias("n"))


@query("b12_derived_measures", f"""WITH {CODED} SELECT l_returnflag, sum(q - d) AS diff,
 count(*) FILTER (WHERE {B9} >= 2 AND coalesce((q > 25)::INT, 0) + coalesce((d > 0.05)::INT, 0) + coalesce((x > 0.04)::INT, 0) >= 2) AS high_risk FROM c GROUP BY 1""", "diff")
def _(t):
    flags = [(F.col("l_quantity") > 25).cast("int"), (F.col("l_discount") > 0.05).cast("int"), (F.col("l_tax") > 0.04).cast("int")]
    return coded(t).groupBy("l_returnflag").agg(F.sum(F.col("l_quantity") - F.col("l_discount")).alias("diff"),
                                                F.count_if(C.risk_count(flags, 2) >= 2).alias("high_risk"))


SHAPES = [(r"bolt|nut", "Fastener", "metal"), (r"ring|gear", "Wheel", "metal"), (r"widget|gadget", "Device", "mixed"), (r"econ", "Economy", "type")]


@query("b13_classify_text", """WITH k AS (SELECT p_partkey, CASE WHEN regexp_matches(lower(p_name), 'bolt|nut') THEN 'Fastener/metal'
  WHEN regexp_matches(lower(p_name), 'ring|gear') THEN 'Wheel/metal' WHEN regexp_matches(lower(p_name), 'widget|gadget') THEN 'Device/mixed'
  WHEN regexp_matches(lower(p_name), 'econ') THEN 'Economy/type' WHEN regexp_matches(lower(p_type), 'bolt|nut') THEN 'Fastener/metal'
  WHEN regexp_matches(lower(p_type), 'ring|gear') THEN 'Wheel/metal' WHEN regexp_matches(lower(p_type), 'widget|gadget') THEN 'Device/mixed'
  WHEN regexp_matches(lower(p_type), 'econ') THEN 'Economy/type' ELSE 'unknown/unknown' END AS kind FROM part) SELECT kind, count(*) AS n FROM k GROUP BY 1""")
def _(t):
    k = C.classify(SHAPES, "p_name", "p_type")
    return t.part.groupBy(F.concat_ws("/", k["name"], k["class"]).alias("kind")).agg(F.count("*").alias("n"))


URL = r"^https?://([a-z]+)\.([a-z]+)\.example\.(\w+)/.*$"


@query("b14_parse_name", r"""SELECT page_id, regexp_extract(url, '^https?://([a-z]+)\.([a-z]+)\.example\.(\w+)/.*$', 1) AS host,
 regexp_extract(url, '^https?://([a-z]+)\.([a-z]+)\.example\.(\w+)/.*$', 3) AS top,
 regexp_matches(url, '^https?://([a-z]+)\.([a-z]+)\.example\.(\w+)/.*$') AS parsed, regexp_replace(trim('I' || page_id), '^I', '') AS uid FROM pages""")
def _(t):
    p = t.pages.withColumn("x", C.parse_name("url", URL, ["host", "mid", "top"]))
    return p.select("page_id", "x.host", "x.top", "x.parsed", C.norm_uid(F.concat(F.lit("I"), F.col("page_id"))).alias("uid"))


@query("b15_month_and_try_date", f"""SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n,
 count(try_cast(CASE WHEN o_orderstatus = 'P' THEN o_orderpriority ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS DATE)) AS n_parsed FROM orders GROUP BY 1""")
def _(t):
    text = F.when(F.col("o_orderstatus") == "P", F.col("o_orderpriority")).otherwise(F.to_date("o_orderdate").cast("string"))
    return t.orders.groupBy(C.month("o_orderdate").alias("month")).agg(F.count("*").alias("n"), F.count(C.try_date(text)).alias("n_parsed"))


@query("b16_cut", """SELECT CASE WHEN c_acctbal >= 0 AND c_acctbal < 2500 THEN 'low' WHEN c_acctbal >= 2500 AND c_acctbal < 7500 THEN 'mid' WHEN c_acctbal >= 7500 AND c_acctbal < 20000 THEN 'high' END AS grp,
 CASE WHEN c_nationkey > -1 AND c_nationkey <= 5 THEN 'a' WHEN c_nationkey > 5 AND c_nationkey <= 15 THEN 'b' WHEN c_nationkey > 15 AND c_nationkey <= 99 THEN 'c' END AS zone,
 count(*) AS n FROM customer GROUP BY 1, 2""")
def _(t):
    return t.customer.groupBy(C.cut("c_acctbal", [0, 2500, 7500, 20000], ["low", "mid", "high"], right=False).alias("grp"),
                              C.cut("c_nationkey", [-1, 5, 15, 99], ["a", "b", "c"]).alias("zone")).agg(F.count("*").alias("n"))


@query("b17_qcut", f"""WITH q AS (SELECT list_sort(list_distinct(quantile_cont(l_quantity, [i / 10.0 FOR i IN range(0, 11)]))) AS e FROM lineitem)
 SELECT greatest(len([x FOR x IN e IF x < l_quantity]), 1)::BIGINT AS bin, count(*) AS n, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem, q GROUP BY 1""")
def _(t):
    b = C.qcut(t.lineitem.select("l_quantity"), "l_quantity", 10)
    return b.groupBy("bin").agg(F.count("*").alias("n"), F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi"))


@query("b18_logit_sigmoid", """SELECT o_orderkey, ln(greatest(least(o_totalprice / 500000, 0.99999), 0.00001) / (1 - greatest(least(o_totalprice / 500000, 0.99999), 0.00001))) AS lg,
 1 / (1 + exp(-(o_totalprice / 100000 - 2))) AS sg FROM orders""", "lg sg")
def _(t):
    return t.orders.select("o_orderkey", C.logit(F.col("o_totalprice") / 500000).alias("lg"), C.sigmoid(F.col("o_totalprice") / 100000 - 2).alias("sg"))


@query("b19_year_bin", f"WITH {TIMED} SELECT CAST(round_even(years, 0) AS BIGINT) AS year_bin, count(*) AS n FROM tv GROUP BY 1")
def _(t):
    return timed(t).df.groupBy(C.year_bin("years").alias("year_bin")).agg(F.count("*").alias("n"))


@query("b20_clock_seconds", """SELECT event_id, CAST(hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS DOUBLE) AS seconds,
 CAST((hour(ts) * 3600 + minute(ts) * 60 + second(ts) - 43200 + 86400) % 86400 AS DOUBLE) AS since_noon FROM events""")
def _(t):
    s = C.clock_seconds(F.date_format("ts", "HHmmss"))
    return t.events.select("event_id", s.alias("seconds"), C.elapsed_seconds(F.lit(43200.0), s).alias("since_noon"))


def entry_batch(t):
    """Each event as a screen entry: a map of names to texts and the sections switched on."""
    e = t.entries()
    k, v = F.col("k"), F.col("value")
    s = lambda c: c.cast("string")
    values = F.create_map(
        F.lit("age"), s(k + 20), F.lit("sex"), F.when(k % 2 == 0, "Female").otherwise("Male"), F.lit("educ_years"), s(k % 20),
        F.lit("race"), F.when(k % 3 == 0, "White").when(k % 3 == 1, "Black").otherwise("Not stated"),
        F.lit("htn_ever"), F.when(k > 50, "true").otherwise("false"), F.lit("smoke_ever"), F.when(k > 30, "true").otherwise("false"),
        F.lit("smoke_years"), F.when(k > 60, s(k)).otherwise(""), F.lit("bp_sys"), s(F.floor(v)), F.lit("bp_dia"), s(k),
        F.lit("diagnosis"), F.when(k % 3 == 0, "Normal").when(k % 3 == 1, "MCI").otherwise(""), F.lit("CDRSUM"), F.when(v < 100, s(F.floor(v / 10))).otherwise(""),
        F.lit("apoe"), F.when(k % 4 == 3, "Not tested").otherwise(s(k % 4)))
    on = F.create_map(F.lit("heart"), F.col("event_type") != "error", F.lit("assessment"), F.col("event_type") != "view",
                      F.lit("genes"), F.col("event_type") != "click")
    return e.withColumns({"values": values, "sections": on})


FEATS = ENTRIES + """, ft AS (SELECT event_id, k + 20.0 AS age, CAST(k % 2 = 0 AS BIGINT) AS female, CAST(k % 20 AS DOUBLE) AS educ_years,
 CASE WHEN k % 3 <> 2 THEN CAST(k % 3 = 0 AS BIGINT) END AS race_white, CASE WHEN event_type <> 'error' THEN CAST(k > 50 AS BIGINT) END AS htn_ever,
 CASE WHEN event_type <> 'error' THEN CASE WHEN k <= 30 THEN 0.0 WHEN k > 60 THEN k END END AS smoke_years,
 CASE WHEN event_type <> 'error' THEN floor(value) END AS bp_sys, CASE WHEN event_type <> 'error' THEN k END AS bp_dia,
 CASE WHEN event_type <> 'view' THEN CASE WHEN k % 3 = 0 THEN 'Normal' WHEN k % 3 = 1 THEN 'MCI' END END AS status,
 CASE WHEN event_type <> 'view' AND value < 100 THEN floor(value / 10) END AS score,
 CASE WHEN event_type <> 'click' AND k % 4 <> 3 THEN k % 4 END AS apoe_e4_count, CASE WHEN event_type <> 'click' THEN CAST(k % 4 = 3 AS BIGINT) END AS apoe_unknown,
 CASE WHEN event_type <> 'error' THEN CAST((k > 50)::INT + (k > 30)::INT AS DOUBLE) END AS vascular_risk_count FROM e)"""
FCOLS = ["event_id", "age", "female", "educ_years", "race_white", "htn_ever", "smoke_years", "bp_sys", "bp_dia", "status", "score",
         "apoe_e4_count", "apoe_unknown", "vascular_risk_count"]


@query("b22_entries_to_features", f"WITH {FEATS} SELECT * FROM ft", "age educ_years smoke_years bp_sys bp_dia score apoe_e4_count")
def _(t):
    return R.to_features(entry_batch(t)).select(*FCOLS)


def checked_entries(t):
    f = R.to_features(entry_batch(t))
    refs = {"ref_low_z_normal": -2.0, "ref_score_p99": 4.0, "ref_age_lo": 40.0, "ref_age_hi": 95.0, "ref_educ_lo": 6.0}
    f = f.withColumns({k: F.lit(v) for k, v in refs.items()}).withColumn("z_memory", F.lit(3.0) - F.col("score"))
    return R.check_rows(f, R.entry_rules(["z_memory"]))


@query("b21_plausibility_rules", f"""WITH {FEATS}, r AS (
 SELECT event_id, CASE WHEN status = 'Normal' AND 3 - score < -2 THEN 1 END AS a, CASE WHEN score > 4 THEN 1 END AS b, CASE WHEN status = 'MCI' AND score = 0 THEN 1 END AS c,
 CASE WHEN (status IS NULL) <> (score IS NULL) THEN 1 END AS d, CASE WHEN score > 5 THEN 1 END AS f, CASE WHEN 3 - score <= -5 THEN 1 END AS g,
 CASE WHEN age NOT BETWEEN 40 AND 95 THEN 1 END AS h, CASE WHEN educ_years < 6 THEN 1 END AS i, CASE WHEN bp_sys <= bp_dia THEN 1 END AS j,
 CASE WHEN smoke_years > 0 AND smoke_years > age - 8 THEN 1 END AS l FROM ft)
 SELECT event_id, CAST(coalesce(a, 0) + coalesce(b, 0) + coalesce(f, 0) + coalesce(j, 0) + coalesce(l, 0) AS BIGINT) AS n_check,
 CAST(coalesce(c, 0) + coalesce(d, 0) + coalesce(g, 0) + coalesce(h, 0) + coalesce(i, 0) AS BIGINT) AS n_note FROM r""")
def _(t):
    n = lambda level: F.size(F.filter("checks", lambda x: x["level"] == level))
    return checked_entries(t).select("event_id", n("check").alias("n_check"), n("note").alias("n_note"))


@query("b23_presence_combo", """SELECT concat_ws(' + ', 'Base', CASE WHEN l_tax > 0 THEN 'Tax' END, CASE WHEN l_discount > 0 THEN 'Discount' END) AS label, count(*) AS n FROM lineitem GROUP BY 1""")
def _(t):
    c = R.combo({"Tax": F.col("l_tax") > 0, "Discount": F.col("l_discount") > 0}, "Base")
    return t.lineitem.groupBy(c.alias("label")).agg(F.count("*").alias("n"))


@query("b24_id_guard", r"""SELECT role, count(*) AS n, count(*) FILTER (WHERE regexp_matches(text, '\d{4,}')) AS n_hits FROM conversations GROUP BY 1""")
def _(t):
    c = t.conversations
    hits = R.id_hits(c.select("role", "text"), r"\d{4,}").groupBy("role").agg(F.count("*").alias("n_hits"))
    out = c.groupBy("role").agg(F.count("*").alias("n")).join(hits, "role", "left").select("role", "n", F.coalesce("n_hits", F.lit(0)).alias("n_hits"))
    return R.id_guard(out, r"\d{4,}")


@query("b25_describe_item", f"""WITH {SPARSE}, g AS (SELECT visit_id, unnest(['z_score', 'f_ever', 'amount']) AS name,
 unnest([(score - 25) / 10, CAST(status = 1 AS INT), CAST(status AS DOUBLE)]) AS value FROM sp WHERE score IS NOT NULL)
 SELECT visit_id, name, CASE WHEN name = 'z_score' THEN 'score score ' || CASE WHEN value <= -2 THEN 'well below' WHEN value <= -1 THEN 'below' WHEN value < 1 THEN 'about as' ELSE 'above' END || ' expected'
 WHEN name = 'f_ever' THEN 'f ever: ' || CASE WHEN value = 1 THEN 'yes' ELSE 'no' END ELSE 'amount of ' || CAST(CAST(value AS INT) AS VARCHAR) END AS phrase FROM g""")
def _(t):
    v = t.sparse().where(F.col("score").isNotNull())
    pair = lambda n, c: F.struct(F.lit(n).alias("name"), c.cast("double").alias("value"))
    g = v.select("visit_id", F.inline(F.array(pair("z_score", (F.col("score") - 25) / 10), pair("f_ever", (F.col("status") == 1).cast("int")),
                                              pair("amount", F.col("status")))))
    return g.select("visit_id", "name", R.describe_item("name", "value").alias("phrase"))


@query("b26_first_sentences", r"""WITH s AS (SELECT doc_id, array_to_string(list_slice(string_split(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '([.!?]) ', '\1' || chr(1), 'g'), chr(1)), 1, 2), ' ') AS x FROM documents)
 SELECT doc_id, CASE WHEN length(x) <= 320 THEN x ELSE regexp_replace(substr(x, 1, 320), ' [^ ]*$', '') || ' ...' END AS lead FROM s""")
def _(t):
    return t.documents.select("doc_id", R.first_sentences(F.regexp_replace("text", r"\s+", " ")).alias("lead"))


@query("b27_shape_flags", """SELECT CAST(l_linenumber AS BIGINT) || 'x' || CAST(l_quantity AS BIGINT) || 'x' || CAST(l_linenumber AS BIGINT) AS matrix,
 l_linenumber * CAST(l_quantity AS BIGINT) = l_partkey % 100 AND l_quantity > 0 AS file_count_matches, count(*) AS n FROM lineitem GROUP BY 1, 2""")
def _(t):
    inv = t.lineitem.select(F.col("l_linenumber").alias("rows"), F.col("l_quantity").alias("cols"), F.col("l_linenumber").cast("long").alias("n_slices"),
                            F.col("l_quantity").cast("long").alias("n_frames"), (F.col("l_partkey") % 100).alias("n_files"), F.lit(True).alias("header_ok"))
    return R.shape_flags(inv).groupBy("matrix", "file_count_matches").agg(F.count("*").alias("n"))


@query("b28_design_view", f"""WITH {VISITS} SELECT segment, avg(acctbal) AS mean_value, 'nearest' AS design FROM v GROUP BY 1
 UNION ALL SELECT segment, avg(score), 'strict' FROM v GROUP BY 1""", "mean_value")
def _(t):
    v = t.visits().select("segment", F.col("score").alias("value"), F.col("acctbal").alias("value_nearest"))
    one = lambda d: R.design_view(v, d, ["value"]).groupBy("segment").agg(F.avg("value").alias("mean_value")).withColumn("design", F.lit(d))
    return one("nearest").unionByName(one("strict"))
