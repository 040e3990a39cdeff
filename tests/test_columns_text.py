"""Null and edge rules of single columns, text handling and retrieval on small frames."""

import pytest
from pyspark.sql import functions as F

from visitframe.functions import columns as C
from visitframe.functions import rules as R
from visitframe.functions import text as X
from visitframe.operators import joins, retrieval


def one(df, c):
    return df.select(c).first()[0]


def test_missing_codes_belong_to_a_variable(spark):
    df = spark.createDataFrame([(1, 88, 88, "88")], "id int, age int, smoke int, txt string")
    out = C.clean(df, {"id": {"kind": "id", "missing": [1]}, "age": {"kind": "count", "missing": [-4]}, "smoke": {"kind": "count", "missing": [88]},
                       "txt": {"kind": "categorical", "missing": ["88"]}}).first()
    assert tuple(out) == (1, 88, None, "88")


def test_row_sums_counts_and_means(spark):
    df = spark.createDataFrame([(1.0, None, 1.0, -4), (None, None, 1.0, None), (None, None, None, -4)], "a double, b double, c double, d int")
    sums = [r[0] for r in df.select(C.row_sum(["a", "b", "c"], 2)).collect()]
    means = [r[0] for r in df.select(C.row_mean(["a", "b", "c"])).collect()]
    given = [r[0] for r in df.select(C.row_count_codes(["d"], [96])).collect()]
    assert sums == [2.0, None, None] and means == [1.0, 1.0, None] and given == [None, 0, None]


def test_indicators_and_clip(spark):
    df = spark.createDataFrame([(3,), (None,)], "s int")
    assert [r[0] for r in df.select(C.indicator("s", 3)).collect()] == [1, None]
    assert [r[0] for r in df.select(C.indicator("s", 3, True)).collect()] == [1, 0]
    assert [r[0] for r in df.select(C.clip(F.col("s").cast("double"), -1.0, 2.0)).collect()] == [2.0, None]


def test_cut_sides_and_qcut_duplicates(spark):
    df = spark.createDataFrame([(65.0,), (12.0,)], "v double")
    assert one(df, C.cut("v", [0, 65, 75], ["young", "old"], right=False)) == "old"
    assert one(df, C.cut("v", [0, 65, 75], ["young", "old"], right=True)) == "young"
    d = spark.createDataFrame([(float(v),) for v in [1, 1, 1, 1, 2, 3]], "v double")
    assert sorted(r["bin"] for r in C.qcut(d, "v", 4).collect()) == [1, 1, 1, 1, 2, 2]


def test_event_year_clock_and_classify(spark):
    df = spark.createDataFrame([("2005-05-01", 8888, "093015.5", None, "Series AV-45 late")], "d string, y int, c string, t1 string, t2 string").withColumn("d", F.to_date("d"))
    assert one(df, C.event_by_year("y", "d", F.lit(1))) == 0
    assert one(df, C.event_by_year(F.lit(2004), "d", F.lit(0))) == 1 and one(df, C.event_by_year(F.lit(2010), "d", F.lit(0))) == 0
    assert one(df, C.clock_seconds("c")) == 34215.5
    assert tuple(one(df, C.classify(C.TRACER_PATTERNS, "t1", "t2"))) == ("Florbetapir", "amyloid")
    assert tuple(one(df, C.classify(C.TRACER_PATTERNS, "t1"))) == ("unknown", "unknown")


def test_id_guard_refuses_identifiers(spark):
    df = spark.createDataFrame([("ok",), ("AB12345",)], "t string")
    assert R.id_hits(df, r"AB\d{4,}").count() == 1
    with pytest.raises(Exception, match="identifier"):
        R.id_guard(df, r"AB\d{4,}").collect()
    assert R.id_guard(df.limit(1), r"AB\d{4,}").count() == 1


def test_phrases(spark):
    df = spark.createDataFrame([("z_memory", -2.5), ("htn_ever", 1.0), ("bmi", 26.5), ("age", 70.0)], "n string, v double")
    assert [r[0] for r in df.select(R.describe_item("n", "v")).collect()] == ["memory score well below expected", "htn ever: yes", "bmi of 26.5", "age of 70"]
    p = spark.createDataFrame([(0.004,), (0.256,)], "p double")
    assert [r[0] for r in p.select(R.percent_text("p")).collect()] == ["under 1%", "26%"]


def test_nearest_visit_breaks_ties_by_date(spark):
    v = spark.createDataFrame([(1, "2000-01-01", 1, 2, 0.0), (1, "2000-01-21", 2, 3, 1.0), (1, "2003-01-01", 3, 1, 9.0)], "entity_id long, visit_date string, visit_id long, status int, score double").withColumn("visit_date", F.to_date("visit_date"))
    s = spark.createDataFrame([(1, "2000-01-11", "a")], "entity_id long, scan_date string, scan_id string").withColumn("scan_date", F.to_date("scan_date"))
    ix = joins.nearest_visit(s, v, ["status", "score"])
    r = ix.first()
    assert (r["i_visit_id"], r["gap_days"]) == (1, 10)
    f = joins.followup_events(ix, v).first()
    assert f["worst_status"] == 1 and f["max_rise"] == 9.0


def python_passages(blocks, size):
    """The packing rule as a plain loop."""
    out, buf, head = [], [], None
    for h, t in blocks:
        w = t.split()
        if buf and (h != head or sum(len(b.split()) for b in buf) + len(w) > size * 1.5):
            out.append((head, " ".join(buf)))
            buf = []
        head = h
        while len(w) > size * 1.5:
            out.append((head, " ".join([*buf, *w[:size]])))
            buf, w = [], w[size:]
        buf.append(" ".join(w))
    return out + ([(head, " ".join(buf))] if buf else [])


def test_passage_packing_matches_the_rule(spark):
    import random
    rng = random.Random(4)
    docs = []
    for i in range(30):
        docs.append((i, [(f"h{rng.randint(0, 2)}", " ".join(f"w{rng.randint(0, 99)}" for _ in range(rng.choice([25, 30, 80, 200, 271, 450, 460, 1000])))) for _ in range(rng.randint(0, 7))]))
    df = spark.createDataFrame(docs, "id long, blocks array<struct<heading:string,text:string>>")
    got = {r["id"]: [tuple(x) for x in r["p"]] for r in df.select("id", X.passage_array(F.col("blocks")).alias("p")).collect()}
    for i, blocks in docs:
        assert got[i] == python_passages(blocks, 180)


def test_tokens_citations_advice(spark):
    df = spark.createDataFrame([("The APOE e4 allele, a risk! Should I take it?", "Yes [2]. No [7].")], "q string, a string")
    assert one(df, X.tokens("q")) == ["apoe", "e4", "allele", "risk", "take"]
    assert one(df, X.is_advice("q")) and not one(df, X.is_advice(F.lit("What is APOE?")))
    assert one(df, X.citations_valid("a", 7)) and not one(df, X.citations_valid("a", 5)) and not one(df, X.citations_valid(F.lit("none"), 5))
    assert one(df, X.cited_sources("a")) == [2, 7]


def test_hybrid_search_equals_full_ranking(spark):
    import random
    rng = random.Random(9)
    words = [f"term{i}" for i in range(30)]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(3, 12))), [rng.random() for _ in range(4)]) for i in range(400)]
    qs = [(100 + i, " ".join(rng.choice(words) for _ in range(3)), [rng.random() for _ in range(4)]) for i in range(3)]
    d = spark.createDataFrame(docs, "doc_id long, text string, vector array<double>").repartition(5)
    q = spark.createDataFrame(qs, "qid long, text string, vector array<double>")
    bm = {(r["qid"], r["doc_id"]): r["bm25"] for r in retrieval.bm25(d, q).collect()}
    got = {(r["qid"], r["rank"]): (r["doc_id"], round(r["score"], 12)) for r in retrieval.search(d, q, 4, "hybrid").collect()}
    for qid, _, v in qs:
        sim = {i: round(sum(a * b for a, b in zip(x, v)), 9) for i, _, x in docs}
        rd = {i: k for k, i in enumerate(sorted(sim, key=lambda i: (-sim[i], i)))}
        rb = {i: k for k, i in enumerate(sorted(sim, key=lambda i: (-bm.get((qid, i), 0.0), i)))}
        best = sorted(sim, key=lambda i: (-(1 / (60 + rd[i]) + 1 / (60 + rb[i])), i))[:4]
        for k, i in enumerate(best):
            assert got[(qid, k + 1)] == (i, round(1 / (60 + rd[i]) + 1 / (60 + rb[i]), 12))


def test_stream_features_equal_batch(spark, tables):
    from visitframe.operators import pit
    from visitframe.plans.registry import QUERIES
    from conftest import SF
    live = {r["visit_id"]: r for r in QUERIES["l2_features_stream"](spark, SF).collect()}
    tl = pit.visit_index(pit.add_years(tables.timeline(tables.sparse())))
    tl = pit.delta(pit.running_slope(pit.carry(pit.ever(tl, ever_high=(F.col("score") > 30).cast("int")), carried=F.col("score")), "score"), "score")
    batch = tl.df.collect()
    assert len(live) == len(batch)
    close = lambda a, b: (a is None and b is None) or a == pytest.approx(b, abs=2e-4)
    for r in batch:
        s = live[r["visit_id"]]
        assert not s["late"] and s["visit_no"] == r["visit_no"] and s["ever_high"] == r["ever_high"]
        assert close(s["carried"], r["carried"]) and close(s["delta_score"], r["delta_score"]) and close(s["slope_score"], r["slope_score"])
