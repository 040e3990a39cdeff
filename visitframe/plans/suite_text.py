"""Text, retrieval (K1-K16) and streaming (L1-L3) queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from visitframe.functions import text as X
from visitframe.operators import retrieval as R
from visitframe.plans.fixtures import SPARSE, VISITS
from visitframe.plans.suite import query
from visitframe.plans.suite_splits import contributions
from visitframe.session import scratch_path, spread, stage
from visitframe.streaming import stream as S

STOP = ", ".join(f"'{w}'" for w in X.STOP_WORDS)
PARAS = r"""ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, split_part(text, chr(10), 1) AS section, source FROM documents),
 pa AS (SELECT doc_id, section, source, regexp_replace(trim(regexp_replace(raw, '[ \t\r\n\f]+', ' ', 'g')), '\[[\d,\s\-–]+\]', '', 'g') AS t FROM ln),
 para AS (SELECT * FROM pa WHERE len(list_filter(string_split(t, ' '), lambda w: w <> '')) >= 25
  AND NOT regexp_matches(section, '(?i)reference|acknowledg|funding|conflict|contributor|declaration|supplement|author|disclosure|data sharing'))"""


def heading():
    return F.split("text", "\n")[0]


@query("k1_paragraphs", f"WITH {PARAS} SELECT doc_id, count(*) AS n, CAST(sum(length(t)) AS BIGINT) AS chars, min(md5(t)) AS first_hash FROM para GROUP BY 1")
def _(t):
    p = R.paragraphs(spread(t.documents), "text", heading(), ["doc_id"])
    return p.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"), F.min(F.md5("text")).alias("first_hash"))


def doc_passages(t):
    return R.passages(spread(t.documents), "text", heading(), ["doc_id", "source"])


@query("k2_passages", None)
def _(t):
    return doc_passages(t)


@query("k2_passage_words", f"""WITH {PARAS} SELECT CAST(sum(len(list_filter(string_split(t, ' '), lambda w: w <> ''))) AS BIGINT) AS n_words, count(DISTINCT doc_id) AS n_docs, true AS within_limit FROM para""")
def _(t):
    n = F.size(F.filter(F.split("text", " "), lambda w: w != ""))
    return doc_passages(t).agg(F.sum(n).alias("n_words"), F.count_distinct("doc_id").alias("n_docs"), (F.max(n) <= 270).alias("within_limit"))


TOK = f"""tk AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: length(w) > 1 AND w NOT IN ({STOP})) AS tk FROM documents),
 qk AS (SELECT item_id AS qid, unnest(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: length(w) > 1 AND w NOT IN ({STOP}))) AS term FROM benchmark)"""


@query("k3_tokens", f"WITH {TOK} SELECT doc_id, len(tk) AS n_tokens, CAST(len(list_distinct(tk)) AS BIGINT) AS n_terms FROM tk")
def _(t):
    return spread(t.documents).select("doc_id", F.size(X.tokens("text")).alias("n_tokens"), F.size(F.array_distinct(X.tokens("text"))).alias("n_terms"))


@query("k4_bm25_index", f"""WITH {TOK}, e AS (SELECT doc_id, len(tk) AS length, unnest(tk) AS term FROM tk), p AS (SELECT doc_id, term, length, count(*) AS tf FROM e GROUP BY ALL)
 SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf, max(length) AS max_length FROM p GROUP BY 1""")
def _(t):
    return R.bm25_index(spread(t.documents)).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"), F.max("length").alias("max_length"))


BM = TOK + """, st AS (SELECT count(*) AS n, avg(len(tk)) AS avg_len FROM tk), pe AS (SELECT doc_id, len(tk) AS length, unnest(tk) AS term FROM tk),
 po AS (SELECT doc_id, term, length, count(*) AS tf FROM pe WHERE term IN (SELECT term FROM qk) GROUP BY ALL), dfq AS (SELECT term, count(*) AS df FROM po GROUP BY 1),
 bm AS (SELECT qid, doc_id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / avg_len))), 9) AS bm25
  FROM qk JOIN dfq USING (term) JOIN po USING (term), st GROUP BY 1, 2)"""


def questions(t):
    return t.benchmark.select(F.col("item_id").alias("qid"), "text")


@query("k5_bm25_scores", f"WITH {BM} SELECT qid, doc_id, bm25 FROM bm", "bm25")
def _(t):
    return R.bm25(spread(t.documents), questions(t))


CENT = """em AS (SELECT vec_id, label, i, CAST(embedding[i] AS DOUBLE) AS x FROM embeddings, range(1, 65) t(i)), nd AS (SELECT vec_id, i, x / sqrt(sum(x * x) OVER (PARTITION BY vec_id)) AS x FROM em),
 ce AS (SELECT CAST(label AS BIGINT) AS qid, i, avg(x) AS c FROM em GROUP BY 1, 2), cu AS (SELECT qid, i, c / sqrt(sum(c * c) OVER (PARTITION BY qid)) AS c FROM ce),
 sim AS (SELECT qid, vec_id AS doc_id, round(sum(c * x), 9) AS similarity FROM cu JOIN nd USING (i) GROUP BY 1, 2)"""


def vectors(t):
    return t.embeddings.select(F.col("vec_id").alias("doc_id"), X.unit(F.transform("embedding", lambda x: x.cast("double"))).alias("vector"), F.col("label").cast("string").alias("source"))


def centroids(t):
    """One query per label: the unit mean of its vectors."""
    e = t.embeddings.select("label", F.posexplode("embedding").alias("i", "x"))
    mean = e.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("c"))
    v = mean.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "c"))), lambda s: s["c"]).alias("v"))
    return v.select(F.col("label").alias("qid"), X.unit(F.col("v")).alias("vector"))


@query("k6_dense_scores", f"WITH {CENT} SELECT qid, doc_id, similarity, row_number() OVER (PARTITION BY qid ORDER BY similarity DESC, doc_id) AS rank FROM sim QUALIFY rank <= 25", "similarity")
def _(t):
    return R.dense_top(vectors(t), centroids(t), 25)


LET = "abcdefghijklmnopqrstuvwxyz"
VEC = lambda tbl, key: f"(SELECT {key}, [x / sqrt(list_sum([y * y FOR y IN v])) FOR x IN v] AS v FROM (SELECT {key}, [" + ", ".join(
    f"CAST(length(lower(text)) - length(replace(lower(text), '{c}', '')) AS DOUBLE)" for c in LET) + f"] AS v FROM {tbl}))"
HYB = BM + f""", dv AS {VEC('documents', 'doc_id')}, qv AS {VEC('(SELECT item_id AS qid, text FROM benchmark)', 'qid')},
 pr AS (SELECT qid, doc_id, round(list_dot_product(dv.v, qv.v), 9) AS similarity FROM dv, qv),
 rk AS (SELECT qid, doc_id, similarity, coalesce(bm25, 0) AS bm25, row_number() OVER (PARTITION BY qid ORDER BY similarity DESC, doc_id) - 1 AS rd,
  row_number() OVER (PARTITION BY qid ORDER BY coalesce(bm25, 0) DESC, doc_id) - 1 AS rb FROM pr LEFT JOIN bm USING (qid, doc_id)),
 hy AS (SELECT *, 1 / (60.0::DOUBLE + rd) + 1 / (60.0::DOUBLE + rb) AS fused FROM rk)"""


def letter_docs(t):
    """The passage library with its vectors, written once like any index."""
    return stage(spread(t.documents).select("doc_id", "text", X.letter_vector("text").alias("vector")), "library")


def letter_queries(t):
    return questions(t).withColumn("vector", X.letter_vector("text"))


@query("k7_search_dense", f"WITH {HYB} SELECT qid, doc_id, similarity AS score, row_number() OVER (PARTITION BY qid ORDER BY similarity DESC, doc_id) AS rank FROM rk QUALIFY rank <= 5", "score")
def _(t):
    return R.search(letter_docs(t), letter_queries(t), 5, "dense")


@query("k7_search_bm25", f"WITH {HYB} SELECT qid, doc_id, bm25 AS score, row_number() OVER (PARTITION BY qid ORDER BY bm25 DESC, doc_id) AS rank FROM rk QUALIFY rank <= 5", "score")
def _(t):
    return R.search(letter_docs(t), letter_queries(t), 5, "bm25")


@query("k7_search_hybrid", f"WITH {HYB} SELECT qid, doc_id, fused AS score, similarity, bm25, row_number() OVER (PARTITION BY qid ORDER BY fused DESC, doc_id) AS rank FROM hy QUALIFY rank <= 5", "score similarity bm25")
def _(t):
    return R.search(letter_docs(t), letter_queries(t), 5, "hybrid")


@query("k8_not_found", f"WITH {CENT} SELECT qid, max(similarity) AS best, max(similarity) < 0.35 AS not_found FROM sim GROUP BY 1", "best")
def _(t):
    return R.not_found(R.dense_top(vectors(t), centroids(t), 5))


ADVICE_SQL = X.ADVICE.replace("'", "''")


@query("k9_advice_flag", f"SELECT role, count(*) AS n, count(*) FILTER (WHERE regexp_matches(text, '{ADVICE_SQL}')) AS n_advice FROM conversations GROUP BY 1")
def _(t):
    return t.conversations.groupBy("role").agg(F.count("*").alias("n"), F.count_if(X.is_advice("text")).alias("n_advice"))


def answers(t):
    hits = R.search(letter_docs(t), letter_queries(t), 5, "bm25")
    h = hits.join(t.documents.select("doc_id", "text"), "doc_id").join(letter_queries(t).select("qid", F.col("vector").alias("qv")), "qid")
    return R.extract(h.withColumn("text", X.normalise("text")), X.letter_vector)


@query("k10_extractive_answers", None)
def _(t):
    return answers(t)


@query("k11_citations", r"""WITH c AS (SELECT conv_id, turn, text || ' [' || (turn % 7) || ']' || CASE WHEN conv_id % 2 = 0 THEN ' [2]' ELSE '' END AS x FROM conversations),
 n AS (SELECT conv_id, turn, list_transform(regexp_extract_all(x, '\[(\d+)\]', 1), lambda z: CAST(z AS INT)) AS k FROM c)
 SELECT conv_id, turn, len(k) > 0 AND len([z FOR z IN k IF z < 1 OR z > 5]) = 0 AS valid, array_to_string(list_sort(list_distinct(k)), ',') AS sources FROM n""")
def _(t):
    x = F.concat("text", F.lit(" ["), (F.col("turn") % 7).cast("string"), F.lit("]"), F.when(F.col("conv_id") % 2 == 0, " [2]").otherwise(""))
    return t.conversations.withColumn("x", x).select("conv_id", "turn", X.citations_valid("x", 5).alias("valid"), F.array_join(X.cited_sources("x").cast("array<string>"), ",").alias("sources"))


@query("k12_eval_retrieval", f"""WITH {CENT}, r AS (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY similarity DESC, doc_id) AS rank FROM sim QUALIFY rank <= 10),
 f AS (SELECT qid, min(rank) FILTER (WHERE label = qid) AS r FROM r JOIN embeddings ON vec_id = doc_id GROUP BY 1)
 SELECT 'dense' AS mode, count(*) AS n, avg(CAST(coalesce(r <= 1, false) AS INT)) AS hit_at_1, avg(CAST(coalesce(r <= 3, false) AS INT)) AS hit_at_3, avg(CAST(coalesce(r <= 5, false) AS INT)) AS hit_at_5, avg(coalesce(1 / r, 0)) AS mrr FROM f""",
       "hit_at_1 hit_at_3 hit_at_5 mrr")
def _(t):
    hits = R.dense_top(vectors(t), centroids(t), 10).join(vectors(t).select("doc_id", "source"), "doc_id").withColumn("mode", F.lit("dense"))
    return R.eval_retrieval(hits, centroids(t).select("qid", F.array(F.col("qid").cast("string")).alias("expect")))


@query("k12_eval_three_modes", f"""WITH {HYB}, al AS (SELECT 'dense' AS mode, qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY similarity DESC, doc_id) AS rank FROM rk UNION ALL
  SELECT 'bm25', qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY bm25 DESC, doc_id) FROM rk UNION ALL SELECT 'hybrid', qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY fused DESC, doc_id) FROM hy),
 tp AS (SELECT mode, qid, min(rank) FILTER (WHERE source = 'src' || (qid % 5)) AS r FROM al JOIN documents USING (doc_id) WHERE rank <= 10 GROUP BY 1, 2)
 SELECT mode, count(*) AS n, avg(CAST(coalesce(r <= 1, false) AS INT)) AS hit_at_1, avg(CAST(coalesce(r <= 3, false) AS INT)) AS hit_at_3, avg(CAST(coalesce(r <= 5, false) AS INT)) AS hit_at_5, avg(coalesce(1 / r, 0)) AS mrr FROM tp GROUP BY 1""",
       "hit_at_1 hit_at_3 hit_at_5 mrr")
def _(t):
    d, q = letter_docs(t), letter_queries(t)
    hits = None
    for mode in ("dense", "bm25", "hybrid"):
        one = R.search(d, q, 10, mode).select("qid", "rank", "doc_id", F.lit(mode).alias("mode"))
        hits = one if hits is None else hits.unionByName(one)
    expect = q.select("qid", F.array(F.concat(F.lit("src"), (F.col("qid") % 5).cast("string"))).alias("expect"))
    return R.eval_retrieval(hits.join(t.documents.select("doc_id", "source"), "doc_id"), expect)


@query("k13_guardrails", f"""WITH {HYB}, b AS (SELECT qid, max(similarity) AS best FROM rk GROUP BY 1), u AS (SELECT qid, CASE WHEN qid % 2 = 0 THEN 'in scope' ELSE 'general' END AS kind, regexp_matches(text, '{ADVICE_SQL}') AS advice, best, best < 0.96 AS nf
  FROM b JOIN benchmark ON qid = item_id) SELECT kind, count(*) AS n, avg(CAST(advice AS INT)) AS advice_rate, avg(CAST(nf AS INT)) AS refused_rate, min(best) AS min_best, avg(best) AS mean_best, max(best) AS max_best FROM u GROUP BY 1""",
       "advice_rate refused_rate min_best mean_best max_best")
def _(t):
    q = letter_queries(t)
    gate = R.not_found(R.dense_top(letter_docs(t), q, 1), 0.96)
    kind = F.when(F.col("qid") % 2 == 0, "in scope").otherwise("general")
    return R.eval_guardrails(q.join(gate, "qid").select(kind.alias("kind"), X.is_advice("text").alias("advice"), "not_found", "best"))


@query("k14_evidence", None)
def _(t):
    hits = R.search(letter_docs(t), letter_queries(t), 8, "hybrid").join(t.documents.select("doc_id", F.col("text")), "doc_id")
    h = hits.select(F.col("qid").alias("factor"), "rank", "similarity", X.normalise("text").alias("text"), F.lit("the|th").alias("must"))
    return R.evidence(h).select("factor", "rank", "quote")


@query("k15_risk_report", None)
def _(t):
    scored = t.predictions().select("row_id", "p", F.when(F.col("segment") == "BUILDING", "segment").alias("missing"))
    c = contributions(t).withColumn("value", F.round(F.col("contribution") * 10, 2))
    checks = scored.select("row_id", F.when(F.col("p") > 0.9, F.array(F.struct(F.lit("check").alias("level"), F.lit("The risk is unusually high.").alias("message")))).alias("checks"))
    return R.risk_report(scored, c, "row_id", checks)


@query("k16_embed_text", None)
def _(t):
    docs, model = R.embed(spread(t.documents).select("doc_id", "text"))
    q, _ = R.embed(questions(t), model=model)
    return R.dense_top(docs.select("doc_id", "vector"), q.select("qid", "vector"), 5)


# ---- streams ----------------------------------------------------------------------------------

@query("l1_profile_stream", """SELECT 'event_type' AS variable, count(*) AS n_rows, CAST(0 AS BIGINT) AS n_blank, count(*) FILTER (WHERE event_type = 'error') AS n_coded FROM events
 UNION ALL SELECT 'value', count(*), 0, 0 FROM events UNION ALL SELECT 'k', count(*), 0, count(*) FILTER (WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) = 0) FROM events""")
def _(t):
    e = t.entries().select("event_type", "value", "k")
    path = scratch_path(t.spark, "events-in")
    e.repartition(4).write.parquet(path)
    arriving = t.spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 2).parquet(path)
    merged = S.profile_stream(arriving, scratch_path(t.spark, "profile-out"), ["error", "0"], ["event_type"])
    return merged()[0]


L2_SQL = f"""WITH {SPARSE}, y AS (SELECT *, date_diff('day', min(visit_date) OVER (PARTITION BY entity_id), visit_date) / 365.25::DOUBLE AS years, CASE WHEN score IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END AS k FROM sp),
 s AS (SELECT *, row_number() OVER w AS visit_no, max(CASE WHEN score IS NOT NULL THEN CAST(score > 30 AS BIGINT) END) OVER w AS ever_high, last_value(score IGNORE NULLS) OVER w AS carried,
 last_value(score IGNORE NULLS) OVER (PARTITION BY entity_id ORDER BY visit_date, visit_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior, sum(k) OVER w AS n, sum(k * years) OVER w AS sx,
 sum(score) OVER w AS sy, sum(k * years * years) OVER w AS sxx, sum(years * score) OVER w AS sxy FROM y WINDOW w AS (PARTITION BY entity_id ORDER BY visit_date, visit_id ROWS UNBOUNDED PRECEDING))
 SELECT entity_id, visit_date, visit_id, visit_no, years, ever_high, carried, score - prior AS delta_score,
 CASE WHEN score IS NOT NULL AND n >= 2 AND n * sxx - sx * sx > 1e-9 THEN greatest(least((n * sxy - sx * sy) / (n * sxx - sx * sx), 10), -10) END AS slope_score, false AS late FROM s"""


@query("l2_features_stream", L2_SQL, "years carried delta_score slope_score")
def _(t):
    """Visits arrive year by year; each run of the stream takes up where the last one ended."""
    v = t.sparse().select("entity_id", "visit_date", "visit_id", "score")
    path, out, offsets = (scratch_path(t.spark, f"features-{x}") for x in ("in", "out", "offsets"))
    first, last = v.agg(F.year(F.min("visit_date")), F.year(F.max("visit_date"))).first()
    for year in range(first, last + 1):
        v.where(F.year("visit_date") == year).write.mode("append").parquet(path)
        arriving = t.spark.readStream.schema(v.schema).parquet(path)
        S.run_available(S.features_stream(arriving).writeStream.format("parquet").option("path", out).outputMode("append"), "features", t.spark, offsets)
    return t.spark.read.parquet(out)


@query("l3_score_stream", """SELECT event_type, count(*) AS n, count(*) FILTER (WHERE value > lim) AS n_check, count(*) FILTER (WHERE k < 20) AS n_note
 FROM (SELECT event_type, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, avg(value) OVER (PARTITION BY event_type) * 3 AS lim FROM events) GROUP BY 1""")
def _(t):
    e = t.entries().drop("ts")
    path, out = scratch_path(t.spark, "entries-in"), scratch_path(t.spark, "scored-out")
    e.repartition(3).write.parquet(path)
    limits = e.groupBy("event_type").agg((F.avg("value") * 3).alias("lim"))
    rules = [("check", F.col("value") > F.col("lim"), F.lit("value above its limit")), ("note", F.col("k") < 20, F.lit("small k"))]
    arriving = t.spark.readStream.schema(e.schema).parquet(path)
    S.run_available(S.score_stream(arriving, limits, "event_type", rules).writeStream.format("parquet").option("path", out), "scored", t.spark)
    level = lambda s: F.count_if(F.exists("checks", lambda c: c["level"] == s))
    return t.spark.read.parquet(out).groupBy("event_type").agg(F.count("*").alias("n"), level("check").alias("n_check"), level("note").alias("n_note"))
