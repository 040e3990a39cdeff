"""Passage retrieval for a batch of queries: BM25, dense scores, rank fusion, guardrails and evaluation.

`docs` has an integer id and text; `queries` has `qid` and text. The query
batch is small and checked; passages are unbounded. Dense scores are computed
batch by batch inside tasks, which keep only the best per query, so all pairs
never exist as rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitframe.functions.rules import describe_item, first_sentences, percent_text
from visitframe.functions.text import MIN_SIMILARITY, SCORE_DIGITS, dot, paragraph_array, passage_array, sentences, tokens, words
from visitframe.operators.ranking import top_signed
from visitframe.scaling import broadcast_if_small, top_k
from visitframe.session import stage

K1, B = 1.5, 0.75
FUSION = 60
MAX_QUERIES = 1_000
#: passages whose words one task counts, pairs of query and passage that it scores, and passages scored at once against all queries
COUNTED_DOCS, SCORED_PAIRS, SCORED_ROWS = 5_000, 500_000, 256


def paragraphs(docs: DataFrame, text: str, heading: Column, keys: Sequence[str]) -> DataFrame:
    return docs.select(*keys, F.posexplode(paragraph_array(text, heading)).alias("para_no", "p")).select(*keys, "para_no", F.col("p.heading").alias("section"), F.col("p.text").alias("text"))


def passages(docs: DataFrame, text: str, heading: Column, keys: Sequence[str], size: int = 180) -> DataFrame:
    """Passages of each document, in order; packed inside the row, without a shuffle."""
    packed = docs.select(*keys, F.posexplode(passage_array(paragraph_array(text, heading), size)).alias("passage_no", "p"))
    return packed.select(*keys, "passage_no", F.col("p.heading").alias("section"), F.col("p.text").alias("text"))


# ---- keyword index ----------------------------------------------------------------------

def bm25_index(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, term, tf, length). Counts combine inside the task that reads the document."""
    t = docs.select(doc, tokens(text).alias("tk")).select(doc, F.size("tk").alias("length"), F.explode("tk").alias("term"))
    return t.groupBy(doc, "term", "length").agg(F.count("*").alias("tf"))


def query_terms(queries: DataFrame, text: str = "text") -> DataFrame:
    """(qid, term, weight): repeated query words count each time."""
    return queries.select("qid", F.explode(tokens(text)).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("weight"))


def bm25(docs: DataFrame, queries: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(qid, doc, bm25) for every passage sharing a word with the query.

    The text is read and tokenised once. Words outside the query batch are
    dropped before the counting shuffle; an empty word marks each passage, so
    the number of passages and their mean length come from the same postings.
    Words and scores are summed by passage in parts of bounded size, so a task's table of groups does not grow with the input.
    """
    cores = docs.sparkSession.sparkContext.defaultParallelism
    q = stage(query_terms(queries), "query-terms")
    mark = docs.sparkSession.range(1).select(F.lit("").alias("term"))
    sized = docs.select(doc, tokens(text).alias("tk")).withColumn("length", F.size("tk"))
    tf = (sized.select(doc, "length", F.explode(F.concat("tk", F.array(F.lit("")))).alias("term"))
          .join(broadcast_if_small(q.select("term").distinct().unionByName(mark)), "term", "left_semi")
          .repartition(max(cores, -(-docs.count() // COUNTED_DOCS)), doc).groupBy(doc, "term", "length").agg(F.count("*").alias("tf")))
    tf = stage(tf, "postings")
    stats = tf.where("term = ''").agg(F.struct(F.count("*").alias("n"), F.avg("length").alias("avg_len"))).scalar()
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    terms = q.join(df, "term").withColumn("s", stats)
    idf = F.ln(F.lit(1.0) + (F.col("s.n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    terms = terms.select("qid", "term", (F.col("weight") * idf).alias("w"), F.col("s.avg_len").alias("avg_len"))
    score = F.col("w") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("avg_len")))
    pairs = q.join(df, "term").agg(F.sum("df")).first()[0] or 0
    # with the short side broadcast, a word found in most passages does not gather in one task
    return tf.repartition(max(cores, -(-pairs // SCORED_PAIRS)), doc).join(broadcast_if_small(terms), "term").groupBy("qid", doc).agg(F.round(F.sum(score), SCORE_DIGITS).alias("bm25"))


# ---- dense scores --------------------------------------------------------------------------

def query_blocks(queries: DataFrame) -> list[DataFrame]:
    """The queries in blocks that the driver and each task can hold, each run by itself; about half full on average."""
    n = queries.count()
    if n <= MAX_QUERIES:
        return [queries]
    k = -(-2 * n // MAX_QUERIES)
    dealt = stage(queries.withColumn("__block", F.pmod(F.xxhash64("qid"), F.lit(k))), "query-blocks")
    return [dealt.where(F.col("__block") == i).drop("__block") for i in range(k)]


def query_matrix(queries: DataFrame, vector: str) -> tuple[list, np.ndarray]:
    """One block of queries on the driver, refused beyond its bound."""
    rows = queries.select("qid", vector).orderBy("qid").limit(MAX_QUERIES + 1).collect()
    if len(rows) > MAX_QUERIES:
        raise ValueError(f"more than {MAX_QUERIES} queries in one batch")
    return [r[0] for r in rows], np.array([r[1] for r in rows], dtype=np.float64)


def _scores(pdf: pd.DataFrame, vector: str, q: np.ndarray) -> np.ndarray:
    # summed column by column, in the order a row expression would use; a few rows at a time stay in the cache
    d = np.stack(pdf[vector].to_numpy()).astype(np.float64)
    out, by_column = np.zeros((len(d), len(q))), np.ascontiguousarray(q.T)
    for lo in range(0, len(d), SCORED_ROWS):
        part, sums = d[lo:lo + SCORED_ROWS], out[lo:lo + SCORED_ROWS]
        for j in range(d.shape[1]):
            sums += part[:, j:j + 1] * by_column[j]
        np.round(sums, SCORE_DIGITS, out=sums)
    return out


def dense_top(docs: DataFrame, queries: DataFrame, k: int, doc: str = "doc_id", vector: str = "vector") -> DataFrame:
    """(qid, doc, similarity, rank): the k most similar passages per query, exact.

    A task scores its passages against a block of queries and passes on the best
    k per query once, at its end; the final ranking sees only those.
    """
    return reduce(DataFrame.unionByName, [_dense_top(docs, block, k, doc, vector) for block in query_blocks(queries)])


def _dense_top(docs: DataFrame, queries: DataFrame, k: int, doc: str, vector: str) -> DataFrame:
    ids, q = query_matrix(queries, vector)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: list = [None] * len(ids)
        for pdf in batches:
            if not len(pdf):
                continue
            s, d = np.ascontiguousarray(_scores(pdf, vector, q).T), pdf[doc].to_numpy()
            for j in range(len(ids)):
                old_s, old_d = kept[j] or (s[j, :0], d[:0])
                # only rows that reach the k-th best so far, or the k-th best of the batch, are sorted; missing scores come last
                least = old_s[-1] if len(old_s) == k else -np.partition(-s[j], k - 1)[k - 1] if len(d) > k else np.nan
                near = slice(None) if np.isnan(least) else np.flatnonzero(s[j] >= least)
                both_s, both_d = np.concatenate([old_s, s[j, near]]), np.concatenate([old_d, d[near]])
                best = np.lexsort((both_d, -both_s))[:k]
                kept[j] = (both_s[best], both_d[best])
        for qid, best in zip(ids, kept):
            if best is not None:
                yield pd.DataFrame({"qid": qid, doc: best[1], "similarity": best[0]})

    dtype = docs.schema[doc].dataType.simpleString()
    qtype = queries.schema["qid"].dataType.simpleString()
    best = docs.select(doc, vector).mapInPandas(score, f"qid {qtype}, {doc} {dtype}, similarity double")
    return top_k(best, ["qid"], [F.col("similarity").desc(), F.col(doc)], k)


def dense_ranks(docs: DataFrame, queries: DataFrame, cand: DataFrame, doc: str = "doc_id", vector: str = "vector") -> DataFrame:
    """(qid, doc, similarity, dense_rank): exact 0-based rank among all passages for a short list of candidates.

    A second pass counts, per batch, the passages ahead of each candidate.
    """
    ids, q = query_matrix(queries, vector)
    at = {i: j for j, i in enumerate(ids)}

    def pair(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            s = np.zeros(len(pdf))
            if len(pdf):
                d, m = np.stack(pdf[vector].to_numpy()).astype(np.float64), q[pdf["qid"].map(at).to_numpy()]
                for j in range(d.shape[1]):
                    s += d[:, j] * m[:, j]
            yield pd.DataFrame({"qid": pdf["qid"], doc: pdf[doc], "similarity": np.round(s, SCORE_DIGITS)})

    dtype, qtype = docs.schema[doc].dataType.simpleString(), queries.schema["qid"].dataType.simpleString()
    own = cand.select("qid", doc).distinct().join(docs.select(doc, vector), doc).select("qid", doc, vector)
    wanted = own.mapInPandas(pair, f"qid {qtype}, {doc} {dtype}, similarity double")
    rows = wanted.collect()     # at most two short lists per query of a bounded batch
    by_q: dict = {i: ([], []) for i in ids}
    for r in rows:
        by_q[r["qid"]][0].append(r[doc])
        by_q[r["qid"]][1].append(r["similarity"])
    lists = {i: (np.array(a), np.array(b)) for i, (a, b) in by_q.items() if a}

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = {i: np.zeros(len(a), dtype=np.int64) for i, (a, _) in lists.items()}
        for pdf in batches:
            if not len(pdf):
                continue
            s, d = np.ascontiguousarray(_scores(pdf, vector, q).T), pdf[doc].to_numpy()
            for j, i in enumerate(ids):
                if i not in lists:
                    continue
                c_id, c_s = lists[i]
                neg = np.sort(-s[j])
                lo, hi = np.searchsorted(neg, -c_s, "left"), np.searchsorted(neg, -c_s, "right")
                total[i] += lo
                # passages of equal similarity are ordered by id; most batches hold none, and equal candidates share a look
                tied, tied_d = np.flatnonzero(hi > lo), {}
                for c in tied.tolist():
                    value = None if np.isnan(c_s[c]) else float(c_s[c])
                    if value not in tied_d:
                        tied_d[value] = np.sort(d[np.isnan(s[j]) if value is None else s[j] == value])
                    total[i][c] += np.searchsorted(tied_d[value], c_id[c])
        for i, n in total.items():
            yield pd.DataFrame({"qid": i, doc: lists[i][0], "ahead": n})

    ahead = docs.select(doc, vector).mapInPandas(count, f"qid {qtype}, {doc} {dtype}, ahead long")
    ranks = ahead.groupBy("qid", doc).agg(F.sum("ahead").alias("dense_rank"))
    return ranks.join(docs.sparkSession.createDataFrame([tuple(r) for r in rows], wanted.schema), ["qid", doc])


def bm25_ranks(docs: DataFrame, scores: DataFrame, cand: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(qid, doc, bm25, bm25_rank): exact 0-based rank for a short list of candidates.

    Passages without any query word come last, by id. Every count is a sum over
    the passages ahead, found in one pass per table.
    """
    c = cand.select("qid", doc).distinct().join(scores, ["qid", doc], "left").select("qid", doc, F.coalesce("bm25", F.lit(0.0)).alias("bm25"))
    rows = c.collect()
    by_q: dict = {}
    for r in rows:
        by_q.setdefault(r["qid"], []).append((r[doc], r["bm25"]))
    lists = {i: (np.array([x[0] for x in v]), np.array([x[1] for x in v])) for i, v in by_q.items()}
    every = np.unique(np.array([r[doc] for r in rows]))

    def count(batches):
        total = {i: np.zeros(len(a), dtype=np.int64) for i, (a, _) in lists.items()}
        for pdf in batches:
            for i, g in pdf.groupby("qid"):
                if i not in lists:
                    continue
                c_id, c_s = lists[i]
                s, d = g["bm25"].to_numpy(), g[doc].to_numpy()
                order = np.lexsort((d, -s))
                neg, did, ids_sorted = -s[order], d[order], np.sort(d)
                lo, hi = np.searchsorted(neg, -c_s, "left"), np.searchsorted(neg, -c_s, "right")
                tied = np.array([np.searchsorted(did[a:b], x) for a, b, x in zip(lo, hi, c_id)], dtype=np.int64)
                # a candidate without a score follows all scored passages, less those counted again by id
                total[i] += np.where(c_s > 0, lo + tied, len(s) - np.searchsorted(ids_sorted, c_id))
        for i, n in total.items():
            yield pd.DataFrame({"qid": i, doc: lists[i][0], "ahead": n})

    def smaller(batches):
        total = np.zeros(len(every), dtype=np.int64)
        for pdf in batches:
            total += np.searchsorted(np.sort(pdf[doc].to_numpy()), every)
        yield pd.DataFrame({doc: every, "below": total})

    dtype, qtype = docs.schema[doc].dataType.simpleString(), scores.schema["qid"].dataType.simpleString()
    ahead = scores.select("qid", doc, "bm25").mapInPandas(count, f"qid {qtype}, {doc} {dtype}, ahead long").groupBy("qid", doc).agg(F.sum("ahead").alias("ahead"))
    below = docs.select(doc).mapInPandas(smaller, f"{doc} {dtype}, below long").groupBy(doc).agg(F.sum("below").alias("below"))
    known = docs.sparkSession.createDataFrame([tuple(r) for r in rows], c.schema)
    j = known.join(ahead, ["qid", doc], "left").join(below, doc)
    rank = F.coalesce("ahead", F.lit(0)) + F.when(F.col("bm25") > 0, F.lit(0)).otherwise(F.col("below"))
    return j.select("qid", doc, "bm25", rank.alias("bm25_rank"))


def bm25_top(docs: DataFrame, queries: DataFrame, scores: DataFrame, k: int, doc: str = "doc_id") -> DataFrame:
    """The k best passages per query by keyword score; short lists are filled with unscored passages by id."""
    best = top_k(scores, ["qid"], [F.col("bm25").desc(), F.col(doc)], k).drop("rank")
    # the k smallest ids outside the list are enough to fill it, and 2k ids always contain them
    low = [r[0] for r in docs.select(doc).orderBy(doc).limit(2 * k).collect()]
    fill = queries.select("qid", F.explode(F.array(*[F.lit(i) for i in low])).alias(doc))
    fill = fill.join(best.select("qid", doc), ["qid", doc], "left_anti").withColumn("bm25", F.lit(0.0))
    return top_k(best.unionByName(fill.select(*best.columns)), ["qid"], [F.col("bm25").desc(), F.col(doc)], k)


def search(docs: DataFrame, queries: DataFrame, k: int = 5, mode: str = "hybrid", doc: str = "doc_id", vector: str = "vector") -> DataFrame:
    """(qid, rank, doc, score): top-k by dense similarity, keywords, or reciprocal rank fusion.

    Fusion needs ranks among all passages. A passage outside the first 2k + 60 of
    both lists scores below every one of the k best dense passages, so only the
    union of those two short lists can win; their exact ranks are counted. Queries
    are run in blocks, so their number has no limit.
    """
    return reduce(DataFrame.unionByName, [_search(docs, block, k, mode, doc, vector) for block in query_blocks(queries)])


def _search(docs: DataFrame, queries: DataFrame, k: int, mode: str, doc: str, vector: str) -> DataFrame:
    if mode == "dense":
        return dense_top(docs, queries, k, doc, vector).select("qid", "rank", doc, F.col("similarity").alias("score"))
    scores = stage(bm25(docs, queries, doc), "bm25")
    if mode == "bm25":
        return bm25_top(docs, queries, scores, k, doc).select("qid", "rank", doc, F.col("bm25").alias("score"))
    reach = 2 * k + FUSION
    cand = stage(dense_top(docs, queries, reach, doc, vector).select("qid", doc).unionByName(bm25_top(docs, queries, scores, reach, doc).select("qid", doc)).distinct(), "cand")
    r = dense_ranks(docs, queries, cand, doc, vector).join(bm25_ranks(docs, scores, cand, doc), ["qid", doc])
    fused = F.lit(1.0) / (F.col("dense_rank") + FUSION) + F.lit(1.0) / (F.col("bm25_rank") + FUSION)
    return top_k(r.withColumn("score", fused), ["qid"], [F.col("score").desc(), F.col(doc)], k).select("qid", "rank", doc, "score", "similarity", "bm25")


# ---- gates and answers ------------------------------------------------------------------------

def not_found(hits: DataFrame, threshold: float = MIN_SIMILARITY) -> DataFrame:
    """Per query: best similarity and whether the library has no answer."""
    return hits.groupBy("qid").agg(F.max("similarity").alias("best")).withColumn("not_found", F.coalesce(F.col("best") < threshold, F.lit(True)))


def extract(hits: DataFrame, embed, n: int = 4, low: int = 8, high: int = 60) -> DataFrame:
    """Per query the n sentences closest to the question, in text order, each with its source number.

    `hits`: qid, rank, text, question vector `qv`; `embed` turns a text column into a vector column.
    """
    s = hits.select("qid", "rank", "qv", F.posexplode(sentences("text")).alias("pos", "sentence"))
    size = F.size(F.filter(words(F.trim("sentence")), lambda w: w != ""))
    s = s.where(size.between(low, high)).withColumn("similarity", dot(embed("sentence"), F.col("qv")))
    best = top_k(s, ["qid"], [F.col("similarity").desc(), F.col("rank"), F.col("pos")], n, "pick")
    item = F.struct("rank", "pos", F.concat(F.trim("sentence"), F.lit(" ["), F.col("rank").cast("string"), F.lit("]")).alias("t"))
    return best.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["t"]), " ").alias("answer"))


def eval_retrieval(hits: DataFrame, expected: DataFrame, ks: Sequence[int] = (1, 3, 5), by: Sequence[str] = ("mode",)) -> DataFrame:
    """hit@k and mean reciprocal rank from the rank of the first expected source. `expected`: qid, array `expect`; `hits` has `source`."""
    j = hits.join(expected, "qid")
    first = j.groupBy("qid", *by).agg(F.min(F.when(F.array_contains("expect", F.col("source")), F.col("rank"))).alias("r"))
    return first.groupBy(*by).agg(F.count("*").alias("n"), *[F.avg(F.coalesce(F.col("r") <= k, F.lit(False)).cast("int")).alias(f"hit_at_{k}") for k in ks],
                                  F.avg(F.coalesce(1 / F.col("r"), F.lit(0.0))).alias("mrr"))


def eval_guardrails(questions: DataFrame) -> DataFrame:
    """Per kind of question: share flagged as advice, share refused, and the similarity margins. Needs kind, advice, not_found, best."""
    share = lambda c: F.avg(F.col(c).cast("int"))
    return questions.groupBy("kind").agg(F.count("*").alias("n"), share("advice").alias("advice_rate"), share("not_found").alias("refused_rate"),
                                         F.min("best").alias("min_best"), F.avg("best").alias("mean_best"), F.max("best").alias("max_best"))


def evidence(hits: DataFrame, must: str = "must", threshold: float = MIN_SIMILARITY) -> DataFrame:
    """One quote per factor: best passage above the threshold that contains its word, result sentences first.

    `hits`: factor, rank, similarity, text and the pattern the passage must contain.
    """
    ok = hits.where((F.col("similarity") >= threshold) & F.regexp_like(F.lower("text"), F.col(must)))
    best = top_k(ok, ["factor"], [F.col("rank")], 1, "pick").drop("pick")
    parts = F.filter(F.split("text", r"(?<=[.!?])\s+"), lambda s: F.regexp_like(F.lower(s), F.col(must)))
    ordered = F.concat(F.filter(parts, lambda s: s.rlike(r"\d")), F.filter(parts, lambda s: ~s.rlike(r"\d")))
    text = F.when(F.size(ordered) > 0, F.array_join(ordered, " ")).otherwise(F.col("text"))
    return best.withColumn("quote", first_sentences(text))


def risk_report(scored: DataFrame, contrib: DataFrame, row: str, checks: DataFrame | None = None) -> DataFrame:
    """Report columns per scored row: summary, reasons that raised or lowered the risk, reliability notes and limits.

    `scored`: row id, p, missing (text). `contrib`: row id, feature, value, contribution. `checks`: row id, array of (level, message).
    """
    lead = top_signed(contrib.where("value IS NOT NULL"), [row]).withColumn("phrase", describe_item("feature", "value"))
    phrases = lambda sign: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("sign") == sign, F.struct("rank", "phrase")))), lambda x: x["phrase"]), "; ")
    why = lead.groupBy(row).agg(phrases(1).alias("up"), phrases(-1).alias("down"))
    r = scored.join(why, row, "left")
    said = lambda c, before: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(before), F.col(c), F.lit(".")))
    r = r.withColumns({
        "summary": F.concat(F.lit("Estimated risk: "), percent_text("p"), F.lit(".")),
        "reasons": F.concat_ws(" ", said("up", "Raised by "), said("down", "Lowered by ")),
        "limits": F.lit("A research estimate; the listed factors describe what the model used, not causes.")})
    notes = said("missing", "Not available: ")
    if checks is not None:
        r = r.join(checks.select(row, "checks"), row, "left")
        notes = F.concat_ws(" ", notes, F.array_join(F.transform("checks", lambda c: F.concat(
            F.when(c["level"] == "check", "Check the entries: ").otherwise("Note: "), c["message"])), " "))
    notes = F.coalesce(notes, F.lit(""))
    return r.withColumn("reliability", F.when(notes == "", "All entries are within the usual ranges.").otherwise(notes)).drop("up", "down", "checks")


def embed(docs: DataFrame, text: str = "text", dims: int = 256, out: str = "vector", model=None):
    """Hashed, idf-weighted, unit-length vectors; returns (table, fitted weights) so queries use the same weights."""
    from pyspark.ml.feature import IDF, HashingTF, Normalizer
    from pyspark.ml.functions import vector_to_array
    tf = HashingTF(numFeatures=dims, inputCol="__tk", outputCol="__tf").transform(docs.withColumn("__tk", tokens(text)))
    model = IDF(inputCol="__tf", outputCol="__idf").fit(tf) if model is None else model
    v = Normalizer(inputCol="__idf", outputCol="__v").transform(model.transform(tf))
    return v.withColumn(out, vector_to_array("__v")).drop("__tk", "__tf", "__idf", "__v"), model
