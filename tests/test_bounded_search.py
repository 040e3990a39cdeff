"""Keyword scores in parts of bounded size; dense lists and ranks with ties."""

import numpy as np
from visitframe.operators import retrieval as R


def test_bm25_parts_grow_with_the_passages(spark, monkeypatch):
    monkeypatch.setattr(R, "COUNTED_DOCS", 2)
    monkeypatch.setattr(R, "SCORED_PAIRS", 3)
    docs = spark.createDataFrame([(i, f"apple pear {'plum ' * (i % 4)}") for i in range(40)] + [(3, "apple apple pear")], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "apple plum"), (2, "pear")], "qid long, text string")
    scores = R.bm25(docs, queries)
    assert scores.rdd.getNumPartitions() > 20
    assert "Exchange hashpartitioning(qid" not in scores._jdf.queryExecution().executedPlan().toString()
    got = {(r["qid"], r["doc_id"]) for r in scores.collect()}
    assert got == {(q, i) for q in (1, 2) for i in range(40)}


def test_dense_lists_and_ranks_with_ties(spark, monkeypatch):
    monkeypatch.setattr(R, "SCORED_ROWS", 3)
    rng = np.random.default_rng(4)
    vec = {i: [float(x) for x in rng.integers(0, 3, 4)] for i in range(60)}
    docs = spark.createDataFrame(list(vec.items()), "doc_id long, vector array<double>").repartition(3)
    q = {1: [1.0, 0.0, 2.0, 0.0], 2: [0.0, 1.0, 0.0, 1.0]}
    queries = spark.createDataFrame(list(q.items()), "qid long, vector array<double>")
    order = {j: sorted(vec, key=lambda i: (-float(np.dot(vec[i], v)), i)) for j, v in q.items()}
    cand = spark.createDataFrame([(j, i) for j in q for i in vec], "qid long, doc_id long")
    ranks = {(r["qid"], r["doc_id"]): r["dense_rank"] for r in R.dense_ranks(docs, queries, cand).collect()}
    assert ranks == {(j, i): n for j in q for n, i in enumerate(order[j])}
    top = R.dense_top(docs, queries, 9).orderBy("qid", "rank").collect()
    assert [(r["qid"], r["doc_id"]) for r in top] == [(j, i) for j in q for i in order[j][:9]]
