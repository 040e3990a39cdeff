"""Files not written by Spark, query blocks, the hot-entity path and row keys of the ablation."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from visitframe.operators import models, retrieval
from visitframe.scaling import Run, Timeline
from visitframe.sources import inventory, io


def test_csv_with_doubled_quotes_and_line_breaks(spark, tmp_path):
    path = tmp_path / "raw.csv"
    path.write_text('a,b\n"say ""hi"", now",1\n"two\nlines",\n x ,"2"\n', encoding="utf-8")
    rows = [tuple(r) for r in io.read_raw_csv(spark, str(path)).collect()]
    assert rows == [('say "hi", now', "1"), ("two\nlines", None), (" x ", "2")]
    assert io.read_raw_csv(spark, str(path), line_breaks=False).count() == 4


@pytest.mark.parametrize("text", ['{"a": 1, "b": ["x", "y"]}\n{"a": 2, "b": []}\n', json.dumps([{"a": 1, "b": ["x", "y"]}, {"a": 2, "b": []}], indent=2)])
def test_json_lines_and_documents(spark, tmp_path, text):
    path = tmp_path / "p.json"
    path.write_text(text)
    assert [(r["a"], r["b"]) for r in io.read_params(spark, str(path)).orderBy("a").collect()] == [(1, ["x", "y"]), (2, [])]


def test_indented_object(spark, tmp_path):
    path = tmp_path / "one.json"
    path.write_text(json.dumps({"q": "why", "n": {"deep": 3}}, indent=1))
    row = io.read_params(spark, str(path)).collect()
    assert len(row) == 1 and row[0]["n"]["deep"] == 3


@pytest.fixture
def library(spark):
    rng = np.random.default_rng(3)
    words = ["alpha", "beta", "gamma", "delta", "omega", "sigma"]
    docs = [(i, " ".join(rng.choice(words, 6)), rng.normal(size=4).round(3).tolist()) for i in range(60)]
    queries = [(i, " ".join(rng.choice(words, 2)), rng.normal(size=4).round(3).tolist()) for i in range(23)]
    schema = "text string, vector array<double>"
    return spark.createDataFrame(docs, f"doc_id long, {schema}"), spark.createDataFrame(queries, f"qid long, {schema}")


@pytest.mark.parametrize("mode", ["dense", "hybrid"])
def test_blocks_of_queries_change_no_result(library, monkeypatch, mode):
    docs, queries = library
    key = ["qid", "rank", "doc_id", "score"]
    whole = sorted(map(tuple, retrieval.search(docs, queries, 3, mode).select(*key).collect()))
    monkeypatch.setattr(retrieval, "MAX_QUERIES", 20)
    assert sorted(map(tuple, retrieval.search(docs, queries, 3, mode).select(*key).collect())) == whole and len(whole) == 69


def test_many_queries_are_accepted(spark, library):
    docs, _ = library
    many = spark.range(2_500).select(F.col("id").alias("qid"), F.array(*[F.rand(i) for i in range(4)]).alias("vector"))
    assert retrieval.dense_top(docs, many, 2).count() == 5_000


def test_calls_of_the_hot_path_do_not_read_the_source_again(spark, tmp_path):
    src = str(tmp_path / "visits")
    rows = [(1 if i % 2 else i, f"2020-01-{1 + i % 28:02d}", i, float(i % 7)) for i in range(400)]
    spark.createDataFrame(rows, "entity_id long, d string, visit_id long, v double").withColumn("visit_date", F.to_date("d")).drop("d").write.parquet(src)
    df = spark.read.parquet(src)
    tl, plain = Timeline(df, hot=[1]), Timeline(df, hot=[])
    for i in range(4):
        tl, plain = (t.runs(**{f"s{i}": Run("sum", F.col("v")), f"l{i}": Run("last", F.col("v"), "before")}) for t in (tl, plain))
    assert src not in tl.df._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, tl.df.select(*sorted(tl.df.columns)).collect()), key=str) == sorted(map(tuple, plain.df.select(*sorted(plain.df.columns)).collect()), key=str)


def test_ablation_keeps_rows_of_one_entity_apart_and_null_levels(spark):
    rows = [(e, 10 * e + k, "test" if e > 4 else "train", int(k == 1), float(k) + e / 100, "a" if e % 2 else None) for e in range(10) for k in range(2)]
    df = spark.createDataFrame(rows, "entity_id long, row_id long, split string, y int, x double, grp string")

    def fit(d, feats, seed=0):
        assert d.count() > 0
        return lambda rows_: rows_.withColumn("p", F.col(feats[0]))

    out = models.ablate(df, {"all": ["x"]}, fit, key="row_id").collect()
    assert [(r["n"], r["auroc"], r["delta_from_all"]) for r in out] == [(10, 1.0, 0.0)]
    groups = models.by_group(df, {"all": ["x"]}, fit, "grp", key="row_id").collect()
    assert {(r["grp"], r["trained_on"]) for r in groups} == {(g, t) for g in ("a", None) for t in ("all", "own group")} and all(r["delta_from_all"] == 0 for r in groups)


def test_paired_intervals_of_an_ablation(spark):
    rng = np.random.default_rng(1)
    rows = [(i, "test" if i % 2 else "train", int(rng.random() < 0.4)) for i in range(600)]
    rows = [(i, s, y, float(y + rng.normal()), float(y * 0.2 + rng.normal())) for i, s, y in rows]
    df = spark.createDataFrame(rows, "entity_id long, split string, y int, good double, weak double")

    def fit(d, feats, seed=0):
        return lambda rows_: rows_.withColumn("p", 1 / (1 + F.exp(-F.coalesce(F.col(feats[-1]), F.lit(0.0)))))

    out = {r["features"]: r for r in models.ablate(df, {"all": ["good"], "less": ["weak"]}, fit, draws=200).collect()}
    assert (out["all"]["delta_auroc_lo"], out["all"]["delta_auroc_hi"]) == (0.0, 0.0)
    assert out["less"]["delta_auroc_lo"] < out["less"]["delta_from_all"] < out["less"]["delta_auroc_hi"] < 0
    groups = models.compare_patterns(df, {"g": ["weak"]}, {"both": ["g"], "none": []}, ["good"], fit, draws=50).collect()
    assert len(groups) == 6 and all(r["delta_auroc_lo"] <= r["delta_auroc_hi"] for r in groups)


def test_rollup_tells_nested_folders_of_one_name_apart(spark, tmp_path):
    for name in ("a/x/1.csv", "a/x/2.csv", "a/3.txt", "b/x/4.csv", "b/x.zip", "5"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("12345")
    rows = {r["folder"]: tuple(r)[1:] for r in inventory.folder_rollup(inventory.list_files(spark, str(tmp_path)), str(tmp_path)).collect()}
    assert rows == {"": (0, 6, 1, 2, 30, ".csv", False), "a": (1, 3, 1, 1, 15, ".csv", False), "a/x": (2, 2, 2, 0, 10, ".csv", False),
                    "b": (1, 2, 1, 1, 10, ".zip", False), "b/x": (2, 1, 1, 0, 5, ".csv", True)}
