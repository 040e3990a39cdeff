import numpy as np
from pyspark.sql import functions as F

from visitframe.operators import boosting, forest
from visitframe.operators.models import fit_forest


def table(spark, n=3000):
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=n), rng.integers(0, 6, n)
    y = (a + (b == 2) + rng.normal(size=n) > 0.5).astype(int)
    split = np.where(np.arange(n) % 4 == 0, "test", "train")
    rows = [(i, float(a[i]), None if i % 17 == 0 else float(b[i]), int(y[i]), str(split[i])) for i in range(n)]
    return spark.createDataFrame(rows, "entity_id long, a double, b double, y int, split string")


def trees_of(f):
    return {r["tree"]: [bytes(r[name]) for name in forest.ARRAYS] for r in f.table.collect()}


def test_trees_do_not_depend_on_where_nodes_are_split(spark, monkeypatch):
    df = table(spark).fillna(0.0, ["b"]).withColumn("c", F.col("a") * F.col("b"))
    make = lambda: forest.Forest(df, ["a", "b", "c"], "y", trees=6, leaf=5, depth=12)
    whole = trees_of(make())
    monkeypatch.setattr(forest, "LOCAL_ROWS", 300)
    monkeypatch.setattr(forest, "OPEN", 5)
    f = make()
    parts = trees_of(f)
    for t, cells in whole.items():
        x, y = forest.Nodes.unpacked(cells), forest.Nodes.unpacked(parts[t])
        assert len(x.feature) == len(y.feature) > 20 and x.n[0] == y.n[0]
        bins = np.random.default_rng(t).integers(1, 32, (3, 500)).astype(np.uint8)
        a, b = x.place(bins), y.place(bins)
        assert (x.pos[a] == y.pos[b]).all() and (x.n[a] == y.n[b]).all()


def test_every_leaf_holds_its_rows_and_the_score_is_their_share(spark):
    df = table(spark, 800).fillna(0.0, ["b"])
    f = forest.Forest(df, ["a", "b"], "y", trees=4, leaf=7, depth=9)
    rows = df.orderBy("entity_id").collect()
    bins = np.stack([boosting.to_bins(np.array([r[c] for r in rows]), e) for c, e in zip(["a", "b"], f.edges)])
    want = np.zeros(len(rows))
    for cells in trees_of(f).values():
        nodes = forest.Nodes.unpacked(cells)
        leaf = nodes.feature < 0
        assert nodes.n[leaf].min() >= 7 and nodes.n[leaf].sum() == nodes.n[0] and nodes.level.max() <= 9
        inner = np.flatnonzero(~leaf)
        yes, at = nodes.pos > nodes.n - nodes.pos, nodes.child[inner]
        assert not (leaf[at] & leaf[at + 1] & (yes[at] == yes[at + 1])).any()
        for k, r in enumerate(bins.T):  # row by row
            i = 0
            while nodes.feature[i] >= 0:
                i = nodes.child[i] + int(r[nodes.feature[i]] > nodes.cut[i])
            want[k] += nodes.pos[i] / nodes.n[i] / 4
    got = {r["entity_id"]: r["p"] for r in f.score(df).collect()}
    assert len(got) == 800 and max(abs(got[r["entity_id"]] - w) for r, w in zip(rows, want)) < 1e-9


def test_first_split_is_the_best_of_all(spark):
    bins = np.random.default_rng(1).integers(1, 9, (2, 200)).astype(np.uint8)
    y, w = (bins[0] > 5).astype(float), np.random.default_rng(2).integers(0, 3, 200).astype(float)
    out = forest.grow(bins, y, w, 0, 1, forest.Growth(leaf=3, take=2, width=9))
    assert out.feature[0] == 0 and out.cut[0] == 5 and list(out.feature[1:]) == [-1, -1]
    assert list(out.n) == [w.sum(), w[y == 0].sum(), w[y == 1].sum()] and out.pos[1] == 0 and out.pos[2] == out.n[2]


def test_close_to_the_forest_of_spark(spark):
    from pyspark.ml.classification import RandomForestClassifier

    from visitframe.operators.models import Design, _auc, _positive

    df = table(spark).cache()
    held = df.where("split = 'test'")
    ours = _auc(fit_forest(df, ["a", "b"], trees=40, depth=10)(held))
    design = Design(df, ["a", "b"])
    m = RandomForestClassifier(featuresCol="x", labelCol="y", numTrees=40, minInstancesPerNode=10, featureSubsetStrategy="sqrt", maxDepth=10, seed=0).fit(design(df.where("split = 'train'")))
    assert abs(ours - _auc(_positive(m.transform(design(held))))) < 0.02
