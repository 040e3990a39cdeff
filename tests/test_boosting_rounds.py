import numpy as np

from visitframe.operators.boosting import Tree, _together


def test_rows_are_placed_level_by_level(spark):
    rng = np.random.default_rng(5)
    tree = Tree(4)
    for node in range(15):
        if node == 0 or (tree.feature[(node - 1) // 2] >= 0 and rng.random() < 0.7):
            tree.feature[node], tree.cut[node], tree.missing_left[node] = rng.integers(3), rng.integers(1, 9), rng.random() < 0.5
    bins = rng.integers(0, 10, (3, 400)).astype(np.uint8)
    for levels in range(5):
        want = []
        for row in bins.T:
            node = 0
            for _ in range(levels):
                if tree.feature[node] >= 0:
                    b = row[tree.feature[node]]
                    node = 2 * node + (1 if (tree.missing_left[node] if b == 0 else b <= tree.cut[node]) else 2)
            want.append(node)
        assert tree.place(bins, levels).tolist() == want
    assert tree.place(bins).tolist() == want


def test_sums_go_to_no_more_tasks_than_keys(spark):
    pairs = spark.sparkContext.parallelize([(i % 3, 1) for i in range(60)], 12)
    together = _together(pairs, 3)
    assert together.getNumPartitions() == 3 and dict(together.collect()) == {0: 20, 1: 20, 2: 20}
