"""Random forest over packed rows.

Features are cut into at most `BINS` bins and the rows are packed as for boosting. A tree draws the weight of a row
(Poisson with mean 1) by a hash of tree and row number, a node its features by a hash of tree and node, and all sums are
whole numbers. So for the blocks as packed a tree depends neither on tasks nor on where its nodes are split.

A node with more than `LOCAL_ROWS` rows is split by sums over all blocks, at most `OPEN` nodes a job. The rows of a
smaller one are sent to one task, which grows the rest of that branch. A row moves once per tree, as one byte per feature,
and the driver holds the large nodes only. Trees are rows of a table; scoring pairs blocks of rows with trees.

Splits lessen the Gini impurity most, a side needs `leaf` draws, and two leaves of one parent that predict the same
class are merged, as Spark ML does.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitframe.operators.boosting import BLOCK_ROWS, _draw, _together, cut_points, pack_blocks, to_bins
from visitframe.session import stage

BINS = 32
LOCAL_ROWS = 1 << 18
OPEN = 4096
#: leaf probabilities are whole steps, so sums over trees do not depend on their order
STEPS = 1 << 40
#: chances that a row is drawn at most 0, 1, 2, ... times
DRAWN = np.cumsum(np.exp(-1.0) / np.cumprod([1.0, *range(1, 17)]))
ARRAYS = {"feature": np.int16, "cut": np.int16, "child": np.int32, "level": np.int16, "n": np.float64, "pos": np.float64}


@dataclass(frozen=True)
class Growth:
    trees: int = 500
    leaf: int = 10
    depth: int = 30
    take: int = 1      # features a node may choose from
    width: int = 33    # bins of a feature, the missing one included
    seed: int = 0


class Nodes:
    """A tree or a branch in order of growth; the children of a node are `child` and `child` + 1, a leaf has feature -1."""

    def __init__(self, **arrays: np.ndarray):
        for name, kind in ARRAYS.items():
            setattr(self, name, np.asarray(arrays.get(name, []), kind))

    @classmethod
    def root(cls, level: int, n: float, pos: float) -> Nodes:
        return cls(feature=[-1], cut=[0], child=[0], level=[level], n=[n], pos=[pos])

    def split(self, at: np.ndarray, feature: np.ndarray, cut: np.ndarray, sides: np.ndarray) -> np.ndarray:
        """Split nodes `at`; `sides` (nodes x 2 x (n, pos)) are the children's sums. Returns the first children."""
        first = len(self.feature) + 2 * np.arange(len(at), dtype=np.int32)
        self.feature[at], self.cut[at], self.child[at] = feature, cut, first
        k = 2 * len(at)
        new = {"feature": np.full(k, -1), "cut": np.zeros(k), "child": np.zeros(k), "level": np.repeat(self.level[at] + 1, 2), "n": sides[:, :, 0].ravel(), "pos": sides[:, :, 1].ravel()}
        for name, kind in ARRAYS.items():
            setattr(self, name, np.concatenate([getattr(self, name), new[name].astype(kind)]))
        return first

    def place(self, bins: np.ndarray) -> np.ndarray:
        """Leaf of each row (column of `bins`)."""
        node = np.zeros(bins.shape[1], np.int32)
        rows = np.arange(bins.shape[1]) if self.feature[0] >= 0 else np.zeros(0, np.int64)
        while len(rows):
            at = node[rows]
            at = self.child[at] + (bins[self.feature[at], rows] > self.cut[at])
            node[rows] = at
            rows = rows[self.feature[at] >= 0]
        return node

    def graft(self, at: int, branch: Nodes) -> None:
        """Put a branch in place of leaf `at`."""
        shift = len(self.feature) - 1  # the branch's root takes the leaf's place
        for name in ARRAYS:
            new = getattr(branch, name).copy()
            if name == "child":
                new += shift
            own = getattr(self, name)
            own[at] = new[0]
            setattr(self, name, np.concatenate([own, new[1:]]))

    def merged(self) -> Nodes:
        """Without splits whose two leaves predict the same class."""
        yes = self.pos > self.n - self.pos
        inner = np.flatnonzero(self.feature >= 0)
        for level in range(int(self.level.max()), -1, -1):
            at = inner[self.level[inner] == level]
            a = self.child[at]
            same = (self.feature[a] < 0) & (self.feature[a + 1] < 0) & (yes[a] == yes[a + 1])
            self.feature[at[same]] = -1
        kept = np.zeros(len(self.feature), bool)
        front = np.zeros(1, np.int64)
        while len(front):
            kept[front] = True
            a = self.child[front[self.feature[front] >= 0]]
            front = np.concatenate([a, a + 1])
        number = np.cumsum(kept) - 1
        return Nodes(**{name: (number[self.child] if name == "child" else getattr(self, name))[kept] for name in ARRAYS})

    def packed(self) -> list[bytes]:
        return [getattr(self, name).tobytes() for name in ARRAYS]

    @classmethod
    def unpacked(cls, cells: Sequence[bytes]) -> Nodes:
        return cls(**{name: np.frombuffer(raw, kind).copy() for (name, kind), raw in zip(ARRAYS.items(), cells)})


FIELDS = ", ".join(f"{name} binary" for name in ARRAYS)


def _weights(number: int, n: int, tree: int, g: Growth) -> np.ndarray:
    """How often each row of a block is drawn for a tree."""
    return np.searchsorted(DRAWN, _draw((number << 32) + np.arange(n), 2 * (g.seed * 100_003 + tree)), "right")


def _choices(ids: np.ndarray, tree: int, n_features: int, g: Growth) -> np.ndarray:
    """Features that nodes (numbered as in a heap, from 1) may be split by."""
    draws = _draw(ids[:, None] * n_features + np.arange(n_features), 2 * (g.seed * 100_003 + tree) + 1)
    return np.argsort(draws, 1, kind="stable")[:, : g.take]


def _sums(bins, y, w, at, choices, width: int) -> np.ndarray:
    """Draws and positive draws by (node, choice, bin) of rows that are in node `at`."""
    k, rows = len(choices), np.arange(len(at))
    out = np.empty((k, choices.shape[1], width, 2))
    for j in range(choices.shape[1]):
        key = at * width + bins[choices[at, j], rows]
        out[:, j, :, 0] = np.bincount(key, w, k * width).reshape(k, width)
        out[:, j, :, 1] = np.bincount(key, w * y, k * width).reshape(k, width)
    return out


def _best(sums: np.ndarray, choices: np.ndarray, leaf: int) -> tuple:
    """Per node: whether it is split, by which feature, up to which bin, and the sums of both sides."""
    gini = lambda s: 2 * (s[..., 1] / np.maximum(s[..., 0], 1)) * (1 - s[..., 1] / np.maximum(s[..., 0], 1))
    left = np.cumsum(sums, 2)
    total = left[:, :, -1:]
    left = left[:, :, :-1]
    right = total - left
    n = np.maximum(total[..., 0], 1)
    gain = gini(total) - left[..., 0] / n * gini(left) - right[..., 0] / n * gini(right)
    gain[(left[..., 0] < leaf) | (right[..., 0] < leaf)] = -np.inf
    flat = gain.reshape(len(gain), -1)
    top = np.argmax(flat, 1)
    i = np.arange(len(top))
    slot, cut = np.divmod(top, gain.shape[2])
    return flat[i, top] > 1e-12, choices[i, slot], cut, np.stack([left[i, slot, cut], right[i, slot, cut]], 1)


def _open(sides: np.ndarray, level: int, g: Growth) -> np.ndarray:
    """Nodes that may be split further, by their sums."""
    n, pos = sides[..., 0], sides[..., 1]
    return (n >= 2 * g.leaf) & (pos > 0) & (pos < n) & (level < g.depth)


def grow(bins: np.ndarray, y: np.ndarray, w: np.ndarray, tree: int, root: int, g: Growth) -> Nodes:
    """The branch below node `root` from all its rows."""
    out = Nodes.root(root.bit_length() - 1, w.sum(), (w * y).sum())
    ids, nodes, at, w, y = np.array([root]), np.zeros(1, np.int64), np.zeros(len(y), np.int64), w.astype(float), y.astype(float)
    if not _open(np.array([out.n[0], out.pos[0]]), int(out.level[0]), g):
        return out
    while len(ids):
        choices = _choices(ids, tree, len(bins), g)
        ok, feature, cut, sides = _best(_sums(bins, y, w, at, choices, g.width), choices, g.leaf)
        if not ok.any():
            break
        first = out.split(nodes[ok], feature[ok], cut[ok], sides[ok])
        go = _open(sides[ok], int(out.level[first[0]]), g)
        rank = np.where(go.ravel(), np.cumsum(go.ravel()) - 1, -1)  # of each child among the open ones
        side = bins[feature[at], np.arange(len(at))] > cut[at]
        old = np.where(ok, np.cumsum(ok) - 1, 0)
        at = np.where(ok[at], rank[2 * old[at] + side], -1)
        use = at >= 0
        bins, y, w, at = bins[:, use], y[use], w[use], at[use]
        ids = (2 * ids[ok][:, None] + [0, 1]).ravel()[go.ravel()]
        nodes = (first[:, None] + [0, 1]).ravel()[go.ravel()].astype(np.int64)
    return out


def _ids(nodes: Nodes) -> np.ndarray:
    """Heap numbers of the nodes of a whole tree."""
    out = np.ones(len(nodes.feature), np.int64)
    for i in np.flatnonzero(nodes.feature >= 0):  # parents come before their children
        out[nodes.child[i]], out[nodes.child[i] + 1] = 2 * out[i], 2 * out[i] + 1
    return out


class Forest:
    """Trees as a table (tree, arrays of its nodes), fitted on the rows of split `train`."""

    def __init__(self, df: DataFrame, features: Sequence[str], target: str, trees: int = 500, leaf: int = 10, depth: int = 30, seed: int = 0):
        self.features, self.spark = list(features), df.sparkSession
        train = df.where("split = 'train'").where(F.col(target).isNotNull())
        self.edges = cut_points(train, self.features, BINS)
        self.g = Growth(trees, leaf, depth, int(np.ceil(np.sqrt(len(self.features)))), max(map(len, self.edges)) + 2, seed)
        blocks = pack_blocks(train, self.features, target, self.edges)
        rows = blocks.agg(F.sum(F.length("val"))).first()[0]
        if not rows:
            raise ValueError("no training rows")
        large, sent = self._large_nodes(blocks, rows)
        self.table = stage(self._trees(self._branches(blocks, large, sent, rows), large), "forest")

    def _large_nodes(self, blocks: DataFrame, rows: int) -> tuple[dict[int, Nodes], dict[int, list[int]]]:
        """Per tree the nodes down to those of `LOCAL_ROWS` rows, and which leaves are sent to tasks."""
        g, f = self.g, len(self.features)
        large = {t: Nodes.root(0, rows, 0) for t in range(g.trees)}
        if rows <= LOCAL_ROWS:
            return large, {t: [0] for t in large}
        sent: dict[int, list[int]] = {t: [] for t in large}
        todo = [(t, 0) for t in large]
        while todo:
            step, todo = todo[:OPEN], todo[OPEN:]
            wanted: dict[int, list[int]] = {}
            for t, node in step:
                wanted.setdefault(t, []).append(node)
            choices = {t: _choices(_ids(large[t])[nodes], t, f, g) for t, nodes in wanted.items()}
            trees = {t: large[t] for t in wanted}

            def sums(part):
                held: dict = {}
                for r in part:
                    bins, y = np.frombuffer(r["bins"], np.uint8).reshape(f, -1), np.frombuffer(r["y"])
                    for t, nodes in wanted.items():
                        w, index = _weights(r["number"], len(y), t, g), np.full(len(trees[t].feature), -1)
                        index[nodes] = np.arange(len(nodes))
                        at = index[trees[t].place(bins)]
                        use = np.flatnonzero((at >= 0) & (w > 0))
                        found = _sums(bins[:, use], y[use], w[use], at[use], choices[t], g.width)
                        held[t] = held[t] + found if t in held else found
                yield from held.items()

            best = _together(blocks.rdd.mapPartitions(sums)).map(lambda kv: (kv[0], _best(kv[1], choices[kv[0]], g.leaf), kv[1][:, 0].sum(1))).collect()
            for t, (ok, feature, cut, sides), total in sorted(best, key=lambda x: x[0]):
                nodes = np.array(wanted[t])
                large[t].n[nodes], large[t].pos[nodes] = total[:, 0], total[:, 1]
                if not ok.any():
                    continue
                first = large[t].split(nodes[ok], feature[ok], cut[ok], sides[ok])
                for a in (first[:, None] + [0, 1]).ravel().tolist():
                    s = np.array([large[t].n[a], large[t].pos[a]])
                    if _open(s, int(large[t].level[a]), g):
                        (todo if s[0] > LOCAL_ROWS else sent[t]).append((t, a) if s[0] > LOCAL_ROWS else a)
        return large, sent

    def _branches(self, blocks: DataFrame, large: dict[int, Nodes], sent: dict[int, list[int]], rows: int) -> DataFrame:
        """(tree, node, arrays): the branch below each leaf that was sent, grown from its rows."""
        g, f, ids = self.g, len(self.features), {t: _ids(nodes) for t, nodes in large.items()}

        def send(batches):
            for batch in batches:
                for r in batch.to_pylist():
                    bins, y = np.frombuffer(r["bins"], np.uint8).reshape(f, -1), np.frombuffer(r["y"])
                    for t, leaves in sent.items():
                        w = _weights(r["number"], len(y), t, g)
                        wanted = np.zeros(len(large[t].feature), bool)
                        wanted[leaves] = True
                        node = large[t].place(bins)
                        use = np.flatnonzero(wanted[node] & (w > 0))
                        use = use[np.argsort(node[use], kind="stable")]
                        found, start = np.unique(node[use], return_index=True)
                        all_ = np.concatenate([bins[:, use], [y[use].astype(np.uint8), w[use].astype(np.uint8)]])
                        cells = [all_[:, a:b].tobytes() for a, b in zip(start, [*start[1:], len(use)])]
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), t, np.int32)), pa.array(found.astype(np.int32)), pa.array(cells, pa.binary())], names=["tree", "node", "rows"])

        def branch(table: pa.Table) -> pa.Table:
            t, node = table.column(0)[0].as_py(), table.column(1)[0].as_py()
            every = np.concatenate([np.frombuffer(c, np.uint8).reshape(f + 2, -1) for c in table.column(2).to_pylist()], 1)
            out = grow(every[:f], every[f], every[f + 1].astype(float), t, int(ids[t][node]), g)
            return pa.table([pa.array([t], pa.int32()), pa.array([node], pa.int32()), *[pa.array([c], pa.binary()) for c in out.packed()]], names=["tree", "node", *ARRAYS])

        parts = max(4 * self.spark.sparkContext.defaultParallelism, g.trees * rows // (1 << 23))
        sent_rows = blocks.select("number", "bins", "y").mapInArrow(send, "tree int, node int, rows binary")
        return sent_rows.repartition(parts, "tree", "node").groupBy("tree", "node").applyInArrow(branch, f"tree int, node int, {FIELDS}")

    def _trees(self, branches: DataFrame, large: dict[int, Nodes]) -> DataFrame:
        """One row per tree: its branches put together, leaves merged."""
        def whole(table: pa.Table) -> pa.Table:
            t = table.column(0)[0].as_py()
            out = Nodes.unpacked(large[t].packed())
            for r in sorted(table.to_pylist(), key=lambda r: r["node"]):
                if r["node"] >= 0:
                    out.graft(r["node"], Nodes.unpacked([r[name] for name in ARRAYS]))
            return pa.table([pa.array([t], pa.int32()), *[pa.array([c], pa.binary()) for c in out.merged().packed()]], names=["tree", *ARRAYS])

        # a tree none of whose nodes was sent is there too
        every = self.spark.range(self.g.trees).select(F.col("id").cast("int").alias("tree"), F.lit(-1).alias("node"), *[F.lit(b"").alias(name) for name in ARRAYS])
        return branches.unionByName(every).groupBy("tree").applyInArrow(whole, f"tree int, {FIELDS}")

    def score(self, df: DataFrame) -> DataFrame:
        """Adds `p`, the mean share of positive draws in a row's leaves."""
        edges, f, n_trees = self.edges, len(self.features), self.g.trees
        rows = stage(df.withColumn("__row", F.monotonically_increasing_id()), "forest-rows")

        def pack(batches):
            held, size = [], 0
            for batch in batches:
                held.append(batch)
                size += batch.num_rows
                if size >= BLOCK_ROWS:
                    yield one(held)
                    held, size = [], 0
            if size:
                yield one(held)

        def one(held):
            t = pa.Table.from_batches(held)
            ids = t.column(0).to_numpy()
            bins = np.stack([to_bins(t.column(i + 1).to_pandas().to_numpy(float), e) for i, e in enumerate(edges)])
            return pa.RecordBatch.from_arrays([pa.array([int(ids[0])]), pa.array([ids.tobytes()]), pa.array([bins.tobytes()])], names=["block", "ids", "bins"])

        def sums(part):
            held: dict = {}
            for r in part:
                nodes = Nodes.unpacked([r[name] for name in ARRAYS])
                leaf = nodes.place(np.frombuffer(r["bins"], np.uint8).reshape(f, -1))
                p = np.rint(nodes.pos / np.maximum(nodes.n, 1) * STEPS).astype(np.int64)[leaf]
                held[r["block"]] = held[r["block"]] + p if r["block"] in held else p
            yield from held.items()

        def unpack(batches):
            for batch in batches:
                for ids, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(ids, np.int64)), pa.array(np.frombuffer(p, np.int64) / STEPS / n_trees)], names=["__row", "p"])

        packed = stage(rows.select("__row", *[F.col(c).cast("double") for c in self.features]).mapInArrow(pack, "block long, ids binary, bins binary"), "forest-blocks")
        trees = self.table.repartition(2 * self.spark.sparkContext.defaultParallelism)
        pairs = trees.crossJoin(packed.drop("ids").hint("shuffle_replicate_nl"))
        total = self.spark.createDataFrame(_together(pairs.rdd.mapPartitions(sums)).map(lambda kv: (kv[0], kv[1].tobytes())), "block long, total binary")
        p = packed.select("block", "ids").join(total, "block").select("ids", "total").mapInArrow(unpack, "__row long, p double")
        return rows.join(stage(p, "forest-scores"), "__row").drop("__row")


def scorer(forest: Forest, prepare: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    return lambda df: forest.score(prepare(df)).drop(*forest.features)
