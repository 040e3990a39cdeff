"""Histogram gradient boosting as Spark rounds.

Features are cut once into at most 255 bins (bin 0 is a missing value). The rows are packed into blocks of `BLOCK_ROWS`
and written to the shared folder; a block's state is its margins. One level of a tree is one aggregate: every task sums
gradients and Hessians of its blocks by (node, feature, bin), the sums of a feature meet in one task, and this task
returns the best cut of each node. So what moves grows with nodes x features x bins, never with rows, and the driver
holds best cuts and trees only. Models of several depths grow in the same jobs.

A split's gain is the second-order one with ridge `ridge`; a child needs a Hessian of `child_weight`; missing values go
to the side with the larger gain. Rows and features are drawn per tree by hashes of their numbers, so a task that is
run again draws the same. Boosting ends when the validation score has not improved for `patience` rounds; the best
round is kept. Margins live in executor memory or on its disk, a lost block is computed again from the last checkpoint,
which is written every `CHECKPOINT` rounds.

The state of a round is an RDD of numpy blocks: a round reads what the round before left in the same task, which no
DataFrame operation expresses without packing all margins anew.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitframe.session import shared_dir, stage

BLOCK_ROWS = 1 << 16
MAX_BINS = 255
CHECKPOINT = 50
#: steps of the margin in which validation rows are counted; rows of one step tie
STEPS, REACH = 1 << 14, 6.0
#: steps of the residual in which the median of a leaf is found
RESIDUALS = 1 << 12
_U = np.uint64


@dataclass
class Tree:
    """Nodes in heap order (children of i: 2i + 1, 2i + 2); a leaf has feature -1. Bins up to `cut` go left."""

    depth: int
    feature: np.ndarray = None
    cut: np.ndarray = None
    missing_left: np.ndarray = None
    value: np.ndarray = None
    gain: np.ndarray = None

    def __post_init__(self):
        n = 2 ** (self.depth + 1) - 1
        self.feature, self.cut = np.full(n, -1, np.int32), np.zeros(n, np.int32)
        self.missing_left, self.value, self.gain = np.zeros(n, bool), np.zeros(n), np.zeros(n)

    def place(self, bins: np.ndarray, levels: int | None = None) -> np.ndarray:
        """Node that each row (column of `bins`) has reached after so many levels."""
        n, flat = bins.shape[1], np.ascontiguousarray(bins).ravel()
        levels = self.depth if levels is None else levels
        node, row = np.zeros(n, np.int64), np.arange(n)
        if not levels:
            return node
        # the next node by node and bin; a leaf leads to itself
        own = np.arange(2**levels - 1)[:, None]
        left = np.arange(256) <= self.cut[: len(own), None]
        left[:, 0] = self.missing_left[: len(own)]
        split = self.feature[: len(own)] >= 0
        following = np.where(split[:, None], 2 * own + 2 - left, own).ravel()
        start = np.where(split, self.feature[: len(own)], 0).astype(np.int64) * n
        for level in range(levels):
            if level and not split[2**level - 1: 2 ** (level + 1) - 1].any():
                break
            if level and not split[: 2**level - 1].all():  # some rows rest in a leaf above
                on = np.flatnonzero(node >= 2**level - 1)
                at = node.take(on)
                node[on] = following.take(at * 256 + flat.take(start.take(at) + on))
            else:
                node = following.take(node * 256 + flat.take(start.take(node) + row))
        return node


@dataclass
class Boosted:
    """A fitted model: bins, first margin and trees up to the best round."""

    features: list[str]
    edges: list[np.ndarray]
    base: float
    depth: int
    trees: list[Tree] = field(default_factory=list)
    score: float = -np.inf
    best_round: int = 0

    def margins(self, columns: Sequence[pd.Series]) -> np.ndarray:
        bins = np.stack([to_bins(c.to_numpy(float), e) for c, e in zip(columns, self.edges)])
        out = np.full(bins.shape[1], self.base)
        for t in self.trees[: self.best_round]:
            out += t.value[t.place(bins)]
        return out


def to_bins(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """1 + number of edges below the value; 0 for a missing one."""
    return np.where(np.isnan(x), 0, 1 + np.searchsorted(edges, x, "left")).astype(np.uint8)


def cut_points(train: DataFrame, features: Sequence[str], bins: int = MAX_BINS) -> list[np.ndarray]:
    """Edges of at most `bins` bins per feature, at about even quantiles of the known values."""
    probs = [i / bins for i in range(1, bins)]
    row = train.agg(*[F.percentile_approx(F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double")), probs, 100_000).alias(f) for f in features]).first()
    return [np.unique(np.array(v if v is not None else [], float)) for v in row]


def _draw(numbers: np.ndarray, seed: int) -> np.ndarray:
    """Even draws from 0 to 1 that depend on the numbers and the seed alone."""
    with np.errstate(over="ignore"):
        h = numbers.astype(_U) * _U(0x9E3779B97F4A7C15) + _U(seed * 0xD1B54A32D192ED03 % 2**64)
        for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
            h = (h ^ (h >> _U(shift))) * _U(by)
    return (h >> _U(11)) / 2.0**53


@dataclass(frozen=True)
class Settings:
    step: float = 0.03
    rows: float = 0.8
    columns: float = 0.8
    child_weight: float = 5.0
    ridge: float = 2.0
    absolute: bool = False  # absolute error in place of the logistic loss
    seed: int = 0


@dataclass
class Block:
    number: int
    bins: np.ndarray    # features x rows
    y: np.ndarray
    val: np.ndarray
    margin: np.ndarray  # models x rows

    def drawn(self, s: Settings, round_: int) -> np.ndarray:
        """Training rows that the round draws, the same for all models."""
        use = ~self.val
        if s.rows < 1:
            use = use & (_draw((self.number << 32) + np.arange(len(self.y)), 2 * (s.seed * 100_003 + round_)) < s.rows)
        return np.flatnonzero(use)

    def gradients(self, model: int, s: Settings, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradient and Hessian of the given rows."""
        margin, y = self.margin[model].take(rows), self.y.take(rows)
        if s.absolute:
            return np.sign(margin - y), np.ones(len(rows))
        p = 1 / (1 + np.exp(-margin))
        return p - y, np.maximum(p * (1 - p), 1e-16)


def _unpacked(n_features: int, base: float, models: int):
    def block(row) -> Block:
        y, val = np.frombuffer(row["y"]), np.frombuffer(row["val"], bool)
        return Block(row["number"], np.frombuffer(row["bins"], np.uint8).reshape(n_features, -1), y, val, np.full((models, len(y)), base))

    return block


def pack_blocks(df: DataFrame, features: Sequence[str], target: str, edges: list[np.ndarray]) -> DataFrame:
    """(number, bins, y, val) with up to `BLOCK_ROWS` rows each; rows without a target are left out."""
    data = df.where(F.col(target).isNotNull() & F.col("split").isin("train", "val"))
    parts = max(1, -(-data.count() // BLOCK_ROWS))
    columns = [F.col(f).cast("double") for f in features]

    def task(batches):
        from pyspark import TaskContext

        number, held, size = TaskContext.get().partitionId() << 12, [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= BLOCK_ROWS:
                yield one(number, held)
                number, held, size = number + 1, [], 0
        if size:
            yield one(number, held)

    def one(number, held):
        t = pa.Table.from_batches(held)
        bins = np.stack([to_bins(t.column(i).to_pandas().to_numpy(float), e) for i, e in enumerate(edges)])
        cells = [number, bins.tobytes(), t.column(len(edges)).to_numpy().astype(float).tobytes(), t.column(len(edges) + 1).to_pandas().to_numpy(bool).tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([c]) for c in cells], names=["number", "bins", "y", "val"])

    packed = data.select(*columns, F.col(target).cast("double"), F.col("split") == "val").repartition(parts).mapInArrow(task, "number long, bins binary, y binary, val binary")
    return stage(packed, "boost-blocks")


def best_cuts(sums: np.ndarray, s: Settings) -> list[tuple]:
    """Per node the best cut of one feature: (gain, cut, missing left, G left, H left, G right, H right)."""
    g, h = sums[:, 0], sums[:, 1]
    gt, ht = g.sum(1, keepdims=True), h.sum(1, keepdims=True)
    known_g, known_h = np.cumsum(g[:, 1:], 1)[:, :-1], np.cumsum(h[:, 1:], 1)[:, :-1]
    out = None
    for left in (True, False):
        gl, hl = (known_g + g[:, :1], known_h + h[:, :1]) if left else (known_g, known_h)
        gr, hr = gt - gl, ht - hl
        gain = gl**2 / (hl + s.ridge) + gr**2 / (hr + s.ridge) - gt**2 / (ht + s.ridge)
        gain[(hl < s.child_weight) | (hr < s.child_weight)] = -np.inf
        at = np.argmax(gain, 1)
        i = np.arange(len(at))
        found = [(float(gain[k, a]), int(a) + 1, left, float(gl[k, a]), float(hl[k, a]), float(gr[k, a]), float(hr[k, a])) for k, a in zip(i, at)]
        out = found if out is None else [max(x, y, key=lambda v: v[0]) for x, y in zip(out, found)]
    return out


class Booster:
    """Grows models of several depths together over one packed table."""

    def __init__(self, df: DataFrame, features: Sequence[str], target: str, settings: Settings, edges: list[np.ndarray] | None = None):
        self.features, self.s = list(features), settings
        train = df.where("split = 'train'").where(F.col(target).isNotNull())
        self.edges = cut_points(train, self.features) if edges is None else edges
        y = F.col(target).cast("double")
        r = train.agg(F.avg(y), F.percentile_approx(y, 0.5, 100_000), F.min(y), F.max(y)).first()
        if r[0] is None:
            raise ValueError("no training rows")
        mean = min(max(r[0], 1e-6), 1 - 1e-6) if not settings.absolute else 0
        self.base = r[1] if settings.absolute else float(np.log(mean / (1 - mean)))
        self.wide = max(r[3] - r[2], 1e-12)  # residuals lie within the range of the target
        self.blocks = pack_blocks(df, self.features, target, self.edges)
        self.spark = df.sparkSession

    def _feature_set(self, round_: int) -> list[int]:
        n = len(self.features)
        take = max(1, int(self.s.columns * n))
        return sorted(np.argsort(_draw(np.arange(n), 2 * (self.s.seed * 100_003 + round_) + 1))[:take].tolist())

    def fit(self, depths: Sequence[int], rounds: int = 3000, patience: int = 100, trim: bool = True) -> list[Boosted]:
        """Models of the given depths; trees after a model's best round are dropped, unless `trim` is off."""
        s, sc = self.s, self.spark.sparkContext
        models = [Boosted(self.features, self.edges, self.base, d) for d in depths]
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(shared_dir(self.spark))
        # a task sums all its blocks before anything moves
        state = self.blocks.rdd.coalesce(sc.defaultParallelism).map(_unpacked(len(self.features), self.base, len(models)))
        live, new = list(range(len(models))), {}
        for t in range(rounds + 1):
            last, state = state, state.map(_grown(new)) if new else state
            state = state.persist(StorageLevel.MEMORY_AND_DISK)
            if t and t % CHECKPOINT == 0:
                state.checkpoint()
            new, chosen = {m: Tree(models[m].depth) for m in live}, self._feature_set(t)
            found = self._level(state, new, 0, chosen, t)
            if last is not state:
                last.unpersist()
            for m in live:  # the score of the trees so far
                score = self._score(found[("val", m)])
                if score > models[m].score or t == 0:
                    models[m].score, models[m].best_round = score, t
            live = [m for m in live if t - models[m].best_round < patience and t < rounds]
            if not live:
                break
            new = {m: new[m] for m in live}
            self._split(new, found, 0, chosen)
            for level in range(1, max(models[m].depth for m in live)):
                deep = {m: tree for m, tree in new.items() if tree.depth > level and (tree.feature[2 ** (level - 1) - 1: 2**level - 1] >= 0).any()}
                if not deep:
                    break
                self._split(deep, self._level(state, deep, level, chosen, t), level, chosen)
            if s.absolute:
                self._medians(state, new, t)
            for m in live:
                models[m].trees.append(new[m])
        state.unpersist()
        for model in models if trim else ():
            del model.trees[model.best_round:]
        return models

    def _level(self, state, trees: dict[int, Tree], level: int, chosen: list[int], round_: int) -> dict:
        """Best cuts by (model, feature) of the nodes of a level; at the top also the validation counts by model."""
        s, nodes, first, wide = self.s, 2**level, 2**level - 1, self.wide

        def sums(blocks) -> Iterator[tuple]:
            held: dict = {}

            def add(key, value):
                held[key] = held[key] + value if key in held else value

            for b in blocks:
                drawn = b.drawn(s, round_)
                bins = b.bins.take(drawn, 1)
                for m, tree in trees.items():
                    if level == 0:
                        add(("val", m), _counted(b, m, s.absolute))
                    use, at = drawn, tree.place(bins, level) - first
                    on = np.flatnonzero(at >= 0)
                    here = bins if len(on) == len(at) else bins.take(on, 1)
                    at, use = at.take(on) * 256, use.take(on)
                    g, h = b.gradients(m, s, use)
                    for f in chosen:
                        key = at + here[f]
                        add((m, f), np.stack([np.bincount(key, w, nodes * 256).reshape(nodes, 256) for w in (g, h)], 1))
            yield from held.items()

        return dict(_together(state.mapPartitions(sums), len(trees) * (len(chosen) + (level == 0))).map(lambda kv: kv if kv[0][0] == "val" else (kv[0], best_cuts(kv[1], s))).collect())

    def _split(self, trees: dict[int, Tree], found: dict, level: int, chosen: list[int]) -> None:
        s = self.s
        for m, tree in trees.items():
            for k in range(2**level):
                node = 2**level - 1 + k
                if level and tree.feature[(node - 1) // 2] < 0:
                    continue
                best = max((found[(m, f)][k] + (-f,) for f in chosen), key=lambda v: (v[0], v[-1]))
                gain, cut, left, gl, hl, gr, hr, f = best
                if not gain > 1e-9:
                    continue
                tree.feature[node], tree.cut[node], tree.missing_left[node], tree.gain[node] = -f, cut, left, gain
                tree.value[2 * node + 1], tree.value[2 * node + 2] = -s.step * gl / (hl + s.ridge), -s.step * gr / (hr + s.ridge)

    def _medians(self, state, trees: dict[int, Tree], round_: int) -> None:
        """Leaf values of the absolute loss: the median residual of the leaf's rows, from finely cut counts."""
        s, wide = self.s, self.wide

        def sums(blocks):
            held: dict = {}
            for b in blocks:
                drawn = b.drawn(s, round_)
                bins, y = b.bins.take(drawn, 1), b.y.take(drawn)
                for m, tree in trees.items():
                    leaf = tree.place(bins)
                    cell = np.clip(((y - b.margin[m].take(drawn)) / wide + 1) / 2 * RESIDUALS, 0, RESIDUALS - 1).astype(np.int64)
                    counts = np.bincount(leaf * RESIDUALS + cell, minlength=len(tree.value) * RESIDUALS).reshape(-1, RESIDUALS)
                    for k in np.flatnonzero(counts.any(1)).tolist():
                        n = counts[k].copy()
                        held[(m, k)] = held[(m, k)] + n if (m, k) in held else n
            yield from held.items()

        def median(n):
            c = np.cumsum(n)
            half = c[-1] / 2
            i = int(np.searchsorted(c, half))
            inside = (half - (c[i] - n[i])) / n[i]
            return ((i + inside) / RESIDUALS * 2 - 1) * wide

        leaves = sum(2**tree.depth for tree in trees.values())
        for (m, k), v in _together(state.mapPartitions(sums), leaves).mapValues(median).collect():
            trees[m].value[k] = s.step * v

    def _score(self, counted: np.ndarray) -> float:
        """AUROC of the validation rows, or their mean absolute error with a minus sign."""
        if self.s.absolute:
            return -counted[0] / counted[1] if counted[1] else -np.inf
        pos, neg = counted
        below = np.concatenate([[0], np.cumsum(neg)[:-1]])
        pairs = pos.sum() * neg.sum()
        return float((pos * (below + neg / 2)).sum() / pairs) if pairs else -np.inf


def _together(sums, keys: int = 200):
    """Sums by key over all tasks, in no more tasks than there are keys; those of a single task are complete as they are."""
    parts = sums.getNumPartitions()
    return sums if parts == 1 else sums.reduceByKey(lambda a, b: a + b, min(parts, keys, 200))


def _counted(b: Block, model: int, absolute: bool) -> np.ndarray:
    z, y = b.margin[model][b.val], b.y[b.val]
    if absolute:
        return np.array([np.abs(y - z).sum(), len(y)])
    cell = np.clip((z / REACH + 1) / 2 * STEPS, 0, STEPS - 1).astype(np.int64)
    return np.stack([np.bincount(cell[y == k], minlength=STEPS) for k in (1, 0)]).astype(float)


def _grown(trees: dict[int, Tree]) -> Callable[[Block], Block]:
    def grow(b: Block) -> Block:
        margin = b.margin.copy()
        for m, tree in trees.items():
            margin[m] += tree.value[tree.place(b.bins)]
        return Block(b.number, b.bins, b.y, b.val, margin)

    return grow


def scorer(model: Boosted, probability: bool) -> Callable[[DataFrame], DataFrame]:
    """Adds `p`: the probability, or the predicted value."""

    @F.pandas_udf("double")
    def predict(*columns: pd.Series) -> pd.Series:
        z = model.margins(columns)
        return pd.Series(1 / (1 + np.exp(-z)) if probability else z)

    score = lambda df: df.withColumn("p", predict(*[F.col(f).cast("double") for f in model.features]))
    score.model = model
    return score
