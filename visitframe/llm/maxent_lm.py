"""Language-model scoring with a hashed maximum-entropy model and a class-factored softmax.

P(word | history) = P(class | history) * P(word | class, history). Both are predicted
from hashed features of the history: the words one, two and three places back (n-gram
and skip features) and the pair of the last two. Classes have one softmax tree, and the
words of each class another: Huffman trees with `FAN` branches a node, so a frequent
word costs a few small softmaxes and a rare one some more. A weight block belongs to a
feature and a node, by hash.

All words seen `LEAST` times or more (and at least the `HEAD` most frequent) have a
leaf and are features of their own. The `HEAD` most frequent fall into classes by
their neighbours, all other words into `TAILS` classes by their spelling, each of
which has one more leaf for all words below `LEAST` and those never seen: these are
told apart by their counts. So vocabulary, feature rows and weight blocks grow with
the corpus; each task holds one copy of them.

Everything is learnt from all training texts: word counts, neighbour counts and
one epoch of updates. For these each task goes through its texts block by block,
moves the weights of every feature row along the gradient (its observed less its
expected counts), at a rate that falls as the row is seen more often, and sends how far its weights moved (as half-precision numbers);
Spark averages that by how often a row was seen. Two such rounds share the texts between them. There is one task per core, so
what is sent grows with the model and not with model times input.

Counts of the `TABLE` most frequent words (and of all with a leaf) are broadcast;
rarer words of a document are joined with the count table, so counts are exact for
all words.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitframe.llm.blocks import LOWER, NOT_SPACE, mix, text_blocks, words_of
from visitframe.session import stage

HEAD, TABLE, ANCHORS = 4096, 1 << 18, 64
CLASSES, TAILS = 32, 8
WIDTH = CLASSES + TAILS
LEAST, FAN = 32, 8
ROWS, EACH = 1 << 15, 6  # weight blocks of each kind of tree, and how many more come with every word
ROUNDS, SLAB = 2, 512
ETA = 0.15
_U = np.uint64
END = _U(0x5BF0_3635_1D2C_E4A8)
BACK = 3


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 1, F.lit(False))


def tokens_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(token hashes, boundaries of rows): the words of each row and one end. The low three bits are the spelling class."""
    w = words_of(data, offsets, NOT_SPACE)
    rows = len(offsets) - 1
    low = LOWER[data]
    last = low[w.end - 1] if len(w.end) else low[:0]
    foreign = np.concatenate([[0], np.cumsum(data >= 0x80)])
    kind = np.select([(last == 0x2E), (last == 0x2C), ((last >= 0x61) & (last <= 0x7A)) | (last >= 0x80)], [1, 2, 0], 3)
    spelling = kind * 2 + (foreign[w.end] > foreign[w.start])
    h = (w.hash & ~_U(7)) | spelling.astype(_U)
    bounds = w.row_start + np.arange(rows + 1)
    out = np.full(len(h) + rows, END)
    place = np.ones(len(out), bool)
    place[bounds[1:] - 1] = False
    out[place] = h
    return out, bounds


class WordTable:
    """Sorted hashes with a quick test for those that are not in it."""

    def __init__(self, hashes: np.ndarray):
        self.order = np.argsort(hashes, kind="stable")
        self.sorted = hashes[self.order]
        self.likely = np.zeros(1 << 16, bool)
        self.likely[(hashes >> _U(48)).astype(np.int64)] = True

    def place(self, hashes: np.ndarray) -> np.ndarray:
        """Index in the original order, -1 if absent."""
        out = np.full(len(hashes), -1, np.int64)
        at = np.flatnonzero(self.likely[(hashes >> _U(48)).astype(np.int64)])
        if len(at) and len(self.sorted):
            i = np.minimum(np.searchsorted(self.sorted, hashes[at]), len(self.sorted) - 1)
            out[at] = np.where(self.sorted[i] == hashes[at], self.order[i], -1)
        return out


# ---------------------------------------------------------------------------
# Counts
# ---------------------------------------------------------------------------

def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(at, weights=np.concatenate([n for _, n in parts]), minlength=len(keys)).astype(np.int64)


def _count_task(batches):
    parts, size = [], 0

    def send():
        keys, n = _merged(parts)
        return pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(n)], names=["h", "c"])

    for batch in batches:
        for _, _, data, offsets in text_blocks(batch.column(0)):
            parts.append(np.unique(tokens_of(data, offsets)[0], return_counts=True))
            size += len(parts[-1][0])
            if size > 1_500_000:
                parts = [_merged(parts)]
                size = len(parts[0][0])
                if size > 1_000_000:
                    yield send()
                    parts, size = [], 0
    if parts:
        yield send()


def word_counts(texts: DataFrame) -> DataFrame:
    """(h, c) of every distinct token of the column `text`."""
    return texts.select("text").mapInArrow(_count_task, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def most_frequent(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The `most` most frequent tokens (all, if there are fewer), as hashes and counts in descending order.

    Where a step of nearly equal counts does not fit whole, it gives its smallest hashes.
    """
    step, prefix = F.floor(F.log2("c") * 16), F.shiftrightunsigned("h", 48)
    sizes = counts.groupBy(step.alias("s")).agg(F.count("*").alias("n")).orderBy(F.desc("s")).collect()  # 16 rows per doubling of counts
    room, whole, part, cut = most, [], None, -1
    for r in sizes:
        if r["n"] > room:
            part = r["s"]
            break
        room -= r["n"]
        whole.append(r["s"])
    if part is not None:
        left = room
        for r in counts.where(step == part).groupBy(prefix.alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect():  # 65,536 rows at most
            left -= r["n"]
            if left >= 0 or room > 0:
                cut = r["p"]
            if left <= 0:
                break
    taken = step >= (whole[-1] if whole else (part or 0) + 1)
    rows = counts.where(taken if part is None else taken | ((step == part) & (prefix <= cut))).select("h", "c", (step.eqNullSafe(F.lit(part)) if part is not None else F.lit(False)).alias("last")).toArrow()
    h, c = rows.column("h").to_numpy().astype(np.int64).view(_U), rows.column("c").to_numpy()
    last = rows.column("last").to_numpy().astype(bool)
    kept = np.concatenate([np.flatnonzero(~last), np.flatnonzero(last)[np.argsort(h[last])][:room]])
    h, c = h[kept], c[kept]
    order = np.lexsort((h, -c))
    return h[order], c[order]


def _neighbour_task(head: WordTable, size: int):
    width = 2 * (ANCHORS + 1)

    def task(batches):
        total = np.zeros(size * width)
        for batch in batches:
            for _, _, data, offsets in text_blocks(batch.column(0)):
                i = head.place(tokens_of(data, offsets)[0])
                anchor = np.where((i >= 0) & (i < ANCHORS), i, ANCHORS)
                for side, (w, by) in enumerate(((i[1:], anchor[:-1]), (i[:-1], anchor[1:]))):
                    known = w >= 0
                    total += np.bincount(w[known] * width + side * (ANCHORS + 1) + by[known], minlength=size * width)
        cell = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(total[cell])], names=["cell", "n"])

    return task


def neighbour_classes(texts: DataFrame, hashes: np.ndarray, counts: np.ndarray, classes: int = CLASSES, seed: int = 7) -> np.ndarray:
    """Class of each head word: weighted k-means on the shares of frequent words beside it, over all texts."""
    n = len(hashes)
    if n <= classes:
        return np.arange(n)
    width = 2 * (ANCHORS + 1)
    shared = texts.sparkSession.sparkContext.broadcast(WordTable(hashes))
    size = n

    def task(batches):
        yield from _neighbour_task(shared.value, size)(batches)

    cells = texts.select("text").mapInArrow(task, "cell long, n double").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    m = np.zeros(n * width)
    m[cells.column("cell").to_numpy()] = cells.column("n").to_numpy()
    m = m.reshape(n, width)
    x = np.sqrt(m / np.maximum(m.sum(1, keepdims=True), 1))
    rng, weight = np.random.default_rng(seed), np.sqrt(counts.astype(float))
    centres = x[[0]]
    far = np.full(n, np.inf)
    while len(centres) < classes:  # far words become centres
        far = np.minimum(far, ((x - centres[-1]) ** 2).sum(1))
        d = far * weight
        centres = np.concatenate([centres, x[[rng.choice(n, p=d / d.sum()) if d.sum() > 0 else len(centres)]]])
    before = None
    while True:
        of = ((x**2).sum(1)[:, None] - 2 * x @ centres.T + (centres**2).sum(1)).argmin(1)
        if before is not None and (of == before).all():
            return of
        before = of
        for k in range(classes):
            mine = of == k
            if mine.any():
                centres[k] = np.average(x[mine], axis=0, weights=weight[mine])


# ---------------------------------------------------------------------------
# The model
# ---------------------------------------------------------------------------

@dataclass
class Tree:
    """Softmax trees of all classes. Leaf i has the nodes and branches from start[i] to start[i + 1]."""

    start: np.ndarray
    node: np.ndarray
    branch: np.ndarray
    bias: np.ndarray  # log share of each branch in its node's count; missing branches have none


def _huffman(leaves: np.ndarray, counts: np.ndarray, nodes: list[list[tuple[int, float]]], paths: list[list[tuple[int, int]]]) -> None:
    """Adds a Huffman tree with `FAN` branches a node over the leaves to `nodes`, and sets their `paths`."""
    heap = [(float(counts[i]), int(i)) for i in leaves]  # leaves count from 0, nodes from -1 down
    heapq.heapify(heap)
    take, first = (len(heap) - 2) % (FAN - 1) + 2, len(nodes)
    while len(heap) > 1:
        low = [heapq.heappop(heap) for _ in range(take)][::-1]
        nodes.append([(i, n) for n, i in low])
        heapq.heappush(heap, (sum(n for n, _ in low), -len(nodes)))
        take = FAN
    above: dict[int, list[tuple[int, int]]] = {}
    for k in range(len(nodes) - 1, first - 1, -1):
        path = above.pop(k, [])
        for b, (i, _) in enumerate(nodes[k]):
            if i < 0:
                above[-1 - i] = [*path, (k, b)]
            else:
                paths[i] = [*path, (k, b)]


def word_trees(cls: np.ndarray, counts: np.ndarray) -> Tree:
    """A Huffman tree over the leaves of each class."""
    nodes: list[list[tuple[int, float]]] = []
    paths: list[list[tuple[int, int]]] = [[] for _ in cls]
    for c in range(WIDTH):
        _huffman(np.flatnonzero(cls == c), counts, nodes, paths)
    bias = np.full((len(nodes), FAN), -1e9, np.float32)
    for k, branches in enumerate(nodes):
        n = np.array([n for _, n in branches])
        bias[k, : len(n)] = np.log(n / n.sum())
    flat = np.array([step for path in paths for step in path], np.int64).reshape(-1, 2)
    return Tree(np.cumsum([0, *map(len, paths)]), flat[:, 0].astype(np.int32), flat[:, 1].astype(np.int8), bias)


REACH = 60  # sums of weights are held within this, so that a float32 exponential is always finite and above 0


def _exp(z: np.ndarray) -> np.ndarray:
    """Exponentials in place, and their sum of each row."""
    np.exp(np.clip(z, -REACH, REACH, out=z), out=z)
    return np.einsum("ij->i", z)  # for so few columns faster than sum, and on one core


def _softmax(z: np.ndarray) -> np.ndarray:
    total = _exp(z)
    z /= total[:, None]
    return z


def _log_of(z: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Logarithm of the softmax's value at each row's target."""
    at = np.clip(np.take(z.ravel(), np.arange(0, z.size, z.shape[1]) + target), -REACH, REACH)
    return at - np.log(_exp(z))


def _take(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rows of `x`; without a test of each index, all of which are within it."""
    return np.take(x, at, axis=0, mode="clip")


def _whole(x: np.ndarray) -> np.ndarray:
    """Each row as one item, which numpy moves at once."""
    return x.view(f"V{x.strides[0]}").ravel()


def _sum_rows(weights: np.ndarray, rows: np.ndarray, start: np.ndarray) -> np.ndarray:
    """`start`, in place, plus the weights of all feature rows of each token."""
    z, part = start, np.empty_like(start)
    for k in range(rows.shape[1]):
        np.take(weights, rows[:, k], axis=0, out=part, mode="clip")
        z += part
    return z


def _step(weights: np.ndarray, rows: np.ndarray, target: np.ndarray, p: np.ndarray, seen: np.ndarray) -> None:
    """One gradient step: a feature row moves by its observed less its expected counts, at a rate that falls with the root of how often it was seen."""
    features = rows.shape[1]
    up = np.negative(p, out=p)
    up.ravel()[np.arange(0, up.size, up.shape[1]) + target] += 1
    flat = rows.ravel()
    order = np.sort((flat << 24) | np.arange(len(flat)))  # as one number: sorts much faster than by argsort
    flat, order = order >> 24, order & 0xFF_FFFF
    first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
    which = flat[first]
    token = order // features
    n = np.diff(np.append(first, len(flat)))
    move = _take(up, _take(token, first))
    two = np.flatnonzero(n == 2)  # most rows come once or twice; only the others need longer sums
    _whole(move)[two] = _whole(_take(move, two) + _take(up, _take(token, first[two] + 1)))
    more = np.flatnonzero(n > 2)
    if len(more):
        times = n[more]
        start = np.cumsum(times) - times
        _whole(move)[more] = _whole(np.add.reduceat(_take(up, _take(token, np.arange(times.sum()) + np.repeat(first[more] - start, times))), start, axis=0))
    count = _take(seen, which) + n.astype(np.float32)
    seen[which] = count
    move *= (np.float32(ETA) / np.sqrt(count))[:, None]
    move += _take(weights, which)
    _whole(weights)[which] = _whole(move)


def _way(tree: Tree, leaf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(token, place in the tree's lists) of every node on the way to each token's leaf."""
    start = np.take(tree.start, leaf)
    n = np.take(tree.start, leaf + 1) - start
    return np.repeat(np.arange(len(leaf)), n), np.arange(n.sum()) + np.repeat(start - np.cumsum(n) + n, n)


def _block_rows(blocks: np.ndarray, keys: np.ndarray, node: np.ndarray) -> np.ndarray:
    return (mix(keys ^ (node.astype(_U) * _U(0x9E37_79B9_7F4A_7C15))[:, None]) % _U(len(blocks))).astype(np.int64)


def _log_leaf(tree: Tree, blocks: np.ndarray, keys: np.ndarray, leaf: np.ndarray) -> np.ndarray:
    token, at = _way(tree, leaf)
    node = np.take(tree.node, at)
    logs = _log_of(_sum_rows(blocks, _block_rows(blocks, _take(keys, token), node), _take(tree.bias, node)), np.take(tree.branch, at))
    return np.bincount(token, weights=logs, minlength=len(leaf))


@dataclass
class ClassModel:
    """Words with classes and leaves, and weight blocks of (feature, node) for the words' trees (`blocks`) and the classes' (`weights`)."""

    head: WordTable
    word_class: np.ndarray
    tree: Tree
    weights: np.ndarray
    blocks: np.ndarray
    classes: Tree | None = None

    def ids(self, hashes: np.ndarray, place: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Number as feature and leaf (place among the words, or their number + spelling) and class of each token."""
        i = self.head.place(hashes) if place is None else place
        tail = (hashes & _U(7)).astype(np.int64)
        cls = np.where(i >= 0, self.word_class[i] if len(self.word_class) else 0, CLASSES + tail)
        return np.where(i >= 0, i, len(self.word_class) + tail), cls

    def keys(self, ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Hashed features of every token (tokens x features): three places back each, and the pair of the last two."""
        start = len(self.word_class) + TAILS
        n = _U(start + 1)
        row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        place = np.arange(len(ids)) - bounds[:-1][row]
        back = []
        for k in range(1, BACK + 1):
            p = np.full(len(ids), start)
            p[k:] = np.where(place[k:] >= k, ids[:-k], start)
            back.append(p.astype(_U))
        return np.stack([mix(_U(k) * n + p) for k, p in enumerate(back)] + [mix(_U(BACK) * n + back[0] + n * (back[1] + _U(1)))], 1)

    def log_class(self, keys: np.ndarray, cls: np.ndarray) -> np.ndarray:
        """log P(class | history) of each token."""
        return _log_leaf(self.classes, self.weights, keys, cls)

    def log_word(self, keys: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """log P(leaf | class, history) of each token."""
        return _log_leaf(self.tree, self.blocks, keys, ids)

    def update(self, keys: np.ndarray, ids: np.ndarray, cls: np.ndarray, seen: tuple[np.ndarray, np.ndarray]) -> None:
        for tree, blocks, leaf, n in ((self.classes, self.weights, cls, seen[0]), (self.tree, self.blocks, ids, seen[1])):
            token, at = _way(tree, leaf)
            if len(at):
                node = np.take(tree.node, at)
                rows = _block_rows(blocks, _take(keys, token), node)
                _step(blocks, rows, np.take(tree.branch, at), _softmax(_sum_rows(blocks, rows, _take(tree.bias, node))), n)


MINI = 16_384


def _train_task(model: ClassModel):
    def task(batches):
        own = replace(model, weights=model.weights.copy(), blocks=model.blocks.copy())
        seen = np.zeros(len(own.weights), np.float32), np.zeros(len(own.blocks), np.float32)
        for batch in batches:
            for _, _, data, offsets in text_blocks(batch.column(0)):
                h, bounds = tokens_of(data, offsets)
                distinct, at = np.unique(h, return_inverse=True)  # each word is looked up once a block
                ids, cls = (np.take(x, at) for x in own.ids(distinct))
                keys = own.keys(ids, bounds)
                for lo in range(0, len(h), MINI):
                    own.update(keys[lo: lo + MINI], ids[lo: lo + MINI], cls[lo: lo + MINI], seen)
        for kind, (w, before) in enumerate(((own.weights, model.weights), (own.blocks, model.blocks))):
            for s in range(0, len(w), SLAB):
                n = seen[kind][s: s + SLAB]
                if n.any():
                    moved = (w[s: s + SLAB] - before[s: s + SLAB]).astype(np.float16)
                    yield pa.RecordBatch.from_arrays([pa.array([2 * s + kind]), pa.array([n.tobytes()], pa.binary()), pa.array([moved.tobytes()], pa.binary())], names=["slab", "n", "w"])

    return task


def _average_task(batches):
    """Slabs arrive sorted; the weighted sums of their moves are kept one at a time."""
    slab, n, total = None, None, None

    def out():
        return pa.RecordBatch.from_arrays([pa.array([slab]), pa.array([n.tobytes()], pa.binary()), pa.array([(total / np.maximum(n, 1)[:, None]).astype(np.float16).tobytes()], pa.binary())],
                                          names=["slab", "n", "w"])

    for batch in batches:
        for s, a, b in zip(*(c.to_pylist() for c in batch.columns)):
            a, b = np.frombuffer(a, np.float32), np.frombuffer(b, np.float16).reshape(SLAB, -1)
            if s != slab:
                if slab is not None:
                    yield out()
                slab, n, total = s, np.zeros(SLAB), np.zeros(b.shape)
            n, total = n + a, total + a[:, None] * b
    if slab is not None:
        yield out()


SLABS = "slab long, n binary, w binary"


def train(texts: DataFrame, head: np.ndarray, word_class: np.ndarray, classes: Tree, tree: Tree, rounds: int = ROUNDS) -> ClassModel:
    """Weights after one epoch in `rounds` rounds; `texts` has `text` and the number `part` of the round that uses it.

    `EACH` weight blocks for classes and as many for words come with every word.
    """
    weights, blocks = (np.zeros((-(-(ROWS + EACH * len(head)) // SLAB) * SLAB, FAN), np.float32) for _ in range(2))
    model = ClassModel(WordTable(head), word_class, tree, weights, blocks, classes)
    context = texts.sparkSession.sparkContext
    for r in range(rounds):
        shared = context.broadcast(model)

        def task(batches, shared=shared):
            yield from _train_task(shared.value)(batches)

        sent = texts.where(F.col("part") == r).select("text").coalesce(context.defaultParallelism).mapInArrow(task, SLABS)
        means = sent.repartition("slab").sortWithinPartitions("slab").mapInArrow(_average_task, SLABS).toLocalIterator(prefetchPartitions=False)
        both = model.weights.copy(), model.blocks.copy()
        for slab, _, w in means:
            s, of = slab // 2, both[slab % 2]
            of[s: s + SLAB] += np.frombuffer(w, np.float16).reshape(SLAB, -1)  # rows not seen have moved by 0
        model = replace(model, weights=both[0], blocks=both[1])
        shared.destroy()  # its copies on disk go
    return model


# ---------------------------------------------------------------------------
# Scores
# ---------------------------------------------------------------------------

@dataclass
class Scorer:
    model: ClassModel
    table: WordTable
    counts: np.ndarray      # of the table's words
    tail_total: np.ndarray  # training tokens of each spelling class outside the head
    unseen: np.ndarray      # share of each spelling class for words never seen
    n: int
    v: int

    @property
    def norm(self) -> float:
        return self.n + 0.5 * (self.v + 1)

    def tail_log10(self, count, kind):
        """log10 P(word | spelling class) from its training count."""
        seen = (1 - self.unseen[kind]) * count / np.maximum(self.tail_total[kind], 1)
        return np.log10(np.where(count > 0, seen, self.unseen[kind]))

    def block(self, data: np.ndarray, offsets: np.ndarray):
        """Per row: tokens, known ones, base and model sums of all tokens in the table; and the rest as (row, hash, times)."""
        h, bounds = tokens_of(data, offsets)
        rows = len(offsets) - 1
        of = np.repeat(np.arange(rows), np.diff(bounds))
        distinct, at = np.unique(h, return_inverse=True)
        place = self.table.place(distinct)
        known = place >= 0
        leaves = len(self.model.word_class)  # the table begins with the words that have a leaf
        number, kind = self.model.ids(distinct, np.where(place < leaves, place, -1))
        count = np.where(known, self.counts[place] if len(self.counts) else 0, 0)
        base = np.where(known, np.log10((count + 0.5) / self.norm), 0.0)
        tail = np.zeros(len(distinct))
        rare = (number >= leaves) & known
        tail[rare] = self.tail_log10(count[rare], kind[rare] - CLASSES)
        ids, cls, known, base, tail = (np.take(x, at) for x in (number, kind, known, base, tail))
        keys = self.model.keys(ids, bounds)
        logs = np.empty(len(h))
        for lo in range(0, len(h), MINI):
            logs[lo: lo + MINI] = self.model.log_class(keys[lo: lo + MINI], cls[lo: lo + MINI]) + self.model.log_word(keys[lo: lo + MINI], ids[lo: lo + MINI])
        score = logs / np.log(10) + tail

        def total(x):
            return np.bincount(of, weights=x, minlength=rows)

        rest = np.flatnonzero(~known)
        return np.diff(bounds), total(known).astype(np.int64), total(base), total(score), of[rest], h[rest]


def _score_task(scorer: Scorer):
    def task(batches):
        rng = np.random.default_rng()
        for batch in batches:
            for lo, hi, data, offsets in text_blocks(batch.column(1)):
                n, known, base, score, of, rest = scorer.block(data, offsets)
                order = np.lexsort((rest, of))
                of, rest = of[order], rest[order]
                first = np.flatnonzero(np.concatenate([[True], (rest[1:] != rest[:-1]) | (of[1:] != of[:-1])])) if len(of) else np.zeros(0, np.int64)
                times = np.diff(np.append(first, len(of))).astype(np.int32)
                bounds = np.searchsorted(of[first], np.arange(hi - lo + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(rng.integers(0, 2**63, hi - lo)), pa.array(n), pa.array(known), pa.array(base), pa.array(score),
                     pa.ListArray.from_arrays(pa.array(bounds), pa.array(rest[first].astype(np.int64))), pa.ListArray.from_arrays(pa.array(bounds), pa.array(times))],
                    names=["doc_id", "rid", "n_tokens", "known", "base", "score", "rest", "times"])

    return task


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of `docs`.

    All words of a spelling class that were never seen share one probability, so `score` and `base_score` do not
    spread over the same unseen words. A null text is an empty one, whose only token is its end. Rows without an id are learnt from. Repeated rows are
    scored each on its own. Without training rows every word is one never seen.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    part = F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(ROUNDS)), F.lit(0))
    texts = docs.where(~held_out(F.col("doc_id"))).select("text", part.alias("part"))
    counts = stage(word_counts(texts), "word-counts")
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    often = counts.where(F.col("c") >= LEAST).count()
    words, word_counts_ = most_frequent(counts, max(TABLE, often))
    head, head_counts = words[: max(HEAD, often)], word_counts_[: max(HEAD, often)]
    spelling = (head & _U(7)).astype(int)
    word_class = np.concatenate([neighbour_classes(texts, head[:HEAD], head_counts[:HEAD]), CLASSES + spelling[HEAD:]]).astype(np.int64)
    # totals of the spelling classes without the words that have a leaf
    tail = F.col("h").bitwiseAND(F.lit(7))
    total, ones = np.zeros(TAILS), np.zeros(TAILS)
    for r in counts.groupBy(tail.alias("t")).agg(F.sum("c").alias("n"), F.sum((F.col("c") == 1).cast("long")).alias("ones")).collect():
        total[r["t"]], ones[r["t"]] = r["n"], r["ones"]
    np.subtract.at(total, spelling, head_counts)
    np.subtract.at(ones, spelling, (head_counts == 1).astype(float))
    leaf_class, leaf_counts = np.concatenate([word_class, CLASSES + np.arange(TAILS)]), np.concatenate([head_counts, total + 1])
    class_counts = np.bincount(leaf_class, weights=np.concatenate([head_counts, total]), minlength=WIDTH)
    classes = word_trees(np.zeros(WIDTH, int), class_counts + 0.5)  # one tree of all classes
    model = train(texts, head, word_class, classes, word_trees(leaf_class, leaf_counts))
    scorer = Scorer(model, WordTable(words), word_counts_, total, (ones + 1) / (total + 2), n, v)
    shared = spark.sparkContext.broadcast(scorer)

    def task(batches):
        yield from _score_task(shared.value)(batches)

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = stage(docs.mapInArrow(task, f"doc_id {kind}, rid long, n_tokens long, known long, base double, score double, rest array<long>, times array<int>"), "scored")
    rest = rows.select("rid", F.explode(F.arrays_zip("rest", "times")).alias("w")).select("rid", F.col("w.rest").alias("h"), F.col("w.times").alias("times"))
    c, t = F.coalesce("c", F.lit(0)), tail
    share = F.element_at(F.array(*[F.lit(float(x)) for x in scorer.unseen]), (t + 1).cast("int"))
    size = F.element_at(F.array(*[F.lit(float(max(x, 1))) for x in total]), (t + 1).cast("int"))
    word = F.log10(F.when(c > 0, (1 - share) * c / size).otherwise(share))
    sums = (rest.join(counts, "h", "left")
            .select("rid", "times", (c > 0).alias("seen"), F.log10((c + 0.5) / scorer.norm).alias("b"), word.alias("s")).groupBy("rid")
            .agg(F.sum(F.when(F.col("seen"), F.col("times"))).alias("k2"), F.sum(F.col("times") * F.col("b")).alias("b2"), F.sum(F.col("times") * F.col("s")).alias("s2")))
    out = rows.drop("rest", "times").join(sums, "rid", "left")

    def plus(a, b):
        return F.col(a) + F.coalesce(F.col(b), F.lit(0))

    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", plus("known", "k2").cast("long").alias("n_known"),
                      F.lit(n).cast("long").alias("train_tokens"), plus("base", "b2").alias("base_score"), plus("score", "s2").alias("score"))
