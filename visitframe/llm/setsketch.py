"""Near-duplicate documents by SetSketch registers.

Every document's set of word shingles gets `m` registers. Register i holds the
exponentially spaced, truncated minimum of an exponential hash over the set:
`floor(1 - log_b(min))` within 0..q+1. Registers of a union are the larger ones,
so sketches merge, and the share of equal registers follows the Jaccard
similarity, so bands of registers find candidates. For a pair, the counts of
larger, smaller and equal registers give a maximum-likelihood estimate of the
similarity; pairs that pass it are confirmed on the full sets in whole numbers.

Sizes: equal sets are one node from the start, so copies cost nothing. Within a
bucket of equal band values all members are compared with one hub, the member
that shares most buckets (a star, never all pairs). What is then still in another
component is compared through the shingles themselves. Let a shingle be rare if
at most `RARE` of these sets hold it. Two sets that share no rare shingle share at
most the smaller number of their common ones, so either they share a rare shingle
(at most `RARE` partners each) or both consist of common shingles almost entirely,
which is what the hub has already gathered. No link is lost to either rule.
Apart from rare shingles, joins have unique keys on one side, which lets Spark
split a hot bucket or a hot hub. Few pairs, registers or sets are broadcast, beyond
a bound they are joined: on small tables the shuffles cost more than the work.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitframe.llm.blocks import NOT_SPACE, mix, shingle_sets, text_blocks, words_of
from visitframe.llm.components import star_forest
from visitframe.scaling import broadcast_if_small
from visitframe.session import stage

_U = np.uint64
ID_ROWS = 500_000  # candidate ids (one long each) that may be broadcast
SMALL_ROWS = 50_000  # pairs, classes or set ids (short rows) that may be broadcast: then the wide side stays where it is
REG_ROWS = 20_000  # register rows (some 300 bytes each) that may be broadcast
SET_BYTES = 8 << 20  # bytes of shingle sets that may be broadcast
RARE = 12


@dataclass(frozen=True)
class Sketch:
    """m registers with base b, rate a and top value q+1; bands of `rows` registers."""

    m: int = 128
    rows: int = 4
    b: float = 1.001
    a: float = 20.0
    q: int = 65_533
    seed: int = 42

    @property
    def bands(self) -> int:
        return self.m // self.rows

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.default_rng(self.seed)
        return (rng.integers(0, 2**32, self.m, dtype=np.uint32) | np.uint32(1), rng.integers(0, 2**32, self.m, dtype=np.uint32))

    def registers(self, sets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """uint16 registers of each set (rows x m); 0 for an empty set."""
        filled = np.flatnonzero(np.diff(bounds) > 0)
        out = np.zeros((len(bounds) - 1, self.m), np.uint16)
        if not len(filled):
            return out
        x, first = (mix(sets) >> _U(32)).astype(np.uint32), bounds[:-1][filled]
        least = np.empty((self.m, len(filled)), np.uint32)
        mul, add = self.hashes()
        for i in range(self.m):
            h = x * mul[i]
            h ^= h >> np.uint32(16)
            h += add[i]
            least[i] = np.minimum.reduceat(h, first)
        # the smallest uniform hash is the smallest exponential one
        expo = -np.log1p(-(least.T.astype(np.float64) + 0.5) / 2.0**32) / self.a
        out[filled] = np.clip(np.floor(1 - np.log(expo) / np.log(self.b)), 0, self.q + 1).astype(np.uint16)
        return out

    def merge(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.maximum(x, y)

    def band_keys(self, registers: np.ndarray) -> np.ndarray:
        """One 64-bit value per band (rows x bands)."""
        cut = registers.astype(_U).reshape(len(registers), self.bands, self.rows)
        h = np.broadcast_to(np.arange(self.bands, dtype=_U) + _U(1), cut.shape[:2]).copy()
        with np.errstate(over="ignore"):
            for j in range(self.rows):
                h = mix(h * _U(0x9E3779B97F4A7C15) + cut[:, :, j] + _U(1))
        return h

    def likelihood(self, x: np.ndarray, y: np.ndarray, n_x: np.ndarray, n_y: np.ndarray, steps: int = 40) -> np.ndarray:
        """Jaccard similarity of pairs of register rows that makes the observed order counts likeliest.

        With shares u, v of the set sizes, a register of x is larger with probability p(u - vJ) and smaller with
        p(v - uJ), where p(t) = -log_b(1 - t (b-1)/b). The log-likelihood is concave in J; its maximum is bracketed.
        """
        more, less = (x > y).sum(1), (x < y).sum(1)
        same = x.shape[1] - more - less
        u = n_x / np.maximum(n_x + n_y, 1)
        v = 1 - u

        def p(t):
            return -np.log1p(-np.clip(t, 0, 1) * (self.b - 1) / self.b) / np.log(self.b)

        def value(j):
            a, b = p(u - v * j), p(v - u * j)
            return more * np.log(np.maximum(a, 1e-300)) + less * np.log(np.maximum(b, 1e-300)) + same * np.log(np.maximum(1 - a - b, 1e-300))

        top = np.minimum(np.divide(u, np.maximum(v, 1e-12)), np.divide(v, np.maximum(u, 1e-12)))
        lo, hi, g = np.zeros(len(x)), np.minimum(top, 1.0), (np.sqrt(5) - 1) / 2
        for _ in range(steps):
            c, d = hi - g * (hi - lo), lo + g * (hi - lo)
            left = value(c) > value(d)
            hi, lo = np.where(left, d, hi), np.where(left, lo, c)
        return (lo + hi) / 2


DEFAULT = Sketch()


def set_id(sets: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """128-bit identity of each set: two wrapping sums of scrambled members."""
    with np.errstate(over="ignore"):
        sums = [np.concatenate([[_U(0)], np.cumsum(mix(sets ^ _U(s)), dtype=_U)]) for s in (0x243F6A8885A308D3, 0x13198A2E03707344)]
        both = np.stack([s[bounds[1:]] - s[bounds[:-1]] for s in sums], 1)
    raw = both.astype(">u8").tobytes()
    return [raw[i: i + 16] for i in range(0, len(raw), 16)]


def _sketch_task(k: int, sketch: Sketch):
    def task(batches):
        for batch in batches:
            for lo, hi, data, offsets in text_blocks(batch.column(1)):
                sets, bounds = shingle_sets(words_of(data, offsets, NOT_SPACE), k)
                regs = sketch.registers(sets, bounds)
                keys = sketch.band_keys(regs).astype(np.int64)
                n = np.diff(bounds)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(set_id(sets, bounds), pa.binary()),
                     pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel()), sketch.bands).cast(pa.list_(pa.int64())),
                     pa.array([r.tobytes() for r in regs], pa.binary())],
                    names=["doc_id", "n_shingles", "sid", "bands", "regs"])
    return task


def _set_task(k: int):
    def task(batches):
        for batch in batches:
            for _, _, data, offsets in text_blocks(batch.column(1)):
                sets, bounds = shingle_sets(words_of(data, offsets, NOT_SPACE), k)
                raw = sets.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(set_id(sets, bounds), pa.binary()), pa.array([raw[8 * a: 8 * b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())], pa.binary())],
                    names=["sid", "members"])
    return task


def _explode_task(batches):
    for batch in batches:
        sets = [np.frombuffer(raw, np.int64) for raw in batch.column(1).to_pylist()]
        if sets:
            owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), pa.array(np.concatenate(sets))], names=["sid", "member"])


def _estimate_task(sketch: Sketch, least: float):
    def task(batches):
        for batch in batches:
            t = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            x, y = (np.frombuffer(b"".join(t[c].to_pylist()), np.uint16).reshape(-1, sketch.m) for c in ("regs_a", "regs_b"))
            if not len(x):
                continue
            j = sketch.likelihood(x, y, t["n_a"].to_numpy(), t["n_b"].to_numpy())
            keep = pa.array(j >= least)
            yield pa.RecordBatch.from_arrays([t["a"].filter(keep), t["b"].filter(keep)], names=["a", "b"])
    return task


def _verify_task(num: int, den: int):
    def task(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                xy = np.sort(np.concatenate([x, y]))
                both = np.count_nonzero(xy[1:] == xy[:-1])
                keep.append(den * both >= num * (len(x) + len(y) - both))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])
    return task


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("sid")).union(pairs.select(F.col("b").alias("sid")))


class NearDuplicates:
    """Classes of documents linked by `den * intersection >= num * union` of their k-word shingle sets.

    Null and empty texts and null ids are never linked. Rows with the same id and different texts are nodes of
    their own; a class is named by its smallest doc_id.
    """

    def __init__(self, docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, sketch: Sketch = DEFAULT,
                 slack: float = 0.25, id_col: str = "doc_id", text_col: str = "text"):
        self.docs, self.k, self.num, self.den, self.sketch, self.slack = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), k, num, den, sketch, slack

    def sketches(self) -> DataFrame:
        """One row per document: n_shingles, identity of its set, band values, registers."""
        kind = self.docs.schema["doc_id"].dataType.simpleString()
        return self.docs.mapInArrow(_sketch_task(self.k, self.sketch), f"doc_id {kind}, n_shingles long, sid binary, bands array<long>, regs binary")

    def _fits(self, a: str, b: str):
        """Sizes alone allow the similarity."""
        return F.lit(self.den) * F.least(a, b) >= F.lit(self.num) * F.greatest(a, b)

    def _sets(self, wanted: DataFrame, nodes: DataFrame) -> DataFrame:
        """(sid, members) of the wanted sets, from the texts again: their ids are broadcast if they are few, else joined."""
        ids = stage(nodes.join(broadcast_if_small(wanted, SMALL_ROWS), "sid", "left_semi").select(F.col("first_id").alias("doc_id")), "candidate-ids")
        texts = self.docs.join(broadcast_if_small(ids, ID_ROWS), "doc_id", "left_semi")
        # rows with one id may differ in text: each set once
        return texts.mapInArrow(_set_task(self.k), "sid binary, members binary").groupBy("sid").agg(F.min("members").alias("members"))

    def confirm(self, pairs: DataFrame, nodes: DataFrame) -> DataFrame:
        """Pairs (a, b) of set ids that are linked: estimate by likelihood, then count on full sets."""
        pairs = stage(pairs, "pairs")
        regs = nodes.select("sid", "regs", F.col("n_shingles").alias("n"))
        ends = stage(_ends(pairs).distinct(), "ends")
        if ends.count() <= REG_ROWS:
            regs = F.broadcast(stage(regs.join(F.broadcast(ends), "sid", "left_semi"), "regs"))
        both = (broadcast_if_small(pairs, SMALL_ROWS).join(regs.select(F.col("sid").alias("a"), F.col("regs").alias("regs_a"), F.col("n").alias("n_a")), "a")
                .join(regs.select(F.col("sid").alias("b"), F.col("regs").alias("regs_b"), F.col("n").alias("n_b")), "b"))
        likely = stage(both.select("a", "b", "n_a", "n_b", "regs_a", "regs_b")
                       .mapInArrow(_estimate_task(self.sketch, self.num / self.den - self.slack), "a binary, b binary"), "likely")
        sets = stage(self._sets(_ends(likely), nodes), "sets")
        if (sets.agg(F.sum(F.length("members"))).first()[0] or 0) <= SET_BYTES:
            sets = F.broadcast(sets)
        both = (likely.join(sets.select(F.col("sid").alias("a"), F.col("members").alias("x")), "a")
                .join(sets.select(F.col("sid").alias("b"), F.col("members").alias("y")), "b"))
        return stage(both.select("a", "b", "x", "y").mapInArrow(_verify_task(self.num, self.den), "a binary, b binary"), "links")

    def _stars(self, members: DataFrame, centre: Column) -> DataFrame:
        """Pairs of each bucket's members with its hub, the most central one."""
        hub = members.groupBy("key").agg(F.max(F.struct(centre.alias("centre"), "sid", "n")).alias("hub"))
        return (members.join(hub, "key").where(F.col("sid") != F.col("hub.sid"))
                .withColumn("hub_n", F.col("hub.n")).where(self._fits("n", "hub_n"))
                .select(F.least("sid", "hub.sid").alias("a"), F.greatest("sid", "hub.sid").alias("b")).distinct())

    @staticmethod
    def _open(members: DataFrame) -> DataFrame:
        """Members of buckets that hold more than one component."""
        mixed = members.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
        return members.join(mixed, "key", "left_semi")

    def _rare(self, members: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
        """From members (key, sid, n, comp) of open buckets: pairs of different components that share a rare shingle,
        and the members that can be linked without one, with `common`, the number of their shingles that are not rare."""
        known = stage(members.select("sid", "n", "comp").distinct(), "open-nodes")
        held = self._sets(known.select("sid"), nodes).mapInArrow(_explode_task, "sid binary, member long")
        held = stage(held.join(broadcast_if_small(known, SMALL_ROWS), "sid"), "open-members")
        held = stage(held.join(held.groupBy("member").agg(F.count("*").alias("f")), "member"), "counted-members")
        rare = held.where(F.col("f") <= RARE)
        other = rare.where("f > 1").select("member", F.col("sid").alias("b"), F.col("n").alias("n_b"), F.col("comp").alias("comp_b"))
        pairs = (rare.where("f > 1").select("member", F.col("sid").alias("a"), "n", "comp").join(other, "member")
                 .where((F.col("comp") < F.col("comp_b")) & self._fits("n", "n_b")).select("a", "b").distinct())
        # a link without a rare shingle needs (den + num) * common >= num * (n_a + n_b), and den * n_b >= num * n_a
        own = held.groupBy("sid").agg(F.count_if(F.col("f") > RARE).alias("common"))
        full = members.join(own, "sid")
        return pairs, full.where(F.lit(self.den) * F.col("common") >= F.lit(self.num) * F.col("n"))

    def _common_pairs(self, full: DataFrame) -> DataFrame:
        """Pairs of different components that consist of common shingles enough to be linked by them.

        A pair that shares several buckets is formed in the first of them only.
        """
        num, den = F.lit(self.num), F.lit(self.den)
        full = full.join(full.groupBy("sid").agg(F.array_sort(F.collect_set("key")).alias("keys")), "sid")
        other = full.select("key", F.col("sid").alias("b"), F.col("n").alias("n_b"), F.col("comp").alias("comp_b"), F.col("common").alias("common_b"), F.col("keys").alias("keys_b"))
        return (full.withColumnRenamed("sid", "a").join(other, "key")
                .where((F.col("comp") < F.col("comp_b")) & self._fits("n", "n_b") & ((den + num) * F.least("common", "common_b") >= num * (F.col("n") + F.col("n_b")))
                       & (F.array_intersect("keys", "keys_b")[0] == F.col("key")))
                .select("a", "b"))

    @staticmethod
    def _with_comp(rows: DataFrame, forest: DataFrame) -> DataFrame:
        """Rows with `comp`, the smallest set id of their component; a set without links is its own."""
        comps = forest.select(F.col("b").alias("sid"), F.col("a").alias("comp"))
        return rows.join(broadcast_if_small(comps, SMALL_ROWS), "sid", "left").withColumn("comp", F.coalesce("comp", "sid"))

    def _still_open(self, members: DataFrame, forest: DataFrame) -> DataFrame:
        return stage(self._open(stage(self._with_comp(members.drop("comp"), forest), "members")), "open")

    def classes(self) -> DataFrame:
        """doc_id, n_shingles, component_id, kept for every document."""
        rows = stage(self.sketches(), "sketches")
        known = rows.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
        nodes = stage(known.groupBy("sid").agg(F.min("doc_id").alias("first_id"), F.min("n_shingles").alias("n_shingles"),
                                               F.min("bands").alias("bands"), F.min("regs").alias("regs")), "nodes")
        spread = nodes.select("sid", F.col("n_shingles").alias("n"), F.explode("bands").alias("key"))
        shared = spread.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
        members = stage(spread.join(shared, "key"), "members")
        degree = members.groupBy("sid").agg(F.sum("c").alias("degree"))
        members = stage(members.drop("c").join(degree, "sid"), "members")

        forest = star_forest(self.confirm(self._stars(members, F.col("degree")), nodes))
        left = self._still_open(members, forest)
        if not left.isEmpty():
            pairs, full = self._rare(left, nodes)
            # the set with most common shingles and fewest others is the centre of its bucket: an original among edited copies
            full = stage(self._open(stage(full, "full")), "full-open")
            pairs = pairs.union(self._stars(full, F.struct("common", (-F.col("n")).alias("others")))).distinct()
            forest = star_forest(forest.union(self.confirm(pairs, nodes)))
            full = self._still_open(full, forest)
            if not full.isEmpty():
                forest = star_forest(forest.union(self.confirm(self._common_pairs(full), nodes)))
        # a class is named by the smallest id of its documents
        roots = self._with_comp(nodes.select("sid", "first_id"), forest)
        names = roots.groupBy("comp").agg(F.min("first_id").alias("component_id"))
        names = stage(roots.select("sid", "comp").join(names, "comp").select("sid", "component_id"), "names")
        out = rows.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("sid")).alias("sid")).join(names, "sid", "left")
        out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
        return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
