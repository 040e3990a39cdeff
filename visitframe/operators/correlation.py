"""Correlations: weighted sums, ranks by distinct value, and whole matrices from masked products."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitframe.scaling import average_ranks, null_safe_join
from visitframe.session import stage

#: distinct (column, value) cells whose ranks a task may hold, 16 bytes each
RANK_CELLS = 4_000_000
SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy")


def _from_sums(s: DataFrame, keys: Sequence[str]) -> DataFrame:
    cov = F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")
    var = F.sqrt(F.col("n") * F.col("sxx") - F.col("sx") ** 2) * F.sqrt(F.col("n") * F.col("syy") - F.col("sy") ** 2)
    return s.select(*keys, F.col("n"), F.try_divide(cov, var).alias("r"))


def weighted_corr(df: DataFrame, by: Sequence[str], x: str, y: str, w: str) -> DataFrame:
    X, Y, Wt = F.col(x), F.col(y), F.col(w)
    s = df.groupBy(*by).agg(F.sum(Wt).alias("n"), F.sum(Wt * X).alias("sx"), F.sum(Wt * Y).alias("sy"), F.sum(Wt * X * X).alias("sxx"),
                            F.sum(Wt * Y * Y).alias("syy"), F.sum(Wt * X * Y).alias("sxy"))
    return _from_sums(s, by)


def spearman(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Rank correlation over pairs where both are known; equal pairs are counted once with a weight."""
    by = list(by)
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by, F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count("*").alias("w"))
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, F.col(x).alias("x"), F.col(y).alias("y"))
    both = rows.select(*by, F.inline(F.array(*[F.struct(F.lit(s).alias("side"), F.col(s).cast("double").alias("v")) for s in ("x", "y")])))
    ranks = average_ranks(both, [*by, "side"], "v", "r")
    for s in ("x", "y"):
        one = ranks.where(F.col("side") == s).select(*by, F.col("v").alias(f"__{s}"), F.col("r").alias(f"r{s}"))
        d = null_safe_join(d.withColumn(f"__{s}", F.col(s).cast("double")), one, [*by, f"__{s}"], "inner")
    return weighted_corr(d, by, "rx", "ry", "w")


# ---- matrices ----------------------------------------------------------------------------

def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Values (0 where unknown) and masks, one row per record."""
    known = np.stack([c.is_valid().to_numpy(zero_copy_only=False) for c in batch.columns], 1)
    values = np.stack([c.fill_null(0.0).to_numpy(zero_copy_only=False) for c in batch.columns], 1)
    return values, known


def _summed(d: DataFrame, size: int, block: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """(i, j, n ... sxy) with the sums of `block(values, known)`, an array (size, size, 6), over all records.

    A task adds up its batches and gives one row per pair of columns with common records, whatever the records.
    """
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size, 6))
        for batch in batches:
            if batch.num_rows:
                total += block(*_columns(batch))
        i, j = np.nonzero(total[:, :, 0])
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), *(pa.array(total[i, j, k]) for k in range(6))], names=["i", "j", *SUMS])

    parts = d.mapInArrow(task, "i int, j int, " + ", ".join(f"{s} double" for s in SUMS))
    return parts.groupBy("i", "j").agg(*[F.sum(s).alias(s) for s in SUMS])


def _named(sums: DataFrame, cols: Sequence[str]) -> DataFrame:
    names = F.array(*[F.lit(c) for c in cols])
    out = _from_sums(sums.where("i < j"), ["i", "j"])
    return out.select(names[F.col("i")].alias("a"), names[F.col("j")].alias("b"), F.col("n").cast("long").alias("n"), "r")


def pearson_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(a, b, n, r) for every pair of columns over the rows where both are known; unknown: null, not a number, infinite.

    Two passes: the means, then the products of centred values and masks (M'M, X'M, (X^2)'M, X'X) batch by batch.
    """
    finite = lambda c: F.when(F.abs(c) < float("inf"), c)
    d = df.select(*[finite(F.col(c).cast("double")).alias(f"x{i}") for i, c in enumerate(cols)])
    mean = np.array([m or 0.0 for m in d.agg(*[F.avg(c) for c in d.columns]).first()])

    def block(values, known):
        m = known.astype(np.float64)
        x = (values - mean) * m
        s, ss = x.T @ m, (x * x).T @ m
        return np.stack([m.T @ m, s, s.T, ss, ss.T, x.T @ x], 2)

    return _named(_summed(d, len(cols), block), cols)


def spearman_matrix(df: DataFrame, cols: Sequence[str], rank_cells: int | None = None) -> DataFrame:
    """(a, b, n, r) of mean ranks for every pair of columns, each pair ranked over the rows where both are known.

    Columns that are known in the same rows share their ranks: a column is ranked once per pattern of missing rows that
    takes some of its rows away. The ranks of distinct values are exact and are looked up inside tasks by binary search
    as far as they fit `rank_cells`, the smallest first; columns with more distinct values are joined to their ranks pair
    by pair. Not-a-number is a value above all others.
    """
    p = len(cols)
    limit = RANK_CELLS if rank_cells is None else rank_cells
    d = stage(df.select(*[(F.col(c).cast("double") + F.lit(0.0)).alias(f"x{i}") for i, c in enumerate(cols)]), "ranked-columns")

    def masks(_, known):
        m = known.astype(np.float64)
        return np.repeat((m.T @ m)[:, :, None], 6, 2)

    common = np.zeros((p, p), np.int64)
    for r in _summed(d, p, masks).select("i", "j", "n").collect():
        common[r["i"], r["j"]] = int(r["n"])
    own = common.diagonal()
    # columns known in the same rows go by the first of them
    first = [next(b for b in range(a + 1) if own[a] == own[b] == common[a, b]) for a in range(p)]
    # the ranking of column a beside column b: over all its known rows, or over those where b's pattern is known too
    ranking = {(a, b): (a, a if common[a, b] == own[a] else first[b]) for a in range(p) for b in range(p) if a != b and common[a, b]}
    keys = sorted(set(ranking.values()))
    if not keys:
        return df.sparkSession.createDataFrame([], "a string, b string, n long, r double")
    items = [F.struct(F.lit(k).alias("k"), F.when(F.col(f"x{b}").isNotNull(), F.col(f"x{a}")).alias("v")) for k, (a, b) in enumerate(keys)]
    ranks = stage(average_ranks(d.select(F.inline(F.array(*items))), ["k"], "v", "r"), "column-ranks")
    held, room = [], limit
    for r in sorted(ranks.groupBy("k").count().collect(), key=lambda r: (r["count"], r["k"])):
        room -= r["count"]
        if room >= 0:
            held.append(r["k"])
    known_ranks = ranks.where(F.col("k").isin(held)).sort("k", "v").toArrow() if held else None
    table = {}
    if held:
        k, v, r = (known_ranks.column(c).to_numpy() for c in ("k", "v", "r"))
        edge = np.searchsorted(k, np.arange(len(keys) + 1))
        # ranks are centred: sums of their products stay small
        table = {keys[i]: (v[edge[i]:edge[i + 1]], r[edge[i]:edge[i + 1]] - (common[keys[i]] + 1) / 2) for i in held}
    quick = [(a, b) for a, b in ranking if a < b and ranking[a, b] in table and ranking[b, a] in table]
    shared = df.sparkSession.sparkContext.broadcast(table)

    def block(values, known):
        looked = {}

        def ranked(key):
            if key not in looked:
                v, r = shared.value[key]
                m = known[:, key[0]] & known[:, key[1]]
                out = np.zeros(len(m))
                out[m] = r[np.searchsorted(v, values[m, key[0]])]
                looked[key] = out
            return looked[key]

        out = np.zeros((p, p, 6))
        for a, b in quick:
            # outside the rows known to both, one of the two ranks is 0, but sums of one column need the mask
            m = known[:, a] & known[:, b]
            x, y = ranked(ranking[a, b])[m], ranked(ranking[b, a])[m]
            out[a, b] = len(x), x.sum(), y.sum(), x @ x, y @ y, x @ y
        return out

    result = _named(_summed(d, p, block), cols)
    slow = [(a, b) for a, b in ranking if a < b and (a, b) not in set(quick)]
    if slow:
        pairs = [F.struct(F.lit(cols[a]).alias("a"), F.lit(cols[b]).alias("b"), F.col(f"x{a}").alias("u"), F.col(f"x{b}").alias("v")) for a, b in slow]
        result = result.unionByName(spearman(d.select(F.inline(F.array(*pairs))), "u", "v", ["a", "b"]))
    return result


def corr_matrix(df: DataFrame, cols: Sequence[str], method: str = "spearman") -> DataFrame:
    """(a, b, n, r) for every pair of columns with common rows, pairwise complete."""
    return pearson_matrix(df, cols) if method == "pearson" else spearman_matrix(df, cols)
