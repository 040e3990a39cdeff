"""Skew-safe building blocks that the operators share.

Three shapes of work would otherwise gather an unbounded group in one task:

* ordered windows per entity, when one entity holds a large share of all rows (`Timeline`);
* global or per-group ranks and prefix sums over a numeric order (`prefix_sums`);
* pseudo-random order by a hash of the key (`rank_by_md5`).

Each splits a group into ordered chunks, aggregates every chunk (with map-side
combine), scans the few chunk totals, and adds the carry back to the rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from visitframe.session import stage

HOT_ROWS = 2_000_000        # an entity above this many rows is scanned in chunks
CELLS_PER_TASK = 1_000_000  # distinct order values one prefix-sum task may hold
MAX_BUCKETS = 1_000
BROADCAST_ROWS = 200_000     # short rows only: a few tens of MB



def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """Join on columns where NULL equals NULL; the right copies of the keys are dropped."""
    renamed = right.withColumnsRenamed({c: f"__r_{c}" for c in on})
    cond = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__r_{c}")) for c in on])
    return left.join(renamed, cond, how).drop(*[f"__r_{c}" for c in on])


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a side after counting it; beyond the bound the join shuffles as usual (with AQE skew handling)."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def small_side(df: DataFrame, name: str, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """A fitted table (one row per group) for a join to rows: written once, counted, broadcast within the bound.

    Joining on a few group values by shuffle would send all rows of a group to one task.
    """
    return broadcast_if_small(stage(df, name), max_rows)


# ---------------------------------------------------------------------------
# Ordered scans per entity
# ---------------------------------------------------------------------------

@dataclass(frozen=True)
class Run:
    """One running aggregate along an entity's timeline.

    fn    sum, count, max, min, last (nearest known value), first (first known value)
    value the column it reads
    side  upto (rows up to and including this one), before, after, all
    """

    fn: str
    value: Column
    side: str = "upto"


def hot_keys(df: DataFrame, key: str, limit: int | None = None) -> DataFrame:
    """Table of the keys with more rows than one task should hold, written once; there are at most rows / limit."""
    limit = HOT_ROWS if limit is None else limit
    counts = df.groupBy(key).agg(F.count("*").alias("n"))
    return stage(counts.where(F.col("n") > limit).select(key), "hot-keys")


class Timeline:
    """A table seen as ordered rows per entity: total order `(time, *tie)` inside `key`.

    Without hot entities every running aggregate shares one exchange. Rows of a
    hot entity are cut into chunks by `chunk` (the day by default, which must be
    monotone in `time`), so no task ever holds the whole entity.
    """

    def __init__(self, df: DataFrame, key: str = "entity_id", time: str = "visit_date",
                 tie: Sequence[str] = ("visit_id",), hot: Iterable | None = None, chunk: Column | None = None):
        self.df, self.key, self.time, self.tie = df, key, time, tuple(tie)
        self._hot = hot if hot is None or isinstance(hot, DataFrame) else self._listed(list(hot))
        self._any: bool | None = None
        self.chunk = F.to_date(F.col(time)) if chunk is None else chunk

    @property
    def order(self) -> list[str]:
        return [self.time, *self.tie]

    def _listed(self, keys: list) -> DataFrame:
        kind = self.df.schema[self.key].dataType.simpleString()
        return self.df.sparkSession.createDataFrame([(k,) for k in keys], f"`{self.key}` {kind}")

    @property
    def marks(self) -> DataFrame:
        """Table of the hot entities."""
        if self._hot is None:
            self._hot = hot_keys(self.df, self.key)
        return self._hot

    @property
    def hot(self) -> bool:
        """Whether any entity is hot; looked up once for a chain of calls."""
        if self._any is None:
            self._any = not self.marks.isEmpty()
        return self._any

    def on(self, df: DataFrame) -> "Timeline":
        out = Timeline(df, self.key, self.time, self.tie, self._hot, self.chunk)
        out._any = self._any
        return out

    def with_columns(self, cols: dict[str, Column]) -> "Timeline":
        return self.on(self.df.withColumns(cols))

    def window(self, descending: bool = False, extra: Sequence[str] = ()) -> "Window":
        order = [F.col(c).desc() if descending else F.col(c).asc() for c in self.order]
        return Window.partitionBy(self.key, *extra).orderBy(*order)

    def runs(self, **runs: Run) -> "Timeline":
        """Append one column per running aggregate."""
        inputs = {f"__in_{n}": r.value for n, r in runs.items()}
        if not self.hot:
            df = self.df.withColumns(inputs)
            df = df.withColumns({n: self._local(n, r, ()) for n, r in runs.items()})
            return self.on(df.drop(*inputs))
        return self.on(self._chunked(runs, inputs).drop(*inputs))

    def _local(self, name: str, r: Run, extra: Sequence[str]) -> Column:
        value = F.col(f"__in_{name}")
        w = self.window(r.side == "after", extra)
        frame = {"upto": lambda: w.rowsBetween(Window.unboundedPreceding, 0),
                 "before": lambda: w.rowsBetween(Window.unboundedPreceding, -1),
                 "after": lambda: w.rowsBetween(Window.unboundedPreceding, -1),
                 "all": lambda: (self.window(False, extra).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
                                 if r.fn in ("first", "last") else Window.partitionBy(self.key, *extra))}[r.side]()
        agg = {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min,
               "last": lambda c: F.last(c, ignorenulls=True),
               "first": lambda c: F.first(c, ignorenulls=True)}[r.fn](value)
        return agg.over(frame)

    def marked(self) -> DataFrame:
        """Rows with `__hot` and, for hot entities only, their `__chunk`."""
        # the marks are broadcast within a bound, so that a hot entity is cut before any shuffle by entity
        marks = self.marks.toDF(self.key).withColumn("__hot", F.lit(True))
        df = null_safe_join(self.df, broadcast_if_small(marks), [self.key])
        return df.withColumn("__chunk", F.when(F.col("__hot"), self.chunk))

    def _chunked(self, runs: dict[str, Run], inputs: dict[str, Column]) -> DataFrame:
        # written once: the totals and the rows read it, and a further call reads it and not the source again
        df = stage(self.on(self.df.withColumns(inputs)).marked(), "timeline")
        pos = F.struct(*[F.col(c) for c in self.order])

        def total(name: str, r: Run) -> Column:
            v = F.col(f"__in_{name}")
            if r.fn in ("last", "first"):
                # the nearest known value on the side the carry comes from
                newest = (r.fn == "last") != (r.side == "after")
                known = F.when(v.isNotNull(), pos)
                return F.max_by(v, known) if newest else F.min_by(v, known)
            return {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min}[r.fn](v)

        totals = (df.where(F.col("__hot")).groupBy(self.key, "__chunk")
                  .agg(*[total(n, r).alias(f"__t_{n}") for n, r in runs.items()]))
        asc = Window.partitionBy(self.key).orderBy("__chunk")
        desc = Window.partitionBy(self.key).orderBy(F.col("__chunk").desc())

        def carry(name: str, r: Run) -> Column:
            v = F.col(f"__t_{name}")
            w = desc if r.side == "after" else asc
            upper = Window.unboundedFollowing if r.side == "all" else -1
            frame = w.rowsBetween(Window.unboundedPreceding, upper)
            agg = {"sum": F.sum, "count": F.sum, "max": F.max, "min": F.min,
                   "last": lambda c: F.last(c, ignorenulls=True),
                   "first": lambda c: F.first(c, ignorenulls=True)}[r.fn](v)
            return agg.over(frame).alias(f"__c_{name}")

        carries = totals.select(self.key, "__chunk", *[carry(n, r) for n, r in runs.items()])
        df = df.withColumns({n: self._local(n, r, ["__chunk"]) for n, r in runs.items()})
        df = null_safe_join(df, carries, [self.key, "__chunk"])

        def combine(name: str, r: Run) -> Column:
            here, before = F.col(name), F.col(f"__c_{name}")
            if r.side == "all":
                return F.when(F.col("__hot"), before).otherwise(here)
            if r.fn == "count":
                return F.coalesce(here, F.lit(0)) + F.coalesce(before, F.lit(0))
            if r.fn == "sum":
                return F.coalesce(here + before, here, before)
            if r.fn in ("max", "min"):
                return (F.greatest if r.fn == "max" else F.least)(here, before)
            near, far = (here, before) if r.fn == "last" else (before, here)
            return F.coalesce(near, far)

        df = df.withColumns({n: combine(n, r) for n, r in runs.items()})
        return df.drop("__hot", "__chunk", *[f"__c_{n}" for n in runs])


# ---------------------------------------------------------------------------
# Ranks, prefix sums and quantiles over a numeric order
# ---------------------------------------------------------------------------

def bucket_edges(cells: DataFrame, order: str, cells_per_task: int) -> list[float]:
    """Edges that cut the order column into even buckets; empty when one task can hold everything.

    The edges only balance the work. They are read back once, as literals, so
    that every branch of the plan sees the same buckets.
    """
    n = cells.count()
    if n <= cells_per_task:
        return []
    k = min(MAX_BUCKETS, -(-n // cells_per_task) * 2)
    probs = [i / k for i in range(1, k)]
    edges = cells.agg(F.percentile_approx(F.col(order).cast("double"), probs, 10_000)).first()[0]
    return sorted(set(edges or []))


def bucket_of(order: str, edges: list[float]) -> Column:
    """Number of edges below the value, by binary search written as nested conditions."""
    v = F.col(order).cast("double")

    def search(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(v > F.lit(edges[mid]), search(mid + 1, hi)).otherwise(search(lo, mid))

    return search(0, len(edges))


def prefix_sums(cells: DataFrame, by: Sequence[str], order: str, sums: Sequence[str],
                cells_per_task: int | None = None, bounded: bool = False) -> DataFrame:
    """Add `<s>_before` (sum over smaller order values of the group) and `<s>_total`.

    `cells` has one row per (by, order); pre-aggregate first. With `bounded` the
    caller states that a group cannot exceed one task (for example one row per
    day), and the size check is left out. Otherwise the cells are written once
    to the shared folder, so their input is read a single time.
    """
    if not bounded:
        cells = stage(cells, "cells")
    edges = [] if bounded else bucket_edges(cells, order, cells_per_task or CELLS_PER_TASK)
    by = list(by)
    if not edges:
        w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
        prior = w.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return cells.withColumns({f"{s}_before": F.coalesce(F.sum(s).over(prior), F.lit(0)) for s in sums}
                                 | {f"{s}_total": F.sum(s).over(w) for s in sums})
    df = cells.withColumn("__b", bucket_of(order, edges))
    keys = [*by, "__b"]
    totals = df.groupBy(*keys).agg(*[F.sum(s).alias(f"__t_{s}") for s in sums])
    g = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    prior = g.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(*keys, *[F.coalesce(F.sum(f"__t_{s}").over(prior), F.lit(0)).alias(f"__c_{s}") for s in sums],
                          *[F.sum(f"__t_{s}").over(g).alias(f"{s}_total") for s in sums])
    local = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumns({f"{s}_before": F.coalesce(F.sum(s).over(local), F.lit(0)) for s in sums})
    df = null_safe_join(df, carry, keys)
    return (df.withColumns({f"{s}_before": F.col(f"{s}_before") + F.col(f"__c_{s}") for s in sums})
            .drop("__b", *[f"__c_{s}" for s in sums]))


def value_cells(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Known values of a column with their counts."""
    return (df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n")))


def exact_quantiles(df: DataFrame, by: Sequence[str], value: str, probs: dict[str, float], **kw) -> DataFrame:
    """Exact quantiles with linear interpolation, one column per entry of `probs`.

    Works on distinct values and their cumulative counts, so a group of any size
    is spread over many tasks.
    """
    cells = prefix_sums(value_cells(df, by, value), by, value, ["n"], **kw)
    v, before, n = F.col(value).cast("double"), F.col("n_before"), F.col("n_total")

    def at(pos: Column) -> Column:
        return F.max(F.when((before <= pos) & (pos < before + F.col("n")), v))

    exprs = []
    for name, q in probs.items():
        pos = F.lit(float(q)) * (n - 1)
        exprs += [at(F.floor(pos)).alias(f"__lo_{name}"), at(F.ceil(pos)).alias(f"__hi_{name}"),
                  F.max(pos - F.floor(pos)).alias(f"__f_{name}")]
    out = cells.groupBy(*by).agg(*exprs)
    return out.select(*by, *[
        (F.col(f"__lo_{p}") + (F.col(f"__hi_{p}") - F.col(f"__lo_{p}")) * F.col(f"__f_{p}")).alias(p) for p in probs])


def average_ranks(df: DataFrame, by: Sequence[str], value: str, out: str, **kw) -> DataFrame:
    """(by, value) → rank with ties sharing their mean rank."""
    cells = prefix_sums(value_cells(df, by, value), by, value, ["n"], **kw)
    return cells.select(*by, value, (F.col("n_before") + (F.col("n") + 1) / F.lit(2.0)).alias(out))


# ---------------------------------------------------------------------------
# Pseudo-random order
# ---------------------------------------------------------------------------

def md5_key(*parts: Column | str, seed: str = "") -> Column:
    """Hex draw for a row: md5 of its key columns and a seed, the same in any SQL engine."""
    return F.md5(F.concat_ws("|", *[col(p).cast("string") for p in parts], F.lit(seed)))


def rank_by_md5(df: DataFrame, by: Sequence[str], key: str, seed: str, out: str = "rk", total: str | None = None) -> DataFrame:
    """0-based position of each row in md5 order within `by`, in 65,536 evenly filled buckets per group."""
    by = list(by)
    df = df.withColumn("__h", md5_key(key, seed=seed)).withColumn("__b", F.substring("__h", 1, 4))
    keys = [*by, "__b"]
    totals = df.groupBy(*keys).agg(F.count("*").alias("__n"))
    g = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    carry = totals.select(*keys, F.coalesce(F.sum("__n").over(
        g.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__c"), F.sum("__n").over(g).alias("__tot"))
    local = Window.partitionBy(*keys).orderBy("__h", key)
    df = null_safe_join(df.withColumn("__r", F.row_number().over(local) - 1), carry, keys)
    df = df.withColumn(out, (F.col("__r") + F.col("__c")).cast("long"))
    if total:
        df = df.withColumn(total, F.col("__tot"))
    return df.drop("__h", "__b", "__r", "__c", "__tot")


# ---------------------------------------------------------------------------
# Picking one or a few rows per key
# ---------------------------------------------------------------------------

def pick_row(df: DataFrame, by: Sequence[str], order: Sequence[Column], cols: Sequence[str], last: bool = False) -> DataFrame:
    """First (or last) row per key as an aggregate: combines on the map side, so a hot key is no problem."""
    order_s = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    agg = F.max_by if last else F.min_by
    picked = df.groupBy(*by).agg(agg(F.struct(*[F.col(c) for c in cols]), order_s).alias("__p"))
    return picked.select(*by, *[F.col(f"__p.{c}").alias(c) for c in cols])


def top_k(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """k best rows per key. Spark limits each map task to k rows per key before the shuffle."""
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    return df.withColumn(rank, F.row_number().over(w.orderBy(*order))).where(F.col(rank) <= k)
