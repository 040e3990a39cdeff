"""Evaluation metrics as grouped queries over (by…, y, p).

Scores are first reduced to cells of (group, score) with counts, so ties are
exact and the ranking step sees distinct scores only.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from visitframe.functions.columns import logit, qcut
from visitframe.functions.md5 import leading_draws
from visitframe.operators.correlation import spearman
from visitframe.operators.profile import unpivot
from visitframe.session import spread, stage
from visitframe.scaling import broadcast_if_small, bucket_edges, bucket_of, md5_key, null_safe_join, prefix_sums, rank_by_md5, small_side


#: cells that one node of a bootstrap tree deals to, and the bits (children) of an inner node
NODE_CELLS, FAN_BITS = 512, 9
#: cells of one sorted chunk of a score
CHUNK_CELLS = 2_000
#: row positions in one list, draws hashed at once, and weights that a task of row draws may hold
POSITIONS, HASHED, HELD_WEIGHTS = 1 << 16, 1 << 14, 1 << 24
#: binary digits of a time's number that are compared at once, and cells of a group of times above which it is cut by risk
TIME_BITS, RISK_CELLS = 8, 100_000


def score_cells(df: DataFrame, by: Sequence[str], p: str = "p", y: str = "y", w: Column | None = None) -> DataFrame:
    w = F.lit(1) if w is None else w
    return (df.where(F.col(p).isNotNull() & F.col(y).isNotNull()).groupBy(*by, F.col(p).alias("p"))
            .agg(F.sum(w * F.col(y)).alias("pos"), F.sum(w * (1 - F.col(y))).alias("neg")).where("pos + neg > 0"))


def ranking_metrics(cells: DataFrame, by: Sequence[str], **kw) -> DataFrame:
    """AUROC (ties ½), average precision (step form), Brier, n and events, all from one pass over the ranked cells."""
    c = prefix_sums(cells, by, "p", ["pos", "neg"], **kw)
    pos, neg, P, N = (F.col(x) for x in ("pos", "neg", "pos_total", "neg_total"))
    tp, fp = P - F.col("pos_before"), N - F.col("neg_before")
    two = (P > 0) & (N > 0)
    n = F.sum(pos + neg)
    return c.groupBy(*by).agg(
        n.cast("long").alias("n"), F.sum(pos).cast("long").alias("events"),
        F.sum(F.when(two, pos * (F.col("neg_before") + neg / 2) / (P * N))).alias("auroc"),
        F.sum(F.when(two, pos / P * (tp / (tp + fp)))).alias("auprc"),
        (F.sum(pos * (F.col("p") - 1) * (F.col("p") - 1) + neg * F.col("p") * F.col("p")) / n).alias("brier"))


def auroc(df: DataFrame, by: Sequence[str] = (), p: str = "p", y: str = "y", **kw) -> DataFrame:
    return ranking_metrics(score_cells(df, by, p, y), by, **kw).select(*by, "n", "events", "auroc")


def average_precision(df: DataFrame, by: Sequence[str] = (), p: str = "p", y: str = "y", **kw) -> DataFrame:
    return ranking_metrics(score_cells(df, by, p, y), by, **kw).select(*by, "n", "events", "auprc")


def brier(df: DataFrame, by: Sequence[str] = (), base_rate: Column | None = None) -> DataFrame:
    """Brier score, and that of always predicting the base rate."""
    out = [F.avg((F.col("p") - F.col("y")) ** 2).alias("brier")]
    if base_rate is not None:
        df = df.withColumn("__b", base_rate)
        out.append(F.avg((F.col("__b") - F.col("y")) ** 2).alias("brier_base"))
    return df.groupBy(*by).agg(*out)


# ---- bootstrap -----------------------------------------------------------------------

def _poisson_one(u: Column) -> Column:
    """Poisson(1) draw from a uniform number by its inverse distribution."""
    cum, term, out = 0.0, 0.36787944117144233, None
    steps = []
    for k in range(0, 12):
        cum += term
        steps.append((cum, k))
        term /= k + 1
    out = F.lit(12)
    for edge, k in reversed(steps):
        out = F.when(u < edge, k).otherwise(out)
    return out


def resample(df: DataFrame, by: Sequence[str], key: str, draws: int, seed: str, method: str = "draws") -> DataFrame:
    """Rows with a replicate number and how often each was drawn.

    draws    exactly n draws with replacement: every row issues one draw per
             replicate, draws are counted per target row, then joined once.
    poisson  independent Poisson(1) weights, computed in place without a shuffle.
    """
    reps = F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("rep")
    if method == "poisson":
        u = F.conv(F.substring(md5_key(key, F.col("rep"), seed=seed), 1, 13), 16, 10).cast("double") / F.lit(float(16 ** 13))
        return df.select("*", reps).withColumn("w", _poisson_one(u)).where("w > 0")
    by = list(by)
    ranked = rank_by_md5(df, by, key, seed, "idx", total="__n")
    draw = ranked.select(*by, "idx", "__n", reps)
    hit = F.conv(F.substring(md5_key(*by, "rep", "idx", seed=seed), 1, 15), 16, 10).cast("long") % F.col("__n")
    counts = draw.groupBy(*by, "rep", hit.alias("idx")).agg(F.count("*").alias("w"))
    return null_safe_join(counts, ranked.drop("__n"), [*by, "idx"], "inner").drop("idx")


def deal_cells(cells: DataFrame, by: Sequence[str], draws: int, seed: str, per_node: int | None = None) -> DataFrame:
    """Cells (…, n) with packed weights `w`, one per replicate: exactly as many draws per group and replicate as the group has rows.

    Weight 0 is the cell's own number of rows, so replicate 0 is the table itself.

    Cells hang below a tree over the leading bits of their hash. From the top down every node deals the draws it got to
    its children by one multinomial draw per replicate, that is conditional binomials; the last level
    deals to its cells. A node is one row, so no group meets in one task, and the work is cells times draws whatever the
    number of rows. Draws depend on the seed, the group and the node alone, so a task that runs again draws the same.
    """
    by, size = list(by), per_node or NODE_CELLS
    names = [c for c in cells.columns if c != "n"]
    total = cells.count()
    bits = max(0, math.ceil(math.log2(total / size))) if total > size else 0
    marked = cells.withColumn("__h", F.xxhash64(*names, F.lit(seed)))
    node = lambda width: F.expr(f"shiftrightunsigned(__h, {64 - width})") if width else F.lit(0).cast("long")
    kinds = {f.name: f.dataType.simpleString() for f in cells.schema.fields}
    keys = "".join(f"`{c}` {kinds[c]}, " for c in by)

    inner = [c for c in names if c not in by]

    def nodes(batches: Iterator[pa.RecordBatch]):
        """(batch, row, children as structs, draws x children) of each node."""
        for batch in batches:
            at = {c: batch.schema.get_field_index(c) for c in ("kids", "drawn", "__seed")}
            for i in range(batch.num_rows):
                kids = batch.column(at["kids"])[i].values
                n = kids.field("n").to_numpy(zero_copy_only=False)
                got = batch.column(at["drawn"])[i]
                got = got.values.to_numpy() if got.is_valid else np.full(draws, n.sum())
                rng = np.random.default_rng([batch.column(at["__seed"])[i].as_py() & (2**63 - 1), len(n)])
                yield batch, i, kids, rng.multinomial(got, n / n.sum())

    def groups(batch: pa.RecordBatch, i: int, n: int) -> list[pa.Array]:
        return [batch.column(batch.schema.get_field_index(c)).take(pa.array(np.full(n, i))) for c in by]

    def to_children(batches):
        for batch, i, kids, w in nodes(batches):
            columns = [*groups(batch, i, len(kids)), kids.field("node"), pa.array(list(np.ascontiguousarray(w.T)), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=[*by, "__node", "drawn"])

    def to_cells(batches):
        for batch, i, kids, w in nodes(batches):
            own = kids.field("n").to_numpy(zero_copy_only=False)
            columns = [*groups(batch, i, len(kids)), *[kids.field(c) for c in inner], pa.array([pack_weights(np.append(n, r)) for n, r in zip(own, w.T)], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=[*by, *inner, "w"])

    def joined(kids: DataFrame, drawn: DataFrame | None) -> DataFrame:
        kids = kids.withColumn("__seed", F.xxhash64(*[F.col(c) for c in by], "__node", F.lit(seed)))
        if drawn is None:
            return spread(kids.withColumn("drawn", F.lit(None).cast("array<bigint>")))
        return null_safe_join(kids, drawn, [*by, "__node"])

    drawn, width = None, 0
    while width < bits:
        deeper = min(width + FAN_BITS, bits)
        kids = (marked.groupBy(*by, node(deeper).alias("node")).agg(F.sum("n").alias("n"))
                .withColumn("__node", F.expr(f"shiftrightunsigned(node, {deeper - width})")).groupBy(*by, "__node").agg(F.sort_array(F.collect_list(F.struct("node", "n"))).alias("kids")))
        drawn = joined(kids, drawn).mapInArrow(to_children, keys + "__node long, drawn array<bigint>")
        width = deeper
    kids = marked.groupBy(*by, node(bits).alias("__node")).agg(F.sort_array(F.collect_list(F.struct("__h", "n", *inner))).alias("kids"))
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*by, *inner])
    return joined(kids, drawn).mapInArrow(to_cells, f"{schema}, w binary")


def draw_cells(base: DataFrame, by: Sequence[str], key: str, draws: int, seed: str) -> DataFrame:
    """Distinct rows of `base` without `key`, with packed weights `w` as in `deal_cells`, from the draws of `resample` row by row.

    No row per draw exists. The cell of each position of a group is listed in md5 order, 4 bytes or 8 a row. A task takes the list
    of one group and a block of replicates, hashes all draws of these and counts them by cell; blocks are so short that
    the counts of a task stay within `HELD_WEIGHTS`. What moves is the lists, once a block, and a weight per cell and replicate.
    """
    by, names = list(by), [c for c in base.columns if c != key]
    ranked = stage(rank_by_md5(base, by, key, seed, "idx"), "row-draws")
    cells = stage(ranked.groupBy(*names).agg(F.min("idx").alias("__cell"), F.count("*").alias("n")), "draw-cells")
    most = cells.groupBy(*by).agg(F.count("*").alias("k")).agg(F.max("k")).first()[0] or 1
    reps = max(1, min(-(-draws // 16), HELD_WEIGHTS // most))
    located = null_safe_join(ranked.drop(key), broadcast_if_small(cells.drop("n")), names, "inner")
    lists = located.groupBy(*by, F.floor(F.col("idx") / POSITIONS).alias("part")).agg(F.sort_array(F.collect_list(F.struct("idx", "__cell"))).alias("s"))
    head = F.concat_ws("|", *[F.col(c).cast("string") for c in by], F.lit(""))
    lists = lists.select(*by, head.alias("__head"), "part", F.col("s.__cell").alias("at"), F.explode(F.sequence(F.lit(0), F.lit(-(-draws // reps) - 1))).alias("unit"))
    keys = [*by, "unit"]
    kinds = {f.name: f.dataType.simpleString() for f in base.schema.fields}
    of_group = "".join(f"`{c}` {kinds[c]}, " for c in by)

    def units(batches: Iterator[pa.RecordBatch]):
        """(key columns of one row, unit, head, cell of each position) unit by unit."""
        now, first, held = None, None, []
        for batch in batches:
            col = {c: batch.column(batch.schema.get_field_index(c)) for c in batch.schema.names}
            for i in range(batch.num_rows):
                key_ = tuple(col[c][i].as_py() for c in keys)
                if key_ != now:
                    if held:
                        yield *first, np.concatenate(held)
                    now, held = key_, []
                    first = [col[c].take(pa.array([i])) for c in by], key_[-1], col["__head"][i].as_py().encode()
                held.append(col["at"][i].values.to_numpy())
        if held:
            yield *first, np.concatenate(held)

    def counted(batches):
        for group, unit, head_, cell_at in units(batches):
            n = len(cell_at)
            own, cell_at = np.unique(cell_at, return_inverse=True)
            lo, hi = unit * reps + 1, min((unit + 1) * reps, draws)
            w = np.zeros((len(own), hi - lo + 1), np.uint32)
            for rep in range(lo, hi + 1):
                count = np.zeros(len(own), np.int64)
                for at in range(0, n, HASHED):
                    hit = leading_draws(head_ + f"{rep}|".encode(), at, min(at + HASHED, n), f"|{seed}".encode()) % n
                    count += np.bincount(cell_at[hit], minlength=len(own))
                w[:, rep - lo] = count
            for at in range(0, len(own), 4096):
                part = own[at:at + 4096]
                columns = [*[c.take(pa.array(np.zeros(len(part), np.int64))) for c in group], pa.array(part), pa.array(np.full(len(part), unit, np.int32)),
                           pa.array([pack_weights(r) for r in w[at:at + 4096]], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=[*by, "__cell", "unit", "w"])

    def joined(batches):
        for batch in batches:
            col = {c: batch.column(batch.schema.get_field_index(c)) for c in batch.schema.names}
            w = [pack_weights(np.concatenate([[n], *[unpack_weights(b) for b in parts]])) for n, parts in zip(col["n"].to_pylist(), col["parts"].to_pylist())]
            yield pa.RecordBatch.from_arrays([*[col[c] for c in names], pa.array(w, pa.binary())], names=[*names, "w"])

    # one task a unit, as far as hashing spreads them
    n_units = max(1, cells.select(*by).distinct().count()) * -(-draws // reps)
    drawn = (lists.repartition(min(n_units, 4_000), *keys).sortWithinPartitions(*keys, "part").drop("part")
             .mapInArrow(counted, f"{of_group}__cell long, unit int, w binary"))
    parts = drawn.groupBy(*by, "__cell").agg(F.transform(F.sort_array(F.collect_list(F.struct("unit", "w"))), lambda x: x["w"]).alias("parts"))
    every = null_safe_join(cells, parts, [*by, "__cell"], "inner")
    return every.mapInArrow(joined, ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", w binary")


def pack_weights(w: np.ndarray) -> bytes:
    """Weights in the narrowest whole numbers that hold them, after a byte with their width."""
    kind = np.min_scalar_type(int(w.max(initial=0)))
    return bytes([kind.itemsize]) + w.astype(kind).tobytes()


def unpack_weights(b: bytes) -> np.ndarray:
    return np.frombuffer(b, f"u{b[0]}", offset=1).astype(np.int64)


def explode_weights(dealt: DataFrame) -> DataFrame:
    """A row per cell and replicate that drew it; replicate 0 is the table itself."""
    rest = [c for c in dealt.columns if c != "w"]

    def task(batches):
        for batch in batches:
            at = batch.schema.get_field_index("w")
            for i in range(batch.num_rows):
                w = unpack_weights(batch.column(at)[i].as_py())
                rep = np.flatnonzero(w)
                same = pa.array(np.full(len(rep), i))
                yield pa.RecordBatch.from_arrays([*[batch.column(c).take(same) for c in range(batch.num_columns) if c != at], pa.array(rep.astype(np.int32)), pa.array(w[rep])],
                                                 names=[*rest, "rep", "w"])

    return dealt.mapInArrow(task, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema.fields if f.name != "w") + ", rep int, w long")


def replicate_metrics(dealt: DataFrame, by: Sequence[str], score: str, precision: bool = True) -> DataFrame:
    """(by, rep, n, events, auroc, auprc, brier) of one score over dealt cells (by, y, score, w), without a row per draw.

    Cells are cut into chunks by even edges of the score and sorted. A task runs through a chunk with one number per
    replicate, for all replicates at once: positives, negatives, pairs inside the chunk, squared errors. Chunk totals are
    scanned per replicate; for the average precision a second run starts each chunk from what lies above it.
    """
    by = list(by)
    cells = dealt.select(*by, F.col(score).alias("v"), "y", "w")
    edges = bucket_edges(cells, "v", CHUNK_CELLS)
    cells = cells.withColumn("chunk", bucket_of("v", edges))
    keys, kinds = [*by, "chunk"], {f.name: f.dataType.simpleString() for f in cells.schema.fields}
    schema = "".join(f"`{c}` {kinds[c]}, " for c in keys)

    def chunks(batches):
        """(key, start or None, [(score, positives, negatives)]) chunk by chunk; ties are one entry."""
        key, start, entries = None, None, []
        for batch in batches:
            cols = batch.to_pydict()
            for row in zip(*(cols[c] for c in [*keys, "v", "y", "w"])):
                if row[:-3] != key:
                    if key is not None:
                        yield key, start, entries
                    key, start, entries = row[:-3], None, []
                v, y, w = row[-3:]
                if v is None:
                    start = np.frombuffer(w).reshape(3, -1)
                    continue
                w = unpack_weights(w)
                if not entries or entries[-1][0] != v:
                    entries.append([v, None, None])     # a side without rows stays empty
                side = 1 if y else 2
                entries[-1][side] = w if entries[-1][side] is None else entries[-1][side] + w
        if key is not None:
            yield key, start, entries

    def rows(key, **columns) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        arrays = [pa.array([k] * n, pa_kinds[c]) for c, k in zip(keys, key)]
        return pa.RecordBatch.from_arrays([*arrays, pa.array(np.arange(n, dtype=np.int32)), *map(pa.array, columns.values())], names=[*keys, "rep", *columns])

    pa_kinds = {f.name: to_arrow_type(f.dataType) for f in cells.schema.fields}

    def totals(batches):
        for key, _, entries in chunks(batches):
            size = len(next(x for x in entries[0][1:] if x is not None))
            (pos, neg), (pairs, square) = np.zeros((2, size), np.int64), np.zeros((2, size))
            for v, a, b in entries:
                if a is not None:
                    pairs += a * (neg if b is None else neg + b / 2)
                    pos += a
                    square += a * (v - 1.0) ** 2
                if b is not None:
                    neg += b
                    square += b * v**2
            yield rows(key, pos=pos, neg=neg, pairs=pairs, square=square)

    def precisions(batches):
        for key, (tp, fp, all_pos), entries in chunks(batches):
            out = np.zeros(len(tp))
            for _, a, b in reversed(entries):
                fp = fp if b is None else fp + b
                if a is None:
                    continue
                tp = tp + a
                out += np.divide(a * tp, (tp + fp) * all_pos, out=np.zeros(len(a)), where=a > 0)
            yield rows(key, auprc=out)

    run = stage(cells.repartition(*keys).sortWithinPartitions(*keys, "v").mapInArrow(totals, schema + "rep int, pos long, neg long, pairs double, square double"), "replicate-chunks")
    g, up = Window.partitionBy(*by, "rep"), Window.partitionBy(*by, "rep").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy(*by, "rep").orderBy(F.col("chunk").desc()).rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    scanned = run.withColumns({"below": zero(F.sum("neg").over(up)), "tp": zero(F.sum("pos").over(down)), "fp": zero(F.sum("neg").over(down)), "all_pos": F.sum("pos").over(g)})
    P, N = F.sum("pos"), F.sum("neg")
    two = (P > 0) & (N > 0)
    out = scanned.groupBy(*by, "rep").agg((P + N).alias("n"), P.alias("events"), F.when(two, F.sum(F.col("pairs") + F.col("pos") * F.col("below")) / (P * N)).alias("auroc"),
                                          (F.sum("square") / (P + N)).alias("brier"))
    if not precision:
        return out

    part = F.sort_array(F.collect_list(F.struct("rep", "tp", "fp", "all_pos")))
    heads = scanned.groupBy(*keys).agg(part.alias("s"))

    def packed(batches):
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index("s"))
            w = [np.stack([lists[i].values.field(c).to_numpy(zero_copy_only=False).astype(float) for c in ("tp", "fp", "all_pos")]).tobytes() for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in keys], pa.array(w, pa.binary())], names=[*keys, "w"])

    heads = heads.mapInArrow(packed, schema + "w binary").select(*keys, F.lit(None).cast("double").alias("v"), F.lit(None).cast(kinds["y"]).alias("y"), "w")
    both = cells.withColumn("v", F.col("v").cast("double")).select(*keys, "v", "y", "w").unionByName(heads)
    ap = both.repartition(*keys).sortWithinPartitions(*keys, F.col("v").asc_nulls_first()).mapInArrow(precisions, schema + "rep int, auprc double").groupBy(*by, "rep").agg(F.sum("auprc").alias("auprc"))
    out = null_safe_join(out, ap, [*by, "rep"])
    return out.withColumn("auprc", F.when(F.col("auroc").isNotNull(), F.col("auprc")))


def resample_cells(cells: DataFrame, draws: int, seed: str) -> DataFrame:
    """Cells (…, n) with a replicate number and a Poisson(n) weight: what n rows with Poisson(1) weights add up to.

    The work is cells times draws, whatever the number of rows. A cell's draws depend on its own values and the seed.
    """
    names = [c for c in cells.columns if c != "n"]
    marked = cells.withColumn("__h", F.xxhash64(*names, F.lit(seed)))

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo in range(0, len(pdf), 200):
                part = pdf.iloc[lo:lo + 200]
                w = np.stack([np.random.default_rng(h & (2**63 - 1)).poisson(n, draws) for h, n in zip(part["__h"], part["n"])])
                row, rep = np.nonzero(w)
                yield part[names].iloc[row].assign(rep=(rep + 1).astype("int32"), w=w[row, rep])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cells.schema.fields if f.name != "n")
    return spread(marked).mapInPandas(draw, f"{schema}, rep int, w long")


def bootstrap(df: DataFrame, by: Sequence[str], key: str, draws: int = 1000, seed: str = "boot", p_ref: str | None = None,
              method: str = "cells", precision: bool = True) -> DataFrame:
    """Point values and 95% intervals; one-class replicates are skipped. Without `precision` a cell method leaves out `auprc`.

    With `p_ref` also the paired AUROC difference on the same replicates. Methods: `cells` deals exactly n draws to the
    distinct (group, outcome, score) cells, `poisson cells` gives them independent weights, `draws` issues a draw for every
    row by md5 and counts them by cell, `poisson` weighs every row. `min_drawn` and `max_drawn` are the least and the most rows of a replicate.
    """
    by = list(by)
    cols = [*by, key, "y", "p", *([p_ref] if p_ref else [])]
    base = df.select(*cols).where("y IS NOT NULL AND p IS NOT NULL")
    # replicate 0 is the sample itself; both scores are ranked in the same pass
    if method in ("cells", "draws"):
        if method == "cells":
            cells = stage(base.groupBy(*[c for c in cols if c != key]).agg(F.count("*").alias("n")), "bootstrap-cells")
        dealt = stage(deal_cells(cells, by, draws, seed) if method == "cells" else draw_cells(base, by, key, draws, seed), "dealt-cells")
        m = replicate_metrics(dealt, by, "p", precision)
        if p_ref:
            m = null_safe_join(m, replicate_metrics(dealt, by, p_ref, precision=False).select(*by, "rep", F.col("auroc").alias("__ref")), [*by, "rep"])
        return _intervals(m, by, p_ref is not None)
    if method == "poisson cells":
        cells = stage(base.groupBy(*[c for c in cols if c != key]).agg(F.count("*").alias("n")), "bootstrap-cells")
        every = resample_cells(cells, draws, seed).unionByName(cells.withColumn("rep", F.lit(0)).withColumnRenamed("n", "w"))
    else:
        every = resample(base, by, key, draws, seed, method).unionByName(base.withColumns({"rep": F.lit(0), "w": F.lit(1).cast("long")}))
    scores = {"p": "p", **({"ref": p_ref} if p_ref else {})}
    long = every.select(*by, "rep", "y", "w", F.inline(F.array(*[F.struct(F.lit(n).alias("score"), F.col(c).alias("__p")) for n, c in scores.items()])))
    group = [*by, "rep", "score"]
    m = ranking_metrics(score_cells(long, group, "__p", "y", F.col("w")), group)
    own = lambda c, s="p": F.max(F.when(F.col("score") == s, F.col(c))).alias(c if s == "p" else "__ref")
    return _intervals(m.groupBy(*by, "rep").agg(*[own(c) for c in ("n", "events", "auroc", "auprc", "brier")], own("auroc", "ref")), by, p_ref is not None)


def _intervals(m: DataFrame, by: Sequence[str], paired: bool) -> DataFrame:
    """Point values (replicate 0) and intervals from metrics per replicate."""
    stats = [c for c in ("auroc", "auprc", "brier") if c in m.columns]
    names = ["n", "events", *stats]
    if paired:
        m = m.withColumn("delta_auroc", F.col("auroc") - F.col("__ref"))
        stats.append("delta_auroc")
        names.append("delta_auroc")
    drawn = (F.col("rep") > 0) & F.col("auroc").isNotNull()
    return m.groupBy(*by).agg(
        *[F.max(F.when(F.col("rep") == 0, F.col(c))).alias(c) for c in names], F.count_if(drawn).alias("replicates"),
        *[f(F.when(F.col("rep") > 0, F.col("n"))).alias(c) for c, f in (("min_drawn", F.min), ("max_drawn", F.max))],
        *[F.percentile(F.when(drawn, F.col(c)), q).alias(f"{c}_{s}") for c in stats for s, q in (("lo", 0.025), ("hi", 0.975))])


def _glue(a: DataFrame, b: DataFrame, by: Sequence[str]) -> DataFrame:
    """Join two per-group results; single-row results meet through a scalar subquery."""
    if by:
        return null_safe_join(a, b, list(by))
    return a.withColumn("__s", b.select(F.struct(*b.columns)).scalar()).select(*a.columns, "__s.*")


# ---- calibration and decisions ------------------------------------------------------------

def calibration_bins(df: DataFrame, bins: int = 10, by: Sequence[str] = ()) -> DataFrame:
    return qcut(df, "p", bins, by=by).groupBy(*by, "bin").agg(F.count("*").alias("n"), F.avg("p").alias("predicted"), F.avg("y").alias("observed"))


def calibration_fit(df: DataFrame, by: Sequence[str] = (), steps: int = 25, tol: float = 1e-9) -> DataFrame:
    """Slope and intercept of observed on logit(predicted), by Newton steps inside the plan.

    The data shrink to one row per distinct score first. Each step is one grouped
    aggregation, and all groups are fitted together until none moves by `tol`. `settled` tells whether a group
    got there in `steps`; one of a single outcome, or whose scores separate the outcomes, has no finite fit and does not.
    """
    by = list(by)
    cells = score_cells(df, by).withColumn("x", logit("p")).withColumn("n", F.col("pos") + F.col("neg"))
    cells = stage(cells, "calibration")
    params = None
    for _ in range(steps):
        d = cells.withColumns({"a": F.lit(0.0), "b": F.lit(0.0)}) if params is None else _with_params(cells, params, by)
        q = F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.col("a") + F.col("b") * F.col("x"))))
        w, g = F.col("n") * q * (1 - q), F.col("pos") - F.col("n") * q
        s = d.groupBy(*by).agg(F.first("a").alias("a"), F.first("b").alias("b"), F.sum(g).alias("g0"), F.sum(g * F.col("x")).alias("g1"),
                               F.sum(w).alias("h00"), F.sum(w * F.col("x")).alias("h01"), F.sum(w * F.col("x") * F.col("x")).alias("h11"),
                               F.sum("pos").alias("P"), F.sum("n").alias("N"), F.sum(F.col("p") * F.col("n")).alias("S"))
        det = F.col("h00") * F.col("h11") - F.col("h01") * F.col("h01")
        da = F.try_divide(F.col("h11") * F.col("g0") - F.col("h01") * F.col("g1"), det)
        db = F.try_divide(F.col("h00") * F.col("g1") - F.col("h01") * F.col("g0"), det)
        params = s.select(*by, (F.col("a") + F.coalesce(da, F.lit(0.0))).alias("a"), (F.col("b") + F.coalesce(db, F.lit(0.0))).alias("b"),
                          F.coalesce(F.greatest(F.abs(da), F.abs(db)) < tol, F.lit(False)).alias("settled"), (F.col("P") / F.col("N")).alias("observed_rate"), (F.col("S") / F.col("N")).alias("mean_predicted"))
        params = stage(params, "calibration-step")
        if params.where(~F.col("settled")).isEmpty():
            break
    return params.select(*by, F.col("b").alias("slope"), F.col("a").alias("intercept"), "observed_rate", "mean_predicted", "settled")


def _with_params(cells: DataFrame, params: DataFrame, by: Sequence[str]) -> DataFrame:
    p = params.select(*by, "a", "b")
    if by:
        return null_safe_join(cells, p, list(by))
    return cells.withColumn("__s", p.select(F.struct("a", "b")).scalar()).select(*cells.columns, "__s.*")


def _at_thresholds(df: DataFrame, ts: Sequence[float], by: Sequence[str]) -> DataFrame:
    cells = score_cells(df, by)
    x = cells.select("*", F.explode(F.array(*[F.lit(float(t)) for t in ts])).alias("threshold"))
    flag = F.col("p") >= F.col("threshold")
    zero = F.lit(0)
    return x.groupBy(*by, "threshold").agg(F.sum(F.when(flag, F.col("pos")).otherwise(zero)).alias("tp"), F.sum(F.when(flag, F.col("neg")).otherwise(zero)).alias("fp"),
                                           F.sum(F.when(~flag, F.col("pos")).otherwise(zero)).alias("fn"), F.sum(F.when(~flag, F.col("neg")).otherwise(zero)).alias("tn"))


def thresholds(df: DataFrame, ts: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    floor = lambda c: F.greatest(c, F.lit(1))
    return _at_thresholds(df, ts, by).select(
        *by, "threshold", (F.lit(100.0) * (tp + fp) / (tp + fp + fn + tn)).alias("flagged_pct"), F.try_divide(tp, tp + fn).alias("sensitivity"),
        F.try_divide(tn, tn + fp).alias("specificity"), (tp / floor(tp + fp)).alias("ppv"), (tn / floor(tn + fn)).alias("npv"))


def decision_curve(df: DataFrame, ts: Sequence[float] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Net benefit of the model and of treating everyone."""
    ts = [round(0.02 * i, 2) for i in range(1, 31)] if ts is None else ts
    tp, fp, fn, tn, t = (F.col(c) for c in ("tp", "fp", "fn", "tn", "threshold"))
    n = tp + fp + fn + tn
    prev, odds = (tp + fn) / n, t / (F.lit(1.0) - t)
    return _at_thresholds(df, ts, by).select(*by, "threshold", (tp / n - fp / n * odds).alias("model"), (prev - (1 - prev) * odds).alias("treat_all"))


def subgroups(df: DataFrame, cols: Sequence[str], min_events: int = 15, key: str | None = None, draws: int = 500, method: str = "cells") -> DataFrame:
    """Rates per subgroup level; AUROC only with enough events and non-events, with its interval if a row key is given."""
    long = unpivot(df, ["y", "p", *([key] if key else [])], cols, "string", "subgroup", "level").where("level IS NOT NULL")
    by = ["subgroup", "level"]
    base = long.groupBy(*by).agg(F.count("*").alias("n"), F.sum("y").alias("events"), F.avg("y").alias("observed"), F.avg("p").alias("predicted"))
    out = ["auroc", "auroc_lo", "auroc_hi"] if key else ["auroc"]
    a = (bootstrap(long, by, key, draws, method=method) if key else auroc(long, by)).select(*by, *out)
    enough = (F.col("events") >= min_events) & (F.col("n") - F.col("events") >= min_events)
    return base.join(a, by, "left").withColumns({c: F.when(enough, F.col(c)) for c in out})


def check_gap(df: DataFrame, by: Sequence[str], min_n: int = 50, limit: float = 0.08) -> DataFrame:
    """Calibration gap per cell of at least `min_n` rows and whether it stays below the limit."""
    t = df.groupBy(*by).agg(F.count("*").alias("n"), F.avg("y").alias("observed"), F.avg("p").alias("predicted")).where(F.col("n") >= min_n)
    gap = F.abs(F.col("predicted") - F.col("observed"))
    return t.withColumns({"gap": gap, "passed": gap < limit})


# ---- concordance ---------------------------------------------------------------------------

def concordance_counts(df: DataFrame, by: Sequence[str] = (), time: str = "time", event: str = "event", risk: str = "risk",
                       w: str | None = None, **kw) -> DataFrame:
    """Concordant, tied and comparable pairs without forming any pair.

    Distinct times are numbered (at one time, events before censored rows). Two
    different numbers first differ in exactly one binary digit, so every pair is
    counted once: at that digit the earlier row is on the 0 side and the later on
    the 1 side of one block. Per digit and block the pairs are counted from
    prefix sums over the risk. Work grows with n log n.
    """
    by = list(by)
    wt = F.lit(1) if w is None else F.col(w)
    rows = df.select(*by, F.col(time).alias("t"), F.col(event).cast("int").alias("e"), F.col(risk).alias("r"), wt.alias("w")).dropna(subset=["t", "e", "r"])
    slots = rows.groupBy(*by, "t").agg(F.max("e").alias("has_e"), F.max(1 - F.col("e")).alias("has_c"))
    slots = prefix_sums(slots.withColumn("k", F.col("has_e") + F.col("has_c")), by, "t", ["k"], **kw)
    slots = slots.select(*by, "t", "has_e", "k_before", F.col("k_total").alias("top"))
    cells = rows.groupBy(*by, "t", "e", "r").agg(F.sum("w").alias("w"))
    cells = null_safe_join(cells, slots, [*by, "t"], "inner")
    slot = F.col("k_before") + F.when(F.col("e") == 1, 0).otherwise(F.col("has_e"))
    bits = F.greatest(F.ceil(F.log2(F.col("top").cast("double") + 1)), F.lit(1)).cast("int")
    x = cells.withColumns({"slot": slot.cast("long"), "bits": bits}).select("*", F.explode(F.sequence(F.lit(0), F.col("bits") - 1)).alias("bit"))
    width = F.pow(F.lit(2.0), F.col("bit")).cast("long")
    x = x.withColumns({"block": F.floor(F.col("slot") / (width * 2)).cast("long"), "late": (F.floor(F.col("slot") / width) % 2) == 1})
    g = [*by, "bit", "block"]
    y = x.groupBy(*g, "r").agg(F.sum(F.when(F.col("late"), F.col("w")).otherwise(0)).alias("late_w"),
                               F.sum(F.when(~F.col("late") & (F.col("e") == 1), F.col("w")).otherwise(0)).alias("event_w"))
    y = prefix_sums(y, g, "r", ["late_w"], **kw)
    return y.groupBy(*by).agg(
        F.sum(F.col("event_w") * F.col("late_w_before")).alias("concordant"), F.sum(F.col("event_w") * F.col("late_w")).alias("tied"),
        F.sum(F.col("event_w") * F.col("late_w_total")).alias("comparable"))


def c_index(df: DataFrame, by: Sequence[str] = (), **kw) -> DataFrame:
    """Harrell's concordance: a higher risk should meet its event earlier; ties in risk count ½."""
    c = concordance_counts(df, by, **kw)
    return c.withColumn("c_index", F.try_divide(F.col("concordant") + F.col("tied") / 2.0, F.col("comparable")))


def replicate_concordance(dealt: DataFrame, time: str, event: str, risk: str) -> DataFrame:
    """(rep, concordant, tied, comparable) of one risk over dealt cells with weights `w`, for all replicates at once.

    As in `concordance_counts`, times are numbered and a pair is counted at the first digit in which its numbers differ,
    here of `TIME_BITS` bits, so a cell is sent once per digit and no pair or row per draw is formed. A task runs through
    the cells of a block of numbers by rising risk, with the weights met so far in a tree over the digit's values. Large
    blocks are cut into chunks by even edges of the risk; the chunks' totals by digit are then scanned in order.
    """
    rows = dealt.select(F.col(time).alias("t"), (F.col(event).cast("int") == 1).alias("e"), F.col(risk).cast("double").alias("r"), "w").dropna(subset=["t", "e", "r"])
    slots = rows.groupBy("t").agg(F.max(F.col("e").cast("int")).alias("has_e"), F.max((~F.col("e")).cast("int")).alias("has_c"))
    slots = stage(prefix_sums(slots.withColumn("k", F.col("has_e") + F.col("has_c")), [], "t", ["k"]), "time-slots")
    top = slots.agg(F.max("k_total")).first()[0] or 1
    levels = max(1, -(-int(top).bit_length() // TIME_BITS))
    slot = (F.col("k_before") + F.when(F.col("e"), 0).otherwise(F.col("has_e"))).cast("long")
    cells = rows.join(broadcast_if_small(slots.select("t", "has_e", "k_before")), "t").select(slot.alias("slot"), "e", "r", "w")
    places = F.explode(F.array(*[F.struct(F.lit(i).alias("level"), F.shiftright("slot", TIME_BITS * (i + 1)).alias("block"), F.shiftright("slot", TIME_BITS * i).bitwiseAND(2**TIME_BITS - 1).cast("int").alias("digit"))
                                 for i in range(levels)])).alias("at")
    keys = ["level", "block", "chunk"]
    large = cells.drop("w", "r").select(places).groupBy("at.level", "at.block").agg(F.count("*").alias("n")).where(F.col("n") > RISK_CELLS).select("level", "block", F.lit(True).alias("large"))
    edges = bucket_edges(cells.select("r"), "r", RISK_CELLS)
    x = cells.select("e", "r", "w", places).select("e", "r", "w", "at.*").join(small_side(large, "large-blocks"), ["level", "block"], "left")
    x = x.select("level", "block", F.when(F.col("large"), bucket_of("r", edges)).otherwise(-1).alias("chunk"), "digit", "e", "r", "w")
    x = x.repartition(*keys).sortWithinPartitions(*keys, "r", F.col("digit").desc())

    def chunks(batches):
        """(key, rows of a chunk as they come)"""
        rows_ = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in range(batch.num_columns))))
        for key, group in itertools.groupby(rows_, lambda r: r[:3]):
            yield key, (r[3:] for r in group)

    def counts(batches):
        for (level, block, chunk), group in chunks(batches):
            tree = _DigitTree()
            for digit, e, r, w in group:
                tree.add(digit, e, r, unpack_weights(w))
            done = tree.finish()
            totals = [(None, *done)] if chunk < 0 else [(None, *done), *tree.totals()]
            yield pa.RecordBatch.from_arrays([pa.array([v] * len(totals), t) for v, t in ((level, pa.int32()), (block, pa.int64()), (chunk, pa.int32()))]
                                             + [pa.array([t[0] for t in totals], pa.int32()), *[pa.array([t[i].astype(np.int64).tobytes() for t in totals], pa.binary()) for i in (1, 2, 3)]],
                                             names=[*keys, "digit", "concordant", "tied", "comparable"])

    run = stage(x.mapInArrow(counts, "level int, block long, chunk int, digit int, concordant binary, tied binary, comparable binary"), "concordance-chunks")

    def across(batches):
        """Pairs between chunks of a block: events of a chunk with the later rows of the chunks before it, and all between any two."""
        for (level, block), group in itertools.groupby(((r[:2], r[2:]) for r in _rows(batches)), lambda r: r[0]):
            later = events = None
            for _, part in itertools.groupby((r[1] for r in group), lambda r: r[0]):
                part = [(d, np.frombuffer(e, np.int64), np.frombuffer(w, np.int64)) for _, d, e, w in part]
                if later is None:
                    later, events = (np.zeros((2**TIME_BITS + 1, len(part[0][1])), np.int64) for _ in range(2))
                    concordant, comparable = np.zeros(later.shape[1], np.int64), np.zeros(later.shape[1], np.int64)
                beyond = np.cumsum(later[::-1], 0)[::-1]
                before = np.cumsum(events, 0)
                for d, e, w in part:
                    concordant += e * beyond[d + 1]
                    comparable += e * beyond[d + 1]
                    if d:
                        comparable += w * before[d - 1]
                for d, e, w in part:
                    later[d] += w
                    events[d] += e
            yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in (concordant, 0 * concordant, comparable)], names=["concordant", "tied", "comparable"])

    kind = "concordant binary, tied binary, comparable binary"
    between = (run.where("digit IS NOT NULL").repartition("level", "block").sortWithinPartitions("level", "block", "chunk", "digit")
               .select("level", "block", "chunk", "digit", "concordant", "tied").mapInArrow(across, kind))

    def by_replicate(batches):
        total = None
        for row in _rows(batches):
            one = np.stack([np.frombuffer(v, np.int64) for v in row])
            total = one if total is None else total + one
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.shape[1], dtype=np.int32)), *map(pa.array, total)], names=["rep", "concordant", "tied", "comparable"])

    every = run.where("digit IS NULL").select("concordant", "tied", "comparable").unionByName(between)
    return every.mapInArrow(by_replicate, "rep int, concordant long, tied long, comparable long").groupBy("rep").agg(*[F.sum(c).alias(c) for c in ("concordant", "tied", "comparable")])


def _rows(batches) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in range(batch.num_columns)))


class _DigitTree:
    """Weights by digit of the rows met so far, in a Fenwick tree, and the pairs they form; a weight is one number per replicate."""

    SIZE = 2**TIME_BITS
    #: nodes that a digit adds to, and nodes that make up the sum over larger digits
    UP, ABOVE = [], []
    for _d in range(SIZE):
        _at, _up, _sum = SIZE - _d, [], []
        while _at <= SIZE:
            _up.append(_at)
            _at += _at & -_at
        _at = SIZE - _d - 1
        while _at:
            _sum.append(_at)
            _at -= _at & -_at
        UP.append(_up)
        ABOVE.append(_sum)

    def __init__(self):
        self.tree = None

    def add(self, digit: int, event: bool, risk: float, w: np.ndarray) -> None:
        """The next row, by rising risk and, among ties, falling digit."""
        if self.tree is None:
            self.tree = np.zeros((self.SIZE + 1, len(w)), np.int64)
            self.events, self.all = np.zeros((self.SIZE, len(w)), np.int64), np.zeros((self.SIZE, len(w)), np.int64)
            self.concordant, self.tied = np.zeros(len(w), np.int64), np.zeros(len(w), np.int64)
            self.risk, self.waiting, self.passed, self.run, self.digit = risk, [], None, None, digit
        same = risk == self.risk or (risk != risk and self.risk != self.risk)
        if not same or digit != self.digit:
            self._end_run()
            if not same:
                self._end_ties()
            self.risk, self.digit = risk, digit
        self.run = w if self.run is None else self.run + w
        self.all[digit] += w
        if event:
            self.events[digit] += w
            for node in self.ABOVE[digit]:
                self.concordant += w * self.tree[node]
            if self.passed is not None:
                self.tied += w * self.passed

    def _end_run(self) -> None:
        self.passed = self.run if self.passed is None else self.passed + self.run
        self.waiting.append((self.digit, self.run))
        self.run = None

    def _end_ties(self) -> None:
        for digit, w in self.waiting:
            for node in self.UP[digit]:
                self.tree[node] += w
        self.waiting, self.passed = [], None

    def finish(self) -> tuple:
        beyond = np.cumsum(self.all[::-1], 0)[::-1]
        return self.concordant, self.tied, (self.events[:-1] * beyond[1:]).sum(0)

    def totals(self) -> list[tuple]:
        """(digit, events, all) of the digits that were met."""
        return [(int(d), self.events[d], self.all[d], self.all[d][:0]) for d in np.flatnonzero(self.all.any(1))]


def c_index_gain(df: DataFrame, key: str, draws: int = 200, seed: str = "cgain", method: str = "cells") -> DataFrame:
    """Paired gain of `risk` over `risk_ref` with a 95% interval over the same replicates, dealt to distinct rows as in `bootstrap`."""
    base = df.select(key, "time", "event", "risk", "risk_ref")
    if method in ("cells", "draws"):
        if method == "cells":
            cells = stage(base.drop(key).dropna(subset=["time", "event"]).groupBy("time", "event", "risk", "risk_ref").agg(F.count("*").alias("n")), "concordance-cells")
        dealt = stage(deal_cells(cells, [], draws, seed) if method == "cells" else draw_cells(base, [], key, draws, seed), "dealt-cells")
        one = lambda n: replicate_concordance(dealt, "time", "event", n).select("rep", F.try_divide(F.col("concordant") + F.col("tied") / 2.0, F.col("comparable")).alias(n))
        c = one("risk").join(one("risk_ref"), "rep", "full")
    else:
        every = resample(base, [], key, draws, seed, method).unionByName(base.withColumns({"rep": F.lit(0), "w": F.lit(1).cast("long")}))
        long = every.select("rep", "time", "event", "w", F.inline(F.array(*[
            F.struct(F.lit(n).alias("model"), F.col(n).cast("double").alias("r")) for n in ("risk", "risk_ref")])))
        c = c_index(long, ["rep", "model"], risk="r", w="w").groupBy("rep").agg(
            *[F.max(F.when(F.col("model") == n, F.col("c_index"))).alias(n) for n in ("risk", "risk_ref")])
    c = c.withColumn("gain", F.col("risk") - F.col("risk_ref"))
    own = lambda x: F.max(F.when(F.col("rep") == 0, F.col(x)))
    drawn = F.when(F.col("rep") > 0, F.col("gain"))
    return c.agg(own("risk").alias("c_index"), own("risk_ref").alias("c_index_ref"), own("gain").alias("gain"), F.percentile(drawn, 0.025).alias("gain_lo"),
                 F.percentile(drawn, 0.975).alias("gain_hi"), F.count(drawn).alias("replicates"))


# ---- regression -----------------------------------------------------------------------------

def regression_metrics(df: DataFrame, by: Sequence[str], y: str = "y", p: str = "p", train_median: float | Column = 0.0) -> DataFrame:
    """Errors of the model, of "no change" and of the training median; R² and rank correlation."""
    Y, P = F.col(y), F.col(p)
    m = train_median if isinstance(train_median, Column) else F.lit(float(train_median))
    agg = df.withColumn("__m", m).groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(Y).alias("mean_change"), F.avg((Y <= 0).cast("int")).alias("share_le0"), F.avg(F.abs(Y - P)).alias("mae"),
        F.avg(F.abs(Y)).alias("mae_no_change"), F.avg(F.abs(Y - F.col("__m"))).alias("mae_train_median"), F.sqrt(F.avg((Y - P) ** 2)).alias("rmse"),
        F.sqrt(F.avg(Y ** 2)).alias("rmse_no_change"), (1 - F.sum((Y - P) ** 2) / (F.var_pop(Y) * F.count("*"))).alias("r2"))
    s = spearman(df, y, p, by).withColumnRenamed("r", "spearman").drop("n")
    return _glue(agg, s, list(by))


def method_agreement(df: DataFrame, a: str, b: str, status: str, by: Sequence[str], min_n: int = 10) -> DataFrame:
    """Two measurements of one quantity: correlation, line of a on b, mean difference with limits, AUROC for a status."""
    d = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    A, B = F.col(a), F.col(b)
    agg = d.groupBy(*by).agg(F.count("*").alias("n"), F.corr(A, B).alias("pearson"), F.regr_slope(A, B).alias("slope"), F.regr_intercept(A, B).alias("intercept"),
                             F.avg(A - B).alias("mean_diff"), F.stddev_samp(A - B).alias("sd")).where(F.col("n") >= min_n)
    agg = agg.select(*by, "n", "pearson", "slope", "intercept", "mean_diff", (F.col("mean_diff") - 1.96 * F.col("sd")).alias("lower"),
                     (F.col("mean_diff") + 1.96 * F.col("sd")).alias("upper"))
    rank = spearman(d, a, b, by).withColumnRenamed("r", "spearman").drop("n")
    roc = auroc(d, by, p=a, y=status).select(*by, "auroc")
    return _glue(_glue(agg, rank, list(by)), roc, list(by))


# ---- checks on scored tables ------------------------------------------------------------------

def check_monotone(scored: DataFrame, by: Sequence[str], key: str, step: str, p: str, tolerance: float = 1.0) -> DataFrame:
    """Largest step down of a score along each row's sweep, in percentage points."""
    w = Window.partitionBy(key, *by).orderBy(step)
    drop = scored.withColumn("__d", (F.lag(p).over(w) - F.col(p)) * 100)
    out = drop.groupBy(*by).agg(F.greatest(F.max("__d"), F.lit(0.0)).alias("largest_drop"))
    return out.withColumn("passed", F.col("largest_drop") <= tolerance)


def check_order(scored: DataFrame, status: str, order: Sequence, p: str = "p") -> DataFrame:
    """Mean score per status, and whether it rises in the stated order."""
    rank = F.array_position(F.array(*[F.lit(s) for s in order]), F.col(status)).cast("int")
    m = scored.where(F.col(status).isin(list(order))).groupBy(status).agg(F.avg(p).alias("mean_p"), F.count("*").alias("n")).withColumn("position", rank)
    prev = F.lag("mean_p").over(Window.partitionBy(F.lit(0)).orderBy("position"))
    return m.withColumn("rises", F.coalesce(F.col("mean_p") > prev, F.lit(True)))


def rule_rates(checked: DataFrame, by: str) -> DataFrame:
    """Share of rows per group on which each level of rule fires."""
    share = lambda level: F.avg(F.exists("checks", lambda x: x["level"] == level).cast("int"))
    return checked.groupBy(by).agg(F.count("*").alias("n"), share("check").alias("check_rate"), share("note").alias("note_rate"))


def ensemble(preds: DataFrame, row: Sequence[str], by: Sequence[str] = ("model",)) -> DataFrame:
    """Mean prediction per row over the seeds."""
    return preds.groupBy(*by, *row, "y").agg(F.avg("p").alias("p"), F.count_distinct("seed").alias("seeds"))
