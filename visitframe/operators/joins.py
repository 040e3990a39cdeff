"""Joins between visits and irregular measurements.

Nothing here pairs all rows of an entity with each other: one side of every
entity join holds at most one row per entity, and the best match is an
aggregate, so map tasks combine it before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitframe.operators.pit import first_row
from visitframe.scaling import Run, Timeline, exact_quantiles, pick_row, small_side
from visitframe.session import stage

KEY = "entity_id"


def left_lookup(left: DataFrame, right: DataFrame, on: str, order: Sequence[Column], cols: Sequence[str]) -> DataFrame:
    """Left join to a lookup reduced to one row per key; `hit` tells whether the key was found."""
    one = pick_row(right, [on], order, cols).withColumn("__hit", F.lit(True))
    return left.join(one, on, "left").withColumn("hit", F.coalesce("__hit", F.lit(False))).drop("__hit")


def exists_in(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of `left` whose composite key occurs in `right`."""
    return left.join(right.select(*on).distinct(), list(on), "left_semi")


def keep_ids(df: DataFrame, ids: DataFrame, key: str = KEY) -> DataFrame:
    return df.join(ids.select(key).distinct(), key, "left_semi")


def drop_ids(df: DataFrame, ids: DataFrame, key: str = KEY) -> DataFrame:
    return df.join(ids.select(key).distinct(), key, "left_anti")


def with_split(v: DataFrame, splits: DataFrame, key: str = KEY) -> DataFrame:
    return v.join(splits.select(key, "split"), key)


def first_scan(scans: DataFrame, cols: Sequence[str], key: str = KEY) -> DataFrame:
    """Earliest scan per entity, as one row."""
    return first_row(scans, ["scan_date", "scan_id", *[c for c in cols if c not in ("scan_date", "scan_id")]],
                     key, ("scan_date", "scan_id"))


def nearest_visit(scans: DataFrame, visits: DataFrame, visit_cols: Sequence[str], scan_cols: Sequence[str] = (),
                  days: int = 365) -> DataFrame:
    """The first scan of each entity with the visit closest in time, either side; visit columns get the prefix `i_`."""
    s = first_scan(scans, scan_cols)
    cols = ["visit_date", "visit_id", *[c for c in visit_cols if c not in ("visit_date", "visit_id")]]
    gap = F.abs(F.datediff("visit_date", "scan_date"))
    m = visits.select(KEY, *cols).join(s, KEY).withColumn("gap_days", gap).where(F.col("gap_days") <= days)
    scan_side = [c for c in s.columns if c != KEY]
    best = pick_row(m, [KEY], [F.col("gap_days"), F.col("visit_date"), F.col("visit_id")], [*scan_side, "gap_days", *cols])
    return best.withColumnsRenamed({c: f"i_{c}" for c in cols})


def asof_forward(anchor: DataFrame, visits: DataFrame, cols: Sequence[str], days: int = 365) -> DataFrame:
    """The first visit on or after each entity's anchor date, within the window."""
    m = visits.join(anchor, KEY).withColumn("gap", F.datediff("visit_date", "anchor")).where(F.col("gap").between(0, days))
    return pick_row(m, [KEY], [F.col("gap"), F.col("visit_date"), F.col("visit_id")], ["visit_date", "visit_id", "anchor", "gap", *cols])


def asof_nearest(anchor: DataFrame, visits: DataFrame, cols: Sequence[str], days: int = 365) -> DataFrame:
    """The visit closest to each entity's anchor date, either side."""
    m = visits.join(anchor, KEY).withColumn("gap", F.datediff("visit_date", "anchor")).where(F.abs("gap") <= days)
    return pick_row(m, [KEY], [F.abs("gap"), F.col("visit_date"), F.col("visit_id")], ["visit_date", "visit_id", "anchor", "gap", *cols])


def attach(index: DataFrame, scans: DataFrame, cols: Sequence[str], lo: int, hi: int, prefix: str) -> DataFrame:
    """Values of each entity's first scan on its index visit if the scan lies `lo`..`hi` days from it."""
    s = first_scan(scans, cols).withColumnRenamed("scan_date", "__scan")
    gap = F.datediff("__scan", "visit_date")
    m = index.join(s.drop("scan_id"), KEY, "left").withColumn("__ok", gap.between(lo, hi))
    return m.withColumns({f"{prefix}_{c}": F.when(F.col("__ok"), F.col(c)) for c in cols}
                         | {f"{prefix}_gap_days": F.when(F.col("__ok"), gap),
                            f"has_{prefix}": F.coalesce(F.col("__ok"), F.lit(False)).cast("int")}).drop("__scan", "__ok", *cols)


def followup_events(index: DataFrame, visits: DataFrame, min_years: float = 0.25) -> DataFrame:
    """What happened after each entity's index visit: longest follow-up, worst status, largest rise."""
    m = visits.select(KEY, "visit_date", "status", "score").join(
        index.select(KEY, "i_visit_date", "i_status", "i_score"), KEY)
    m = m.withColumn("years", F.datediff("visit_date", "i_visit_date") / F.lit(365.25)).where(F.col("years") > min_years)
    return m.groupBy(KEY).agg(F.max("i_status").alias("i_status"), F.max("years").alias("followup_years"),
                              F.max("status").alias("worst_status"), F.max(F.col("score") - F.col("i_score")).alias("max_rise"))


def similar_cell(df: DataFrame, cells: DataFrame, group: str, status: str) -> DataFrame:
    """n, events and rate of the reference cell (group × status), or of the whole group if the cell is absent."""
    whole = cells.groupBy(group).agg(F.sum("n").alias("__gn"), F.sum("events").alias("__ge"))
    own = cells.select(group, status, F.col("n").alias("__cn"), F.col("events").alias("__ce"))
    j = df.join(small_side(own, "cells"), [group, status], "left").join(small_side(whole, "cell-groups"), group, "left")
    n, e = F.coalesce("__cn", "__gn"), F.coalesce("__ce", "__ge")
    return j.withColumns({"cell_found": F.col("__cn").isNotNull(), "cell_n": n, "cell_events": e, "cell_rate": e / n}).drop(
        "__cn", "__ce", "__gn", "__ge")


def sweep(df: DataFrame, name: str, values: Sequence[float]) -> DataFrame:
    """Every row once per value of a short list."""
    return df.select("*", F.posexplode(F.array(*[F.lit(v) for v in values])).alias("step", name))


def confirm_outcome(tl: Timeline, event: Column) -> DataFrame:
    """Per entity with an event: was it reverted, confirmed or never checked by a later visit?"""
    tl = tl.on(tl.df.where(F.col("status").isNotNull())).runs(__t=Run("min", F.when(event, F.col("years")), "all"))
    later = F.col("years") > F.col("__t")
    per = tl.df.where(F.col("__t").isNotNull()).groupBy(tl.key).agg(
        F.max((later & ~event).cast("int")).alias("reverted"), F.max((later & event).cast("int")).alias("seen_again"))
    return per.select(tl.key, F.when(F.col("reverted") == 1, "reverted").when(F.col("seen_again") == 1, "confirmed")
                      .otherwise("not checked").alias("outcome"))


def linkage_summary(scans: DataFrame, visits: DataFrame) -> DataFrame:
    """Gap from each entity's first scan to its nearest visit, counted by source and window."""
    s = first_scan(scans, ["source"])
    m = visits.select(KEY, "visit_date").join(s, KEY)
    # written once (a number per entity), as the counts and the quantiles read it
    gap = stage(m.groupBy(KEY, "source").agg(F.min(F.abs(F.datediff("visit_date", "scan_date"))).alias("gap")), "linkage-gaps")
    agg = gap.groupBy("source").agg(F.count("*").alias("n"), *[F.count_if(F.col("gap") <= d).alias(f"within_{d}") for d in (90, 180, 365)],
                                    F.min("gap").alias("min_gap"), F.avg("gap").alias("mean_gap"), F.max("gap").alias("max_gap"))
    return agg.join(exact_quantiles(gap, ["source"], "gap", {"p25_gap": 0.25, "median_gap": 0.5, "p75_gap": 0.75}), "source")
