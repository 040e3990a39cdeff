"""Point-in-time features and outcome labels along an entity's timeline.

Features look at rows up to the current one, labels at later rows only. All
running columns come from `Timeline.runs`, so they share one exchange and stay
safe when one entity holds a large share of the rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from visitframe.scaling import Run, Timeline, md5_key, null_safe_join, pick_row, prefix_sums, top_k

DAYS_PER_YEAR = 365.25
DAYS_PER_MONTH = 30.44


def add_years(tl: Timeline) -> Timeline:
    """`days` and `years` since the entity's first visit."""
    tl = tl.runs(__first=Run("min", F.col(tl.time), "all"))
    days = F.datediff(F.col(tl.time), F.col("__first"))
    return tl.on(tl.df.withColumns({"days": days, "years": days / F.lit(DAYS_PER_YEAR)}).drop("__first"))


def visit_index(tl: Timeline) -> Timeline:
    """`n_prior_visits`, `visit_no` and `years_of_history`."""
    tl = tl.runs(n_prior_visits=Run("count", F.lit(1), "before"))
    return tl.with_columns({"visit_no": F.col("n_prior_visits") + 1, "years_of_history": F.col("years")})


def ever(tl: Timeline, **flags: Column) -> Timeline:
    """Sticky flag: null before any report, 1 once reported, else 0."""
    return tl.runs(**{n: Run("max", c) for n, c in flags.items()})


def carry(tl: Timeline, **cols: Column) -> Timeline:
    """Last known value up to and including this visit."""
    return tl.runs(**{n: Run("last", c) for n, c in cols.items()})


def spread(tl: Timeline, value: Column, out: str) -> Timeline:
    """First known value of a fact that never changes, on every visit, with an unknown flag."""
    tl = tl.runs(**{out: Run("first", value, "all")})
    return tl.with_columns({f"{out}_unknown": F.col(out).isNull().cast("int")})


def running_slope(tl: Timeline, *cols: str, t: str = "years", limit: float = 10.0) -> Timeline:
    """Least-squares slope per year over all known values so far (`slope_<c>`), from five running sums."""
    runs = {}
    for c in cols:
        y, known = F.col(c).cast("double"), F.col(c).isNotNull()
        x = F.when(known, F.col(t))
        runs |= {f"__n_{c}": Run("count", y), f"__sx_{c}": Run("sum", x), f"__sy_{c}": Run("sum", y),
                 f"__sxx_{c}": Run("sum", x * x), f"__sxy_{c}": Run("sum", x * y)}
    tl = tl.runs(**runs)
    out = {}
    for c in cols:
        n, sx, sy, sxx, sxy = (F.col(f"__{k}_{c}") for k in ("n", "sx", "sy", "sxx", "sxy"))
        den = n * sxx - sx * sx
        slope = (n * sxy - sx * sy) / den
        out[f"slope_{c}"] = F.when((n >= 2) & F.col(c).isNotNull() & (den > 1e-9),
                                   F.greatest(F.least(slope, F.lit(limit)), F.lit(-limit)))
    return tl.on(tl.df.withColumns(out).drop(*runs))


def delta(tl: Timeline, *cols: str) -> Timeline:
    """Change since the last known value at an earlier visit (`delta_<c>`)."""
    tl = tl.runs(**{f"__p_{c}": Run("last", F.col(c), "before") for c in cols})
    return tl.on(tl.df.withColumns({f"delta_{c}": F.col(c) - F.col(f"__p_{c}") for c in cols})
                 .drop(*[f"__p_{c}" for c in cols]))


def visit_gaps(tl: Timeline) -> Timeline:
    """Months since the previous visit."""
    tl = tl.runs(__p=Run("last", F.col(tl.time), "before"))
    return tl.on(tl.df.withColumn("gap_months", F.datediff(F.col(tl.time), F.col("__p")) / F.lit(DAYS_PER_MONTH)).drop("__p"))


# ---------------------------------------------------------------------------
# Labels from later visits
# ---------------------------------------------------------------------------

def next_event(tl: Timeline, event: Column) -> Timeline:
    """Time to the next event at a later row, follow-up after this row, and the survival pair."""
    tl = tl.runs(__next=Run("min", F.when(event, F.col("years")), "after"), __last=Run("max", F.col("years"), "all"))
    tte, fu = F.col("__next") - F.col("years"), F.col("__last") - F.col("years")
    return tl.on(tl.df.withColumns({
        "time_to_event": tte, "followup_after": fu, "event_time": F.coalesce(tte, fu),
        "event": F.col("__next").isNotNull().cast("int")}).drop("__next", "__last"))


def horizon_label(h: float, tte: str = "time_to_event", fu: str = "followup_after") -> Column:
    """1 if the event came within `h` years, 0 if followed at least that long, null if unknown."""
    return F.when(F.col(tte) <= h, 1).when(F.col(fu) >= h, 0)


def eligible(tl: Timeline, allowed: Sequence[int], event: Column, visit_ok: Column | None = None) -> Timeline:
    """Allowed status now, no event so far (this visit included), and an allowed kind of visit."""
    tl = tl.runs(__ever=Run("max", F.coalesce(event.cast("int"), F.lit(0))))
    ok = F.col("status").isin(list(allowed)) & (F.col("__ever") == 0)
    if visit_ok is not None:
        ok = ok & visit_ok
    return tl.on(tl.df.withColumn("eligible", F.coalesce(ok, F.lit(False))).drop("__ever"))


def max_future(tl: Timeline, value: str, horizon: float, out: str = "max_future") -> Timeline:
    """Largest value at later rows within `horizon` years (inclusive).

    The range frame runs over one row per entity and day, so its cost is bounded
    by the calendar whatever the number of visits; rows of the same day follow by order.
    """
    reach = math.floor(horizon * DAYS_PER_YEAR)
    daily = tl.df.where(F.col(value).isNotNull()).groupBy(tl.key, "days").agg(F.max(value).alias("__m"))
    points = tl.df.select(tl.key, "days").distinct().join(daily, [tl.key, "days"], "left")
    w = Window.partitionBy(tl.key).orderBy("days").rangeBetween(1, reach)
    ahead = points.select(tl.key, "days", F.max("__m").over(w).alias("__ahead"))
    same_day = tl.window(True, ["days"]).rowsBetween(Window.unboundedPreceding, -1)
    df = tl.df.withColumn("__same", F.max(value).over(same_day)).join(ahead, [tl.key, "days"], "left")
    return tl.on(df.withColumn(out, F.greatest("__ahead", "__same")).drop("__ahead", "__same"))


def rise_label(value: str, future: str, by: float, h: float) -> Column:
    """1 if the value rises by at least `by` within the horizon, 0 if followed, null without a baseline."""
    return F.when(F.col(value).isNotNull(),
                  F.when(F.col(future) - F.col(value) >= by, 1).when(F.col("followup_after") >= h, 0))


def label_recount(tl: Timeline, event: Column, h: float, out: str = "label_recount") -> DataFrame:
    """The horizon label a second way, from counts instead of minima, without pairing rows.

    Events up to the end of the horizon minus events up to this row; rows from
    the horizon onwards. Both are read off range frames over the days, which only
    grow along the order. With hot entities the frames run over daily counts.
    """
    within, reached = math.floor(h * DAYS_PER_YEAR), math.ceil(h * DAYS_PER_YEAR)
    key, happened = tl.key, F.coalesce(event.cast("int"), F.lit(0))
    df = tl.runs(__seen=Run("sum", happened)).df
    w = Window.partitionBy(key).orderBy("days")
    upto = lambda c, last: F.sum(c).over(w.rangeBetween(Window.unboundedPreceding, last))
    ahead = lambda e, n: {"e_to_horizon": upto(e, within), "n_from_horizon": F.sum(n).over(Window.partitionBy(key)) - upto(n, reached - 1)}
    if tl.hot:
        daily = df.groupBy(key, "days").agg(F.sum(happened).alias("e"), F.count("*").alias("n"))
        df = df.join(daily.withColumns(ahead("e", "n")).select(key, "days", "e_to_horizon", "n_from_horizon"), [key, "days"], "left")
    else:
        known = F.col("days").isNotNull() & F.col(key).isNotNull()
        df = df.withColumns({c: F.when(known, v) for c, v in ahead(happened, F.lit(1)).items()})
    return df.withColumn(out, F.when(F.col("e_to_horizon") - F.col("__seen") > 0, 1)
                         .when(F.col("n_from_horizon") > 0, 0)).drop("__seen", "e_to_horizon", "n_from_horizon")


# ---------------------------------------------------------------------------
# One row per entity
# ---------------------------------------------------------------------------

def first_row(df: DataFrame, cols: Sequence[str], key: str = "entity_id", order: Sequence[str] = ("visit_date", "visit_id"),
              last: bool = False) -> DataFrame:
    """The first (or last) row per entity as it stands, nulls included."""
    rest = [c for c in cols if c not in order]
    if len(rest) + len(order) == len(cols):     # the columns hold the order, so they are sent once
        picked = df.groupBy(key).agg((F.max if last else F.min)(F.struct(*order, *rest)).alias("__p"))
        return picked.select(key, *[F.col(f"__p.{c}").alias(c) for c in cols])
    return pick_row(df, [key], [F.col(c) for c in order], cols, last)


def first_known(df: DataFrame, cols: Sequence[str], key: str = "entity_id", order: Sequence[str] = ("visit_date", "visit_id"),
                last: bool = False) -> DataFrame:
    """Per column the first (or last) known value, which may come from different rows."""
    agg, pos = (F.max_by if last else F.min_by), F.struct(*order)
    return df.groupBy(key).agg(*[agg(c, F.when(F.col(c).isNotNull(), pos)).alias(c) for c in cols])


def change_at(df: DataFrame, value: str, horizons: Sequence[float], tol: float = 0.5, key: str = "entity_id",
              order: Sequence[str] = ("visit_date", "visit_id")) -> DataFrame:
    """Change from the first visit to the visit nearest each horizon, within `tol` years."""
    known = df.where(F.col(value).isNotNull() & F.col("years").isNotNull())
    base = F.min_by(value, F.when(F.col("years") == 0, F.struct(*order)))
    out = [base.alias("base")]
    for h in horizons:
        dist = F.abs(F.col("years") - F.lit(float(h)))
        out.append(F.min_by(value, F.when(dist <= tol, F.struct(dist, *order))).alias(f"at_{h:g}"))
    agg = known.groupBy(key).agg(*out)
    return agg.select(key, *[(F.col(f"at_{h:g}") - F.col("base")).alias(f"change_{h:g}") for h in horizons])


def time_to_event(df: DataFrame, start: Sequence[int], event: Sequence[int], key: str = "entity_id",
                  order: Sequence[str] = ("visit_date", "visit_id")) -> DataFrame:
    """From the first known status to the first event status after baseline, or to the last visit."""
    later = F.col("years") > 0
    agg = df.groupBy(key).agg(
        F.min_by("status", F.when(F.col("status").isNotNull(), F.struct(*order))).alias("s0"),
        F.min(F.when(later & F.col("status").isin(list(event)), F.col("years"))).alias("ev"),
        F.max(F.when(later, F.col("years"))).alias("last"))
    return (agg.where(F.col("s0").isin(list(start)) & F.col("last").isNotNull())
            .select(key, F.coalesce("ev", "last").alias("time"), F.col("ev").isNotNull().cast("int").alias("event")))


def kaplan_meier(tte: DataFrame, grid: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Cumulative incidence in percent on a grid of years.

    Times are whole days, so a group has at most one row per day after the first
    aggregation. The product keeps a factor of zero, which a sum of logs would lose.
    """
    cells = tte.groupBy(*by, "time").agg(F.sum("event").alias("d"), F.count("*").alias("n"))
    risk = prefix_sums(cells, by, "time", ["n"], bounded=True)
    factor = F.lit(1.0) - F.col("d") / (F.col("n_total") - F.col("n_before"))
    w = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy("time")
    surv = risk.withColumn("surv", F.product(factor).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    points = surv.withColumn("years", F.explode(F.array(*[F.lit(float(g)) for g in grid])))
    inc = F.lit(1.0) - F.coalesce(F.min(F.when(F.col("time") <= F.col("years"), F.col("surv"))), F.lit(1.0))
    return points.groupBy(*by, "years").agg((inc * 100).alias("incidence_pct"))


def horizon_counts(tte: DataFrame, horizons: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Started with follow-up, status known and events by each horizon."""
    df = tte.withColumn("horizon", F.explode(F.array(*[F.lit(float(h)) for h in horizons])))
    hit = (F.col("event") == 1) & (F.col("time") <= F.col("horizon"))
    return df.groupBy(*by, "horizon").agg(F.count("*").alias("n"), F.count_if(hit | (F.col("time") >= F.col("horizon"))).alias("known"),
                                          F.count_if(hit).alias("events"))


def landmarks(df: DataFrame, min_prior: int = 2) -> DataFrame:
    return df.where(F.col("eligible") & (F.col("n_prior_visits") >= min_prior) & F.col("label").isNotNull())


def one_landmark(df: DataFrame, cols: Sequence[str], seed: str, key: str = "entity_id",
                 order: Sequence[str] = ("visit_date", "visit_id")) -> DataFrame:
    """One pseudo-random landmark per entity."""
    return pick_row(df, [key], [md5_key(key, *order, seed=seed), *[F.col(c) for c in order]], cols)


def visit_sequence(tl: Timeline, cols: Sequence[str], n: int = 6) -> DataFrame:
    """`sequence`: the last n visits as an array, left padded, each with lag in years, values and missing flags."""
    item = F.struct(*[F.col(c) for c in tl.order], F.col("years"), *[F.col(c) for c in cols])
    df = tl.df.withColumn("__item", item)
    recent = lambda extra: F.collect_list("__item").over(tl.window(False, extra).rowsBetween(-(n - 1), 0))
    if not tl.hot:
        df = df.withColumn("__seq", recent(()))
    else:
        df = tl.on(df).marked()
        # the newest rows of each chunk, and for each chunk the newest rows of the chunks before it
        order = [F.col(c).desc() for c in tl.order]
        tail = (top_k(df.where(F.col("__hot")), [tl.key, "__chunk"], order, n - 1)
                .groupBy(tl.key, "__chunk").agg(F.sort_array(F.collect_list("__item")).alias("__tail")))
        w = Window.partitionBy(tl.key).orderBy("__chunk").rowsBetween(-(n - 1), -1)
        prior = tail.select(tl.key, "__chunk", F.flatten(F.collect_list("__tail").over(w)).alias("__prior"))
        df = null_safe_join(df.withColumn("__seq", recent(["__chunk"])), prior, [tl.key, "__chunk"])
        joined = F.concat(F.coalesce("__prior", F.slice("__seq", 1, 0)), F.col("__seq"))
        df = df.withColumn("__seq", F.slice(joined, F.greatest(F.size(joined) - (n - 1), F.lit(1)), n)).drop(
            "__prior", "__hot", "__chunk")
    step = lambda x: F.struct(
        (F.col("years") - x["years"]).alias("lag_years"), F.lit(0).alias("padding"),
        *[F.coalesce(x[c].cast("double"), F.lit(0.0)).alias(c) for c in cols],
        *[x[c].isNull().cast("int").alias(f"{c}_missing") for c in cols])
    blank = F.struct(F.lit(0.0).alias("lag_years"), F.lit(1).alias("padding"), *[F.lit(0.0).alias(c) for c in cols],
                     *[F.lit(0).alias(f"{c}_missing") for c in cols])
    seq = F.concat(F.array_repeat(blank, F.lit(n) - F.size("__seq")), F.transform("__seq", step))
    return df.withColumn("sequence", seq).drop("__seq", "__item")


def percentile_of(p: Column, edges: Column) -> Column:
    """Percentile (in steps of five) of a score in a 21-point reference vector."""
    return F.size(F.filter(edges, lambda e: e < p)) * 5
