"""Profiles, descriptions, crosstabs and cohort tables.

Long tables of (column, value) or (group, value) come from one pass over the
data; anything sorted or ranked goes through the bucketed primitives.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from visitframe.functions.columns import cut, month, qcut, try_date, year_bin
from visitframe.operators.pit import first_known
from visitframe.scaling import exact_quantiles, null_safe_join

COLUMNS_PER_PASS = 200


def unpivot(df: DataFrame, keys: Sequence[str], cols: Sequence[str], cast: str = "double", name: str = "variable",
            value: str = "value") -> DataFrame:
    """One row per (row, column), in place and without a shuffle."""
    items = [F.struct(F.lit(c).alias(name), F.col(c).cast(cast).alias(value)) for c in cols]
    return df.select(*keys, F.inline(F.array(*items)))


# ---- column profile -----------------------------------------------------------

def profile(df: DataFrame, codes: Sequence[str]) -> DataFrame:
    """Per column: blank and coded cells and their shares. Wide tables are profiled 200 columns at a time."""
    out = None
    for i in range(0, len(df.columns), COLUMNS_PER_PASS):
        part = df.columns[i:i + COLUMNS_PER_PASS]
        stats = df.agg(F.count("*").alias("n_rows"), F.array(*[
            F.struct(F.lit(c).alias("variable"), F.count_if(F.col(c).isNull()).alias("n_blank"),
                     F.count_if(F.col(c).cast("string").isin(list(codes))).alias("n_coded")) for c in part]).alias("x"))
        rows = stats.select("n_rows", F.inline("x"))
        out = rows if out is None else out.unionByName(rows)
    pct = lambda n: F.lit(100.0) * n / F.greatest(F.col("n_rows"), F.lit(1))
    return out.withColumns({"blank_pct": pct(F.col("n_blank")), "missing_pct": pct(F.col("n_blank") + F.col("n_coded"))})


def profile_summary(prof: DataFrame) -> DataFrame:
    """Counts of complete, sparse and empty columns and the overall share of missing cells (one row per column in)."""
    m = F.col("missing_pct")
    return prof.agg(F.count("*").alias("n_columns"), F.count_if(m == 0).alias("complete"), F.count_if(m > 50).alias("over_50"),
                    F.count_if(m > 90).alias("over_90"), F.count_if(m >= 100).alias("empty"),
                    (F.lit(100.0) * F.sum(F.col("n_blank") + F.col("n_coded")) / F.sum("n_rows")).alias("overall_missing_pct"),
                    F.percentile(m, 0.5).alias("median_missing_pct"))


def describe(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """min, p25, median, mean, p75, max."""
    q = exact_quantiles(df, by, value, {"min": 0.0, "p25": 0.25, "median": 0.5, "p75": 0.75, "max": 1.0})
    mean = df.groupBy(*by).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))
    if by:
        return null_safe_join(mean, q, list(by))
    return mean.select("n", "mean", q.select(F.struct("min", "p25", "median", "p75", "max")).scalar().alias("q")).select("n", "mean", "q.*")


VISIT_BUCKETS = ([0, 1, 2, 3, 4, 5, 10, float("inf")], ["1", "2", "3", "4", "5", "6-10", "11+"])


def rows_per_entity(df: DataFrame, key: str = "entity_id") -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n_visits"))


def rows_histogram(per: DataFrame) -> DataFrame:
    edges, labels = VISIT_BUCKETS
    return per.groupBy(cut("n_visits", edges, labels).alias("bucket")).agg(F.count("*").alias("n"))


def category_counts(df: DataFrame, cols: Sequence[str], max_distinct: int = 40) -> DataFrame:
    """Counts per value with `(blank)`, for columns of at most `max_distinct` values."""
    long = unpivot(df, [], cols, "string")
    cells = long.groupBy("variable", F.coalesce("value", F.lit("(blank)")).alias("value")).agg(F.count("*").alias("n"))
    few = cells.groupBy("variable").agg(F.count("*").alias("k")).where(F.col("k") <= max_distinct)
    return cells.join(few.select("variable"), "variable", "left_semi")


def date_ranges(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Earliest and latest month per date column and the share of cells that parse."""
    long = unpivot(df, [], cols, "string").withColumn("d", try_date("value"))
    return (long.groupBy("variable").agg(F.min("d").alias("lo"), F.max("d").alias("hi"), F.count("d").alias("k"), F.count("*").alias("n"))
            .where("k > 0").select("variable", month("lo").alias("min_month"), month("hi").alias("max_month"),
                                   (F.lit(100.0) * F.col("k") / F.col("n")).alias("parsed_pct")))


def coverage(visits: DataFrame, sources: dict[str, DataFrame], known: Column, key: str = "entity_id") -> DataFrame:
    """Entities per source and combination, from one row of flags per entity."""
    base = visits.groupBy(key).agg(F.count("*").alias("n_visits"), F.max(known.cast("int")).alias("known"))
    flags = base
    for name, s in sources.items():
        flags = flags.join(s.select(key).distinct().withColumn(f"has_{name}", F.lit(1)), key, "full")
    has = {n: F.col(f"has_{n}").isNotNull() for n in sources}
    seen, names = F.col("n_visits").isNotNull(), list(sources)
    both = seen
    for n in names:
        both = both & has[n]
    lines = {"any visit": seen, "2+ visits": F.col("n_visits") >= 2, "3+ visits": F.col("n_visits") >= 3, "known": F.col("known") == 1,
             **{f"source {n}": seen & has[n] for n in names}, "all sources": both, **{f"{n} without visits": ~seen & has[n] for n in names}}
    return (flags.agg(F.array(*[F.struct(F.lit(k).alias("line"), F.count_if(c).alias("n")) for k, c in lines.items()]).alias("x"))
            .select(F.inline("x")))


# ---- shares and crosstabs -------------------------------------------------------

def pivot_share(df: DataFrame, cols: Sequence[str], by: str, levels: Sequence) -> DataFrame:
    """Share of rows where each column is known, one output column per level of `by`."""
    long = unpivot(df, [by], cols, "string").withColumn("k", F.col("value").isNotNull().cast("int"))
    return long.groupBy("variable").pivot(by, list(levels)).agg(F.avg("k"))


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts of a × b with margins (`All`) and each cell's share of its row."""
    c = df.select(F.coalesce(F.col(a).cast("string"), F.lit("(blank)")).alias("a"), F.coalesce(F.col(b).cast("string"), F.lit("(blank)")).alias("b"))
    cube = c.cube("a", "b").agg(F.count("*").alias("n")).select(F.coalesce("a", F.lit("All")).alias("a"), F.coalesce("b", F.lit("All")).alias("b"), "n")
    total = F.max(F.when(F.col("b") == "All", F.col("n"))).over(Window.partitionBy("a"))
    return cube.withColumn("row_pct", F.lit(100.0) * F.col("n") / total)


def transitions(v: DataFrame, status: str = "status") -> DataFrame:
    """First known × last known status per entity."""
    first = first_known(v, [status]).withColumnRenamed(status, "first")
    last = first_known(v, [status], last=True).withColumnRenamed(status, "last")
    return crosstab(first.join(last, "entity_id"), "first", "last")


def rate_by(df: DataFrame, x: str, y: str, by: Sequence[str]) -> DataFrame:
    return df.where(F.col(y).isNotNull()).groupBy(*by, x).agg(F.count("*").alias("n"), F.avg(y).alias("rate"))


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """Two codings of one fact: both known, % yes each, % equal, % of a's yes confirmed by b."""
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    pct = lambda c: F.avg(c.cast("int")) * 100
    return both.agg(F.count("*").alias("both_known"), pct(F.col(a) == 1).alias("a_yes_pct"), pct(F.col(b) == 1).alias("b_yes_pct"),
                    pct(F.col(a) == F.col(b)).alias("agree_pct"), pct(F.when(F.col(a) == 1, F.col(b) == 1)).alias("confirmed_pct"))


def availability_by_year(v: DataFrame, cols: Sequence[str], date: str = "visit_date") -> DataFrame:
    """Share known per calendar year for each column and for any of them."""
    anyone = reduce(lambda x, y: x | y, [F.col(c).isNotNull() for c in cols])
    return v.groupBy(F.year(date).alias("year")).agg(F.count("*").alias("n"), *[F.avg(F.col(c).isNotNull().cast("int")).alias(f"share_{c}") for c in cols],
                                                     F.avg(anyone.cast("int")).alias("share_any"))


def trajectories(v: DataFrame, value: str, baseline: str) -> DataFrame:
    """Mean and count by baseline group and rounded year."""
    return v.where(F.col(value).isNotNull()).groupBy(baseline, year_bin("years").alias("year_bin")).agg(
        F.avg(value).alias("mean_value"), F.count("*").alias("n"))


# ---- cohorts ----------------------------------------------------------------------

def cohort_flow(v: DataFrame, steps: dict[str, Column], key: str = "entity_id") -> DataFrame:
    """Rows that pass every condition up to and including each step, in one pass."""
    lines, so_far = [], F.lit(True)
    for i, (name, cond) in enumerate(steps.items()):
        so_far = so_far & F.coalesce(cond, F.lit(False))
        lines.append(F.struct(F.lit(i).alias("step"), F.lit(name).alias("name"), F.count_if(so_far).alias("n")))
    return v.agg(F.array(*lines).alias("x")).select(F.inline("x"))


def cohort_table(v: DataFrame, cohorts: dict[str, Column], targets: Sequence[str]) -> DataFrame:
    """n and events per cohort × target × split."""
    items = [F.struct(F.lit(name).alias("cohort"), F.lit(tg).alias("target"), F.when(cond, F.col(tg)).alias("y"))
             for name, cond in cohorts.items() for tg in targets]
    return (v.select("split", F.inline(F.array(*items))).where("y IS NOT NULL").groupBy("cohort", "target", "split")
            .agg(F.count("*").alias("n"), F.sum("y").alias("events")))


def selection(first: DataFrame, has_followup: Column, age: str, status: str = "status") -> DataFrame:
    return first.groupBy(status).agg(F.count("*").alias("n"), (F.avg(has_followup.cast("int")) * 100).alias("followup_pct"),
                                     F.avg(F.when(has_followup, F.col(age))).alias("age_with"), F.avg(F.when(~has_followup, F.col(age))).alias("age_without"))


def split_table(first: DataFrame, site: str = "site", status: str = "status", levels: Sequence = (1, 2, 3)) -> DataFrame:
    return first.groupBy("split").agg(F.count("*").alias("entities"), F.count_distinct(site).alias("sites"),
                                      *[(F.avg((F.col(status) == s).cast("int")) * 100).alias(f"pct_{s}") for s in levels])


def coverage_gain(v: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """Share known before and after a fill step, and what is still missing."""
    pct = lambda c: F.avg(F.col(c).isNotNull().cast("int")) * 100
    return (v.agg(F.array(*[F.struct(F.lit(n).alias("variable"), pct(a).alias("before_pct"), pct(b).alias("after_pct"),
                                     (F.lit(100.0) - pct(b)).alias("missing_pct")) for n, (a, b) in pairs.items()]).alias("x")).select(F.inline("x")))


def compare_groups(df: DataFrame, group: str, age: str, known: Column, carrier: Column, site: str = "site") -> DataFrame:
    """Index-visit comparison: size, sites, median age, share known and share carrying."""
    med = exact_quantiles(df, [group], age, {"median_age": 0.5})
    agg = df.groupBy(group).agg(F.count("*").alias("n"), F.count_distinct(site).alias("sites"), (F.avg(known.cast("int")) * 100).alias("known_pct"),
                                (F.avg(F.when(known, carrier.cast("int"))) * 100).alias("carrier_pct"))
    return null_safe_join(agg, med, [group])


def combo_counts(df: DataFrame, label: Column) -> DataFrame:
    c = df.groupBy(label.alias("combination")).agg(F.count("*").alias("n"))
    return c.withColumn("pool_pct", F.lit(100.0) * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))))


# ---- measures -----------------------------------------------------------------------

def valid_pct(v: DataFrame, cols: Sequence[str], first: Column) -> DataFrame:
    """Share of known values per variable, over all visits and over first visits."""
    return v.agg(F.array(*[F.struct(F.lit(c).alias("variable"), (F.avg(F.col(c).isNotNull().cast("int")) * 100).alias("all_pct"),
                                    (F.avg(F.when(first, F.col(c).isNotNull().cast("int"))) * 100).alias("first_pct")) for c in cols]).alias("x")).select(F.inline("x"))


def prevalence(v: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Share of each code among the known values of each variable."""
    cells = unpivot(v, [], cols).where("value IS NOT NULL").groupBy("variable", "value").agg(F.count("*").alias("n"))
    return cells.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("variable")))


def code_share(v: DataFrame, cols: Sequence[str], codes: Sequence, not_given, by: Sequence[str]) -> DataFrame:
    """Share of "could not do" codes among the items that were given."""
    long = unpivot(v, by, cols)
    given = ~F.col("value").eqNullSafe(F.lit(not_given))
    return long.groupBy(*by, "variable").agg(F.count_if(given).alias("n_given"), F.avg(F.when(given, F.coalesce(F.col("value").isin(list(codes)), F.lit(False)).cast("int"))).alias("share"))


def binned(df: DataFrame, x: str, y: str, q: int, min_n: int = 0) -> DataFrame:
    """Mean of x and y, sd of y per quantile bin of x."""
    d = qcut(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()), x, q)
    return (d.groupBy("bin").agg(F.count("*").alias("n"), F.avg(x).alias("mean_x"), F.avg(y).alias("mean_y"), F.stddev_samp(y).alias("sd_y"))
            .where(F.col("n") >= min_n))


def suppress(table: DataFrame, rule: Column) -> DataFrame:
    """Keep only the cells large enough to show."""
    return table.where(rule)


def suppress_values(table: DataFrame, rule: Column, cols: Sequence[str]) -> DataFrame:
    """Keep the row but blank its values where the cell is too small."""
    return table.withColumns({c: F.when(rule, F.col(c)) for c in cols})


# ---- components ------------------------------------------------------------------------

def pca_variance(df: DataFrame, vector: str, k: int) -> DataFrame:
    """Cumulative share of variance explained by the first k components of standardised columns."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector
    v = df.select(array_to_vector(F.col(vector)).alias("x"))
    z = StandardScaler(withMean=True, withStd=True, inputCol="x", outputCol="z").fit(v).transform(v)
    ratio = [float(r) for r in PCA(k=k, inputCol="z", outputCol="pc").fit(z).explainedVariance]
    rows = [(i + 1, r, sum(ratio[:i + 1])) for i, r in enumerate(ratio)]
    return df.sparkSession.createDataFrame(rows, "component int, share double, cumulative double")


# ---- reference values --------------------------------------------------------------------

def reference_vector(df: DataFrame, value: str, points: int = 21) -> DataFrame:
    """`edges`: evenly spaced percentiles of a score as one array."""
    names = {f"q{i}": i / (points - 1) for i in range(points)}
    return exact_quantiles(df, [], value, names).select(F.array(*names).alias("edges"))


def reference_ranges(df: DataFrame, value: str, by: str, event: str) -> DataFrame:
    """Per group and over all (`All`): p1, p99, share of zeros, event rate."""
    both = df.select(F.explode(F.array(F.col(by).cast("string"), F.lit("All"))).alias("grp"), value, event)
    q = exact_quantiles(both, ["grp"], value, {"p01": 0.01, "p99": 0.99})
    agg = both.groupBy("grp").agg(F.count("*").alias("n"), F.avg((F.col(value) == 0).cast("int")).alias("zero_share"), F.avg(event).alias("event_rate"))
    return null_safe_join(agg, q, ["grp"])


def inventory_summary(inv: DataFrame, folder: str, fields: Sequence[str]) -> DataFrame:
    """(folder, field, value, n) for every category field of an inventory."""
    return unpivot(inv, [folder], fields, "string", "field").groupBy(folder, "field", F.coalesce("value", F.lit("(blank)")).alias("value")).agg(
        F.count("*").alias("n"))
