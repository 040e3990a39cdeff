"""Column expressions for cleaning and deriving measures. All stay inside code generation."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from visitframe.scaling import col, exact_quantiles, null_safe_join, small_side

# First match wins, in this order (pattern, tracer, class).
TRACER_PATTERNS = [
    (r"fdg|fluorodeoxyglucose", "FDG", "fdg"),
    (r"pib|pittsburgh", "PiB", "amyloid"),
    (r"florbetapir|av-?45|amyvid", "Florbetapir", "amyloid"),
    (r"florbetaben|neuraceq|fbb", "Florbetaben", "amyloid"),
    (r"nav-?4694|flutafuranol", "NAV4694", "amyloid"),
    (r"flutemetamol|vizamyl", "Flutemetamol", "amyloid"),
    (r"mk-?6240", "MK-6240", "tau"),
    (r"flortaucipir|av-?1451|t807|tauvid", "Flortaucipir", "tau"),
    (r"pi-?2620", "PI-2620", "tau"),
    (r"gtp-?1", "GTP1", "tau"),
]


# ---- cleaning ---------------------------------------------------------------

def clean(df: DataFrame, varmap: dict[str, dict]) -> DataFrame:
    """Null out each variable's own missing codes; ids, dates and text columns stay as they are."""
    numeric = {f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)}

    def one(c: str) -> Column:
        spec = varmap.get(c)
        if spec is None or spec["kind"] in ("id", "date") or c not in numeric or not spec["missing"]:
            return F.col(c)
        return F.when(~F.col(c).isin(spec["missing"]), F.col(c)).alias(c)

    return df.select(*[one(c) for c in df.columns])


def code_counts(df: DataFrame, codes: dict[str, Sequence]) -> DataFrame:
    """Per variable: how many cells hold one of its codes, and which share of all rows."""
    stats = df.agg(F.count("*").alias("n_rows"), F.array(*[
        F.struct(F.lit(c).alias("variable"), F.count_if(F.col(c).isin(list(k))).alias("n_coded")) for c, k in codes.items()]).alias("x"))
    return stats.select("n_rows", F.inline("x")).withColumn("share", F.col("n_coded") / F.col("n_rows"))


def nan_to_null(c: str | Column) -> Column:
    """NaN from a file or a model becomes NULL at the boundary."""
    return F.when(~F.isnan(col(c)), col(c))


# ---- encodings --------------------------------------------------------------

def label(c: str | Column, mapping: dict) -> Column:
    return F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in mapping.items()))[col(c)]


def indicator(c: str | Column, code, null_as_zero: bool = False) -> Column:
    """1/0 for `c = code`; an unknown value stays null, or counts as 0 where asked."""
    hit = (col(c) == code).cast("int")
    return F.coalesce(hit, F.lit(0)) if null_as_zero else hit


def coalesce_forms(a: str | Column, b: str | Column | None = None) -> Column:
    """Absent/recent/remote answer of the first form as 0/1, else the second form's count as 0/1."""
    first = F.when(col(a) == 0, 0).when(col(a).isin(1, 2), 1)
    return first if b is None else F.coalesce(first, (col(b) >= 1).cast("int"))


def event_by_year(year: str | Column, visit: str | Column, fallback: Column, none_code: int = 8888, after: int = 1900) -> Column:
    """0 for the 'no event' code, 1 for an event in a year up to the visit's, else the fallback answer."""
    y = col(year)
    return F.coalesce(F.when((y > after) & (y <= F.year(col(visit))), 1).when(y == none_code, 0), fallback)


def clip(c: str | Column, lo: float, hi: float) -> Column:
    return F.when(col(c).isNotNull(), F.greatest(F.least(col(c), F.lit(hi)), F.lit(lo)))


def n_known(cols: Sequence[str | Column]) -> Column:
    return reduce(lambda a, b: a + b, [col(c).isNotNull().cast("int") for c in cols])


def row_sum(cols: Sequence[str | Column], min_count: int = 0) -> Column:
    """Sum of the known items, null if fewer than `min_count` are known."""
    total = reduce(lambda a, b: a + b, [F.coalesce(col(c).cast("double"), F.lit(0.0)) for c in cols])
    return F.when(n_known(cols) >= min_count, total)


def row_mean(cols: Sequence[str | Column]) -> Column:
    return F.try_divide(row_sum(cols, 1), n_known(cols))


def row_min(cols: Sequence[str | Column]) -> Column:
    return F.least(*[col(c) for c in cols])


def row_count_codes(cols: Sequence[str | Column], codes: Sequence, not_given=-4) -> Column:
    """How many items hold one of the codes; null if no item was given (a blank cell counts as given)."""
    hits = reduce(lambda a, b: a + b, [F.coalesce(col(c).isin(list(codes)).cast("int"), F.lit(0)) for c in cols])
    given = reduce(lambda a, b: a | b, [~col(c).eqNullSafe(F.lit(not_given)) for c in cols])
    return F.when(given, hits)


def risk_count(cols: Sequence[str | Column], min_known: int = 3) -> Column:
    return row_sum(cols, min_known)


# ---- text -------------------------------------------------------------------

def classify(patterns: Sequence[tuple[str, str, str]], *texts: str | Column) -> Column:
    """(name, class) of the first pattern found; the first text with any match decides."""
    def of(text: Column) -> Column:
        low = F.lower(F.coalesce(text, F.lit("")))
        out = F.lit(None).cast("struct<name:string,class:string>")
        for pattern, name, group in reversed(patterns):
            out = F.when(low.rlike(pattern), F.struct(F.lit(name).alias("name"), F.lit(group).alias("class"))).otherwise(out)
        return out
    unknown = F.struct(F.lit("unknown").alias("name"), F.lit("unknown").alias("class"))
    return F.coalesce(*[of(col(c)) for c in texts], unknown)


def parse_name(c: str | Column, pattern: str, fields: Sequence[str]) -> Column:
    """Struct of the pattern's groups, empty strings and `parsed` false where the name does not match."""
    parts = [F.regexp_extract(col(c), pattern, i + 1).alias(f) for i, f in enumerate(fields)]
    return F.struct(*parts, col(c).rlike(pattern).alias("parsed"))


def norm_uid(c: str | Column) -> Column:
    return F.regexp_replace(F.trim(col(c)), "^I", "")


def clock_seconds(c: str | Column) -> Column:
    """HHMMSS.f text as seconds since midnight."""
    s = col(c)
    rest = F.substring(s, 5, 32)
    return (F.substring(s, 1, 2).cast("int") * 3600 + F.substring(s, 3, 2).cast("int") * 60
            + F.when(rest == "", F.lit(0.0)).otherwise(rest.cast("double")))


def elapsed_seconds(start: Column, end: Column) -> Column:
    """Time from start to end on a 24-hour clock."""
    return F.pmod(end - start, F.lit(86400.0))


# ---- dates ------------------------------------------------------------------

def month(c: str | Column) -> Column:
    """Dates leave at month resolution."""
    return F.date_format(col(c), "yyyy-MM")


def try_date(c: str | Column) -> Column:
    """Date from text, null where it does not parse."""
    return F.to_date(F.try_to_timestamp(col(c)))


def year_bin(years: str | Column) -> Column:
    """Whole years, halves to the even year."""
    return F.bround(col(years)).cast("long")


# ---- bins -------------------------------------------------------------------

def cut(c: str | Column, edges: Sequence[float], labels: Sequence[str], right: bool = True) -> Column:
    """Fixed-edge bins: (a, b] if `right`, else [a, b); null outside."""
    v, out = col(c), F
    for lo, hi, name in zip(edges[:-1], edges[1:], labels):
        cond = (v > lo) & (v <= hi) if right else (v >= lo) & (v < hi)
        out = out.when(cond, name)
    return out


def quantile_edges(df: DataFrame, c: str, q: int, by: Sequence[str] = (), **kw) -> DataFrame:
    """`edges`: sorted distinct quantile edges, one array per group."""
    names = {f"q{i}": i / q for i in range(q + 1)}
    e = exact_quantiles(df, by, c, names, **kw)
    return e.select(*by, F.array_sort(F.array_distinct(F.array(*names))).alias("edges"))


def edge_bin(v: Column, edges: Column) -> Column:
    """1-based (a, b] bin, the lowest value included in the first."""
    return F.when(v.isNotNull(), F.greatest(F.size(F.filter(edges, lambda e: e < v)), F.lit(1)))


def qcut(df: DataFrame, c: str, q: int, out: str = "bin", by: Sequence[str] = (), **kw) -> DataFrame:
    """Equal-sized groups by exact quantile edges; duplicate edges are dropped."""
    edges = quantile_edges(df, c, q, by, **kw)
    v = F.col(c).cast("double")
    if not by:
        return df.withColumn("__edges", edges.scalar()).withColumn(out, edge_bin(v, F.col("__edges"))).drop("__edges")
    return null_safe_join(df, small_side(edges, "edges"), list(by)).withColumn(out, edge_bin(v, F.col("edges"))).drop("edges")


# ---- probabilities ----------------------------------------------------------

def logit(p: str | Column, eps: float = 1e-5) -> Column:
    q = clip(p, eps, 1 - eps)
    return F.ln(q / (F.lit(1.0) - q))


def sigmoid(x: str | Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-col(x)))
