"""Top-k lists, text lists of leading values, idempotent appends and entity sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitframe.scaling import pick_row, top_k


def top_contrib(df: DataFrame, row: Sequence[str], k: int = 8, floor: float = 0.02, value: str = "contribution", tie: str = "feature") -> DataFrame:
    """The k largest contributions per row by absolute value, above the floor."""
    return top_k(df.where(F.abs(value) > floor), row, [F.abs(value).desc(), F.col(tie)], k)


def top_signed(df: DataFrame, row: Sequence[str], up: int = 3, down: int = 2, floor: float = 0.05, value: str = "contribution", tie: str = "feature") -> DataFrame:
    """Leading positive and negative contributions per row."""
    d = df.where(F.abs(value) > floor).withColumn("sign", F.when(F.col(value) > 0, 1).otherwise(-1))
    k = F.when(F.col("sign") > 0, up).otherwise(down)
    return top_k(d, [*row, "sign"], [F.abs(value).desc(), F.col(tie)], max(up, down)).where(F.col("rank") <= k)


def top_n(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows of a total order."""
    return df.orderBy(*order).limit(n)


def top_text(counts: DataFrame, by: Sequence[str], label: str, n: str, k: int) -> DataFrame:
    """`a (9), b (5), +3 more` from (group, label, n) counts."""
    total = counts.groupBy(*by).agg(F.count("*").alias("__k"))
    head = top_k(counts, by, [F.col(n).desc(), F.col(label)], k)
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", label, n))),
                                    lambda x: F.concat(x[label].cast("string"), F.lit(" ("), x[n].cast("string"), F.lit(")"))), ", ")
    t = head.groupBy(*by).agg(text.alias("text")).join(total, list(by))
    more = F.when(F.col("__k") > k, F.concat(F.lit(", +"), (F.col("__k") - k).cast("string"), F.lit(" more"))).otherwise("")
    return t.select(*by, F.concat("text", more).alias("text"))


def upsert_last(old: DataFrame, new: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Union of a log and new rows, keeping the newest per key."""
    both = old.withColumn("__gen", F.lit(0)).unionByName(new.withColumn("__gen", F.lit(1)))
    rest = [c for c in old.columns if c not in key]
    return pick_row(both, key, [F.col("__gen"), *[F.col(c) for c in order]], rest, last=True)


def ids_intersect(*sets: DataFrame, key: str = "entity_id") -> DataFrame:
    out = sets[0].select(key)
    for s in sets[1:]:
        out = out.intersect(s.select(key))
    return out.distinct()


def ids_except(a: DataFrame, *others: DataFrame, key: str = "entity_id") -> DataFrame:
    out = a.select(key).distinct()
    for o in others:
        out = out.join(o.select(key).distinct(), key, "left_anti")
    return out
