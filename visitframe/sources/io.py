"""Reading and writing tables, parameters and reports."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from visitframe.functions.rules import id_guard
from visitframe.operators.profile import COLUMNS_PER_PASS


def read_raw_csv(spark: SparkSession, path: str, line_breaks: bool = True) -> DataFrame:
    """Every column as text; only an empty cell is null; broken bytes are replaced; a quote inside a cell is doubled.

    With `line_breaks` a quoted cell may hold them, and each file is read by one task. Turn it off for large files
    without such cells: they are then split.
    """
    return spark.read.options(header=True, inferSchema=False, nullValue="", encoding="UTF-8", mode="PERMISSIVE", quote='"', escape='"', multiLine=line_breaks).csv(path)


def infer_types(df: DataFrame) -> dict[str, str]:
    """Narrowest of bigint, double, date, string that fits every known value of each text column, 200 columns per pass."""
    # the pattern comes first, because a failing cast costs far more than a failing match
    shape = {"bigint": r"^\s*[+-]?\d{1,19}\s*$", "double": r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$", "date": r"^\s*\d{4}-\d{1,2}-\d{1,2}\s*$"}
    fits = {k: lambda c, k=k, p=p: F.when(c.rlike(p), c.try_cast(k)) for k, p in shape.items()}
    row = {}
    for i in range(0, len(df.columns), COLUMNS_PER_PASS):
        part = df.columns[i:i + COLUMNS_PER_PASS]
        row |= df.agg(*[F.count_if(F.col(c).isNotNull() & f(F.col(c)).isNull()).alias(f"{c}|{k}") for c in part for k, f in fits.items()]).first().asDict()
    return {c: next((k for k in fits if row[f"{c}|{k}"] == 0), "string") for c in df.columns}


def build_cache(df: DataFrame, prof: DataFrame, path: str, max_missing: float = 90.0) -> dict[str, str]:
    """Write the usable columns of a text table as typed, zstd-compressed parquet; returns the chosen types.

    The profile has one row per column, so the list of kept columns is short.
    """
    keep = [r["variable"] for r in prof.where(F.col("missing_pct") <= max_missing).select("variable").collect()]
    kept = df.select(*[c for c in df.columns if c in set(keep)])
    types = infer_types(kept)
    kept.select(*[F.col(c).cast(k).alias(c) for c, k in types.items()]).write.mode("overwrite").option("compression", "zstd").parquet(path)
    return types


def load_visits(spark: SparkSession, path: str, cols: Sequence[str] | None = None, key: str = "entity_id", date: str = "visit_date") -> DataFrame:
    """Pruned scan with a parsed date. Order is left to the operators that need it."""
    df = spark.read.parquet(path)
    if cols is not None:
        df = df.select(*dict.fromkeys([key, date, *cols]))
    return df.withColumn(date, F.to_date(date))


def save_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    w = df.write.mode("overwrite").option("compression", "zstd")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def load_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_report(df: DataFrame, path: str, id_pattern: str | None = None) -> None:
    """Aggregates as JSON lines; refuses to write text shaped like an identifier."""
    (df if id_pattern is None else id_guard(df, id_pattern)).write.mode("overwrite").json(path)


def read_params(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """JSON lines, or one document (an object or a list) per file with any line breaks; the first line tells which."""
    first = spark.read.text(path).where("trim(value) <> ''").head(1)
    try:
        whole = not (first and isinstance(json.loads(first[0][0]), dict))
    except ValueError:
        whole = True
    reader = spark.read.option("multiLine", whole)
    return (reader.schema(schema) if schema else reader).json(path)


def union_sources(sources: dict[str, DataFrame], rename: dict[str, str], keep: Sequence[str], date: str = "scan_date",
                  domains: dict[str, Sequence] | None = None) -> DataFrame:
    """Stack tables with different spellings: rename, parse the date, name the source; codes outside a domain become null."""
    parts = []
    for name, df in sources.items():
        df = df.withColumnsRenamed({k: v for k, v in rename.items() if k in df.columns})
        parts.append(df.withColumn(date, F.to_date(date)).withColumn("source", F.lit(name)).select(*keep, "source"))
    out = reduce(lambda a, b: a.unionByName(b), parts)
    return out.withColumns({c: F.when(F.col(c).isin(list(ok)), F.col(c)) for c, ok in (domains or {}).items()})


def column_blocks(prof: DataFrame, prefixes: dict[str, str], usable: Column) -> DataFrame:
    """Columns per block of the wide table (by name prefix), how many are usable, and a total row."""
    block = reduce(lambda out, kv: out.when(F.col("variable").startswith(kv[0]), kv[1]), prefixes.items(), F).otherwise("Other")
    t = prof.withColumn("block", block).rollup("block").agg(F.count("*").alias("n_columns"), F.count_if(usable).alias("n_usable"))
    return t.withColumn("block", F.coalesce("block", F.lit("Total")))


def select_matching(df: DataFrame, names: Sequence[str], regex: str) -> DataFrame:
    """Columns named in the list or matching the pattern; the scan is pruned to them."""
    return df.select(*[c for c in df.columns if c in set(names) or re.search(regex, c)])
