"""Registry of the named queries and of their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from visitframe.plans.fixtures import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def tidy(df: DataFrame, rounded: set[str], digits: int) -> DataFrame:
    """Plain output types, and floats rounded so that engines with another summation order agree."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        elif isinstance(f.dataType, (T.FloatType, T.DecimalType)):
            c = c.cast("double")
        if f.name in rounded:
            c = F.round(c.cast("double"), digits) + F.lit(0.0)
        out.append(c.alias(f.name))
    return df.select(*out)


def query(name: str, sql: str | None = None, r: str = "", digits: int = 6):
    """Register `fn(tables) -> DataFrame`; columns named in `r` are rounded on both sides."""
    cols = r.split()

    def register(fn):
        QUERIES[name] = lambda spark, sf_dir: tidy(fn(Tables.of(spark, sf_dir)), set(cols), digits)
        if sql is not None:
            text = sql.strip()
            if cols:
                rep = ", ".join(f"round(CAST({c} AS DOUBLE), {digits}) + 0.0::DOUBLE AS {c}" for c in cols)
                text = f"SELECT * REPLACE ({rep}) FROM ({text})"
            ORACLES[name] = text
        return fn

    return register
