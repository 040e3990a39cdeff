"""Boilerplate lines by the number of distinct sites that hold them. DataFrame functions only.

Lines are known by two 64-bit hashes. A first combined aggregate leaves only
lines that stand on two sites or more. Their site counts come from HyperLogLog
sketches, which merge on the map side, so a line of a third of all documents is
no hot key. Lines whose estimate is near the threshold get an exact distinct
count. A line on `min_sites` sites or more is boilerplate: it stays in the
document with the smallest id that holds it and goes from all others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitframe.session import stage

LG_K = 12
#: three standard errors of a sketch with 2^12 registers (1.04 / sqrt(4096) each), and one site
MARGIN = 0.05


def clean_line(line: Column) -> Column:
    """What makes two lines equal: the text without white space at its ends."""
    return F.trim(F.regexp_replace(line, r"^[\t\r\f\v]+|[\t\r\f\v]+$", ""))


def line_keys(docs: DataFrame) -> DataFrame:
    """One row per non-blank line: doc_id, tkey (hash of the text), source, pos, h1, h2."""
    lines = (docs.where(F.col("text").isNotNull())
             .select("doc_id", F.xxhash64("text").alias("tkey"), "source", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
             .withColumn("line", clean_line(F.col("line"))).where(F.col("line") != ""))
    return lines.select("doc_id", "tkey", "source", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))


def boilerplate(lines: DataFrame, min_sites: int) -> DataFrame:
    """h1, h2, first_doc of the lines on `min_sites` distinct sites or more. A null site is no site."""
    key = ["h1", "h2"]
    wide = (lines.groupBy(*key).agg(F.min("source").alias("lo"), F.max("source").alias("hi"), F.min("doc_id").alias("first_doc"))
            .where("lo < hi" if min_sites > 1 else "lo IS NOT NULL").select(*key, "first_doc"))
    wide = stage(wide, "wide-lines")
    at = lines.join(wide, key, "left_semi").where(F.col("source").isNotNull())
    sketches = at.groupBy(*key).agg(F.hll_sketch_agg("source", LG_K).alias("sketch"))
    spread = stage(sketches.select(*key, F.hll_sketch_estimate("sketch").alias("sites")), "line-spread")
    slack = max(1.0, MARGIN * min_sites)
    near = spread.where((F.col("sites") >= min_sites - slack) & (F.col("sites") <= min_sites + slack)).select(*key)
    exact = (lines.join(near, key, "left_semi").groupBy(*key).agg(F.count_distinct("source").alias("sites"))
             .where(F.col("sites") >= min_sites).select(*key))
    sure = spread.where(F.col("sites") > min_sites + slack).select(*key)
    return wide.join(sure.union(exact), key)


def dedup_lines(docs: DataFrame, min_sites: int = 3, keep_first: bool = True) -> DataFrame:
    """All columns of `docs` (doc_id, text, source, ...) with the text cleaned, and `n_lines`, `n_removed`.

    `n_lines` counts non-blank lines. Null and empty texts stay as they are. Repeated rows of one id are cleaned
    alike. Rows without an id are never changed, though their lines count for the spread. With `keep_first` off the
    smallest id loses the line too. Own columns `n_lines`, `n_removed` of `docs` are replaced.
    """
    docs = docs.drop("n_lines", "n_removed")
    lines = stage(line_keys(docs.select("doc_id", "text", "source")), "lines")
    bad = stage(boilerplate(lines, min_sites), "boilerplate")
    hit = lines.join(bad, ["h1", "h2"])
    if keep_first:
        hit = hit.where(F.col("doc_id") != F.col("first_doc"))
    gone = (hit.groupBy(F.col("doc_id").alias("__id"), F.col("tkey").alias("__tkey"))
            .agg(F.collect_set("pos").alias("__gone")))
    cut = F.split("text", "\n")
    out = docs.join(gone, (F.col("doc_id") == F.col("__id")) & (F.xxhash64("text") == F.col("__tkey")), "left")
    places = F.array_except(F.sequence(F.lit(0), F.size(cut) - 1), F.col("__gone"))
    left = F.array_join(F.transform(F.array_sort(places), lambda i: F.get(cut, i)), "\n")
    n_lines = F.coalesce(F.size(F.filter(cut, lambda x: clean_line(x) != "")), F.lit(0))
    return (out.withColumn("n_lines", F.when(F.col("text").isNull(), 0).otherwise(n_lines).cast("long"))
            .withColumn("n_removed", F.coalesce(F.size("__gone"), F.lit(0)).cast("long"))
            .withColumn("text", F.when(F.col("__gone").isNull(), F.col("text")).otherwise(left))
            .select(*docs.columns, "n_lines", "n_removed"))
