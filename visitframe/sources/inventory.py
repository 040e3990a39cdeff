"""File listings as tables: what lies in each folder, and whether it changed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visitframe.functions.columns import parse_name


def list_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """path, length, modificationTime of every file; the contents are not read."""
    files = spark.read.format("binaryFile").options(recursiveFileLookup=True, pathGlobFilter=glob).load(root)
    return files.select("path", "length", "modificationTime")


def folder_inventory(files: DataFrame, name_pattern: str, fields: list[str]) -> DataFrame:
    """Per folder: files, bytes, most frequent extension, archive twin, and the parts of its name."""
    f = files.withColumns({"folder": F.regexp_extract("path", r"([^/]+)/[^/]+$", 1), "file": F.regexp_extract("path", r"([^/]+)$", 1)})
    ext = F.lower(F.regexp_extract("file", r"(\.[^.]+)$", 1))
    f = f.withColumn("ext", F.when(ext == "", "(none)").otherwise(ext))
    zips = f.where(F.col("ext") == ".zip").select(F.regexp_replace("file", r"\.zip$", "").alias("folder"), F.col("length").alias("zip_bytes"))
    by_ext = f.groupBy("folder", "ext").agg(F.count("*").alias("n"), F.sum("length").alias("bytes"))
    per = by_ext.groupBy("folder").agg(F.sum("n").alias("n_files"), F.sum("bytes").alias("bytes"),
                                       F.max_by("ext", F.struct("n", "ext")).alias("file_format"))
    out = per.join(zips, "folder", "left").withColumn("has_zip_twin", F.col("zip_bytes").isNotNull())
    return out.withColumn("name", parse_name("folder", name_pattern, fields)).select("folder", "n_files", "bytes", "file_format", "has_zip_twin", "name.*")


def folder_rollup(files: DataFrame, root: str) -> DataFrame:
    """Per folder at every level below `root` (itself the empty path): files and bytes in it and in all folders below it.

    Folders are told apart by their whole path. `n_direct` counts the files that lie in the folder itself, `n_folders`
    its direct subfolders, and `has_zip_twin` says whether `<path>.zip` lies beside it. Files are counted per folder
    and extension first, so only those few rows are repeated for the folders above.
    """
    # Spark lists full addresses; what comes before the root's path is the scheme
    rel = F.substring_index("path", root.rstrip("/") + "/", -1)
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    own = (files.select(F.regexp_replace(rel, "/?[^/]*$", "").alias("dir"), F.when(ext == "", "(none)").otherwise(ext).alias("ext"), "length")
           .groupBy("dir", "ext").agg(F.count("*").alias("n"), F.sum("length").alias("bytes")))
    parts = F.filter(F.split("dir", "/"), lambda x: x != "")
    up = F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/")))
    each = own.select(up.alias("folder"), "dir", "ext", "n", "bytes")
    by_ext = each.groupBy("folder", "ext").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.sum(F.when(F.col("folder") == F.col("dir"), F.col("n")).otherwise(0)).alias("direct"))
    per = by_ext.groupBy("folder").agg(F.sum("n").alias("n_files"), F.sum("direct").alias("n_direct"), F.sum("bytes").alias("bytes"), F.max_by("ext", F.struct("n", "ext")).alias("file_format"))
    below = per.where("folder <> ''").groupBy(F.regexp_replace("folder", "/?[^/]*$", "").alias("folder")).agg(F.count("*").alias("n_folders"))
    twins = files.where(ext == ".zip").select(F.regexp_replace(rel, r"\.[zZ][iI][pP]$", "").alias("folder")).distinct().withColumn("twin", F.lit(True))
    depth = F.when(F.col("folder") == "", 0).otherwise(F.size(F.split("folder", "/")))
    out = per.join(below, "folder", "left").join(twins, "folder", "left")
    return out.select("folder", depth.alias("depth"), "n_files", "n_direct", F.coalesce("n_folders", F.lit(0)).alias("n_folders"), "bytes", "file_format", F.coalesce("twin", F.lit(False)).alias("has_zip_twin"))


def manifest_check(files: DataFrame, manifest: DataFrame, tolerance: int = 0) -> DataFrame:
    """Sizes and times against an earlier listing; missing and new files fail too."""
    now = files.select("path", F.col("length").alias("size_now"), F.col("modificationTime").alias("time_now"))
    then = manifest.select("path", F.col("length").alias("size_then"), F.col("modificationTime").alias("time_then"))
    j = now.join(then, "path", "full")
    same_size = F.coalesce(F.abs(F.col("size_now") - F.col("size_then")) <= tolerance, F.lit(False))
    return j.withColumns({"size_ok": same_size, "time_ok": F.coalesce(F.col("time_now") <= F.col("time_then"), F.lit(False)),
                          "passed": same_size & F.coalesce(F.col("time_now") <= F.col("time_then"), F.lit(False))})
