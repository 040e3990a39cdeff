"""Source and sink queries (A1-A10) and image queries (D30-D32).

Files are written below the session's shared folder and read back.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from visitframe.operators import profile, voxels
from visitframe.plans.fixtures import SCANS, VISITS, VOXELS
from visitframe.plans.suite import query
from visitframe.session import scratch_path
from visitframe.sources import inventory, io


def csv_table(t):
    """lineitem as raw text files: coded cells left as they are, low taxes blank."""
    path = scratch_path(t.spark, "raw-csv")
    df = t.lineitem.withColumns({"l_tax": F.when(F.col("l_tax") > 0.02, F.col("l_tax")), "l_shipdate": F.to_date("l_shipdate"),
                                 "sparse": F.when(F.col("l_quantity") == 50, F.lit("x"))})
    df.write.mode("overwrite").option("header", True).csv(path)
    return io.read_raw_csv(t.spark, path)


@query("a1_raw_csv_scan", """SELECT l_returnflag, count(*) AS n, count(CASE WHEN l_tax > 0.02 THEN 1 END) AS n_tax, count(CASE WHEN l_quantity = 50 THEN 1 END) AS n_sparse,
 max(CAST(l_quantity AS VARCHAR)) AS max_text FROM lineitem GROUP BY 1""")
def _(t):
    return csv_table(t).groupBy("l_returnflag").agg(F.count("*").alias("n"), F.count("l_tax").alias("n_tax"), F.count("sparse").alias("n_sparse"),
                                                    F.max("l_quantity").alias("max_text"))


@query("a2_pruned_typed_cache", """SELECT l_linestatus, sum(l_quantity) AS quantity, CAST(max(l_shipdate) AS DATE) AS last_ship, CAST(sum(l_partkey) AS BIGINT) AS parts FROM lineitem GROUP BY 1""", "quantity")
def _(t):
    raw = csv_table(t)
    path = scratch_path(t.spark, "cache")
    types = io.build_cache(raw, profile.profile(raw, ["-4"]), path)
    assert "sparse" not in types
    return io.load_table(t.spark, path).groupBy("l_linestatus").agg(F.sum("l_quantity").alias("quantity"), F.max("l_shipdate").alias("last_ship"),
                                                                   F.sum("l_partkey").alias("parts"))


@query("a3_load_visits", f"WITH {VISITS} SELECT entity_id, count(*) AS n, max(score) AS top FROM v GROUP BY 1", "top")
def _(t):
    path = scratch_path(t.spark, "visits")
    io.save_table(t.visits(), path)
    return io.load_visits(t.spark, path, ["score"]).groupBy("entity_id").agg(F.count("*").alias("n"), F.max("score").alias("top"))


@query("a4_partitioned_save_load", f"WITH {VISITS} SELECT packet, count(*) AS n, sum(score) AS total FROM v WHERE packet = 'F' GROUP BY 1", "total")
def _(t):
    path = scratch_path(t.spark, "model-table")
    io.save_table(t.visits(), path, ["packet"])
    return io.load_table(t.spark, path).where("packet = 'F'").groupBy("packet").agg(F.count("*").alias("n"), F.sum("score").alias("total"))


@query("a5_json_report_roundtrip", f"WITH {VISITS} SELECT segment, count(*) AS n, avg(score) AS mean_score FROM v GROUP BY 1", "mean_score")
def _(t):
    path = scratch_path(t.spark, "report")
    io.write_report(t.visits().groupBy("segment").agg(F.count("*").alias("n"), F.avg("score").alias("mean_score")), path, r"\d{6,}")
    return io.read_params(t.spark, path, "segment string, n long, mean_score double")


def folder_tree(t, one_file: bool = False):
    path = scratch_path(t.spark, "folders")
    name = F.concat_ws("_", F.lit("SET"), F.col("l_returnflag"), F.concat(F.lit("I"), F.col("l_linenumber")))
    rows = t.lineitem.select(name.alias("folder"), "l_orderkey", "l_quantity")
    (rows.repartition("folder") if one_file else rows).write.mode("overwrite").partitionBy("folder").parquet(path)
    return inventory.list_files(t.spark, path)


@query("a6_folder_inventory", None)
def _(t):
    inv = inventory.folder_inventory(folder_tree(t), r"^folder=SET_([A-Z])_I(\d+)$", ["series", "image_id"])
    return inv.select("folder", "n_files", "bytes", "file_format", "has_zip_twin", "series", "image_id", "parsed")


@query("a7_manifest_check", None)
def _(t):
    files = folder_tree(t)
    manifest = scratch_path(t.spark, "manifest")
    files.write.parquet(manifest)
    return inventory.manifest_check(files, t.spark.read.parquet(manifest)).groupBy("passed").agg(F.count("*").alias("n"))


@query("a6_folder_names", """SELECT DISTINCT concat('folder=SET_', l_returnflag, '_I', l_linenumber) AS folder, CAST(1 AS BIGINT) AS n_files, true AS filled, '.parquet' AS file_format, false AS has_zip_twin,
 l_returnflag AS series, CAST(l_linenumber AS VARCHAR) AS image_id FROM lineitem""")
def _(t):
    inv = inventory.folder_inventory(folder_tree(t, one_file=True), r"^folder=SET_([A-Z])_I(\d+)$", ["series", "image_id"])
    return inv.select("folder", "n_files", (F.col("bytes") > 0).alias("filled"), "file_format", "has_zip_twin", "series", "image_id")


@query("a7_manifest_with_faults", """WITH f AS (SELECT DISTINCT l_returnflag, l_linenumber FROM lineitem)
 SELECT size_ok, time_ok, count(*) AS n FROM (SELECT l_linenumber NOT IN (1, 2, 3) AS size_ok, l_linenumber NOT IN (2, 3, 4) AS time_ok FROM f) GROUP BY 1, 2""")
def _(t):
    files = folder_tree(t, one_file=True)
    image = F.regexp_extract("path", r"_I(\d+)/", 1).cast("int")
    # image 1 has another size, 2 is new, 3 is gone, 4 was written later
    then = (files.where(image != 2).withColumn("length", F.col("length") + (image == 1).cast("long"))
            .withColumn("modificationTime", F.when(image == 4, F.col("modificationTime") - F.expr("INTERVAL 1 HOUR")).otherwise(F.col("modificationTime"))))
    checked = inventory.manifest_check(files.where(image != 3), then)
    return checked.groupBy("size_ok", "time_ok").agg(F.count("*").alias("n"))


@query("a6_folder_rollup", """WITH f AS (SELECT DISTINCT l_returnflag AS a, l_linenumber AS b FROM lineitem)
 SELECT '' AS folder, CAST(0 AS BIGINT) AS depth, count(*) AS n_files, CAST(0 AS BIGINT) AS n_direct, count(DISTINCT a) AS n_folders, '.parquet' AS file_format FROM f
 UNION ALL SELECT concat('set=', a), 1, count(*), 0, count(*), '.parquet' FROM f GROUP BY a
 UNION ALL SELECT concat('set=', a, '/image=', b), 2, 1, 1, 0, '.parquet' FROM f""")
def _(t):
    path = scratch_path(t.spark, "nested-folders")
    rows = t.lineitem.select(F.col("l_returnflag").alias("set"), F.col("l_linenumber").alias("image"), "l_orderkey", "l_quantity")
    rows.repartition("set", "image").write.partitionBy("set", "image").parquet(path)
    return inventory.folder_rollup(inventory.list_files(t.spark, path), path).select("folder", "depth", "n_files", "n_direct", "n_folders", "file_format")


@query("a8_union_sources", f"""WITH {SCANS} SELECT source, year(scan_date) AS year, count(*) AS n, sum(measure) AS total, count(CASE WHEN tracer IN (1, 2, 3) THEN 1 END) AS n_tracer FROM s GROUP BY 1, 2""", "total")
def _(t):
    s = t.scans()
    a = s.where("source = 'a'").select("entity_id", F.col("scan_date").cast("string").alias("SCANDATE"), F.col("measure").alias("SUMMARY"), F.col("tracer").alias("TRACER"))
    b = s.where("source = 'b'").select("entity_id", F.col("scan_date").cast("string").alias("SCAN_DATE"), F.col("measure").alias("GAAIN"), F.col("tracer").alias("TRACER"))
    u = io.union_sources({"a": a, "b": b}, {"SCANDATE": "scan_date", "SCAN_DATE": "scan_date", "SUMMARY": "measure", "GAAIN": "measure", "TRACER": "tracer"},
                         ["entity_id", "scan_date", "measure", "tracer"], domains={"tracer": [1, 2, 3]})
    return u.groupBy("source", F.year("scan_date").alias("year")).agg(F.count("*").alias("n"), F.sum("measure").alias("total"), F.count("tracer").alias("n_tracer"))


@query("g1_union_all", f"""WITH {SCANS} SELECT source, tracer, count(*) AS n FROM s GROUP BY 1, 2""")
def _(t):
    s = t.scans()
    keep = ["entity_id", "scan_date", "tracer"]
    u = io.union_sources({k: s.where(F.col("source") == k).select(*keep) for k in ("a", "b")}, {}, keep)
    return u.groupBy("source", "tracer").agg(F.count("*").alias("n"))


@query("a9_column_blocks", """WITH c AS (SELECT unnest(['l_quantity', 'l_tax', 'l_discount', 'l_returnflag', 'l_linestatus', 'l_shipdate', 'l_orderkey', 'l_partkey', 'l_suppkey', 'l_linenumber', 'l_extendedprice']) AS variable, unnest([count(*) FILTER (WHERE l_quantity = 50),
  count(*) FILTER (WHERE l_tax <= 0.06), count(*) FILTER (WHERE l_discount <= 0.05), 0, 0, 0, 0, 0, 0, 0, 0]) / count(*) * 100 AS m FROM lineitem),
 b AS (SELECT CASE WHEN starts_with(variable, 'l_line') THEN 'Line' WHEN starts_with(variable, 'l_s') THEN 'Ship' ELSE 'Other' END AS block, m FROM c)
 SELECT coalesce(block, 'Total') AS block, count(*) AS n_columns, count(*) FILTER (WHERE m <= 50) AS n_usable FROM b GROUP BY ROLLUP (block)""")
def _(t):
    df = t.lineitem.select(F.when(F.col("l_quantity") != 50, F.col("l_quantity")).alias("l_quantity"), F.when(F.col("l_tax") > 0.06, F.col("l_tax")).alias("l_tax"),
                           F.when(F.col("l_discount") > 0.05, F.col("l_discount")).alias("l_discount"), "l_returnflag", "l_linestatus", "l_shipdate", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")
    return io.column_blocks(profile.profile(df, []), {"l_line": "Line", "l_s": "Ship"}, F.col("missing_pct") <= 50)


@query("a10_select_matching", """SELECT l_orderkey, l_linestatus, l_shipdate::DATE AS l_shipdate, count(*) AS n FROM lineitem GROUP BY 1, 2, 3""")
def _(t):
    df = io.select_matching(t.lineitem, ["l_orderkey", "l_linestatus"], "(DATE|date)$")
    return df.withColumn("l_shipdate", F.to_date("l_shipdate")).groupBy(*df.columns).agg(F.count("*").alias("n"))


# ---- images -------------------------------------------------------------------------

WIN = {0: (0.0, 2.0), 1: (1.0, 3.0), 2: (20.0, 30.0)}


def all_frames(t):
    """Four frames per image: the stored one and three scaled copies."""
    v = t.voxels().drop("frame", "duration")
    k = F.explode(F.array(*[F.lit(i) for i in range(4)])).alias("frame")
    v = v.select("*", k)
    return v.withColumns({"value": F.col("value") * (F.lit(1.0) + F.col("frame") / 10), "duration": F.lit(1.0) + F.col("frame"), "tracer": F.col("tracer") % 4})


FRAMES = VOXELS + """, af AS (SELECT image_id, z, y, x, tracer % 4 AS tracer, k AS frame, value * (1 + k / 10.0::DOUBLE) AS value, 1.0::DOUBLE + k AS duration FROM vox, range(0, 4) g(k)),
 fr AS (SELECT DISTINCT image_id, tracer, frame, duration, frame * 3.0::DOUBLE AS mid FROM af), wf AS (SELECT *, CASE WHEN tracer = 0 THEN mid BETWEEN -5 AND 7 WHEN tracer = 1 THEN mid BETWEEN -4 AND 8 WHEN tracer = 2 THEN mid BETWEEN 15 AND 35 ELSE false END AS inside FROM fr),
 us AS (SELECT image_id, frame, duration FROM (SELECT *, count(*) FILTER (WHERE inside) OVER (PARTITION BY image_id) AS ni FROM wf) WHERE CASE WHEN ni >= 2 THEN inside ELSE true END),
 sm AS (SELECT image_id, z, y, x, sum(value * duration) / sum(duration) AS value FROM af JOIN us USING (image_id, frame, duration) GROUP BY 1, 2, 3, 4)"""


def used_frames(v):
    frames = v.select("image_id", "tracer", "frame", "duration", (F.col("frame") * 3.0).alias("mid")).distinct()
    return voxels.frames_to_use(frames, WIN)


def static(t):
    v = all_frames(t)
    return voxels.static_mean(v, used_frames(v))


@query("d30_static_mean", f"WITH {FRAMES} SELECT * FROM sm", "value")
def _(t):
    return static(t)


def mask(t):
    return t.voxels().select("z", "y", "x").distinct().withColumn("region", F.when(F.col("z") < 2, "cortex").otherwise("reference"))


@query("d31_roi_ratio", f"""WITH {FRAMES} SELECT image_id, avg(value) FILTER (WHERE z < 2) / avg(value) FILTER (WHERE z >= 2) AS ratio, avg(CAST(value > 0 AS INT)) FILTER (WHERE z >= 2) AS coverage FROM sm GROUP BY 1""", "ratio coverage")
def _(t):
    return voxels.roi_ratio(static(t), mask(t))


@query("d32_block_means", f"WITH {FRAMES} SELECT image_id, z // 2 AS bz, y // 2 AS byy, x // 2 AS bx, avg(value) AS value FROM sm GROUP BY 1, 2, 3, 4", "value")
def _(t):
    return voxels.block_means(static(t), 2).withColumnRenamed("by", "byy")


@query("d32_mean_volume", f"""WITH {FRAMES}, sc AS (SELECT image_id, greatest(avg(value), 1e-6) AS s FROM sm WHERE z < 2 GROUP BY 1)
 SELECT CAST(label AS VARCHAR) AS grp, z, y, x, avg(value / s) AS value, count(*) AS n_images FROM sm JOIN sc USING (image_id) JOIN embeddings ON vec_id = image_id GROUP BY 1, 2, 3, 4""", "value")
def _(t):
    group = t.embeddings.select(F.col("vec_id").alias("image_id"), F.col("label").cast("string").alias("grp"))
    return voxels.mean_volume(static(t), mask(t).where("region = 'cortex'"), group)
