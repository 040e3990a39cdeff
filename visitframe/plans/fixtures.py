"""Views that map the given tables onto visits, scans, predictions and the other roles.

Each view has a SQL twin as a CTE, used by the SQL side of the checks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visitframe.scaling import Timeline, hot_keys

VISITS = """v AS (SELECT o_custkey AS entity_id, CAST(o_orderdate AS DATE) AS visit_date, o_orderkey AS visit_id,
 CAST(c_nationkey AS BIGINT) AS site, CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS status, o_totalprice / 10000 AS score,
 o_orderstatus AS packet, c_mktsegment AS segment, c_acctbal AS acctbal
 FROM orders JOIN customer ON o_custkey = c_custkey)"""

SPARSE = VISITS + """, sp AS (SELECT * REPLACE (CASE WHEN packet <> 'P' THEN score END AS score) FROM v)"""

TIMED = VISITS + """, tv AS (SELECT *, date_diff('day', min(visit_date) OVER (PARTITION BY entity_id), visit_date) AS days,
 date_diff('day', min(visit_date) OVER (PARTITION BY entity_id), visit_date) / 365.25::DOUBLE AS years,
 row_number() OVER (PARTITION BY entity_id ORDER BY visit_date, visit_id) AS rn FROM v)"""

LABELLED = TIMED + """, lab AS (SELECT *, max(years) OVER (PARTITION BY entity_id) - years AS followup_after,
 min(CASE WHEN status = 1 THEN years END) OVER (PARTITION BY entity_id ORDER BY visit_date, visit_id
   ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) - years AS time_to_event,
 coalesce(max(CASE WHEN status = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY entity_id ORDER BY visit_date, visit_id
   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) = 0 AND status IN (2, 3, 4, 5) AS eligible FROM tv),
 ev AS (SELECT *, coalesce(time_to_event, followup_after) AS event_time, CAST(time_to_event IS NOT NULL AS BIGINT) AS event,
 CASE WHEN time_to_event <= 1 THEN 1 WHEN followup_after >= 1 THEN 0 END AS label FROM lab)"""

SCANS = """s AS (SELECT o_custkey AS entity_id, CAST(l_shipdate AS DATE) AS scan_date,
 concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS scan_id, CAST(l_linenumber AS BIGINT) AS tracer,
 l_returnflag <> 'R' AS qc, l_quantity AS measure, l_extendedprice AS measure2,
 CASE WHEN l_linestatus = 'F' THEN 'a' ELSE 'b' END AS source
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""

PRED = """p AS (SELECT o_orderkey AS row_id, o_custkey AS entity_id, CAST(o_orderstatus = 'F' AS INTEGER) AS y,
 round(least(greatest(o_totalprice / 500000, 0.01), 0.99), 2) AS p,
 round(least(greatest(c_acctbal / 10000, 0.01), 0.99), 2) AS p_ref,
 o_orderpriority AS priority, c_mktsegment AS segment, o_totalprice AS price,
 CAST(o_orderdate AS DATE) AS order_date
 FROM orders JOIN customer ON o_custkey = c_custkey)"""

FEATURES = """f AS (SELECT c_custkey AS entity_id, c_acctbal AS acctbal, CAST(c_nationkey AS BIGINT) AS site, c_mktsegment AS segment,
 count(o_orderkey) AS n_visits, avg(o_totalprice / 10000) AS mean_score,
 avg(CASE WHEN o_orderkey IS NOT NULL THEN CAST(o_orderstatus = 'F' AS INTEGER) END) AS share_f,
 avg(CASE WHEN o_orderstatus = 'F' THEN o_totalprice / 10000 END) AS score_f,
 max(CAST(o_orderdate >= TIMESTAMP '2001-01-01' AS INTEGER)) AS y
 FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2, 3, 4)"""

VOXELS = """vox AS (SELECT vec_id AS image_id, label % 4 AS frame, 1.0::DOUBLE + label % 4 AS duration, label AS tracer,
 CAST((i - 1) // 16 AS BIGINT) AS z, CAST(((i - 1) // 4) % 4 AS BIGINT) AS y, CAST((i - 1) % 4 AS BIGINT) AS x,
 CAST(embedding[i] AS DOUBLE) + 1.0::DOUBLE AS value FROM embeddings, range(1, 65) t(i))"""

ENTRIES = """e AS (SELECT event_id, user_id, ts, event_type, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
 FROM events)"""


class Tables:
    """The given tables of one folder, and the views over them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir, self._hot = spark, str(sf_dir).rstrip("/"), {}

    @classmethod
    def of(cls, spark: SparkSession, sf_dir: str) -> "Tables":
        return cls(spark, sf_dir)

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def hot(self, table: str, key: str) -> DataFrame:
        """Hot keys of a table, counted for this set of tables once."""
        if (table, key) not in self._hot:
            self._hot[table, key] = hot_keys(getattr(self, table), key)
        return self._hot[table, key]

    # ---- visits -----------------------------------------------------------
    def visits(self) -> DataFrame:
        j = self.orders.join(self.customer, F.col("o_custkey") == F.col("c_custkey"))
        return j.select(
            F.col("o_custkey").alias("entity_id"), F.to_date("o_orderdate").alias("visit_date"),
            F.col("o_orderkey").alias("visit_id"), F.col("c_nationkey").alias("site"),
            F.substring("o_orderpriority", 1, 1).cast("int").alias("status"),
            (F.col("o_totalprice") / F.lit(10000.0)).alias("score"), F.col("o_orderstatus").alias("packet"),
            F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("acctbal"))

    def timeline(self, df: DataFrame | None = None) -> Timeline:
        return Timeline(self.visits() if df is None else df, hot=self.hot("orders", "o_custkey"))

    def sparse(self) -> DataFrame:
        return self.visits().withColumn("score", F.when(F.col("packet") != "P", F.col("score")))

    # ---- scans ------------------------------------------------------------
    def scans(self) -> DataFrame:
        j = self.lineitem.join(self.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        return j.select(
            F.col("o_custkey").alias("entity_id"), F.to_date("l_shipdate").alias("scan_date"),
            F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("scan_id"),
            F.col("l_linenumber").alias("tracer"), (F.col("l_returnflag") != "R").alias("qc"),
            F.col("l_quantity").alias("measure"), F.col("l_extendedprice").alias("measure2"),
            F.when(F.col("l_linestatus") == "F", "a").otherwise("b").alias("source"))

    # ---- predictions and features ------------------------------------------
    def predictions(self) -> DataFrame:
        clip = lambda c: F.round(F.least(F.greatest(c, F.lit(0.01)), F.lit(0.99)), 2)
        j = self.orders.join(self.customer, F.col("o_custkey") == F.col("c_custkey"))
        return j.select(
            F.col("o_orderkey").alias("row_id"), F.col("o_custkey").alias("entity_id"),
            (F.col("o_orderstatus") == "F").cast("int").alias("y"),
            clip(F.col("o_totalprice") / F.lit(500000.0)).alias("p"), clip(F.col("c_acctbal") / F.lit(10000.0)).alias("p_ref"),
            F.col("o_orderpriority").alias("priority"), F.col("c_mktsegment").alias("segment"),
            F.col("o_totalprice").alias("price"), F.to_date("o_orderdate").alias("order_date"))

    def features(self) -> DataFrame:
        score = F.col("o_totalprice") / F.lit(10000.0)
        j = self.orders.join(self.customer, F.col("o_custkey") == F.col("c_custkey"))
        return (j.groupBy(F.col("c_custkey").alias("entity_id"), F.col("c_acctbal").alias("acctbal"),
                          F.col("c_nationkey").alias("site"), F.col("c_mktsegment").alias("segment"))
                .agg(F.count("o_orderkey").alias("n_visits"), F.avg(score).alias("mean_score"),
                     F.avg((F.col("o_orderstatus") == "F").cast("int")).alias("share_f"),
                     F.avg(F.when(F.col("o_orderstatus") == "F", score)).alias("score_f"),
                     F.max((F.col("o_orderdate") >= F.lit("2001-01-01").cast("timestamp_ntz")).cast("int")).alias("y")))

    # ---- images, entries ----------------------------------------------------
    def voxels(self) -> DataFrame:
        e = self.embeddings.select(
            F.col("vec_id").alias("image_id"), (F.col("label") % 4).alias("frame"),
            (F.lit(1.0) + F.col("label") % 4).alias("duration"), F.col("label").alias("tracer"),
            F.posexplode("embedding").alias("i", "v"))
        return e.select("image_id", "frame", "duration", "tracer", F.floor(F.col("i") / 16).alias("z"),
                        (F.floor(F.col("i") / 4) % 4).alias("y"), (F.col("i") % 4).cast("long").alias("x"),
                        (F.col("v").cast("double") + F.lit(1.0)).alias("value"))

    def entries(self) -> DataFrame:
        return self.events.select("event_id", "user_id", "ts", "event_type", "value",
                                  F.get_json_object("props", "$.k").cast("long").alias("k"))
