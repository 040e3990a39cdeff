"""Splits by entity and site, folds, controls, and preparation fitted on training rows only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from visitframe.operators.profile import unpivot
from visitframe.scaling import exact_quantiles, md5_key, null_safe_join, rank_by_md5, small_side

SPLITS = ("train", "val", "test", "external")


def holdout_sites(first: DataFrame, frac: float, seed: str, site: str = "site") -> DataFrame:
    """round(frac × sites) whole sites, in md5 order."""
    sites = rank_by_md5(first.select(site).distinct(), [], site, seed, "rk", total="n")
    return sites.where(F.col("rk") < F.bround(F.col("n") * frac)).select(site)


def stratified_split(first: DataFrame, strata: str, seed: str, key: str = "entity_id", site: str = "site", frac_external: float = 0.2) -> DataFrame:
    """(entity, site, split): whole sites to `external`, the rest 70/15/15 within each stratum."""
    ext = holdout_sites(first, frac_external, seed, site).withColumn("__ext", F.lit(True))
    d = null_safe_join(first.select(key, site, F.coalesce(F.col(strata), F.lit(0)).alias("stratum")), small_side(ext, "external-sites"), [site])
    d = d.withColumn("__rest", F.col("__ext").isNull())
    d = rank_by_md5(d, ["__rest", "stratum"], key, seed, "rk", total="n")
    split = (F.when(~F.col("__rest"), "external").when(F.col("rk") < F.floor(F.col("n") * 0.70), "train")
             .when(F.col("rk") < F.floor(F.col("n") * 0.85), "val").otherwise("test"))
    return d.select(key, site, "stratum", split.alias("split"))


def check_splits(v: DataFrame, splits: DataFrame, key: str = "entity_id", site: str = "site") -> DataFrame:
    """Three checks as rows: one split per entity, no shared site, and agreement with a second copy of the splits."""
    per = v.groupBy(key).agg(F.count_distinct("split").alias("k"), F.min("split").alias("split"))
    one = per.agg(F.lit("entity in one split").alias("check_name"), F.count_if(F.col("k") > 1).alias("n_bad"))
    sites = v.groupBy(site).agg(F.max((F.col("split") == "external").cast("int")).alias("e"), F.max((F.col("split") != "external").cast("int")).alias("r"))
    shared = sites.agg(F.lit("external sites unseen").alias("check_name"), F.count_if((F.col("e") == 1) & (F.col("r") == 1)).alias("n_bad"))
    j = per.join(splits.select(key, F.col("split").alias("saved")), key, "left")
    same = j.agg(F.lit("saved splits agree").alias("check_name"), F.count_if(~F.col("split").eqNullSafe(F.col("saved"))).alias("n_bad"))
    out = one.unionByName(shared).unionByName(same)
    return out.withColumn("passed", F.col("n_bad") == 0)


def kfold(df: DataFrame, label: str, group: str, k: int, seed: str, key: str, min_size: int = 5) -> DataFrame:
    """Fold numbers balanced within label × group; combinations below `min_size` fall back to the label."""
    full = F.concat_ws("_", F.col(label).cast("string"), F.col(group).cast("string"))
    size = df.groupBy(label, group).agg(F.count("*").alias("__k"))
    d = null_safe_join(df, small_side(size, "stratum-sizes"), [label, group])
    d = d.withColumn("stratum", F.when(F.col("__k") >= min_size, full).otherwise(F.col(label).cast("string"))).drop("__k")
    return rank_by_md5(d, ["stratum"], key, seed, "rk").withColumn("fold", F.col("rk") % k).drop("rk")


def shuffle_labels(df: DataFrame, label: str, seed: str, key: str) -> DataFrame:
    """Labels dealt out to the rows in a second pseudo-random order."""
    rows = rank_by_md5(df, [], key, f"{seed}-rows", "__rk")
    labels = rank_by_md5(df.select(key, label), [], key, f"{seed}-labels", "__rk").select("__rk", F.col(label).alias(f"{label}_shuffled"))
    return rows.join(labels, "__rk").drop("__rk")


def modality_dropout(df: DataFrame, groups: dict[str, Sequence[str]], key: str, copies: int = 4, prob: float = 0.35, seed: str = "drop") -> DataFrame:
    """The original rows (`copy` 0) and copies in which whole groups of columns are blanked at random."""
    d = df.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies))))
    out = {}
    for g, cols in groups.items():
        u = F.conv(F.substring(md5_key(key, F.col("copy"), F.lit(g), seed=seed), 1, 8), 16, 10).cast("double") / F.lit(float(16 ** 8))
        keep = (F.col("copy") == 0) | (u >= prob)
        out |= {c: F.when(keep, F.col(c)) for c in cols}
    return d.withColumns(out)


def mask_groups(df: DataFrame, groups: dict[str, Sequence[str]], patterns: dict[str, Sequence[str]]) -> DataFrame:
    """Every row once per availability pattern, with the unavailable groups blanked."""
    d = df.withColumn("pattern", F.explode(F.array(*[F.lit(p) for p in patterns])))
    out = {}
    for g, cols in groups.items():
        ok = [p for p, avail in patterns.items() if g in avail]
        out |= {c: F.when(F.col("pattern").isin(ok), F.col(c)) for c in cols}
    return d.withColumns(out)


class Prep:
    """Median fill, missing flags where more than 1% are missing, standardisation; fitted on training rows."""

    def __init__(self, features: Sequence[str]):
        self.features = list(features)

    def fit(self, train: DataFrame) -> "Prep":
        long = unpivot(train, [], self.features)
        med = {r["variable"]: r["m"] for r in exact_quantiles(long, ["variable"], "value", {"m": 0.5}).collect()}
        row = train.agg(*[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in self.features]).first()
        self.median = {c: med.get(c, 0.0) for c in self.features}
        self.flags = [c for c in self.features if row[c] > 0.01]
        filled = self._fill(train)
        names = self._names()
        stats = filled.agg(*[a for c in names for a in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"))]).first()
        self.mean = {c: float(stats[f"m_{c}"]) for c in names}
        self.sd = {c: float(stats[f"s_{c}"]) + 1e-6 for c in names}
        return self

    def _names(self) -> list[str]:
        return [f"f_{c}" for c in self.features] + [f"na_{c}" for c in self.flags]

    def _fill(self, df: DataFrame) -> DataFrame:
        return df.withColumns({f"f_{c}": F.coalesce(F.col(c).cast("double"), F.lit(float(self.median[c]))) for c in self.features}
                              | {f"na_{c}": F.col(c).isNull().cast("double") for c in self.flags})

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds the standardised columns `f_…` and `na_…`."""
        out = self._fill(df)
        return out.withColumns({c: (F.col(c) - F.lit(self.mean[c])) / F.lit(self.sd[c]) for c in self._names()})

    @property
    def columns(self) -> list[str]:
        return self._names()


def check_no_future(rows: DataFrame, build, k: int, features: Sequence[str], keys: Sequence[str] = ("entity_id", "visit_id"),
                    no: str = "visit_no", tol: float = 1e-6) -> DataFrame:
    """Build the features twice, from all visits and from the first k only, and count differences at visit k per feature."""
    at = lambda d: unpivot(d.where(F.col(no) == k), keys, features)
    full, cut_off = at(build(rows)), at(build(rows.where(F.col(no) <= k)))
    j = cut_off.join(full.withColumnRenamed("value", "__full"), [*keys, "variable"], "left")
    same = F.coalesce(F.abs(F.col("value") - F.col("__full")) < tol, F.lit(False)) | (F.col("value").isNull() & F.col("__full").isNull())
    return j.groupBy("variable").agg(F.count("*").alias("n_compared"), F.count_if(~same).alias("n_changed"))


def check_counts(actual: DataFrame, reported: DataFrame, on: str = "name") -> DataFrame:
    """Counts of a report against the table they describe."""
    j = actual.join(reported.withColumnRenamed("n", "reported"), on, "full")
    return j.withColumn("passed", F.col("n").eqNullSafe(F.col("reported")))


def check_scan_dates(rows: DataFrame, by: Sequence[str] = (), scan: str = "scan_date", visit: str = "visit_date") -> DataFrame:
    """No scan may be newer than the visit that uses it: rows with a scan, rows that break this, the largest lead in days."""
    lead = F.datediff(scan, visit)
    out = rows.where(F.col(scan).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.count_if(F.coalesce(lead > 0, F.lit(True))).alias("n_late"), F.max(lead).alias("largest_lead"))
    return out.withColumn("passed", F.col("n_late") == 0)


def check_slope(v: DataFrame, value: str, key: str = "entity_id", visits: int = 3) -> DataFrame:
    """Slope over the first visits by the regression aggregate, next to the running slope at that visit."""
    d = v.where((F.col("visit_no") <= visits) & F.col(value).isNotNull())
    return d.groupBy(key).agg(F.regr_slope(value, "years").alias("by_regression"),
                              F.max(F.when(F.col("visit_no") == visits, F.col(f"slope_{value}"))).alias("by_running_sums"),
                              F.count("*").alias("n"))


def check_harmonised(v: DataFrame, z: str, version: str, status: str) -> DataFrame:
    """Mean adjusted score by form version and status."""
    return v.where(F.col(z).isNotNull()).groupBy(version, status).agg(F.count("*").alias("n"), F.avg(z).alias("mean_z"))
