"""Image measures over a long table of voxels (image, frame, z, y, x, value)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Minutes after injection between which frames are averaged.
WINDOWS = {"PiB": (50, 70), "Florbetapir": (50, 70), "Florbetaben": (90, 110), "NAV4694": (50, 70),
           "Flortaucipir": (80, 100), "MK-6240": (90, 110), "FDG": (30, 60)}
TOLERANCE = 5
FULL_DYNAMIC_MIN_FRAMES = 9
LAST_MINUTES = 20


def window_bound(tracer: Column, which: int, windows: dict | None = None) -> Column:
    out = F
    for name, w in (windows or WINDOWS).items():
        out = out.when(tracer == name, float(w[which]))
    return out


def frames_to_use(frames: DataFrame, windows: dict | None = None, min_frames: int = FULL_DYNAMIC_MIN_FRAMES) -> DataFrame:
    """One row per (image, frame) to average.

    Frames whose midpoint lies in the tracer's window, if at least two do; else,
    for long series, those of the last 20 minutes; else all.
    `frames`: image_id, frame, tracer, mid (minutes), duration.
    """
    lo, hi = window_bound(F.col("tracer"), 0, windows), window_bound(F.col("tracer"), 1, windows)
    f = frames.withColumn("inside", F.coalesce(F.col("mid").between(lo - TOLERANCE, hi + TOLERANCE), F.lit(False)))
    per = f.groupBy("image_id").agg(F.count_if("inside").alias("n_inside"), F.count("*").alias("n_frames"), F.max("mid").alias("last_mid"))
    f = f.join(per, "image_id")
    late = F.coalesce(F.col("mid") >= F.col("last_mid") - LAST_MINUTES, F.lit(True))
    use = F.when(F.col("n_inside") >= 2, F.col("inside")).when(F.col("n_frames") >= min_frames, late).otherwise(F.lit(True))
    return f.where(use).select("image_id", "frame", "duration")


def static_mean(voxels: DataFrame, used: DataFrame) -> DataFrame:
    """Duration-weighted mean over the chosen frames, per voxel."""
    v = voxels.select("image_id", "frame", "z", "y", "x", "value").join(used, ["image_id", "frame"])
    return v.groupBy("image_id", "z", "y", "x").agg((F.sum(F.col("value") * F.col("duration")) / F.sum("duration")).alias("value"))


def roi_ratio(voxels: DataFrame, mask: DataFrame, target: str = "cortex", reference: str = "reference") -> DataFrame:
    """Mean of the target region over the mean of the reference, and how much of the reference is covered."""
    v = voxels.join(mask, ["z", "y", "x"])
    mean = lambda r: F.avg(F.when(F.col("region") == r, F.col("value")))
    agg = v.groupBy("image_id").agg(mean(target).alias("t"), mean(reference).alias("r"),
                                    F.avg(F.when(F.col("region") == reference, (F.col("value") > 0).cast("int"))).alias("coverage"))
    return agg.select("image_id", F.when(F.col("r") > 0, F.col("t") / F.col("r")).alias("ratio"), "coverage")


def block_means(voxels: DataFrame, size: int | Sequence[int] = 8) -> DataFrame:
    """Mean per block of size × size × size voxels; incomplete edge blocks are left out."""
    sizes = [size] * 3 if isinstance(size, int) else list(size)
    axes = dict(zip("zyx", sizes))
    b = voxels.groupBy("image_id", *[F.floor(F.col(a) / s).alias(f"b{a}") for a, s in axes.items()]).agg(
        F.avg("value").alias("value"), F.count("*").alias("n"))
    return b.where(F.col("n") == sizes[0] * sizes[1] * sizes[2]).drop("n")


def mean_volume(voxels: DataFrame, mask: DataFrame, group: DataFrame, floor: float = 1e-6) -> DataFrame:
    """Average volume per group after scaling every image by its own mean inside the mask."""
    scale = voxels.join(mask.select("z", "y", "x").distinct(), ["z", "y", "x"]).groupBy("image_id").agg(F.greatest(F.avg("value"), F.lit(floor)).alias("s"))
    v = voxels.join(scale, "image_id").join(group, "image_id")
    return v.groupBy("grp", "z", "y", "x").agg(F.avg(F.col("value") / F.col("s")).alias("value"), F.count("*").alias("n_images"))
