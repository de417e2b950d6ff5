"""Eight-bit colour in whole numbers, the same in any engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Bins of hue (0-179), saturation and value (0-255).
H_BINS, S_BINS, V_BINS = 16, 8, 8
N_BINS = H_BINS * S_BINS * V_BINS


def gray(b: Column, g: Column, r: Column) -> Column:
    """(299 r + 587 g + 114 b) / 1000, rounded half up."""
    return F.floor((299 * r + 587 * g + 114 * b + 500) / 1000).cast("int")


def hsv(b: Column, g: Column, r: Column) -> tuple[Column, Column, Column]:
    """Hue in half degrees, saturation and value of 0-255; quotients are cut towards minus infinity."""
    top, low = F.greatest(b, g, r), F.least(b, g, r)
    span = top - low
    by = lambda x: F.floor(30 * x / span).cast("int")
    hue = F.when(span == 0, 0).when(top == r, by(g - b)).when(top == g, 60 + by(b - r)).otherwise(120 + by(r - g))
    saturation = F.when(top == 0, 0).otherwise(F.floor(255 * span / top).cast("int"))
    return F.pmod(hue, F.lit(180)), saturation, top


def hsv_bin(b: Column, g: Column, r: Column) -> Column:
    """0 to 1023: bins are half-open ranges of equal width."""
    h, s, v = hsv(b, g, r)
    cut = lambda x, n, size: F.floor(x * n / size).cast("int")
    return (cut(h, H_BINS, 180) * S_BINS + cut(s, S_BINS, 256)) * V_BINS + cut(v, V_BINS, 256)


def inverted(value: Column) -> Column:
    return 255 - value


def otsu_thresholds(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """The grey level of each image that splits its pixels best: keys, threshold.

    Pixels up to the threshold are one class, others the other; the variance between the classes is
    largest, the least level of ties. One class alone has the threshold 0. Sums run over 256 levels.
    """
    counts = pixels.groupBy(*keys, "gray").agg(F.count("*").alias("n"))
    w = W.partitionBy(*keys).orderBy("gray").rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy(*keys)
    rows = counts.withColumns({
        "low_n": F.sum("n").over(w), "low_sum": F.sum(F.col("n") * F.col("gray")).over(w),
        "all_n": F.sum("n").over(whole), "all_sum": F.sum(F.col("n") * F.col("gray")).over(whole),
    })
    apart = (F.col("low_sum") * F.col("all_n") - F.col("low_n") * F.col("all_sum")).cast("double")
    below = F.col("low_n") * (F.col("all_n") - F.col("low_n"))
    score = F.when(below > 0, apart * apart / below).otherwise(F.lit(0.0))
    best = F.max(F.struct(score.alias("score"), (-F.col("gray")).alias("level"))).alias("best")
    return rows.groupBy(*keys).agg(best).select(*keys, F.when(F.col("best.score") > 0, -F.col("best.level")).otherwise(0).alias("threshold"))
