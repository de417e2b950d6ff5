"""Who it is: colour histograms against the target's samples, and recognised text against the name."""

from __future__ import annotations

import difflib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kegler.functions import ocr
from kegler.functions.colour import N_BINS, hsv_bin
from kegler.operators.detections import upper_back

#: A colour match alone is never certain; text that is less alike than this doesn't count.
COLOUR_CAP, TEXT_THRESHOLD = 0.85, 0.55


def histograms(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """Counts by colour bin of each entity: keys, bin, n. Map-side sums, one row per bin and key."""
    return pixels.groupBy(*keys, hsv_bin(F.col("b"), F.col("g"), F.col("r")).alias("bin")).agg(F.count("*").alias("n"))


def normalised(hist: DataFrame, keys: list[str], value: str = "n", n_bins: int = N_BINS) -> DataFrame:
    """Add ``v``: values of each entity stretched to 0..1 over all bins, those that aren't there being 0.

    If all bins are equal there is nothing to stretch and all are 0.
    """
    stats = hist.groupBy(*keys).agg(F.max(value).alias("_max"), F.min(value).alias("_min"), F.count("*").alias("_n"))
    low = F.when(F.col("_n") < n_bins, F.least(F.lit(0), F.col("_min"))).otherwise(F.col("_min"))
    high = F.when(F.col("_n") < n_bins, F.greatest(F.lit(0), F.col("_max"))).otherwise(F.col("_max"))
    stats = stats.withColumns({"_low": low, "_span": high - low})
    v = F.when(F.col("_span") > 0, (F.col(value) - F.col("_low")) / F.col("_span")).otherwise(F.lit(0.0))
    return hist.join(stats, keys).withColumn("v", v).drop("_max", "_min", "_n", "_low", "_span")


def colour_similarity(hist: DataFrame, reference: DataFrame, keys: list[str]) -> DataFrame:
    """Bhattacharyya similarity of each entity's histogram with the reference: keys, colour_score.

    hist: keys, bin, v; reference: bin, v. Only bins of both add to the product, but totals are over
    all bins of each. 1 - distance, not below 0 and at most the cap; 0 if either is empty. The
    reference has at most as many rows as there are bins and is broadcast; entities are summed map-side.
    """
    total = reference.agg(F.sum("v").alias("_ref_total"))
    ref = reference.select("bin", F.col("v").alias("_ref"))
    both = hist.join(F.broadcast(ref), "bin", "left")
    sums = both.groupBy(*keys).agg(F.sum(F.sqrt(F.col("v") * F.coalesce("_ref", F.lit(0)))).alias("_both"), F.sum("v").alias("_total"))
    scale = F.sqrt(F.col("_total") * F.col("_ref_total"))
    distance = F.sqrt(F.greatest(F.lit(0.0), 1.0 - F.col("_both") / scale))
    score = F.when(scale > 0, F.least(F.lit(COLOUR_CAP), F.greatest(F.lit(0.0), 1.0 - distance))).otherwise(F.lit(0.0))
    return sums.join(F.broadcast(total)).select(*keys, score.alias("colour_score"))


def identity_score(colour: Column, text: Column) -> Column:
    """The better of the two signals; a missing one counts as 0."""
    return F.greatest(F.coalesce(colour, F.lit(0.0)), F.coalesce(text, F.lit(0.0)))


def contains_name(text: Column, name: str) -> Column:
    """Whether recognised text contains the name, without regard to case."""
    return F.contains(F.lower(text), F.lit(name.lower()))


def text_scores(found: DataFrame, name: str, keys: list[str], text: str = "text", confidence: str = "confidence") -> DataFrame:
    """Best text score of each entity: keys, text_score.

    A text that contains the name scores the recogniser's confidence; another its similarity
    (matched characters over all), if that is enough; else 0. Case-folded. Distinct texts are
    compared once per batch.
    """
    needle = name.casefold()

    @F.pandas_udf("double")
    def similarity(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            known = {t: difflib.SequenceMatcher(None, needle, t.casefold()).ratio() if t is not None else 0.0 for t in texts.unique()}
            yield texts.map(known)

    hit = contains_name(F.col(text), name)
    alike = similarity(F.col(text))
    score = F.when(hit, F.coalesce(confidence, F.lit(0.0))).when(alike >= TEXT_THRESHOLD, alike).otherwise(F.lit(0.0))
    return found.select(*keys, F.coalesce(score, F.lit(0.0)).alias("_s")).groupBy(*keys).agg(F.max("_s").alias("text_score"))


def crop_pixels(boxes: DataFrame, pixels: DataFrame, width: int, height: int) -> DataFrame:
    """The pixels of each person's upper back: video_id, frame_index, det_idx, x, y, b, g, r. An equi-join by
    frame; only pixels between the outermost crops' edges pass the filter, and empty crops have none."""
    keys = ["video_id", "frame_index"]
    crops = upper_back(boxes, width, height).where("not crop_empty").select(*keys, "det_idx", "crop_top", "crop_bottom", "crop_left", "crop_right")
    inside = (F.col("x") >= F.col("crop_left")) & (F.col("x") < F.col("crop_right")) & (F.col("y") >= F.col("crop_top")) & (F.col("y") < F.col("crop_bottom"))
    return pixels.join(crops, keys).where(inside).select(*keys, "det_idx", "x", "y", "b", "g", "r")


def reference_histogram(samples: DataFrame) -> DataFrame:
    """The target's stretched histogram: bin, v. At most as many rows as there are bins."""
    return normalised(histograms(samples.withColumn("_one", F.lit(0)), ["_one"]), ["_one"]).select("bin", "v")


def identify(boxes: DataFrame, pixels: DataFrame, samples: DataFrame, width: int, height: int, texts: DataFrame | None = None) -> DataFrame:
    """Boxes with ``score`` as the identity of the person: from the crop's pixels to a stretched histogram to
    its similarity with the target's, or the text score where that is better.

    boxes: video_id, frame_index, det_idx, x1, y1, x2, y2; pixels: video_id, frame_index, x, y, b, g, r;
    samples: b, g, r of the target; texts: video_id, frame_index, det_idx, text_score. A person without pixels, or
    a target without samples, has the colour score 0.
    """
    keys = ["video_id", "frame_index", "det_idx"]
    hist = normalised(histograms(crop_pixels(boxes, pixels, width, height), keys), keys)
    scored = colour_similarity(hist, reference_histogram(samples), keys)
    rows = boxes.drop("score").join(scored, keys, "left")
    if texts is None:
        return rows.withColumn("score", F.coalesce("colour_score", F.lit(0.0))).drop("colour_score")
    rows = rows.join(texts.select(*keys, "text_score"), keys, "left")
    return rows.withColumn("score", identity_score(F.col("colour_score"), F.col("text_score"))).drop("colour_score", "text_score")


def recognise(crops: DataFrame, load: Callable[[], Callable[[np.ndarray], list[tuple[str, float]]]], keys: list[str]) -> DataFrame:
    """Texts that a recogniser reads in any of the prepared images of each crop: keys, text, confidence.

    crops: keys, height, width, pixels (b, g, r bytes, row by row). ``load`` makes the recogniser, once per worker.
    """
    from kegler.sources.media import once_per_worker

    reader = once_per_worker(load)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found: dict[str, list] = {c: [] for c in (*keys, "text", "confidence")}
            for *key, height, width, data in zip(*(batch[k] for k in keys), batch["height"], batch["width"], batch["pixels"], strict=True):
                for image in ocr.variants(np.frombuffer(data, np.uint8).reshape(height, width, 3)):
                    for text, confidence in reader()(image):
                        for c, v in zip(found, (*key, text, float(confidence)), strict=True):
                            found[c].append(v)
            if found["text"]:
                yield pd.DataFrame(found)

    kinds = ", ".join(f"`{k}` {crops.schema[k].dataType.simpleString()}" for k in keys)
    return crops.select(*keys, "height", "width", "pixels").mapInPandas(run, f"{kinds}, text string, confidence double")
