"""Operators on person detections."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kegler.config import PersonParams
from kegler.schemas import DETECTIONS

#: Share of a box's height where the upper back begins and ends.
BACK_TOP, BACK_BOTTOM = 0.18, 0.55


def detect(frames: DataFrame, detector: Callable[[dict], list[dict]] | None = None, load: Callable[[], Callable[[dict], list[dict]]] | None = None) -> DataFrame:
    """Run a person detector over frames, each given as a dict. ``load`` makes the detector, once per worker."""
    from kegler.sources.media import once_per_worker

    columns = [c.split()[0] for c in DETECTIONS.split(", ")]
    get = once_per_worker(load) if load is not None else lambda: detector

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: dict[str, list] = {c: [] for c in columns}
            for frame in batch.to_dict("records"):
                for k, box in enumerate(get()(frame)):
                    found = {"video_id": frame["video_id"], "frame_index": frame["frame_index"], "det_idx": k} | box
                    for c in columns:
                        out[c].append(found.get(c))
            if out["det_idx"]:
                yield pd.DataFrame(out)

    return frames.mapInPandas(run, DETECTIONS)


def person_boxes(detections: DataFrame, params: PersonParams) -> DataFrame:
    """Persons that count, with whole coordinates: boxes are cut to whole pixels before their height is tested.

    Filters on class and score reach the scan; the class column is optional.
    """
    rows = detections.where(F.col("score") >= params.score)
    if "cls" in detections.columns:
        rows = rows.where(F.col("cls") == params.person_class)
    return rows.withColumns({c: F.col(c).cast("int") for c in ("x1", "y1", "x2", "y2")}).where(F.col("y2") - F.col("y1") >= params.min_height)


def upper_back(detections: DataFrame, width: int, height: int) -> DataFrame:
    """Add the crop (top, bottom, left, right; ends exclusive) of the upper back, and whether it is empty."""
    tall = F.col("y2") - F.col("y1")
    rows = detections.withColumns({
        "crop_top": F.greatest(F.lit(0), F.col("y1") + (tall * BACK_TOP).cast("int")),
        "crop_bottom": F.least(F.lit(height), F.col("y1") + (tall * BACK_BOTTOM).cast("int")),
        "crop_left": F.greatest(F.lit(0), F.col("x1")),
        "crop_right": F.least(F.lit(width), F.col("x2")),
    })
    return rows.withColumn("crop_empty", (F.col("crop_bottom") <= F.col("crop_top")) | (F.col("crop_right") <= F.col("crop_left")))


#: Offsets of the 5 x 5 ellipse that closes gaps in moving pixels.
ELLIPSE = [(x, y) for y in (-1, 0, 1) for x in (-2, -1, 0, 1, 2)] + [(0, -2), (0, 2)]


def closed(points: set[tuple[int, int]]) -> set[tuple[int, int]]:
    """Points after closing by the ellipse: grown, then shrunk again. Beyond the frame nothing shrinks."""
    grown = {(x + a, y + b) for x, y in points for a, b in ELLIPSE}
    return {(x, y) for x, y in grown if all((x + a, y + b) in grown for a, b in ELLIPSE)}


def ball_differences(pixels: DataFrame, mask: DataFrame) -> DataFrame:
    """Grey difference of each pixel of the mask to the frame before: video_id, frame_index, x, y, diff.

    pixels: video_id, frame_index, x, y, gray, and optionally width and height; mask: x, y of one lane, as
    large as a frame at most and so broadcast. A first frame, or one of another size than the one before, has none.
    """
    w = W.partitionBy("video_id", "x", "y").orderBy("frame_index")
    rows = pixels.join(F.broadcast(mask.select("x", "y")), ["x", "y"])
    diff = F.abs(F.col("gray") - F.lag("gray").over(w))
    if "width" in pixels.columns:
        diff = F.when((F.col("width") == F.lag("width").over(w)) & (F.col("height") == F.lag("height").over(w)), diff)
    return rows.select("video_id", "frame_index", "x", "y", diff.alias("diff")).where("diff is not null")


def detect_ball(pixels: DataFrame, mask: DataFrame, min_area: int = 50, max_area: int = 3000, threshold: int = 25) -> DataFrame:
    """The ball in a lane: difference, threshold, closing, largest blob. video_id, frame_index, area, x, y."""
    return largest_blobs(ball_differences(pixels, mask), min_area, max_area, threshold, close=True)


def largest_blobs(pixels: DataFrame, min_area: int = 50, max_area: int = 3000, threshold: int = 25, close: bool = False) -> DataFrame:
    """The largest moving blob of each frame: video_id, frame_index, area, x, y (centroid, cut).

    pixels: video_id, frame_index, x, y, diff (grey difference). Blobs are 8-connected, one frame is
    one group and bounded by its resolution; ``close`` fills small gaps first. An area is a number of pixels. Kept
    as the ball detector's last step; the pipeline's ball flag doesn't use it.
    """
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        left = set(zip(frame["x"].tolist(), frame["y"].tolist(), strict=True))
        left = closed(left) if close else left
        best: list[tuple[int, int]] = []
        while left:
            blob, todo = [], [left.pop()]
            while todo:
                x, y = todo.pop()
                blob.append((x, y))
                near = {(x + a, y + b) for a in (-1, 0, 1) for b in (-1, 0, 1)} & left
                left -= near
                todo += near
            if min_area <= len(blob) <= max_area and (len(blob), min(best, default=()) > min(blob)) > (len(best), False):
                best = blob
        row = frame.iloc[:1][["video_id", "frame_index"]]
        if not best:
            return row.iloc[:0].assign(area=0, x=0, y=0)
        return row.assign(area=len(best), x=sum(p[0] for p in best) // len(best), y=sum(p[1] for p in best) // len(best))

    moving = pixels.where(F.col("diff") > threshold)
    return moving.groupBy("video_id", "frame_index").applyInPandas(run, "video_id string, frame_index long, area int, x int, y int")
