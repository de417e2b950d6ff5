"""Zone overlays for a look at the calibration."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kegler.functions.geometry import ZONES, Lane, in_polygon

#: Colours (B, G, R) of the zones, and the weight of a fill.
COLOURS = {"approach_zone": (0, 200, 0), "lane_zone": (200, 120, 0), "pin_zone": (0, 0, 220)}
ALPHA = 0.18


def blend(value: Column, colour: int, alpha: float = ALPHA) -> Column:
    """alpha * colour + (1 - alpha) * value in hundredths, rounded half up: whole numbers throughout."""
    a = round(alpha * 100)
    return F.floor((a * colour + (100 - a) * value + 50) / 100).cast("int")


def overlay(pixels: DataFrame, lanes: list[Lane], alpha: float = ALPHA) -> DataFrame:
    """Pixels (x, y, b, g, r, ...) with the zones of all lanes filled, lane by lane, approach, lane, pin."""
    x2, y2 = 2 * F.col("x"), 2 * F.col("y")
    for lane in lanes:
        for zone in ZONES:
            inside = in_polygon(x2, y2, getattr(lane, zone))
            pixels = pixels.withColumn("_in", inside).withColumns({c: F.when(F.col("_in"), blend(F.col(c), v, alpha)).otherwise(F.col(c)) for c, v in zip("bgr", COLOURS[zone], strict=True)}).drop("_in")
    return pixels


def overlay_plan(frames: DataFrame, lanes: list[Lane]) -> DataFrame:
    """frame_index, draw_order, lane_name, zone: what is drawn on each frame."""
    steps = F.array(*[F.struct(F.lit(k).alias("draw_order"), F.lit(lane.name).alias("lane_name"), F.lit(z).alias("zone")) for k, (lane, z) in enumerate((lane, z) for lane in lanes for z in ZONES if len(getattr(lane, z)) >= 3)])
    return frames.withColumn("s", F.explode(steps)).select(*frames.columns, "s.draw_order", "s.lane_name", "s.zone")


def packed_frames(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """keys, pixels (b, g, r bytes, row by row) of each frame. A frame is one value, bounded by its resolution."""
    byte = lambda c: F.char(F.col(c))
    rows = pixels.select(*keys, "y", "x", F.encode(F.concat(byte("b"), byte("g"), byte("r")), "ISO-8859-1").alias("p"))
    joined = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("y", "x", "p"))).alias("rows"))
    whole = F.aggregate("rows", F.lit(b""), lambda s, r: F.concat(s, r["p"]))
    return joined.select(*keys, whole.alias("pixels"))


def render_overlay(pixels: DataFrame, lanes: list[Lane], open_writer: Callable[[str], Callable[[bytes | None], None]], alpha: float = ALPHA) -> DataFrame:
    """Blend the zones into all frames and hand them, in order, to the writer of their video: video_id, n_frames.

    pixels: video_id, frame_index, x, y, b, g, r. ``open_writer`` takes a video's id and returns a function that
    takes the bytes of each frame and, at the end, None. A video has one writer, so it is one group.
    """
    frames = packed_frames(overlay(pixels, lanes, alpha), ["video_id", "frame_index"])

    def run(key: tuple, video: pd.DataFrame) -> pd.DataFrame:
        write = open_writer(key[0])
        try:
            for frame in video.sort_values("frame_index", kind="stable")["pixels"]:
                write(frame)
        finally:
            write(None)
        return pd.DataFrame({"video_id": [key[0]], "n_frames": [len(video)]})

    return frames.groupBy("video_id").applyInPandas(run, "video_id string, n_frames long")
