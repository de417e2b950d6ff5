"""Per-lane, per-frame signals from detections and pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kegler.functions.geometry import Lane, foot_in_zone


def frame_lanes(frames: DataFrame, lanes: list[Lane]) -> DataFrame:
    """Every frame with every lane: an explode of a literal, not a join."""
    every = F.array(*[F.struct(F.lit(k).alias("lane_pos"), F.lit(x.name).alias("lane_name")) for k, x in enumerate(lanes)])
    return frames.withColumn("lane", F.explode(every)).select(*frames.columns, "lane.lane_pos", "lane.lane_name")


def best_candidates(in_zone: DataFrame, keys: list[str]) -> DataFrame:
    """The candidate with the best score of each key, the first detection of ties: confidence, cx2, cy2.

    Only scores above 0 count. A partial maximum on the map side, no window.
    """
    top = F.max(F.struct("score", (-F.col("det_idx")).alias("first"), "cx2", "cy2")).alias("top")
    return in_zone.where("score > 0").groupBy(*keys).agg(top).select(*keys, F.col("top.score").alias("confidence"), "top.cx2", "top.cy2")


def occupancy(frames: DataFrame, in_zone: DataFrame, lanes: list[Lane], keys: list[str]) -> DataFrame:
    """A row for every frame and lane, with the best candidate or confidence 0 and no centre."""
    best = best_candidates(in_zone, [*keys, "lane_name"])
    out = frame_lanes(frames, lanes).join(best, [*keys, "lane_name"], "left")
    return out.withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))


def pose_motion(occupied: DataFrame, partition: list[str], order: str = "frame_index") -> DataFrame:
    """Add ``pose_motion``: how far the centre moved since the frame before, in pixels. A frame without
    a centre resets: motion is 0 there and in the frame after."""
    w = W.partitionBy(*partition).orderBy(order)
    dx, dy = F.col("cx2") - F.lag("cx2").over(w), F.col("cy2") - F.lag("cy2").over(w)
    # Centres are doubled whole numbers: the sum of squares is exact, and halved after the root.
    moved = F.sqrt((dx * dx + dy * dy).cast("double")) / 2
    return occupied.withColumn("pose_motion", F.coalesce(moved, F.lit(0.0)))


def pixel_motion(pixels: DataFrame, mask: DataFrame, keys: list[str], order: str = "frame_index") -> DataFrame:
    """Mean grey difference to the frame before within each lane's mask: keys, order, lane_name, pin_motion.

    pixels: keys, order, x, y, gray, and optionally width and height; mask: lane_name, x, y. Pixels
    outside all masks go first, the mask being as large as a frame at most and so broadcast. The
    first frame, and one whose size differs from the one before, has no motion.
    """
    masked = pixels.join(F.broadcast(mask), ["x", "y"])
    w = W.partitionBy(*keys, "lane_name", "x", "y").orderBy(order)
    diff = F.abs(F.col("gray") - F.lag("gray").over(w))
    if "width" in pixels.columns:
        same = (F.col("width") == F.lag("width").over(w)) & (F.col("height") == F.lag("height").over(w))
        diff = F.when(same, diff)
    rows = masked.withColumn("_diff", F.coalesce(diff, F.lit(0)))
    out = rows.groupBy(*keys, order, "lane_name").agg(F.sum("_diff").cast("long").alias("diff_sum"), F.count("*").alias("mask_pixels"))
    return out.withColumn("pin_motion", F.col("diff_sum") / F.col("mask_pixels"))


def build_signals(frames: DataFrame, scored: DataFrame, lanes: list[Lane], motion: DataFrame | None = None) -> DataFrame:
    """The signals table: video_id, lane_name, lane_pos, frame_index and the four signals.

    frames: video_id, frame_index; scored: person boxes with ``score`` as identity; motion: the result
    of ``pixel_motion`` by video. The ball flag has no detector and is false.
    """
    keys = ["video_id", "frame_index"]
    filled = occupancy(frames.select(*keys), foot_in_zone(scored, lanes), lanes, keys)
    moved = pose_motion(filled, ["video_id", "lane_name"])
    if motion is None:
        moved = moved.withColumn("pin_motion", F.lit(0.0))
    else:
        moved = moved.join(motion.select(*keys, "lane_name", "pin_motion"), [*keys, "lane_name"], "left")
    return moved.select("video_id", "lane_name", "lane_pos", "frame_index", F.col("confidence").alias("bowler_confidence"), "pose_motion", F.coalesce("pin_motion", F.lit(0.0)).alias("pin_motion"), F.lit(False).alias("ball_reached_pins"))


def as_arrays(signals: DataFrame, partition: list[str], columns: list[str], order: str = "frame_index") -> DataFrame:
    """The column-oriented form: one row per lane, an array per signal in frame order. A lane is one value."""
    rows = signals.groupBy(*partition).agg(F.array_sort(F.collect_list(F.struct(order, *columns))).alias("_rows"))
    return rows.select(*partition, F.size("_rows").alias("n"), *[F.col(f"_rows.{c}").alias(c) for c in columns])
