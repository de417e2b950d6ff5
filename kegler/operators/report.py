"""What a run found, as rows instead of printed lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def run_metrics(signals: DataFrame, hits: DataFrame, shots: DataFrame) -> DataFrame:
    """One row per video: n_lanes, n_signals, n_probe_hits, n_shots, n_gutter, frames_in_shots. Three
    partial aggregations and joins of their few rows."""
    seen = signals.groupBy("video_id").agg(F.countDistinct("lane_name").alias("n_lanes"), F.count("*").alias("n_signals"))
    probed = hits.groupBy("video_id").agg(F.count("*").alias("n_probe_hits"))
    found = shots.groupBy("video_id").agg(F.count("*").alias("n_shots"), F.count_if("gutter_fallback").alias("n_gutter"), F.sum(F.col("end_frame") - F.col("start_frame") + 1).alias("frames_in_shots"))
    return seen.join(probed, "video_id", "left").join(found, "video_id", "left").na.fill(0)


def progress(frames: DataFrame, total: int, share: float = 0.02) -> DataFrame:
    """The frames at which a scan of ``total`` frames reports: about every ``share`` of it."""
    step = max(1, int(total * share))
    return frames.where(F.col("frame_index") % step == 0).select("video_id", "frame_index", (100.0 * F.col("frame_index") / total).alias("percent"))


def shot_lines(shots: DataFrame, fps: float) -> DataFrame:
    """video_id, shot_no, line: the summary of each numbered shot."""
    seconds = (F.col("end_frame") - F.col("start_frame")) / F.lit(float(fps))
    tag = F.when(F.col("gutter_fallback"), " gutter").otherwise("")
    line = F.concat(F.format_string("shot %02d ", "shot_no"), F.col("lane_name"), tag, F.format_string(" frames %d-%d, %.2f s, confidence %.3f", "start_frame", "end_frame", seconds, "bowler_confidence"))
    return shots.select("video_id", "shot_no", line.alias("line"))
