"""What to cut and what to join: clip and reel manifests, names and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def numbered(shots: DataFrame) -> DataFrame:
    """Add ``shot_no`` from 1 by start, then lane: one video is one window."""
    w = W.partitionBy("video_id").orderBy("start_frame", "lane_pos" if "lane_pos" in shots.columns else "lane_name", "end_frame")
    return shots.withColumn("shot_no", F.row_number().over(w))


def clip_manifest(shots: DataFrame, fps: float) -> DataFrame:
    """video_id, shot_no, lane_name, file_name, start_seconds, duration_seconds, and both as the cutter
    is told them, with three decimals. Numbers have two digits at least."""
    start, length = F.col("start_frame") / F.lit(float(fps)), (F.col("end_frame") - F.col("start_frame")) / F.lit(float(fps))
    name = F.concat(F.format_string("shot_%02d_", "shot_no"), F.col("lane_name"), F.when(F.col("gutter_fallback"), "_gutter").otherwise(""), F.lit(".mp4"))
    return numbered(shots).select("video_id", "shot_no", "lane_name", name.alias("file_name"), start.alias("start_seconds"), length.alias("duration_seconds"), F.format_string("%.3f", start).alias("start_text"), F.format_string("%.3f", length).alias("duration_text"))


def concat_line(path: Column) -> Column:
    """A line of the joiner's list: forward slashes, quotes escaped."""
    return F.concat(F.lit("file '"), F.replace(F.replace(path, F.lit("\\"), F.lit("/")), F.lit("'"), F.lit("\\'")), F.lit("'"))


def reel_manifest(clips: DataFrame) -> DataFrame:
    """Clips in order of their names, which from 100 shots on isn't their number, with the offset at
    which each begins. A video with fewer than two clips has no reel."""
    w = W.partitionBy("video_id").orderBy("file_name")
    many = W.partitionBy("video_id")
    rows = clips.withColumn("_n", F.count("*").over(many)).where("_n >= 2")
    before = F.coalesce(F.sum("duration_seconds").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    return rows.select("video_id", F.row_number().over(w).alias("reel_pos"), "file_name", "duration_seconds", before.alias("offset_seconds"), concat_line(F.col("file_name")).alias("list_line"))


def shot_summary(shots: DataFrame, fps: float) -> DataFrame:
    """Shots, gutter shots and seconds of each lane of each video."""
    return shots.groupBy("video_id", "lane_name").agg(F.count("*").alias("n_shots"), F.count_if("gutter_fallback").alias("n_gutter"), (F.sum(F.col("end_frame") - F.col("start_frame")) / F.lit(float(fps))).alias("total_seconds"))


def cache_name(stem: Column, factor: Column) -> Column:
    """Name of the detection copy: two decimals, without zeros and a point at the end."""
    number = F.regexp_replace(F.regexp_replace(F.format_string("%.2f", factor), "0+$", ""), r"\.$", "")
    return F.concat(stem, F.lit(".detect_"), number, F.lit("x.mp4"))


def format_sanity(counts: DataFrame, presets: DataFrame) -> DataFrame:
    """Range join of shot counts with format presets (few rows): which formats a count fits."""
    joined = counts.join(F.broadcast(presets), (F.col("n_shots") >= F.col("min_shots")) & (F.col("n_shots") <= F.col("max_shots")), "left")
    return joined.groupBy("video_id", "lane_name", "n_shots").agg(F.count("format").alias("n_formats"), F.coalesce(F.array_join(F.sort_array(F.collect_list("format")), ","), F.lit("")).alias("formats"))
