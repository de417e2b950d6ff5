"""The registered queries of the engine's own operators, on tables derived from the test data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kegler import fixtures as fx
from kegler.config import SCALE_FACTORS, PersonParams
from kegler.functions import colour, geometry, scaling
from kegler.operators import detections as det
from kegler.operators import identity, manifest, overlay, report, search, segment, signals, target
from kegler.sources import calibration

PERSON = PersonParams()
Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    Q[f.__name__] = f
    return f


def _shots(spark: SparkSession, sf: str) -> DataFrame:
    lanes = fx.signals(spark, sf)
    pos = F.substring("lane_name", 6, 1).cast("int")
    return segment.segment_shots(lanes, fx.PARAMS).withColumn("lane_pos", pos)


def _boxes(spark: SparkSession, sf: str) -> DataFrame:
    return det.person_boxes(fx.detections(spark, sf), PERSON)


def _frames(spark: SparkSession, sf: str) -> DataFrame:
    return fx.table(spark, sf, "orders").select(F.lit("v").alias("video_id"), F.col("o_orderkey").alias("frame_index"))


SHOT = ["lane_name", "start_frame", "end_frame"]


@query
def q_shot_segments(spark, sf):
    return _shots(spark, sf).select(*SHOT, F.round("bowler_confidence", 6).alias("confidence"), "gutter_fallback")


@query
def q_setup_runs(spark, sf):
    return segment.setup_runs(fx.signals(spark, sf), fx.PARAMS).select("lane_name", "run_start", "run_end", F.round("setup_confidence", 6).alias("confidence"))


@query
def q_forward_onset(spark, sf):
    return segment.onsets(fx.signals(spark, sf), fx.PARAMS).select("lane_name", "run_start", "run_end", "onset")


@query
def q_impact_or_gutter(spark, sf):
    return segment.impacts(fx.signals(spark, sf), fx.PARAMS).select("lane_name", "run_start", "onset", "impact", "gutter_fallback")


@query
def q_settle_streak(spark, sf):
    return segment.settles(fx.signals(spark, sf), fx.PARAMS).select("lane_name", "run_start", "impact", "settle", "settled")


@query
def q_shot_summary(spark, sf):
    return manifest.shot_summary(_shots(spark, sf), fx.FPS).select("lane_name", "n_shots", "n_gutter", F.round("total_seconds", 6).alias("total_seconds"))


@query
def q_clip_manifest(spark, sf):
    rows = manifest.clip_manifest(_shots(spark, sf), fx.FPS)
    return rows.select("shot_no", "lane_name", "file_name", F.round("start_seconds", 6).alias("start_seconds"), F.round("duration_seconds", 6).alias("duration_seconds"))


@query
def q_reel_manifest(spark, sf):
    rows = manifest.reel_manifest(manifest.clip_manifest(_shots(spark, sf), fx.FPS))
    return rows.select("reel_pos", "file_name", F.round("offset_seconds", 4).alias("offset_seconds"), "list_line")


@query
def q_lane_restricted(spark, sf):
    one = fx.signals(spark, sf).where(F.col("lane_name") == "lane_2")
    return segment.segment_shots(one, fx.PARAMS).select(*SHOT, "gutter_fallback")


@query
def q_person_filter(spark, sf):
    return _boxes(spark, sf).select("frame_index", "det_idx", "x1", "y1", "x2", "y2", "score")


@query
def q_foot_points(spark, sf):
    return geometry.foot_points(_boxes(spark, sf)).select("frame_index", "det_idx", (F.col("foot_x2") / 2.0).alias("foot_x"), (F.col("foot_y2") / 2.0).alias("foot_y"), (F.col("cx2") / 2.0).alias("cx"), (F.col("cy2") / 2.0).alias("cy"))


@query
def q_foot_in_zone(spark, sf):
    return geometry.foot_in_zone(_boxes(spark, sf), fx.LANES).select("frame_index", "det_idx", "lane_name")


def _occupied(spark, sf):
    return signals.occupancy(_frames(spark, sf), geometry.foot_in_zone(_boxes(spark, sf), fx.LANES), fx.LANES, ["video_id", "frame_index"])


@query
def q_zone_occupancy(spark, sf):
    return _occupied(spark, sf).select("frame_index", "lane_name", "confidence")


@query
def q_best_candidate(spark, sf):
    best = signals.best_candidates(geometry.foot_in_zone(_boxes(spark, sf), fx.LANES), ["frame_index", "lane_name"])
    return best.select("frame_index", "lane_name", "confidence", (F.col("cx2") / 2.0).alias("cx"), (F.col("cy2") / 2.0).alias("cy"))


@query
def q_pose_motion(spark, sf):
    return signals.pose_motion(_occupied(spark, sf), ["video_id", "lane_name"]).select("frame_index", "lane_name", F.round("pose_motion", 6).alias("pose_motion"))


@query
def q_upper_back_crop(spark, sf):
    return det.upper_back(_boxes(spark, sf), fx.WIDTH, fx.HEIGHT).select("frame_index", "det_idx", "crop_top", "crop_bottom", "crop_left", "crop_right", "crop_empty")


def _lane_rows(spark, lanes):
    rows = [(x.name, *([{"x": a, "y": b} for a, b in getattr(x, z)] for z in geometry.ZONES)) for x in lanes]
    return spark.createDataFrame(rows, "name string, " + ", ".join(f"{z} array<struct<x:int,y:int>>" for z in geometry.ZONES))


@query
def q_scaled_zones(spark, sf):
    out = []
    for f in SCALE_FACTORS:
        person = PERSON.scaled(f)
        for lane in fx.LANES:
            for z in geometry.ZONES:
                out += [(f, lane.name, z, k, x, y, person.min_height) for k, (x, y) in enumerate(getattr(lane.scaled(f), z))]
    return spark.createDataFrame(out, "factor double, lane_name string, zone string, vertex_idx int, x int, y int, min_height int")


@query
def q_snap_factor(spark, sf):
    """The discount of each line, as a share kept, asks for a factor."""
    asked = fx.table(spark, sf, "lineitem").select((F.lit(1.0) - F.col("l_discount") * 5).alias("d")).select(F.round("d", 2).alias("requested")).distinct().where("requested >= 0.25")
    return asked.select("requested", scaling.snapped(F.col("requested")).alias("factor"))


@query
def q_cache_names(spark, sf):
    factors = F.explode(F.array(*map(F.lit, SCALE_FACTORS))).alias("factor")
    stems = fx.table(spark, sf, "nation").select(F.lower("n_name").alias("stem"), factors)
    return stems.select("stem", "factor", manifest.cache_name(F.col("stem"), F.col("factor")).alias("cache_name"))


@query
def q_zone_mask(spark, sf):
    grid = spark.range(64).select((F.col("id") % 8).cast("int").alias("x"), F.floor(F.col("id") / 8).cast("int").alias("y"))
    return geometry.zone_pixels(grid, fx.GRID_LANES).groupBy("lane_name").agg(F.count("*").alias("mask_pixels"), F.sum("x").alias("sum_x"), F.sum("y").alias("sum_y"))


@query
def q_pin_motion(spark, sf):
    px = fx.frame_pixels(spark, sf)
    grid = spark.range(64).select((F.col("id") % 8).cast("int").alias("x"), F.floor(F.col("id") / 8).cast("int").alias("y"))
    out = signals.pixel_motion(px.withColumn("video_id", F.lit("v")), geometry.zone_pixels(grid, fx.GRID_LANES), ["video_id"])
    return out.select("frame_index", "lane_name", "diff_sum", "mask_pixels", "pin_motion")


@query
def q_hsv_bins(spark, sf):
    return identity.histograms(fx.pixels(spark, sf), ["image_id"])


@query
def q_histogram_norm(spark, sf):
    return identity.normalised(fx.hist(spark, sf), ["vec_id"], n_bins=64).select("vec_id", "bin", F.round("v", 6).alias("v"))


def _colour(spark, sf):
    own = fx.hist(spark, sf)
    labels = fx.table(spark, sf, "embeddings").select("vec_id", "label")
    reference = own.join(labels.where("label = 0"), "vec_id").groupBy("bin").agg(F.sum("n").alias("v"))
    return identity.colour_similarity(own.withColumn("v", F.col("n")), reference, ["vec_id"])


@query
def q_bhattacharyya(spark, sf):
    return _colour(spark, sf).select("vec_id", F.round("colour_score", 6).alias("colour_score"))


@query
def q_identity_score(spark, sf):
    """The colour score against a text score that every third entity lacks."""
    text = F.when(F.col("vec_id") % 3 > 0, (F.col("vec_id") * 37 % 100) / 100.0)
    return _colour(spark, sf).select("vec_id", F.round(identity.identity_score(F.col("colour_score"), text), 6).alias("score"))


@query
def q_ocr_substring(spark, sf):
    rows = fx.table(spark, sf, "conversations")
    return rows.where(identity.contains_name(F.col("text"), "THE")).groupBy("conv_id").agg(F.count("*").alias("n_hits"))


@query
def q_ocr_fuzzy(spark, sf):
    rows = fx.table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("text"), F.lit(0.9).alias("confidence"))
    return identity.text_scores(rows, "ring", ["p_partkey"])


@query
def q_probe_hits(spark, sf):
    return search.probe_hits(fx.signals(spark, sf), fx.PROBE[0], fx.PARAMS.confidence).select("probe_frame")


def _lengths(lanes: DataFrame) -> DataFrame:
    """Frames of each video: those of its shortest lane."""
    per_lane = lanes.groupBy("video_id", "lane_name").agg(F.count("*").alias("n"))
    return per_lane.groupBy("video_id").agg(F.min("n").alias("n"))


@query
def q_probe_windows(spark, sf):
    lanes = fx.signals(spark, sf)
    n, before, after = fx.PROBE
    lengths = _lengths(lanes)
    hits = search.probe_hits(lanes, n, 0.97).join(lengths, "video_id").where("probe_frame < n").drop("n")
    windows = search.probe_windows(hits, lengths, before, after)
    rows = search.scan_windows(windows, lanes, before + after)
    return rows.groupBy("lane_name", "probe_frame", "window_start", "window_end").agg(F.count("*").alias("n_frames"), F.max("bowler_confidence").alias("max_confidence"))


def _probed(spark, sf):
    return search.probe_shots(fx.signals(spark, sf), fx.PARAMS, *fx.PROBE)


@query
def q_probe_shots(spark, sf):
    return _probed(spark, sf).select(*SHOT, F.round("bowler_confidence", 6).alias("confidence"), "gutter_fallback", "window_no")


@query
def q_linear_vs_probe(spark, sf):
    return search.compare_strategies(segment.segment_shots(fx.signals(spark, sf), fx.PARAMS), _probed(spark, sf)).drop("video_id")


@query
def q_venue_lanes(spark, sf):
    text = calibration.venue_text(fx.LANES, fx.WIDTH, fx.HEIGHT)
    lanes = calibration.venue_from_text(spark.range(1).select(F.lit(text).alias("text")))
    zones = F.explode(F.array(*[F.struct(F.lit(z).alias("zone"), F.col(z).alias("points")) for z in geometry.ZONES])).alias("z")
    rows = lanes.select("lane_pos", "name", zones).select("lane_pos", "name", "z.zone", F.posexplode("z.points").alias("vertex_idx", "p"))
    return rows.select("lane_pos", F.col("name").alias("lane_name"), "zone", "vertex_idx", "p.x", "p.y")


@query
def q_target_samples(spark, sf):
    return target.sample_pixels(fx.pixels(spark, sf), per_image=40)


@query
def q_reference_persons(spark, sf):
    """The first person in the zone of one lane of every order, taken as a reference image."""
    zoned = geometry.foot_in_zone(_boxes(spark, sf), fx.LANES).withColumn("image_id", F.col("frame_index"))
    images = fx.table(spark, sf, "orders").select(F.col("o_orderkey").alias("image_id"), F.when(F.col("o_orderkey") % 2 == 0, "left").otherwise("right").alias("lane_name"))
    return target.reference_persons(images, zoned).select("image_id", "lane_name", "det_idx", "x1", "y1", "x2", "y2")


@query
def q_overlay_blend(spark, sf):
    px = fx.frame_pixels(spark, sf).select("frame_index", "x", "y", *[F.col("gray").alias(c) for c in "bgr"])
    return overlay.overlay(px, fx.GRID_LANES)


@query
def q_overlay_plan(spark, sf):
    return overlay.overlay_plan(fx.table(spark, sf, "embeddings").select(F.col("vec_id").alias("frame_index")), fx.LANES)


@query
def q_label_anchor(spark, sf):
    return geometry.label_anchors(_lane_rows(spark, fx.LANES))


PRESETS = [("match play", 12, 21), ("doubles", 5, 11), ("baker", 1, 11), ("league", 12, 21), ("practice", 60, 80)]


@query
def q_format_sanity(spark, sf):
    counts = _shots(spark, sf).groupBy("video_id", "lane_name").agg(F.count("*").alias("n_shots"))
    presets = spark.createDataFrame(PRESETS, "format string, min_shots int, max_shots int")
    return manifest.format_sanity(counts, presets).drop("video_id")


@query
def q_shot_segments_sql(spark, sf):
    """Candidates that settle, by lane: what the relational form finds before the chain picks from them."""
    rows = segment.settles(fx.signals(spark, sf), fx.PARAMS)
    return rows.groupBy("lane_name").agg(F.count("*").alias("n_candidates"), F.count_if("gutter_fallback").alias("n_gutter"), F.count_if("settled").alias("n_settled"))


@query
def q_run_metrics(spark, sf):
    lanes = fx.signals(spark, sf)
    return report.run_metrics(lanes, search.probe_hits(lanes, fx.PROBE[0], fx.PARAMS.confidence), segment.segment_shots(lanes, fx.PARAMS)).drop("video_id")


@query
def q_signal_arrays(spark, sf):
    """Array form of the signals: length, the last five confidences in hundredths, frames with a hit."""
    rows = signals.as_arrays(fx.signals(spark, sf), ["lane_name"], ["bowler_confidence", "pin_motion"])
    tail = F.array_join(F.transform(F.slice("bowler_confidence", -5, 5), lambda x: F.round(x * 100).cast("int")), ",")
    hits = F.size(F.filter("pin_motion", lambda x: x > fx.PARAMS.pin))
    return rows.select("lane_name", "n", tail.alias("tail"), hits.alias("n_hits"))


@query
def q_signal_digests(spark, sf):
    """Digests of the whole arrays, in frame order: confidences in hundredths and motion in thousandths."""
    rows = signals.as_arrays(fx.signals(spark, sf), ["lane_name"], ["bowler_confidence", "pin_motion"])
    digest = lambda c, unit: F.sha2(F.array_join(F.transform(c, lambda x: F.floor(x * F.lit(float(unit)) + F.lit(0.5)).cast("string")), ","), 256)
    return rows.select("lane_name", "n", digest("bowler_confidence", 100).alias("confidence_sha256"), digest("pin_motion", 1000).alias("pin_sha256"))


@query
def q_video_shots(spark, sf):
    """Shots of three videos of four lanes each."""
    shots = segment.segment_shots(fx.signals(spark, sf, 3), fx.PARAMS)
    return shots.select("video_id", *SHOT, F.round("bowler_confidence", 6).alias("confidence"), "gutter_fallback")


@query
def q_video_clips(spark, sf):
    """Clips of three videos: each is numbered on its own, and a reel begins anew."""
    shots = segment.segment_shots(fx.signals(spark, sf, 3), fx.PARAMS).withColumn("lane_pos", F.substring("lane_name", 6, 1).cast("int"))
    rows = manifest.reel_manifest(manifest.clip_manifest(shots, fx.FPS))
    return rows.select("video_id", "reel_pos", "file_name", F.round("offset_seconds", 4).alias("offset_seconds"))


@query
def q_otsu(spark, sf):
    return colour.otsu_thresholds(fx.frame_pixels(spark, sf), ["frame_index"])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(Q)
