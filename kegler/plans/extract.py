"""The whole way from detections or signals to a manifest."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kegler.config import PersonParams, ProbeParams, SegmentParams, check_strategy, snap_factor
from kegler.functions.colour import gray
from kegler.functions.geometry import Lane, find_lane, foot_in_zone, zone_pixels
from kegler.operators.detections import person_boxes
from kegler.operators.identity import identify
from kegler.operators.manifest import clip_manifest, reel_manifest
from kegler.operators.search import probe_shots
from kegler.operators.segment import segment_shots
from kegler.operators.signals import build_signals, pixel_motion


@dataclass(frozen=True)
class ExtractConfig:
    lanes: list[Lane]
    fps: float = 30.0
    strategy: str = "probe"
    lane: str | None = None
    factor: float = 0.5
    segment: SegmentParams = field(default_factory=SegmentParams)
    probe: ProbeParams = field(default_factory=ProbeParams)
    person: PersonParams = field(default_factory=PersonParams)

    def lanes_scaled(self) -> list[Lane]:
        chosen = self.lanes if self.lane is None else [find_lane(self.lanes, self.lane)]
        return [x.scaled(snap_factor(self.factor)) for x in chosen]


def pin_motion_of(pixels: DataFrame, config: ExtractConfig, width: int, height: int) -> DataFrame:
    """Grey motion in the pin zones from coloured pixels: video_id, frame_index, lane_name, pin_motion."""
    spark = pixels.sparkSession
    grid = spark.range(width * height).select((F.col("id") % width).cast("int").alias("x"), F.floor(F.col("id") / width).cast("int").alias("y"))
    shades = pixels.select("video_id", "frame_index", "x", "y", gray(F.col("b"), F.col("g"), F.col("r")).alias("gray"))
    return pixel_motion(shades, zone_pixels(grid, config.lanes_scaled()), ["video_id"])


def signals_of(frames: DataFrame, detections: DataFrame, config: ExtractConfig, motion: DataFrame | None = None, pixels: DataFrame | None = None, samples: DataFrame | None = None, size: tuple[int, int] = (0, 0), texts: DataFrame | None = None) -> DataFrame:
    """Signals from detections at detection resolution.

    With ``pixels`` and the target's ``samples`` the whole way: persons in an approach zone are identified by the
    colours of their backs (and by ``texts``), and motion comes from the pin zones' pixels. ``size`` is the frames'
    width and height. Without pixels the detections' score is the identity already, and ``motion`` is as given.
    """
    factor = snap_factor(config.factor)
    boxes = person_boxes(detections, config.person.scaled(factor))
    lanes = config.lanes_scaled()
    if pixels is not None:
        # Only who stands in a zone is scored: the cheap test comes first.
        zoned = foot_in_zone(boxes, lanes).select(*boxes.columns).distinct()
        boxes = identify(zoned, pixels, samples, *size, texts)
        motion = pin_motion_of(pixels, config, *size) if motion is None else motion
    return build_signals(frames, boxes, lanes, motion)


def shots_of(signals: DataFrame, config: ExtractConfig) -> DataFrame:
    """Shots by the chosen strategy, with the pose threshold at detection resolution."""
    check_strategy(config.strategy)
    p = config.segment.scaled(snap_factor(config.factor)).in_frames(config.fps)
    rows = signals if config.lane is None else signals.where(F.col("lane_name") == config.lane)
    if config.strategy == "linear":
        return segment_shots(rows, p)
    return probe_shots(rows, p, *config.probe.in_frames(config.fps)).drop("window_no")


def extract_shots(frames: DataFrame, detections: DataFrame, config: ExtractConfig, motion: DataFrame | None = None, **identity) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(shots, clip manifest, reel manifest). identity: pixels, samples, size and texts of ``signals_of``."""
    shots = shots_of(signals_of(frames, detections, config, motion, **identity), config)
    clips = clip_manifest(shots, config.fps)
    return shots, clips, reel_manifest(clips)
