"""Parameters, their scaling by the resolution of the detection frames, and their checks."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

#: Resolutions of the detection copy that are supported, as shares of the source's.
SCALE_FACTORS = (1.0, 0.75, 0.5, 0.4, 0.33, 0.25)
STRATEGIES = ("probe", "linear")
DEFAULT_FPS = 30.0


@dataclass(frozen=True)
class SegmentParams:
    """Thresholds and budgets of the segmentation, in seconds where the name says so."""

    # The defaults.
    confidence: float = 0.30
    stationary_frames: int = 8
    pose_motion: float = 4.0
    lookback_seconds: float = 0.5
    settle_frames: int = 12
    pin_motion: float = 1.5
    pad_seconds: float = 0.3
    release_seconds: float = 10.0
    impact_seconds: float = 8.0
    settle_seconds: float = 5.0
    gutter_seconds: float = 4.0

    def scaled(self, factor: float) -> "SegmentParams":
        """Only the pose threshold is a length in pixels."""
        return replace(self, pose_motion=self.pose_motion * factor)

    def in_frames(self, fps: float) -> "FrameParams":
        """Budgets in whole frames, cut towards zero."""
        n = lambda seconds: int(fps * seconds)
        return FrameParams(
            self.confidence, self.stationary_frames, self.pose_motion, self.settle_frames, self.pin_motion,
            n(self.lookback_seconds), n(self.pad_seconds), n(self.release_seconds), n(self.impact_seconds), n(self.settle_seconds), n(self.gutter_seconds),
        )


@dataclass(frozen=True)
class FrameParams:
    """The same with budgets in frames."""

    confidence: float
    stationary: int
    pose: float
    settle_run: int
    pin: float
    lookback: int
    pad: int
    release: int
    impact: int
    settle: int
    gutter: int


@dataclass(frozen=True)
class ProbeParams:
    """Probe step and the range scanned around a hit, in seconds."""

    # The defaults.
    interval_seconds: float = 10.0
    before_seconds: float = 15.0
    after_seconds: float = 25.0

    def in_frames(self, fps: float) -> tuple[int, int, int]:
        return max(1, int(self.interval_seconds * fps)), int(self.before_seconds * fps), int(self.after_seconds * fps)


@dataclass(frozen=True)
class PersonParams:
    """Detections that count: class, least score (inclusive), least height in pixels."""

    # The defaults.
    person_class: int = 0
    score: float = 0.4
    min_height: int = 80

    def scaled(self, factor: float) -> "PersonParams":
        return replace(self, min_height=max(20, int(self.min_height * factor)))


def snap_factor(requested: float) -> float:
    """The largest supported factor that isn't above ``requested``."""
    fits = [f for f in SCALE_FACTORS if f <= requested]
    if not fits:
        raise ValueError(f"factor {requested} is below {min(SCALE_FACTORS)}; supported: {', '.join(map(str, SCALE_FACTORS))}")
    return max(fits)


def check_strategy(name: str) -> str:
    if name not in STRATEGIES:
        raise ValueError(f"unknown strategy {name!r}; choose from {', '.join(STRATEGIES)}")
    return name


def check_path(path: str) -> str:
    """Paths with line feeds, returns or tabs come from unescaped backslashes."""
    if re.search(r"[\n\r\t]", path):
        raise ValueError(f"control character in path {path!r}")
    return path
