"""Shots from signals: a setup run, an onset, an impact or its fallback, and a settled end.

Every question that the search asks ("first frame from x on with ...") is a look-up that window
functions, running minima in descending order, answer for all frames at once. What is left is the chain of
candidates of a lane, which is sequential: a lane of a video is one group.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kegler.config import FrameParams

LANE = ["video_id", "lane_name"]


def flags(signals: DataFrame, p: FrameParams) -> DataFrame:
    """Add eligible, moving, hit and low."""
    return signals.withColumns({
        "eligible": (F.col("bowler_confidence") >= p.confidence) & (F.col("pose_motion") <= p.pose),
        "moving": F.col("pose_motion") > p.pose,
        "hit": F.col("ball_reached_pins") | (F.col("pin_motion") > p.pin),
        "low": F.col("pin_motion") < p.pin,
    })


def lookups(signals: DataFrame, p: FrameParams, partition: list[str] = LANE) -> DataFrame:
    """Add n, next_break (first frame that isn't eligible, else n), next_move, next_hit, streak (lows
    in a row up to here) and next_calm (first frame with a long enough streak); all from here on.

    What comes next is a running minimum in descending order, so a lane costs one pass each way.
    """
    i = F.col("frame_index")
    upto = W.partitionBy(*partition).orderBy("frame_index").rowsBetween(W.unboundedPreceding, 0)
    back = W.partitionBy(*partition).orderBy(i.desc()).rowsBetween(W.unboundedPreceding, 0)
    first = lambda c: F.min(F.when(c, i)).over(back)
    rows = flags(signals, p).withColumns({
        "n": F.count("*").over(W.partitionBy(*partition)),
        "streak": i - F.coalesce(F.max(F.when(~F.col("low"), i)).over(upto), F.lit(-1)),
    })
    return rows.withColumns({
        "next_break": F.coalesce(first(~F.col("eligible")), "n"),
        "next_move": first(F.col("moving")),
        "next_hit": first(F.col("hit")),
        "next_calm": first(F.col("streak") >= p.settle_run),
    })


def setup_runs(signals: DataFrame, p: FrameParams, partition: list[str] = LANE) -> DataFrame:
    """Maximal runs of eligible frames that are long enough: run_start, run_end (exclusive), mean confidence."""
    lane = W.partitionBy(*partition).orderBy("frame_index")
    rows = flags(signals, p).withColumn("island", F.col("frame_index") - F.sum(F.col("eligible").cast("int")).over(lane.rowsBetween(W.unboundedPreceding, 0)))
    runs = rows.where("eligible").groupBy(*partition, "island").agg(F.min("frame_index").alias("run_start"), (F.max("frame_index") + 1).alias("run_end"), F.avg("bowler_confidence").alias("setup_confidence"))
    return runs.where(F.col("run_end") - F.col("run_start") >= p.stationary).drop("island")


def _at(rows: DataFrame, looked: DataFrame, place: Column, columns: list[str], partition: list[str]) -> DataFrame:
    """Columns of the look-up table at a computed frame of the same lane; null past its end."""
    there = looked.select(*partition, F.col("frame_index").alias("_at"), *columns)
    return rows.withColumn("_at", place).join(there, [*partition, "_at"], "left").drop("_at")


def onsets(signals: DataFrame, p: FrameParams, partition: list[str] = LANE, looked: DataFrame | None = None) -> DataFrame:
    """Setup runs that end in motion: add ``onset``, the first moving frame from the run's end on, within budget.

    looked: the look-ups of the same signals, where a caller has them."""
    looked = lookups(signals, p, partition) if looked is None else looked
    rows = _at(setup_runs(signals, p, partition), looked, F.col("run_end"), ["next_move"], partition)
    return rows.where(F.col("next_move") < F.col("run_end") + p.release).withColumnRenamed("next_move", "onset")


def impacts(signals: DataFrame, p: FrameParams, partition: list[str] = LANE, looked: DataFrame | None = None) -> DataFrame:
    """Onsets with ``impact`` and ``gutter_fallback``: the first hit within budget, else a fixed
    distance from the onset, if the video is long enough for that."""
    looked = lookups(signals, p, partition) if looked is None else looked
    rows = _at(onsets(signals, p, partition, looked), looked, F.col("onset"), ["next_hit", "n"], partition)
    missed = F.coalesce(F.col("next_hit") >= F.col("onset") + p.impact, F.lit(True))
    rows = rows.withColumn("gutter_fallback", missed).withColumn("impact", F.when(missed, F.col("onset") + p.gutter).otherwise(F.col("next_hit")))
    return rows.where(~F.col("gutter_fallback") | (F.col("impact") < F.col("n"))).drop("next_hit")


def settles(signals: DataFrame, p: FrameParams, partition: list[str] = LANE) -> DataFrame:
    """Impacts with ``settle``: the end of the first calm run that begins at the impact or later, within
    budget, else the end of the budget or of the video; ``settled`` tells which."""
    looked = lookups(signals, p, partition)
    rows = _at(impacts(signals, p, partition, looked), looked, F.col("impact") + p.settle_run - 1, ["next_calm"], partition)
    found = F.coalesce(F.col("next_calm") < F.least(F.col("n"), F.col("impact") + p.settle), F.lit(False))
    return rows.withColumn("settled", found).withColumn("settle", F.when(found, F.col("next_calm")).otherwise(F.least(F.col("impact") + p.settle, F.col("n") - 1))).drop("next_calm")


@dataclass
class Shot:
    start: int
    end: int
    confidence: float
    gutter: bool


def _next(mask: np.ndarray) -> np.ndarray:
    """For each place and the one past the end: the next place at or after it where mask holds, else the end."""
    n = len(mask)
    places = np.where(mask, np.arange(n), n)
    return np.append(np.minimum.accumulate(places[::-1])[::-1], n)


def find_shots(confidence: np.ndarray, pose: np.ndarray, pin: np.ndarray, ball: np.ndarray, p: FrameParams, before: int = 0, lead: tuple[int, float] = (0, 0.0)) -> list[Shot]:
    """The chain of one lane. Arrays of unequal length count as far as the shortest goes.

    before: frames of the video before the first of the arrays; a lookback may reach into them. lead: number
    and summed confidence of eligible frames just before, which belong to a run that begins with the arrays.
    """
    n = min(len(confidence), len(pose), len(pin), len(ball))
    confidence, pose, pin, ball = confidence[:n], pose[:n], pin[:n], ball[:n].astype(bool)
    eligible = (confidence >= p.confidence) & (pose <= p.pose)
    calm = pin < p.pin
    last_loud = np.maximum.accumulate(np.where(calm, -1, np.arange(n))) if n else np.empty(0, int)
    to_eligible, to_break, to_move = _next(eligible), _next(~eligible), _next(pose > p.pose)
    to_hit, to_calm = _next(ball | (pin > p.pin)), _next(np.arange(n) - last_loud >= p.settle_run)
    shots: list[Shot] = []
    at = int(to_eligible[0])
    while at < n:
        rest = int(to_break[at])
        onset = int(to_move[rest])
        more, total = lead if at == 0 else (0, 0.0)
        length = rest - at + more
        if length < p.stationary or onset >= min(n, rest + p.release):
            at = rest + 1
        else:
            impact = int(to_hit[onset])
            gutter = impact >= min(n, onset + p.impact)
            if gutter:
                impact = onset + p.gutter
            if impact >= n:
                at = onset + 1
            else:
                settle = int(to_calm[min(n, impact + p.settle_run - 1)]) if p.settle_run else impact
                if settle >= min(n, impact + p.settle):
                    settle = min(impact + p.settle, n - 1)
                end = min(n - 1, settle + p.pad)
                shots.append(Shot(max(-before, onset - p.lookback), end, float((np.sum(confidence[at:rest]) + total) / length), gutter))
                at = end + 1
        at = int(to_eligible[min(at, n)])
    return shots


SIGNAL_COLUMNS = ("bowler_confidence", "pose_motion", "pin_motion", "ball_reached_pins")
_SHOTS = "video_id string, lane_name string, start_frame long, end_frame long, bowler_confidence double, gutter_fallback boolean"


def segment_shots(signals: DataFrame, p: FrameParams) -> DataFrame:
    """Shots of every lane of every video. One shuffle by (video, lane); a lane is one Arrow group."""
    def run(key: tuple, lane: pd.DataFrame) -> pd.DataFrame:
        lane = lane.sort_values("frame_index", kind="stable")
        found = find_shots(*(lane[c].to_numpy() for c in SIGNAL_COLUMNS), p)
        first = int(lane["frame_index"].iloc[0])
        return pd.DataFrame(
            [(key[0], key[1], s.start + first, s.end + first, s.confidence, s.gutter) for s in found],
            columns=["video_id", "lane_name", "start_frame", "end_frame", "bowler_confidence", "gutter_fallback"],
        )

    return signals.select("video_id", "lane_name", "frame_index", *SIGNAL_COLUMNS).groupBy(*LANE).applyInPandas(run, _SHOTS)
