"""Shots from a live stream of signals, by keyed state.

Each (video, lane) keeps the signals that an open candidate may still need; of a setup run that goes on
and on, all but the last frames are a count and a sum, so state is bounded by the budgets. A candidate is reported
as soon as no later frame can change it; an end-of-video row (frame_index of the length, all signals
null) cuts the budgets short, as a finished video does, and drops the state. The result over a whole
video equals the batch result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from kegler.config import FrameParams
from kegler.operators.segment import _SHOTS, SIGNAL_COLUMNS, find_shots

_STATE = "first long, lead long, lead_confidence double, confidence array<double>, pose array<double>, pin array<double>, ball array<boolean>"


def horizon(p: FrameParams) -> int:
    """Frames after a shot's end from which on it can't change."""
    return p.settle + max(p.impact, p.gutter) + p.release + p.settle_run + p.pad + p.lookback + 2


def _led(signals: list[np.ndarray], lead: tuple[int, float], p: FrameParams) -> tuple[int, tuple[int, float]]:
    """(frames to let go, what they leave): frames that begin with a long setup run become part of its lead."""
    eligible = (signals[0] >= p.confidence) & (signals[1] <= p.pose)
    run = len(eligible) if eligible.all() else int(np.argmin(eligible))
    spare = run - 2 * horizon(p)
    if spare <= 0:
        return 0, lead
    return spare, (lead[0] + spare, lead[1] + float(np.sum(signals[0][:spare])))


def _step(first: int, signals: list[np.ndarray], p: FrameParams, ended: bool, lead: tuple[int, float] = (0, 0.0)) -> tuple[list[tuple], int]:
    """(final shots, frame from which on signals must be kept). Shots are final when the video has
    ended or when they ended so long ago that no budget reaches beyond what is known."""
    n = len(signals[0])
    found = find_shots(*signals, p, before=first, lead=lead)
    if ended:
        return [(first + s.start, first + s.end, s.confidence, s.gutter) for s in found], n
    out, keep = [], 0
    for s in found:
        if s.end + p.settle + p.pad + max(p.impact, p.gutter) >= n:
            break
        out.append((first + s.start, first + s.end, s.confidence, s.gutter))
        keep = s.end + 1
    if keep == 0 and n > 4 * horizon(p):
        # Nothing found: all before the last run of frames that could still be a setup is done with.
        eligible = (signals[0] >= p.confidence) & (signals[1] <= p.pose)
        loose = np.flatnonzero(~eligible[: n - 2 * horizon(p)])
        if not found and len(loose):
            keep = int(loose[-1]) + 1
    return out, keep


def stream_shots(signals: DataFrame, p: FrameParams) -> DataFrame:
    """Shots of a stream of signals whose frames come in order within a lane, without gaps from 0."""
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first, lead, own = 0, (0, 0.0), [np.empty(0), np.empty(0), np.empty(0), np.empty(0, bool)]
        if state.exists:
            first, *lead, confidence, pose, pin, ball = state.get
            lead, own = tuple(lead), [np.array(confidence, float), np.array(pose, float), np.array(pin, float), np.array(ball, bool)]
        rows = pd.concat(list(batches)).sort_values("frame_index", kind="stable")
        ended = bool(rows["bowler_confidence"].isna().any())
        rows = rows[rows["bowler_confidence"].notna()]
        own = [np.concatenate([x, rows[c].to_numpy(x.dtype)]) for x, c in zip(own, SIGNAL_COLUMNS, strict=True)]
        found, keep = _step(first, own, p, ended, lead)
        if ended:
            state.remove()
        else:
            left = [x[keep:] for x in own]
            spare, lead = _led(left, (0, 0.0) if keep else lead, p)
            state.update((first + keep + spare, *lead, *(x[spare:].tolist() for x in left)))
        yield pd.DataFrame([(*key, *s) for s in found], columns=[c.split()[0] for c in _SHOTS.split(", ")])

    return signals.groupBy("video_id", "lane_name").applyInPandasWithState(run, _SHOTS, _STATE, "append", GroupStateTimeout.NoTimeout)
