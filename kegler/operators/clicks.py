"""Polygons from recorded clicks: what an interactive calibration does, replayed from a table."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame


def fold_clicks(events: list[tuple[str, int, int]]) -> tuple[str, list[tuple[int, int]]]:
    """(``done``, ``cancelled`` or ``open``, vertices) after events of the kinds add, undo, finish and cancel.

    Undo without a vertex, finish with fewer than three, and any other kind change nothing; what comes
    after the end isn't looked at.
    """
    points: list[tuple[int, int]] = []
    for kind, x, y in events:
        if kind == "add":
            points.append((x, y))
        elif kind == "undo":
            del points[-1:]
        elif kind == "finish" and len(points) >= 3:
            return "done", points
        elif kind == "cancel":
            return "cancelled", []
    return "open", points


def replay_clicks(events: DataFrame) -> DataFrame:
    """lane_name, zone, state, points of each zone. events: lane_name, zone, event_no, kind, x, y."""
    def run(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("event_no", kind="stable")
        state, points = fold_clicks(list(zip(own["kind"], own["x"], own["y"], strict=True)))
        return pd.DataFrame({"lane_name": [key[0]], "zone": [key[1]], "state": [state], "points": [[{"x": int(x), "y": int(y)} for x, y in points]]})

    return events.groupBy("lane_name", "zone").applyInPandas(run, "lane_name string, zone string, state string, points array<struct<x:int,y:int>>")
