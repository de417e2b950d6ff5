"""Venue and target files: JSON with a fixed set of fields."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kegler.config import check_path
from kegler.functions.geometry import ZONES, Lane
from kegler.schemas import TARGET_JSON, VENUE_JSON

_VENUE, _LANE, _TARGET = {"lanes", "frame_width", "frame_height"}, {"name", *ZONES}, {"name", "shirt_color_samples"}


def _points(zone: F.Column) -> F.Column:
    return F.transform(zone, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))


def lanes_of(venues: DataFrame) -> DataFrame:
    """One row per lane: lane_pos, name, the zones as arrays of points, frame_width, frame_height."""
    lane = F.posexplode("lanes").alias("lane_pos", "lane")
    rows = venues.select(lane, "frame_width", "frame_height")
    return rows.select("lane_pos", "lane.name", *[_points(F.col(f"lane.{z}")).alias(z) for z in ZONES], "frame_width", "frame_height")


def read_venue(spark: SparkSession, path: str) -> DataFrame:
    return lanes_of(spark.read.schema(VENUE_JSON).option("multiLine", True).option("mode", "FAILFAST").json(path))


def venue_from_text(rows: DataFrame, text: str = "text") -> DataFrame:
    """The same from a column of JSON texts."""
    parsed = F.from_json(text, VENUE_JSON, {"mode": "FAILFAST"})
    return lanes_of(rows.select(parsed.alias("v")).select("v.*"))


def check_fields(what: str, found: dict, wanted: set[str], optional: frozenset[str] = frozenset()) -> None:
    if more := sorted(set(found) - wanted):
        raise TypeError(f"{what}: unknown fields {', '.join(more)}")
    if less := sorted(wanted - optional - set(found)):
        raise TypeError(f"{what}: missing fields {', '.join(less)}")


def parse_lanes(text: str) -> list[Lane]:
    """Lanes of a venue text for the driver, which compiles zones into expressions."""
    venue = json.loads(text)
    check_fields("venue", venue, _VENUE)
    for lane in venue["lanes"]:
        check_fields(f"lane {lane.get('name')!r}", lane, _LANE)
    return [Lane(x["name"], *(tuple((int(a), int(b)) for a, b in x[z]) for z in ZONES)) for x in venue["lanes"]]


def venue_text(lanes: list[Lane], width: int, height: int) -> str:
    return json.dumps({"lanes": [{"name": x.name} | {z: [list(p) for p in getattr(x, z)] for z in ZONES} for x in lanes], "frame_width": width, "frame_height": height}, indent=2)


def read_target(spark: SparkSession, path: str) -> DataFrame:
    """target_name, sample_idx, b, g, r; a file without samples has no rows."""
    rows = spark.read.schema(TARGET_JSON).option("multiLine", True).option("mode", "FAILFAST").json(path)
    sample = F.posexplode(F.coalesce("shirt_color_samples", F.array().cast("array<array<int>>"))).alias("sample_idx", "s")
    return rows.select(F.col("name").alias("target_name"), sample).select("target_name", "sample_idx", F.col("s")[0].alias("b"), F.col("s")[1].alias("g"), F.col("s")[2].alias("r"))


def parse_target(text: str) -> tuple[str, list[tuple[int, int, int]]]:
    target = json.loads(text)
    check_fields("target", target, _TARGET, frozenset({"shirt_color_samples"}))
    return target["name"], [tuple(s) for s in target.get("shirt_color_samples", [])]


def target_text(name: str, samples: list[tuple[int, int, int]]) -> str:
    return json.dumps({"name": name, "shirt_color_samples": [list(s) for s in samples]}, indent=2)


def save_venue(path: str, lanes: list[Lane], width: int, height: int) -> None:
    Path(check_path(path)).write_text(venue_text(lanes, width, height), encoding="utf-8")


def save_target(path: str, target: DataFrame) -> None:
    """Write a target table (target_name, sample_idx, b, g, r), of some thousand rows, as its file."""
    rows = target.orderBy("sample_idx").collect()
    names = {r["target_name"] for r in rows}
    if len(names) != 1:
        raise ValueError(f"one target is needed, not {len(names)}")
    Path(check_path(path)).write_text(target_text(names.pop(), [(r["b"], r["g"], r["r"]) for r in rows]), encoding="utf-8")
