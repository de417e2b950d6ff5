"""Integer geometry as column expressions: they stay inside generated code, without a join."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Polygon = tuple[tuple[int, int], ...]


@dataclass(frozen=True)
class Lane:
    """A lane and its three zones, closed polygons in pixels."""

    name: str
    approach_zone: Polygon
    lane_zone: Polygon
    pin_zone: Polygon

    def scaled(self, factor: float) -> "Lane":
        cut = lambda zone: tuple((int(x * factor), int(y * factor)) for x, y in zone)
        return Lane(self.name, cut(self.approach_zone), cut(self.lane_zone), cut(self.pin_zone))


ZONES = ("approach_zone", "lane_zone", "pin_zone")


def find_lane(lanes: list[Lane], name: str) -> Lane:
    for lane in lanes:
        if lane.name == name:
            return lane
    raise KeyError(f"no lane {name!r}; there are {', '.join(x.name for x in lanes)}")


def edges(zone: Polygon) -> list[tuple[int, int, int, int]]:
    return [(*a, *b) for a, b in zip(zone, zone[1:] + zone[:1], strict=True)]


def in_polygon(x2: Column, y2: Column, zone: Polygon) -> Column:
    """Whether the point (x2/2, y2/2) lies in the polygon or on its boundary. All in whole numbers.

    Coordinates come doubled, so that the middle of a bottom edge is whole. Inside: a ray to the
    right crosses an odd number of edges. On the boundary: collinear with an edge, between its ends.
    """
    if len(zone) < 3:
        return F.lit(False)
    crossed, touched = F.lit(0), []
    x, y = x2.cast("long"), y2.cast("long")
    for ax, ay, bx, by in [tuple(2 * v for v in e) for e in edges(zone)]:
        cross = (x - ax) * (by - ay) - (y - ay) * (bx - ax)
        touched.append((cross == 0) & x.between(min(ax, bx), max(ax, bx)) & y.between(min(ay, by), max(ay, by)))
        if ay != by:
            # Left of the edge, seen upwards: the crossing is to the right of the point.
            right = cross < 0 if by > ay else cross > 0
            spans = (y >= min(ay, by)) & (y < max(ay, by))
            crossed = crossed + (spans & right).cast("int")
    return (crossed % 2 == 1) | reduce(lambda a, b: a | b, touched)


def foot_points(detections: DataFrame) -> DataFrame:
    """Add the doubled middle of the bottom edge (foot_x2, foot_y2) and the doubled centre (cx2, cy2)."""
    return detections.withColumns({
        "foot_x2": F.col("x1") + F.col("x2"), "foot_y2": 2 * F.col("y2"),
        "cx2": F.col("x1") + F.col("x2"), "cy2": F.col("y1") + F.col("y2"),
    })


def foot_in_zone(detections: DataFrame, lanes: list[Lane]) -> DataFrame:
    """One row per detection and lane whose approach zone holds its foot; zones may overlap."""
    named = F.filter(
        F.array(*[F.struct(F.lit(k).alias("lane_pos"), F.lit(x.name).alias("lane_name"), in_polygon(F.col("foot_x2"), F.col("foot_y2"), x.approach_zone).alias("inside")) for k, x in enumerate(lanes)]),
        lambda z: z["inside"],
    )
    rows = detections if "foot_x2" in detections.columns else foot_points(detections)
    return rows.withColumn("zone", F.explode(named)).select(*rows.columns, "zone.lane_pos", "zone.lane_name")


def zone_pixels(grid: DataFrame, lanes: list[Lane], zone: str = "pin_zone") -> DataFrame:
    """The pixels (x, y) of a grid that a zone covers, boundary included: lane_name, x, y."""
    parts = [grid.where(in_polygon(2 * F.col("x"), 2 * F.col("y"), getattr(lane, zone))).select(F.lit(lane.name).alias("lane_name"), "x", "y") for lane in lanes]
    return reduce(DataFrame.unionByName, parts)


def label_anchors(lanes: DataFrame) -> DataFrame:
    """lane_name, zone, x, y: the mean of a zone's vertices, cut to whole pixels; zones of less than 3 have none."""
    zones = F.explode(F.array(*[F.struct(F.lit(z).alias("zone"), F.col(z).alias("points")) for z in ZONES])).alias("z")
    rows = lanes.select(F.col("name").alias("lane_name"), zones).select("lane_name", "z.zone", "z.points").where("size(points) >= 3")
    mean = lambda c: (F.aggregate("points", F.lit(0).cast("long"), lambda n, p: n + p[c]) / F.size("points")).cast("int")
    return rows.select("lane_name", "zone", mean("x").alias("x"), mean("y").alias("y"))
