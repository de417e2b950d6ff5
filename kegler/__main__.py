"""Command line: ``python -m kegler <command>``; thin wrappers around the plans."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from kegler.config import ProbeParams, check_path, check_strategy, snap_factor
from kegler.functions.geometry import ZONES, Lane
from kegler.operators.clicks import fold_clicks


def pair_frames(frames: list[str], lanes: list[str]) -> list[tuple[str, str]]:
    """A frame for each lane: one frame serves all lanes, else there must be as many of either."""
    if len(frames) == 1:
        frames = frames * len(lanes)
    if len(frames) != len(lanes):
        raise SystemExit(2)
    return list(zip(frames, lanes, strict=True))


def lanes_from_clicks(path: str) -> list[Lane]:
    """Lanes in order of their first click. A zone that isn't finished, or was cancelled, is an error that names it."""
    zones: dict[str, dict[str, list]] = {}
    for line in Path(path).read_text(encoding="utf-8").splitlines():
        e = json.loads(line)
        zones.setdefault(e["lane_name"], {}).setdefault(e["zone"], []).append((e["kind"], e.get("x"), e.get("y")))
    lanes = []
    for name, own in zones.items():
        done = {z: fold_clicks(own.get(z, [])) for z in ZONES}
        for z, (state, _) in done.items():
            if state != "done":
                raise RuntimeError(f"{z} of lane {name!r} is {state}")
        lanes.append(Lane(name, *(tuple(done[z][1]) for z in ZONES)))
    return lanes


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="kegler")
    sub = out.add_subparsers(dest="command", required=True)
    extract = sub.add_parser("extract", help="shots and manifests from frames and scored detections")
    extract.add_argument("frames")
    extract.add_argument("detections")
    extract.add_argument("venue", type=check_path)
    extract.add_argument("out")
    extract.add_argument("--strategy", default="probe", type=check_strategy)
    extract.add_argument("--lane")
    extract.add_argument("--fps", type=float, default=30.0)
    extract.add_argument("--factor", type=float, default=0.5)
    extract.add_argument("--probe-interval", type=float, default=10.0)
    merge = sub.add_parser("merge", help="join the clips of a folder")
    merge.add_argument("clips", type=check_path)
    merge.add_argument("out", type=check_path)
    merge.add_argument("--pattern", default="shot_*.mp4")
    merge.add_argument("--reencode", action="store_true")
    fetch = sub.add_parser("fetch", help="the path of a local source")
    fetch.add_argument("source")
    preview = sub.add_parser("preview", help="what is drawn on each frame")
    preview.add_argument("frames")
    preview.add_argument("venue", type=check_path)
    calibrate = sub.add_parser("calibrate", help="check a venue file and pair frames with lanes; with --clicks, make it")
    calibrate.add_argument("venue", type=check_path)
    calibrate.add_argument("--frame", action="append", default=[])
    calibrate.add_argument("--lane", action="append", default=[])
    calibrate.add_argument("--clicks", help="recorded clicks: JSON lines of lane_name, zone, kind, x, y")
    calibrate.add_argument("--size", type=int, nargs=2, metavar=("WIDTH", "HEIGHT"))
    return out


def main(arguments: list[str] | None = None) -> int:
    a = parser().parse_args(arguments)
    from kegler.sources import calibration, media

    if a.command == "fetch":
        print(media.resolve(a.source))
        return 0
    if a.command == "calibrate":
        if a.clicks:
            if not a.size:
                raise SystemExit(2)
            calibration.save_venue(a.venue, lanes_from_clicks(a.clicks), *a.size)
        lanes = calibration.parse_lanes(Path(a.venue).read_text(encoding="utf-8"))
        for frame, lane in pair_frames(a.frame, a.lane) if a.lane else []:
            print(frame, lane)
        print(", ".join(x.name for x in lanes))
        return 0
    if a.command == "merge":
        print(media.merge_clips(a.clips, a.out, a.pattern, a.reencode))
        return 0
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("kegler").getOrCreate()
    lanes = calibration.parse_lanes(Path(a.venue).read_text(encoding="utf-8"))
    if a.command == "preview":
        from kegler.operators.overlay import overlay_plan

        overlay_plan(media.read_frames(spark, a.frames).select("video_id", "frame_index"), lanes).show(1000, False)
        return 0
    from kegler.plans.extract import ExtractConfig, extract_shots

    config = ExtractConfig(lanes, a.fps, a.strategy, a.lane, snap_factor(a.factor), probe=ProbeParams(a.probe_interval))
    shots, clips, reel = extract_shots(media.read_frames(spark, a.frames), spark.read.parquet(a.detections), config)
    for name, rows in (("shots", shots), ("clips", clips), ("reel", reel)):
        rows.write.mode("overwrite").parquet(f"{a.out}/{name}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
