"""Geometry, detections, identity, manifests, sources, adapters and the whole plan."""

import json
import os
import random
import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from kegler import __main__ as cli
from kegler import config
from kegler import fixtures as fx
from kegler.config import PersonParams
from kegler.functions import colour, geometry
from kegler.operators import detections, identity, manifest, overlay, report, signals, target
from kegler.plans.extract import ExtractConfig, extract_shots, shots_of, signals_of
from kegler.sources import calibration, media


def test_in_polygon_is_exact(spark):
    """Against half planes for a convex zone, with every lattice point in and around it."""
    zone = ((2, 1), (9, 3), (7, 8), (1, 6))
    rows = spark.range(0, 22 * 20).select((F.col("id") % 22).cast("int").alias("x"), F.floor(F.col("id") / 22).cast("int").alias("y"))
    got = {(r["x"], r["y"]) for r in rows.where(geometry.in_polygon(F.col("x"), F.col("y"), zone)).collect()}
    side = lambda x, y, ax, ay, bx, by: (2 * bx - 2 * ax) * (y - 2 * ay) - (2 * by - 2 * ay) * (x - 2 * ax)
    want = {(x, y) for x in range(22) for y in range(20) if all(side(x, y, *e) >= 0 for e in geometry.edges(zone))}
    assert got == want
    hollow = ((0, 0), (8, 0), (8, 8), (4, 2), (0, 8))
    inside = spark.createDataFrame([(8, 14), (8, 2), (2, 8), (8, 4), (16, 16), (17, 16)], "x int, y int")
    assert [r[0] for r in inside.select(geometry.in_polygon(F.col("x"), F.col("y"), hollow)).collect()] == [False, True, True, True, True, False]
    assert not geometry.Lane("a", (), (), ()).scaled(0.5).pin_zone


def test_lane_lookup_and_scaling():
    assert geometry.find_lane(fx.LANES, "left").name == "left"
    with pytest.raises(KeyError, match="left, right"):
        geometry.find_lane(fx.LANES, "middle")
    assert fx.LANES[0].scaled(0.33).approach_zone[0] == (19, 409)


def test_factor_and_checks():
    assert [config.snap_factor(f) for f in (2.0, 1.0, 0.99, 0.5, 0.34, 0.25)] == [1.0, 1.0, 0.75, 0.5, 0.33, 0.25]
    with pytest.raises(ValueError, match="0.25"):
        config.snap_factor(0.2)
    with pytest.raises(ValueError):
        config.check_strategy("other")
    with pytest.raises(ValueError):
        config.check_path("C:\new.json")
    assert config.PersonParams().scaled(0.2).min_height == 20 and config.ProbeParams(0.001).in_frames(30.0) == (1, 450, 750)


def test_person_boxes_cut_before_height(spark):
    rows = spark.createDataFrame([(0, 0.0, 10.9, 89.9, 0.4, 0), (0, 0.9, 10.0, 80.8, 0.9, 0), (0, 0.0, 10.0, 200.0, 0.39, 0), (0, 0.0, 10.0, 200.0, 0.9, 1)], "x1 int, y1 double, x2 double, y2 double, score double, cls int")
    got = detections.person_boxes(rows, config.PersonParams()).collect()
    assert [(r["y1"], r["y2"]) for r in got] == [(0, 89), (0, 80)]


def test_crop_at_the_border(spark):
    rows = spark.createDataFrame([(-5, -50, 30, 50), (700, 1200, 760, 1300), (0, 1279, 10, 1400), (730, 0, 760, 100)], "x1 int, y1 int, x2 int, y2 int")
    got = [tuple(r)[4:] for r in detections.upper_back(rows, 720, 1280).collect()]
    assert got == [(0, 5, 0, 30, False), (1218, 1255, 700, 720, False), (1300, 1280, 0, 10, True), (18, 55, 730, 720, True)]


def test_ties_go_to_the_first_detection(spark):
    rows = spark.createDataFrame([(1, 3, 0.5, 10, 10), (1, 1, 0.5, 20, 20), (1, 2, 0.4, 30, 30), (2, 0, 0.0, 5, 5)], "frame_index long, det_idx int, score double, cx2 int, cy2 int")
    assert [tuple(r) for r in signals.best_candidates(rows, ["frame_index"]).collect()] == [(1, 0.5, 20, 20)]


def test_signals_fill_and_reset(spark):
    frames = spark.createDataFrame([("v", k) for k in range(5)], "video_id string, frame_index long")
    box = lambda k, x: ("v", k, 0, x, 900, x + 40, 1000, 0.9)
    rows = spark.createDataFrame([box(0, 180), box(1, 183), box(3, 190), box(4, 190)], "video_id string, frame_index long, det_idx int, x1 int, y1 int, x2 int, y2 int, score double")
    out = signals.build_signals(frames, rows, fx.LANES).where("lane_name = 'left'").orderBy("frame_index").collect()
    assert [(r["bowler_confidence"], r["pose_motion"]) for r in out] == [(0.9, 0.0), (0.9, 3.0), (0.0, 0.0), (0.9, 0.0), (0.9, 0.0)]
    assert all(r["pin_motion"] == 0.0 and r["ball_reached_pins"] is False for r in out)


def test_pixel_motion_guards_size(spark):
    px = [("v", f, x, 0, 10 * f + x, 2, 1 if f < 2 else 9) for f in range(3) for x in range(2)]
    rows = spark.createDataFrame(px, "video_id string, frame_index long, x int, y int, gray int, width int, height int")
    mask = spark.createDataFrame([("a", 0, 0), ("a", 1, 0), ("b", 1, 0), ("c", 7, 7)], "lane_name string, x int, y int")
    got = {(r["lane_name"], r["frame_index"]): r["pin_motion"] for r in signals.pixel_motion(rows, mask, ["video_id"]).collect()}
    assert got == {("a", 0): 0.0, ("a", 1): 10.0, ("a", 2): 0.0, ("b", 0): 0.0, ("b", 1): 10.0, ("b", 2): 0.0}


def test_colour(spark):
    rows = spark.createDataFrame([(0, 0, 0), (255, 255, 255), (0, 0, 255), (0, 255, 0), (255, 0, 0), (1, 0, 255)], "b int, g int, r int")
    got = [tuple(r) for r in rows.select(*colour.hsv(F.col("b"), F.col("g"), F.col("r")), colour.hsv_bin(F.col("b"), F.col("g"), F.col("r")), colour.gray(F.col("b"), F.col("g"), F.col("r"))).collect()]
    assert [g[:3] for g in got] == [(0, 0, 0), (0, 0, 255), (0, 255, 255), (60, 255, 255), (120, 255, 255), (179, 255, 255)]
    assert [g[4] for g in got] == [0, 255, 76, 150, 29, 76] and all(0 <= g[3] < 1024 for g in got)


def test_similarity(spark):
    hist = spark.createDataFrame([("same", 0, 2.0), ("same", 1, 2.0), ("half", 0, 1.0), ("none", 5, 3.0), ("zero", 0, 0.0)], "id string, bin int, v double")
    ref = spark.createDataFrame([(0, 1.0), (1, 1.0)], "bin int, v double")
    got = {r["id"]: r["colour_score"] for r in identity.colour_similarity(hist, ref, ["id"]).collect()}
    assert got["same"] == 0.85 and abs(got["half"] - (1 - (1 - 0.5**0.5) ** 0.5)) < 1e-9 and got["none"] == 0.0 and got["zero"] == 0.0
    assert all(r["colour_score"] == 0.0 for r in identity.colour_similarity(hist, ref.where("false"), ["id"]).collect())
    flat = identity.normalised(spark.createDataFrame([("a", 0, 3), ("a", 1, 3)], "id string, bin int, n int"), ["id"], n_bins=2).collect()
    assert [r["v"] for r in flat] == [0.0, 0.0]


def test_text_scores(spark):
    rows = spark.createDataFrame([(1, "xx MARLOW", 0.7), (1, "marlow", 0.4), (2, "@arlov", 0.9), (3, "zzz", 0.9), (4, None, 0.9)], "id int, text string, confidence double")
    got = {r["id"]: r["text_score"] for r in identity.text_scores(rows, "Marlow", ["id"]).collect()}
    assert got[1] == 0.7 and got[2] == pytest.approx(8 / 12) and got[3] == 0.0 and got[4] == 0.0


def test_blobs(spark):
    square = [("v", 1, x, y, 30) for x in range(10, 18) for y in range(10, 18)] + [("v", 1, 50, 50, 99), ("v", 2, 1, 1, 30), ("v", 1, 9, 9, 25)]
    rows = spark.createDataFrame(square, "video_id string, frame_index long, x int, y int, diff int")
    assert [tuple(r) for r in detections.largest_blobs(rows).collect()] == [("v", 1, 64, 13, 13)]


def test_manifests(spark):
    shots = spark.createDataFrame([("v", "left", 0, 300 + k, 390 + k, 0.5, k == 7) for k in range(105)] + [("w", "left", 0, 5, 9, 0.5, False)], "video_id string, lane_name string, lane_pos int, start_frame long, end_frame long, bowler_confidence double, gutter_fallback boolean")
    clips = manifest.clip_manifest(shots, 30.0)
    names = {r["shot_no"]: r for r in clips.where("video_id = 'v'").collect()}
    assert names[8]["file_name"] == "shot_08_left_gutter.mp4" and names[101]["file_name"] == "shot_101_left.mp4"
    assert names[1]["start_text"] == "10.000" and names[1]["duration_text"] == "3.000"
    reel = manifest.reel_manifest(clips).orderBy("reel_pos").collect()
    assert len(reel) == 105 and reel[10]["file_name"] == "shot_101_left.mp4" and reel[2]["offset_seconds"] == 6.0
    line = spark.range(1).select(manifest.concat_line(F.lit("C:\\a\\it's.mp4"))).first()[0]
    assert line == "file 'C:/a/it\\'s.mp4'"
    got = [r[0] for r in spark.createDataFrame([(f,) for f in config.SCALE_FACTORS], "f double").select(manifest.cache_name(F.lit("m"), F.col("f"))).collect()]
    assert got == ["m.detect_1x.mp4", "m.detect_0.75x.mp4", "m.detect_0.5x.mp4", "m.detect_0.4x.mp4", "m.detect_0.33x.mp4", "m.detect_0.25x.mp4"]


def test_target(spark):
    refs = spark.createDataFrame([(1, "left"), (2, "left")], "image_id long, lane_name string")
    boxes = spark.createDataFrame([(1, "left", 2), (1, "left", 1), (1, "right", 0)], "image_id long, lane_name string, det_idx int")
    persons = target.reference_persons(refs, boxes)
    assert sorted((r["image_id"], r["det_idx"]) for r in persons.collect()) == [(1, 1), (2, None)]
    with pytest.raises(Exception, match="lane left in image 2"):
        target.require_persons(persons).collect()
    px = spark.createDataFrame([(i, k, k, k, k) for i in (1, 2) for k in range(i * 100)], "image_id long, pixel_idx long, b int, g int, r int")
    counts = target.sample_pixels(px, 150).groupBy("image_id").agg(F.countDistinct("pixel_idx").alias("n")).collect()
    assert {r["image_id"]: r["n"] for r in counts} == {1: 100, 2: 150}


def test_overlay(spark):
    px = spark.createDataFrame([(x, 0, 100, 100, 100) for x in range(4)], "x int, y int, b int, g int, r int")
    lane = geometry.Lane("a", ((0, 0), (1, 0), (1, 1), (0, 1)), ((1, 0), (2, 0), (2, 1)), ((9, 9), (8, 8)))
    got = [tuple(r)[2:] for r in overlay.overlay(px, [lane]).orderBy("x").collect()]
    assert got == [(82, 118, 82), (103, 118, 67), (118, 104, 82), (100, 100, 100)]
    assert overlay.overlay_plan(spark.range(2), [lane]).count() == 4


def test_json_round_trip_and_checks(spark, tmp_path):
    text = calibration.venue_text(fx.LANES, 720, 1280)
    (tmp_path / "venue.json").write_text(text)
    assert calibration.parse_lanes(text) == fx.LANES
    rows = calibration.read_venue(spark, str(tmp_path / "venue.json")).orderBy("lane_pos").collect()
    assert [r["name"] for r in rows] == ["left", "right"] and (rows[0]["approach_zone"][1]["x"], rows[0]["frame_height"]) == (100, 1280)
    for change, error in (({"more": 1}, "unknown"), ({"lanes": None}, "")):
        with pytest.raises(TypeError, match=error):
            calibration.parse_lanes(json.dumps(json.loads(text) | change))
    with pytest.raises(TypeError, match="missing"):
        calibration.parse_lanes("{}")
    (tmp_path / "t.json").write_text(calibration.target_text("Ann", [(1, 2, 3), (4, 5, 6)]))
    (tmp_path / "u.json").write_text('{"name": "Bo"}')
    assert [tuple(r) for r in calibration.read_target(spark, str(tmp_path / "t.json")).collect()] == [("Ann", 0, 1, 2, 3), ("Ann", 1, 4, 5, 6)]
    assert calibration.read_target(spark, str(tmp_path / "u.json")).count() == 0 and calibration.parse_target('{"name": "Bo"}') == ("Bo", [])


def test_media(spark, tmp_path):
    (tmp_path / "fake.mp4").write_bytes(b"x")
    assert media.resolve(str(tmp_path / "fake.mp4")) == str(tmp_path / "fake.mp4")
    assert media.resolve("http://x", lambda s: "log\n/cache/a.mp4\n") == "/cache/a.mp4"
    with pytest.raises(RuntimeError):
        media.resolve("http://x")
    with pytest.raises(RuntimeError, match="no-such-tool"):
        media.need_tool("no-such-tool")
    lines = []
    media.run_tool(["sh", "-c", "echo a; echo b"], "x", show=lines.append)
    assert lines == ["a", "b"]
    with pytest.raises(RuntimeError, match="line 60"):
        media.run_tool(["sh", "-c", "for i in $(seq 60); do echo line $i; done; exit 3"], "x", show=lambda s: None)
    for k in (1, 2, 10):
        (tmp_path / f"shot_{k}.mp4").write_bytes(b"x")
    assert [r["file_name"] for r in media.list_clips(spark, str(tmp_path)).collect()] == ["shot_1.mp4", "shot_10.mp4", "shot_2.mp4"]
    with pytest.raises(RuntimeError, match="no clips"):
        media.list_clips(spark, str(tmp_path), "none_*.mp4")
    fps = spark.createDataFrame([(0.0,), (25.0,), (None,)], "fps double")
    assert [r["fps"] for r in media.videos(fps).collect()] == [30.0, 25.0, 30.0]
    made = []
    assert media.ensure_copy("c", lambda t: False, made.append, "s", 0.5) == "c" and made == ["c"] and media.ensure_copy("c", lambda t: False, made.append, "s", 1.0) == "s"
    frames = media.decode(media.read_images(spark, str(tmp_path), "fake.mp4"), lambda content: iter([(0, 1, 1, content)]))
    assert [(r["video_id"], bytes(r["pixels"])) for r in frames.collect()] == [("fake", b"x")]
    boxes = detections.detect(frames, lambda frame: [{"cls": 0, "x1": 0.0, "y1": 1.0, "x2": 2.0, "y2": 3.0, "score": 0.5}] * 2)
    assert [r["det_idx"] for r in boxes.collect()] == [0, 1]
    clips = spark.createDataFrame([(str(tmp_path / "o1"),), (str(tmp_path / "o2"),)], "file_name string")
    assert media.export_clips(clips, lambda row: open(row["file_name"], "w").close()) == 2 and (tmp_path / "o2").exists()


def test_reports(spark):
    shots = spark.createDataFrame([("v", 7, "left", 30, 120, 0.5, True)], "video_id string, shot_no int, lane_name string, start_frame long, end_frame long, bowler_confidence double, gutter_fallback boolean")
    assert report.shot_lines(shots, 30.0).first()["line"] == "shot 07 left gutter frames 30-120, 3.00 s, confidence 0.500"
    frames = spark.range(100).select(F.lit("v").alias("video_id"), F.col("id").alias("frame_index"))
    assert report.progress(frames, 100).count() == 50 and report.progress(frames, 3).count() == 100
    rows = spark.createDataFrame([("v", "a", 0, 0.1), ("w", "a", 0, 0.2)], "video_id string, lane_name string, frame_index long, bowler_confidence double")
    none = shots.where("false")
    got = report.run_metrics(rows, rows.where("false").select("video_id"), none).collect()
    assert all(r["n_shots"] == r["n_probe_hits"] == r["frames_in_shots"] == 0 and r["n_signals"] == 1 for r in got)
    own = signals.as_arrays(spark.createDataFrame([("a", 2, 0.3), ("a", 0, 0.1), ("a", 1, 0.2)], "lane_name string, frame_index long, c double"), ["lane_name"], ["c"])
    assert [tuple(r) for r in own.collect()] == [("a", 3, [0.1, 0.2, 0.3])]
    levels = spark.createDataFrame([(1, 10)] * 5 + [(1, 12)] * 4 + [(1, 200)] * 6 + [(2, 7)] * 3, "id int, gray int")
    assert {r["id"]: r["threshold"] for r in colour.otsu_thresholds(levels, ["id"]).collect()} == {1: 12, 2: 0}


def test_whole_plan(spark):
    """A person stands, moves and is followed by pin motion: one shot, by either strategy."""
    rng = random.Random(1)
    frames = spark.range(700).select(F.lit("v").alias("video_id"), F.col("id").alias("frame_index"))
    rows = []
    for k in range(700):
        x = 90 + (0 if k < 330 else (k - 330) * 3 % 40)
        if k < 420:
            rows.append(("v", k, 0, x, 420, x + 20, 520, 0.8))
        rows.append(("v", k, 1, rng.randint(340, 350), 0, 355, 30, 0.9))
    boxes = spark.createDataFrame(rows, "video_id string, frame_index long, det_idx int, x1 int, y1 int, x2 int, y2 int, score double")
    motion = spark.range(700).select(F.lit("v").alias("video_id"), F.col("id").alias("frame_index"), F.lit("left").alias("lane_name"), F.when(F.col("id").between(400, 430), 9.0).otherwise(0.2).alias("pin_motion"))
    for strategy in ("linear", "probe"):
        shots, clips, reel = extract_shots(frames, boxes, ExtractConfig(fx.LANES, strategy=strategy), motion)
        assert [(r["lane_name"], r["start_frame"], r["end_frame"], r["gutter_fallback"]) for r in shots.collect()] == [("left", 316, 451, False)]
        assert clips.first()["file_name"] == "shot_01_left.mp4" and reel.count() == 0
    with pytest.raises(KeyError):
        ExtractConfig(fx.LANES, lane="none").lanes_scaled()
    with pytest.raises(ValueError):
        shots_of(spark.createDataFrame([], "lane_name string"), ExtractConfig(fx.LANES, strategy="x"))


def test_command_line(tmp_path, capsys):
    with pytest.raises(SystemExit):
        cli.main(["--help"])
    said = capsys.readouterr().out
    assert all(c in said for c in ("calibrate", "extract", "preview", "fetch", "merge"))
    (tmp_path / "v.json").write_text(calibration.venue_text(fx.LANES, 720, 1280))
    assert cli.main(["calibrate", str(tmp_path / "v.json"), "--frame", "a.png", "--lane", "left", "--lane", "right"]) == 0
    assert capsys.readouterr().out == "a.png left\na.png right\nleft, right\n"
    with pytest.raises(SystemExit) as e:
        cli.pair_frames(["a", "b"], ["x", "y", "z"])
    assert e.value.code == 2
    assert cli.main(["fetch", str(tmp_path / "v.json")]) == 0


def test_every_query_has_sql_or_is_known_not_to(spark, sf):
    import duckdb

    from kegler import oracle, queries

    named, sql = queries.queries(), oracle.oracle_sql()
    assert set(named) - set(sql) == {"q_ocr_fuzzy", "q_probe_shots", "q_linear_vs_probe"} and not set(sql) - set(named)
    con = duckdb.connect()
    for t in ("events", "lineitem", "orders", "part", "nation", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    for name in ("q_shot_segments", "q_foot_in_zone", "q_pin_motion", "q_bhattacharyya", "q_probe_windows", "q_reel_manifest"):
        got = named[name](spark, sf)
        want = con.execute(sql[name])
        columns = [d[0] for d in want.description]
        assert sorted(map(str, (tuple(r[c] for c in columns) for r in got.collect()))) == sorted(map(str, want.fetchall())), name


def test_pandas_is_only_where_it_must_be(spark, sf):
    """Plans of the relational queries run no Python."""
    from kegler import queries

    for name, f in queries.queries().items():
        plan = f(spark, sf)._jdf.queryExecution().executedPlan().toString()
        if name not in ("q_ocr_fuzzy", "q_probe_shots", "q_linear_vs_probe", "q_shot_segments", "q_shot_summary", "q_clip_manifest", "q_reel_manifest", "q_lane_restricted", "q_format_sanity", "q_run_metrics", "q_video_shots", "q_video_clips"):
            assert "Python" not in plan and "Pandas" not in plan and "CartesianProduct" not in plan, name


def test_signal_digests_see_whole_arrays(spark, sf, monkeypatch):
    import hashlib
    import math

    import duckdb
    from pyspark.sql import Window as W

    from kegler import fixtures, oracle, queries

    rows = [r.asDict() for r in fixtures.signals(spark, sf).collect()]
    want = {}
    for lane in {r["lane_name"] for r in rows}:
        own = sorted((r for r in rows if r["lane_name"] == lane), key=lambda r: r["frame_index"])
        join = lambda c, unit: hashlib.sha256(",".join(str(math.floor(r[c] * unit + 0.5)) for r in own).encode()).hexdigest()  # noqa: B023, E731
        want[lane] = (len(own), join("bowler_confidence", 100.0), join("pin_motion", 1000.0))
    got = {r["lane_name"]: tuple(r)[1:] for r in queries.queries()["q_signal_digests"](spark, sf).collect()}
    assert got == want
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{sf}/events.parquet')")
    assert sorted(con.execute(oracle.oracle_sql()["q_signal_digests"]).fetchall()) == sorted((k, *v) for k, v in want.items())
    # A motion that moves by one frame shows; the counts and tails of q_signal_arrays stay.
    whole, arrays = fixtures.signals(spark, sf), queries.queries()["q_signal_arrays"](spark, sf).collect()
    swapped = whole.withColumn("pin_motion", F.lag("pin_motion", 1, 0.0).over(W.partitionBy("lane_name").orderBy("frame_index")))
    monkeypatch.setattr(fixtures, "signals", lambda *_: swapped)
    moved = {r["lane_name"]: tuple(r)[1:] for r in queries.queries()["q_signal_digests"](spark, sf).collect()}
    assert all(moved[k][:2] == want[k][:2] and moved[k][2] != want[k][2] for k in want)
    assert {r["lane_name"]: r["tail"] for r in queries.queries()["q_signal_arrays"](spark, sf).collect()} == {r["lane_name"]: r["tail"] for r in arrays}


def test_identity_from_pixels(spark):
    """From boxes and pixels to a score: who wears the target's colour scores high, others low; a crop outside the frame 0."""
    pixels = [("v", 0, x, y, 0, 0, 250) for x in range(20) for y in range(40)] + [("v", 0, x, y, 250, 0, 0) for x in range(20, 40) for y in range(40)]
    px = spark.createDataFrame(pixels, "video_id string, frame_index long, x int, y int, b int, g int, r int")
    boxes = spark.createDataFrame([("v", 0, 0, 2, 0, 18, 40, 0.9), ("v", 0, 1, 22, 0, 38, 40, 0.9), ("v", 0, 2, 60, 0, 80, 40, 0.9)], "video_id string, frame_index long, det_idx int, x1 int, y1 int, x2 int, y2 int, score double")
    samples = spark.createDataFrame([(0, 0, 250)] * 5, "b int, g int, r int")
    got = {r["det_idx"]: r["score"] for r in identity.identify(boxes, px, samples, 40, 40).collect()}
    assert got == {0: 0.85, 1: 0.0, 2: 0.0}
    texts = spark.createDataFrame([("v", 0, 1, 0.93)], "video_id string, frame_index long, det_idx int, text_score double")
    got = {r["det_idx"]: r["score"] for r in identity.identify(boxes, px, samples, 40, 40, texts).collect()}
    assert got == {0: 0.85, 1: 0.93, 2: 0.0}
    assert identity.identify(boxes, px, samples.where("false"), 40, 40).agg({"score": "max"}).first()[0] == 0.0


def test_whole_plan_from_pixels(spark):
    """The plan with identity and motion from pixels: signals come from nothing but frames, boxes and samples."""
    lane = fx.Lane("one", ((0, 0), (19, 0), (19, 39), (0, 39)), ((20, 0), (25, 0), (25, 39), (20, 39)), ((30, 0), (35, 0), (35, 5), (30, 5)))
    config = ExtractConfig([lane], factor=1.0, strategy="linear", person=PersonParams(min_height=20))
    frames = spark.range(4).select(F.lit("v").alias("video_id"), F.col("id").alias("frame_index"))
    grid = frames.withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(39)))).withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(39))))
    px = grid.withColumns({"b": F.when((F.col("x") >= 30) & (F.col("frame_index") == 2), 100).otherwise(0), "g": F.lit(0), "r": F.when(F.col("x") < 20, 250).otherwise(0)})
    boxes = spark.createDataFrame([("v", k, 0, 2 + 3 * (k == 3), 0, 12 + 3 * (k == 3), 30, 0.9) for k in range(4) if k != 1], "video_id string, frame_index long, det_idx int, x1 int, y1 int, x2 int, y2 int, score double")
    samples = spark.createDataFrame([(0, 0, 250)], "b int, g int, r int")
    rows = {r["frame_index"]: r for r in signals_of(frames, boxes, config, pixels=px, samples=samples, size=(40, 40)).collect()}
    assert [rows[k]["bowler_confidence"] for k in range(4)] == [0.85, 0.0, 0.85, 0.85]
    assert [rows[k]["pose_motion"] for k in range(4)] == [0.0, 0.0, 0.0, 3.0]
    assert [rows[k]["pin_motion"] for k in range(4)] == [0.0, 0.0, 11.0, 11.0]


def test_build_target(spark):
    boxes = [(1, 0, 300, 0, 340, 100, 0.9), (1, 1, 90, 900, 130, 1100, 0.9), (1, 2, 95, 900, 130, 1100, 0.9), (2, 0, 400, 900, 440, 1100, 0.9)]
    found = spark.createDataFrame(boxes, "image_id long, det_idx int, x1 int, y1 int, x2 int, y2 int, score double")
    px = spark.createDataFrame([(i, x, y, i, x % 256, 7) for i, a in ((1, 90), (2, 400)) for x in range(a - 5, a + 60, 5) for y in range(900, 1100, 10)], "image_id long, x int, y int, b int, g int, r int")
    refs = spark.createDataFrame([(1, "left"), (2, "right")], "image_id long, lane_name string")
    rows = target.build_target("Ann", refs, found, px, fx.LANES, fx.WIDTH, fx.HEIGHT, per_image=30).collect()
    # Crops are rows 936 to 1009 and the box's columns; both images' samples are joined and numbered.
    assert sorted(r["sample_idx"] for r in rows) == list(range(60)) and {r["target_name"] for r in rows} == {"Ann"}
    assert all(90 <= r["g"] < 130 for r in rows if r["b"] == 1) and all(400 % 256 <= r["g"] < 440 % 256 for r in rows if r["b"] == 2)
    with pytest.raises(Exception, match="no person"):
        target.build_target("Ann", refs, found.where("image_id = 1"), px, fx.LANES, fx.WIDTH, fx.HEIGHT).collect()


def random_lane(rng, n):
    """Standing, moving and pin motion at random, often enough for shots."""
    conf, pose, pin = (np.zeros(n) for _ in range(3))
    at = 0
    while at < n:
        run = rng.randint(2, 12)
        conf[at : at + run], pose[at : at + run] = rng.choice([0.0, 0.9]), rng.choice([0.0, 0.0, 6.0])
        pin[at : at + run] = rng.choice([0.0, 0.0, 3.0])
        at += run
    return conf, pose, pin, np.zeros(n, bool)


def test_lazy_probe_reads_only_what_it_needs(spark):
    from kegler.operators.search import lazy_walk, probe_videos, probe_walk

    rng = random.Random(4)
    params = fx.FrameParams(confidence=0.3, stationary=3, pose=4.0, settle_run=3, pin=1.5, lookback=2, pad=1, release=12, impact=12, settle=9, gutter=6)
    for _ in range(25):
        n = rng.randint(0, 400)
        lanes = [(name, random_lane(rng, n)) for name in ("a", "b")]
        seen = set()

        def scan(a, b, lanes=lanes, seen=seen):
            seen.update(range(a, b))
            out = []
            for name, own in lanes:
                conf, pose, pin, ball = (x[a:b].copy() for x in own)
                pose[:1] = pin[:1] = 0.0
                out.append((name, (conf, pose, pin, ball)))
            return out

        want = probe_walk(lanes, params, 20, 10, 25)
        got = lazy_walk(scan, n, params, 20, 10, 25)
        assert [(k, w, s) for k, _, w, s in got] == want
        assert len(seen) <= n
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import this module
    n, quiet = 300, (np.zeros(300), np.zeros(300), np.zeros(300), np.zeros(300, bool))
    looked = []
    assert lazy_walk(lambda a, b: looked.append((a, b)) or [("a", tuple(x[a:b] for x in quiet))], n, params, 20, 10, 25) == []
    assert looked == [(k, k + 1) for k in range(0, 300, 20)]

    def load():
        def read(video, a, b):
            rng = random.Random(video)
            own = random_lane(rng, 200)
            conf, pose, pin, ball = (x[a:b].copy() for x in own)
            pose[:1] = pin[:1] = 0.0
            return [("a", (conf, pose, pin, ball))]

        return read

    videos = spark.createDataFrame([("x", 200), ("y", 200), ("z", 0)], "video_id string, n_frames long")
    got = sorted((r["video_id"], r["window_no"], r["start_frame"], r["end_frame"]) for r in probe_videos(videos, load, params, 20, 10, 25).collect())
    want = []
    for video in ("x", "y"):
        lanes = [("a", random_lane(random.Random(video), 200))]
        want += [(video, w, s.start, s.end) for _, w, s in probe_walk(lanes, params, 20, 10, 25)]
    assert got == sorted(want)


def test_merge_clicks_and_saving(spark, tmp_path, monkeypatch):
    from kegler.operators.clicks import replay_clicks

    with pytest.raises(RuntimeError, match="no clips"):
        media.merge_clips(str(tmp_path), str(tmp_path / "out.mp4"))
    for n in ("shot_02_a.mp4", "shot_100_a.mp4", "shot_11_it's.mp4", "other.mp4"):
        (tmp_path / n).write_bytes(b"")
    seen = {}

    def run(command, what):
        listed = command[command.index("-i") + 1]
        seen.update(command=command, lines=open(listed, encoding="utf-8").read().splitlines(), listed=listed)
        raise RuntimeError("stopped")

    monkeypatch.setattr(media, "need_tool", lambda name: name)
    for again in (False, True):
        with pytest.raises(RuntimeError, match="stopped"):
            media.merge_clips(str(tmp_path), str(tmp_path / "deep" / "reel.mp4"), reencode=again, run=run)
        assert not os.path.exists(seen["listed"]) and (tmp_path / "deep").is_dir()
        assert [x.rsplit("/", 1)[1] for x in seen["lines"]] == ["shot_02_a.mp4'", "shot_100_a.mp4'", "shot_11_it\\'s.mp4'"]
        assert ("copy" in seen["command"]) != again and ("libx264" in seen["command"]) == again
    assert media.merge_clips(str(tmp_path), str(tmp_path / "r.mp4"), run=lambda c, w: None) == 3

    events = [("l", "approach_zone", k, kind, x, y) for k, (kind, x, y) in enumerate([("undo", 0, 0), ("add", 1, 2), ("add", 3, 4), ("finish", 0, 0), ("add", 9, 9), ("undo", 0, 0), ("add", 5, 6), ("finish", 0, 0), ("add", 7, 7)])]
    events += [("l", "pin_zone", 0, "add", 1, 1), ("l", "pin_zone", 1, "cancel", 0, 0), ("m", "pin_zone", 0, "add", 1, 1)]
    rows = {(r["lane_name"], r["zone"]): (r["state"], [tuple(p) for p in r["points"]]) for r in replay_clicks(spark.createDataFrame(events, "lane_name string, zone string, event_no int, kind string, x int, y int")).collect()}
    assert rows == {("l", "approach_zone"): ("done", [(1, 2), (3, 4), (5, 6)]), ("l", "pin_zone"): ("cancelled", []), ("m", "pin_zone"): ("open", [(1, 1)])}

    calibration.save_venue(str(tmp_path / "v.json"), fx.LANES, 720, 1280)
    assert calibration.parse_lanes((tmp_path / "v.json").read_text()) == fx.LANES
    own = spark.createDataFrame([("Ann", 1, 4, 5, 6), ("Ann", 0, 1, 2, 3)], "target_name string, sample_idx int, b int, g int, r int")
    calibration.save_target(str(tmp_path / "t.json"), own)
    assert calibration.parse_target((tmp_path / "t.json").read_text()) == ("Ann", [(1, 2, 3), (4, 5, 6)])
    clicks = tmp_path / "clicks.jsonl"
    clicks.write_text("\n".join(json.dumps({"lane_name": "x", "zone": z, "kind": k, "x": x, "y": x * x}) for z in ("approach_zone", "lane_zone", "pin_zone") for k, x in (("add", 1), ("add", 2), ("add", 3), ("finish", 0))))
    assert cli.main(["calibrate", str(tmp_path / "new.json"), "--clicks", str(clicks), "--size", "72", "128"]) == 0
    assert calibration.parse_lanes((tmp_path / "new.json").read_text())[0].pin_zone == ((1, 1), (2, 4), (3, 9))


def test_ocr_images_and_recogniser(spark):
    from kegler.functions import ocr

    rng = np.random.default_rng(2)
    crop = rng.integers(0, 256, (20, 30, 3), dtype=np.uint8)
    six = ocr.variants(crop)
    assert [x.shape for x in six] == [(20, 30, 3)] + [(60, 90, 3)] * 5
    assert (six[3] == 255 - six[2]).all() and set(np.unique(six[4])) <= {0, 255} and ocr.variants(crop[:0]) == []
    flat = np.full((10, 10, 3), 77, np.uint8)
    assert (ocr.enlarged(flat) == 77).all()
    # The centre of each enlarged pixel is the pixel itself.
    assert (ocr.enlarged(crop)[1::3, 1::3] == crop).all()
    ramp = np.tile(np.arange(100, 140, dtype=np.uint8), (40, 1))
    assert np.ptp(ocr.evened(ramp).astype(int)) > np.ptp(ramp.astype(int))
    two = np.array([[10] * 5 + [200] * 5], np.uint8)
    assert ocr.split_level(two) == 10

    def load():
        return lambda image: [("ANNA B", 0.5)] if image.shape[0] == 30 else [("anma", 0.9)] if image.shape[0] == 10 else []

    rows = spark.createDataFrame([("v", 1, 10, 12, bytes(360)), ("v", 2, 0, 0, b"")], "video_id string, det int, height int, width int, pixels binary")
    read = identity.recognise(rows, load, ["video_id", "det"])
    assert read.count() == 6
    assert [tuple(r) for r in identity.text_scores(read, "anna", ["video_id", "det"]).collect()] == [("v", 1, 0.75)]


def test_ball_from_pixels(spark):
    frames = []
    for f in range(3):
        for x in range(30):
            for y in range(30):
                # A square of 8 x 8 with a hole jumps in between frames; outside the mask all flickers.
                ball = f >= 1 and 5 + 8 * (f - 1) <= x < 13 + 8 * (f - 1) and 5 <= y < 13 and (x, y) != (8, 8)
                frames.append(("v", f, x, y, 200 if ball else 90 * (f % 2) if x >= 25 else 0))
    px = spark.createDataFrame(frames, "video_id string, frame_index long, x int, y int, gray int")
    mask = spark.range(25 * 30).select((F.col("id") % 25).cast("int").alias("x"), F.floor(F.col("id") / 25).cast("int").alias("y"))
    rows = {r["frame_index"]: (r["area"], r["x"], r["y"]) for r in detections.detect_ball(px, mask).collect()}
    assert rows[1] == (64, 8, 8) and rows[2][0] == 127 + 1
    sized = px.withColumns({"width": F.when(F.col("frame_index") == 1, 30).otherwise(31), "height": F.lit(30)})
    assert detections.detect_ball(sized, mask).count() == 0
    assert detections.closed({(0, 0)}) == {(0, 0)}


def test_frames_images_downloads_and_models(spark, tmp_path):
    rows = spark.createDataFrame([("a", 0), ("b", 7), ("c", None)], "video_id string, n_frames long")
    frames = spark.createDataFrame([("a", 0), ("a", 1)], "video_id string, frame_index long")
    assert {r["video_id"]: r["n_frames"] for r in media.with_frame_counts(rows, frames).collect()} == {"a": 2, "b": 7, "c": 0}
    (tmp_path / "a.img").write_bytes(b"ok")
    found = media.read_images(spark, str(tmp_path), "*.img", lambda data: (1, 1, data) if data == b"ok" else None)
    assert bytes(found.first()["pixels"]) == b"ok"
    (tmp_path / "b.img").write_bytes(b"bad")
    with pytest.raises(Exception, match="no image can be read"):
        media.read_images(spark, str(tmp_path), "*.img", lambda data: (1, 1, data) if data == b"ok" else None).collect()

    got = []

    def fetch(address, path):
        got.append(address)
        if address != "none":
            open(path, "w").close()

    folder = str(tmp_path / "cache")
    first = media.download_once("u", folder, lambda a: ("id7", "mp4"), fetch)
    assert first.endswith("id7.mp4") and media.download_once("u", folder, lambda a: ("id7", "mp4"), fetch) == first and got == ["u"]
    with pytest.raises(RuntimeError, match="wrote no file"):
        media.download_once("none", folder, lambda a: ("id8", "mp4"), fetch)
    assert os.listdir(folder) == ["id7.mp4"]
    made = []
    get = media.once_per_worker(lambda: made.append(1) or len(made))
    assert get() == get() == 1 and made == [1]


def test_overlay_is_written_frame_by_frame(spark, tmp_path):
    rows = [("v", f, x, y, 10 * f, 200, 255) for f in (2, 0, 1) for x in range(8) for y in range(8)]
    px = spark.createDataFrame(rows, "video_id string, frame_index long, x int, y int, b int, g int, r int")
    path = str(tmp_path / "video.raw")

    def open_writer(video):
        out = open(path, "wb")
        return lambda frame: out.close() if frame is None else out.write(frame)

    assert [tuple(r) for r in overlay.render_overlay(px, fx.GRID_LANES, open_writer).collect()] == [("v", 3)]
    data = np.frombuffer(open(path, "rb").read(), np.uint8).reshape(3, 8, 8, 3)
    # Pixel (7, 1) lies in no zone.
    assert data[:, 1, 7].tolist() == [[0, 200, 255], [10, 200, 255], [20, 200, 255]]
    blended = {(r["frame_index"], r["x"], r["y"]): (r["b"], r["g"], r["r"]) for r in overlay.overlay(px, fx.GRID_LANES).collect()}
    assert all(tuple(data[f, y, x]) == v for (f, x, y), v in blended.items())


def test_snapping_as_a_column_and_on_the_driver(spark):
    from kegler.functions.scaling import snapped

    asked = [0.2, 0.25, 0.3, 0.33, 0.34, 0.5, 0.74, 0.99, 1.0, 2.0]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in asked], "f double").select(snapped(F.col("f"))).collect()]
    assert got == [None, *(config.snap_factor(x) for x in asked[1:])]
