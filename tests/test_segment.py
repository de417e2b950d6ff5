"""Segmentation: hand-made cases, a sequential statement of the rules, probe search and streaming."""

import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from kegler.config import FrameParams, SegmentParams
from kegler.operators import search, segment

P = FrameParams(confidence=0.5, stationary=3, pose=2.0, settle_run=2, pin=1.0, lookback=2, pad=1, release=6, impact=5, settle=5, gutter=4)


def told(confidence, pose, pin, ball, p):
    """The rules frame by frame."""
    n = min(map(len, (confidence, pose, pin, ball)))
    out, k = [], 0
    ok = [confidence[x] >= p.confidence and pose[x] <= p.pose for x in range(n)]
    while k < n:
        if not ok[k]:
            k += 1
            continue
        end = next((x for x in range(k, n) if not ok[x]), n)
        onset = next((x for x in range(end, min(n, end + p.release)) if pose[x] > p.pose), None)
        if end - k < p.stationary or onset is None:
            k = end + 1
            continue
        impact = next((x for x in range(onset, min(n, onset + p.impact)) if ball[x] or pin[x] > p.pin), None)
        gutter = impact is None
        if gutter:
            impact = onset + p.gutter
            if impact >= n:
                k = onset + 1
                continue
        stop = min(n, impact + p.settle)
        settle = next((x for x in range(impact + p.settle_run - 1, stop) if all(pin[y] < p.pin for y in range(x - p.settle_run + 1, x + 1))), None)
        if settle is None:
            settle = min(impact + p.settle, n - 1)
        last = min(n - 1, settle + p.pad)
        out.append((max(0, onset - p.lookback), last, sum(confidence[k:end]) / (end - k), gutter))
        k = last + 1
    return out


def found(confidence, pose, pin, ball, p=P, **more):
    own = [np.array(x, float) for x in (confidence, pose, pin)] + [np.array(ball, bool)]
    return [(s.start, s.end, s.confidence, s.gutter) for s in segment.find_shots(*own, p, **more)]


def lane(n, run, onset=(), hits=(), loud=()):
    conf, pose, pin = [0.0] * n, [0.0] * n, [0.0] * n
    for k in range(*run):
        conf[k] = 1.0
    for k in onset:
        pose[k] = 5.0
    for k in hits:
        pin[k] = 9.0
    for k in loud:
        pin[k] = 1.0
    return conf, pose, pin, [False] * n


def test_plain_shot():
    assert found(*lane(30, (2, 6), [6], [9, 10])) == [(4, 13, 1.0, False)]


def test_run_just_long_enough():
    assert found(*lane(30, (2, 4), [6], [9])) == [] and len(found(*lane(30, (2, 5), [6], [9]))) == 1


def test_onset_at_and_after_the_budget():
    assert len(found(*lane(40, (0, 3), [8], [9]))) == 1  # 3 + 6 - 1
    assert found(*lane(40, (0, 3), [9], [9])) == []


def test_impact_on_the_onset_frame_and_at_the_budget():
    assert found(*lane(30, (0, 3), [3], [3]))[0][3] is False
    assert found(*lane(30, (0, 3), [3], [7]))[0][3] is False
    assert found(*lane(30, (0, 3), [3], [8]))[0][3] is True


def test_gutter_fits_or_not():
    assert found(*lane(9, (0, 3), [4])) == [(2, 8, 1.0, True)]  # 4 + 4 = n - 1
    assert found(*lane(8, (0, 3), [4])) == []


def test_equal_to_the_threshold_is_neither_hit_nor_low():
    assert found(*lane(30, (0, 3), [3], [4], loud=range(5, 30))) == [(1, 10, 1.0, False)]  # clamped at 4 + 5, pad 1


def test_settle_clamped_at_the_end():
    assert found(*lane(8, (0, 3), [3], [4], loud=range(5, 8))) == [(1, 7, 1.0, False)]


def test_lows_before_a_gutter_impact_do_not_count():
    assert found(*lane(30, (0, 3), [3]))[0][1] == 3 + 4 + 1 + 1


def test_ball_flag_alone():
    conf, pose, pin, ball = lane(30, (0, 3), [3])
    ball[5] = True
    assert found(conf, pose, pin, ball) == [(1, 7, 1.0, False)]


def test_resume_inside_a_run():
    conf, pose, pin, ball = lane(40, (0, 30), [3, 20], [4, 21])
    assert found(conf, pose, pin, ball) == told(conf, pose, pin, ball, P) and len(found(conf, pose, pin, ball)) == 2


def test_empty_unequal_and_without_target():
    assert found([], [], [], []) == [] and found([0.0] * 9, [9.0] * 9, [9.0] * 9, [True] * 9) == []
    conf, pose, pin, ball = lane(30, (2, 6), [6], [9])
    assert found(conf, pose[:9], pin, ball) == told(conf, pose[:9], pin, ball, P)


def lanes_at_random(rng, n):
    conf = [rng.choice([0.2, 0.5, 0.9]) for _ in range(n)]
    pose = [rng.choice([0.0, 1.0, 2.0, 2.5]) if rng.random() < 0.9 else 9.0 for _ in range(n)]
    pin = [rng.choice([0.0, 0.5, 1.0, 1.5]) if rng.random() < 0.5 else 0.0 for _ in range(n)]
    return conf, pose, pin, [rng.random() < 0.03 for _ in range(n)]


def params_at_random(rng):
    return FrameParams(0.5, rng.randint(1, 4), 2.0, rng.randint(1, 4), 1.0, rng.randint(0, 4), rng.randint(0, 3), rng.randint(1, 9), rng.randint(1, 9), rng.randint(1, 9), rng.randint(0, 7))


def test_property_chain_equals_the_rules():
    rng = random.Random(11)
    shots = 0
    for _ in range(1500):
        own, p = lanes_at_random(rng, rng.randint(0, 70)), params_at_random(rng)
        want = told(*own, p)
        got = found(*own, p)
        assert [(a, b, g) for a, b, _, g in got] == [(a, b, g) for a, b, _, g in want]
        assert np.allclose([c for *_, c, _ in got], [c for *_, c, _ in want])
        assert all(0 <= a <= b < len(own[0]) for a, b, *_ in got)
        shots += len(got)
    assert shots > 500


def table(spark, lanes):
    rows = [("v", f"l{k}", k, i, c, po, pi, b) for k, own in enumerate(lanes) for i, (c, po, pi, b) in enumerate(zip(*own, strict=True))]
    return spark.createDataFrame(rows, "video_id string, lane_name string, lane_pos int, frame_index long, bowler_confidence double, pose_motion double, pin_motion double, ball_reached_pins boolean")


def test_spark_forms_agree(spark):
    rng = random.Random(5)
    lanes = [lanes_at_random(rng, 120 + k) for k in range(3)]
    rows = table(spark, lanes)
    for parts in (1, 5):
        got = sorted((r["lane_name"], r["start_frame"], r["end_frame"], r["gutter_fallback"]) for r in segment.segment_shots(rows.repartition(parts), P).collect())
        assert got == sorted((f"l{k}", a, b, g) for k, own in enumerate(lanes) for a, b, _, g in told(*own, P))
    assert segment.segment_shots(rows.where("false"), P).count() == 0
    assert segment.settles(rows, P).where((F.col("settle") > F.col("n") - 1) | (F.col("impact") < F.col("onset"))).count() == 0


def walked(lanes, p, interval, before, after):
    """Probe search, told step by step."""
    n = min(len(x) for own in lanes for x in own)
    kept, probe = [], 0
    while probe < n:
        nxt = probe + interval
        if any(own[0][probe] >= p.confidence for own in lanes):
            a, b = max(0, probe - before), min(n, probe + after)
            window = []
            for k, own in enumerate(lanes):
                conf, pose, pin, ball = (list(x[a:b]) for x in own)
                pose[0] = pin[0] = 0.0
                window += [(s + a, k, e + a, g) for s, e, _, g in told(conf, pose, pin, ball, p)]
            window.sort(key=lambda x: (x[0], x[1]))
            kept += [x for x in window if not any(y[:2] == x[:2] for y in kept)] if not kept else [x for x in window if x[:2] not in {y[:2] for y in kept}]
            if window:
                nxt = max(nxt, window[-1][2] + 1)
        probe = nxt
    return sorted(kept)


def test_probe_search(spark):
    rng = random.Random(8)
    for _ in range(60):
        lanes, p = [lanes_at_random(rng, rng.randint(30, 90)) for _ in range(2)], params_at_random(rng)
        # Rare targets, so that probes also miss.
        lanes = [([c if rng.random() < 0.4 else 0.1 for c in own[0]], *own[1:]) for own in lanes]
        ready = [(f"l{k}", tuple(np.array(x) for x in own)) for k, own in enumerate(lanes)]
        got = sorted((s.start, k, s.end, s.gutter) for k, _, s in search.probe_walk(ready, p, 7, 9, 25))
        want = walked(lanes, p, 7, 9, 25)
        assert [x[:2] for x in got if got.count(x) == 1] == [x[:2] for x in want if want.count(x) == 1]
    rows = table(spark, lanes)
    n = min(len(own[0]) for own in lanes)
    out = search.probe_shots(rows, p, 7, 9, 25).collect()
    assert sorted((r["start_frame"], r["lane_pos"], r["end_frame"], r["gutter_fallback"]) for r in out) == got and all(r["end_frame"] < n for r in out)


def test_streaming_equals_batch(spark, tmp_path):
    from kegler.streaming.shots import _step, stream_shots

    rng = random.Random(21)
    for _ in range(150):
        n, p = rng.randint(1, 400), replace(params_at_random(rng), lookback=3)
        conf, pose, pin, ball = lanes_at_random(rng, n)
        own = [np.array(x, float) for x in (conf, pose, pin)] + [np.array(ball)]
        first, kept, out, at = 0, [x[:0] for x in own], [], 0
        while at < n:
            step = rng.randint(1, 60)
            kept = [np.concatenate([k, x[at : at + step]]) for k, x in zip(kept, own)]
            at += step
            got, keep = _step(first, kept, p, False)
            out += got
            first, kept = first + keep, [k[keep:] for k in kept]
        out += _step(first, kept, p, True)[0]
        assert [(a, b, g) for a, b, _, g in out] == [(a, b, g) for a, b, _, g in told(conf, pose, pin, ball, p)]
    lanes = [lanes_at_random(rng, 90) for _ in range(2)]
    rows = table(spark, lanes).drop("lane_pos")
    for k in range(3):
        rows.where(F.col("frame_index").between(30 * k, 30 * k + 29)).coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}"))
    ends = spark.createDataFrame([("v", f"l{k}", 90, None, None, None, None) for k in range(2)], rows.schema)
    ends.coalesce(1).write.parquet(str(tmp_path / "in" / "3"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    q = stream_shots(stream, P).writeStream.format("memory").queryName("shots").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = sorted((r["lane_name"], r["start_frame"], r["end_frame"]) for r in spark.table("shots").collect())
    assert got == sorted((f"l{k}", a, b) for k, own in enumerate(lanes) for a, b, *_ in told(*own, P))


def test_seconds_become_whole_frames():
    p = SegmentParams().in_frames(29.97)
    assert (p.lookback, p.pad, p.release, p.impact, p.settle, p.gutter) == (14, 8, 299, 239, 149, 119)
    assert SegmentParams().scaled(0.5).pose_motion == 2.0


@pytest.mark.parametrize("fps", [24.0, 30.0, 59.94])
def test_budgets_cut_towards_zero(fps):
    assert SegmentParams().in_frames(fps).lookback == int(fps * 0.5)


def test_a_long_setup_run_needs_little_state():
    """Frames come in small batches; a run of thousands of frames is kept as a count and a sum."""
    from kegler.streaming import shots as live

    n, run = 6000, 5000
    conf, pose, pin = np.zeros(n), np.zeros(n), np.zeros(n)
    conf[100 : 100 + run] = np.linspace(0.6, 0.9, run)
    pose[100 + run + 2], pin[100 + run + 4] = 9.0, 9.0
    ball = np.zeros(n, bool)
    want = [(s.start, s.end, s.gutter) for s in segment.find_shots(conf, pose, pin, ball, P)]
    first, lead, own, got, most = 0, (0, 0.0), [np.empty(0), np.empty(0), np.empty(0), np.empty(0, bool)], [], 0
    for k in range(0, n + 1, 50):
        own = [np.concatenate([x, y[k : k + 50]]) for x, y in zip(own, (conf, pose, pin, ball))]
        found, keep = live._step(first, own, P, k >= n, lead)
        got += found
        own = [x[keep:] for x in own]
        spare, lead = live._led(own, (0, 0.0) if keep else lead, P)
        first, own = first + keep + spare, [x[spare:] for x in own]
        most = max(most, len(own[0]))
    assert [(s[0], s[1], s[3]) for s in got] == want and len(want) == 1
    assert abs(got[0][2] - conf[100 : 100 + run].mean()) < 1e-9
    assert most < 10 * live.horizon(P)
