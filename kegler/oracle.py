"""DuckDB SQL for the engine's own queries."""

from __future__ import annotations

from kegler import fixtures as fx
from kegler.config import SCALE_FACTORS
from kegler.functions.geometry import ZONES, edges
from kegler.operators.overlay import ALPHA, COLOURS

P = fx.PARAMS
_W = "PARTITION BY lane_name ORDER BY frame_index"
_AHEAD, _BEHIND = "ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING", "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"

SIGNALS = f"""
ev AS (
  SELECT CAST(user_id % 4 AS INT) AS l, ts, event_id, value, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events
), s0 AS (
  SELECT l, 'lane_' || l AS lane_name, row_number() OVER w - 1 AS frame_index, CAST(k AS DOUBLE) / 100 AS conf,
         coalesce(abs(value - lag(value, 1) OVER w), 0) AS pose, coalesce(abs(value - lag(value, 2) OVER w), 0) AS pin
  FROM ev WINDOW w AS (PARTITION BY l ORDER BY ts, event_id)
), s1 AS (
  SELECT *, conf >= CAST({P.confidence} AS DOUBLE) AND pose <= {P.pose} AS el, pose > {P.pose} AS mov, pin > {P.pin} AS hit, pin < {P.pin} AS low, count(*) OVER (PARTITION BY lane_name) AS n FROM s0
), s2 AS (
  SELECT *, coalesce(min(CASE WHEN NOT el THEN frame_index END) OVER ({_W} {_AHEAD}), n) AS nbreak,
         min(CASE WHEN el THEN frame_index END) OVER ({_W} {_AHEAD}) AS nel,
         min(CASE WHEN mov THEN frame_index END) OVER ({_W} {_AHEAD}) AS nmove,
         min(CASE WHEN hit THEN frame_index END) OVER ({_W} {_AHEAD}) AS nhit,
         frame_index - coalesce(max(CASE WHEN NOT low THEN frame_index END) OVER ({_W} {_BEHIND}), -1) AS streak,
         sum(CAST(round(conf * 100) AS BIGINT)) OVER ({_W} {_BEHIND}) AS upto
  FROM s1
), s AS (
  SELECT *, min(CASE WHEN streak >= {P.settle_run} THEN frame_index END) OVER ({_W} {_AHEAD}) AS ncalm FROM s2
)"""

#: What becomes of a candidate that begins at any eligible frame.
STEPS = f"""
, c1 AS (
  SELECT lane_name, l, n, frame_index AS i, nbreak AS j, upto, conf FROM s WHERE el
), c2 AS (
  SELECT c1.*, CASE WHEN j - i >= {P.stationary} AND a.nmove < j + {P.release} THEN a.nmove END AS onset,
         (z.upto - c1.upto + CAST(round(c1.conf * 100) AS BIGINT)) / CAST(100 AS DOUBLE) / (j - i) AS confidence
  FROM c1 LEFT JOIN s AS a ON a.lane_name = c1.lane_name AND a.frame_index = j JOIN s AS z ON z.lane_name = c1.lane_name AND z.frame_index = j - 1
), c3 AS (
  SELECT c2.*, coalesce(nhit >= onset + {P.impact}, true) AS gutter, CASE WHEN coalesce(nhit >= onset + {P.impact}, true) THEN onset + {P.gutter} ELSE nhit END AS impact
  FROM c2 LEFT JOIN s ON s.lane_name = c2.lane_name AND s.frame_index = onset
), c4 AS (
  SELECT c3.*, coalesce(s.ncalm < least(c3.n, impact + {P.settle}), false) AS settled,
         CASE WHEN coalesce(s.ncalm < least(c3.n, impact + {P.settle}), false) THEN s.ncalm ELSE least(impact + {P.settle}, c3.n - 1) END AS settle
  FROM c3 LEFT JOIN s ON s.lane_name = c3.lane_name AND s.frame_index = impact + {P.settle_run} - 1
), step AS (
  SELECT *, onset IS NOT NULL AND impact < n AS is_shot, greatest(0, onset - {P.lookback}) AS start_frame, least(n - 1, settle + {P.pad}) AS end_frame,
         CASE WHEN onset IS NULL THEN j + 1 WHEN impact >= n THEN onset + 1 ELSE least(n - 1, settle + {P.pad}) + 1 END AS resume
  FROM c4
), jump AS (
  SELECT step.*, s.nel AS next_i FROM step LEFT JOIN s ON s.lane_name = step.lane_name AND s.frame_index = resume
), chain(lane_name, i) AS (
  SELECT lane_name, nel FROM s WHERE frame_index = 0 AND nel IS NOT NULL
  UNION ALL SELECT jump.lane_name, jump.next_i FROM chain JOIN jump ON jump.lane_name = chain.lane_name AND jump.i = chain.i WHERE jump.next_i IS NOT NULL
), shots AS (
  SELECT l AS lane_pos, jump.lane_name AS lane_name, start_frame, end_frame, confidence, gutter AS gutter_fallback
  FROM chain JOIN jump ON jump.lane_name = chain.lane_name AND jump.i = chain.i WHERE is_shot
)"""

#: The same for maximal runs alone, without the chain.
RUNS = """
, runs AS (
  SELECT c4.* FROM c4 LEFT JOIN s AS b ON b.lane_name = c4.lane_name AND b.frame_index = c4.i - 1 WHERE NOT coalesce(b.el, false)
)"""

#: Three videos: twelve lanes, told apart by their number.
_VIDEOS = ("user_id % 4", "user_id % 12")
_VIDEO = "'v' || (lane_pos // 4) AS video_id, 'lane_' || (lane_pos % 4) AS lane_name"
_VIDEO_CLIPS = f"""
, named AS (
  SELECT 'v' || (lane_pos // 4) AS video_id, printf('shot_%02d_', CAST(row_number() OVER (PARTITION BY lane_pos // 4 ORDER BY start_frame, lane_pos, end_frame) AS INT)) || 'lane_' || (lane_pos % 4) || CASE WHEN gutter_fallback THEN '_gutter' ELSE '' END || '.mp4' AS file_name,
         (end_frame - start_frame) / CAST({fx.FPS} AS DOUBLE) AS seconds
  FROM shots
)"""

_CLIPS = f"""
, num AS (
  SELECT *, row_number() OVER (ORDER BY start_frame, lane_pos, end_frame) AS shot_no FROM shots
), clips AS (
  SELECT CAST(shot_no AS INT) AS shot_no, lane_name, printf('shot_%02d_', CAST(shot_no AS INT)) || lane_name || CASE WHEN gutter_fallback THEN '_gutter' ELSE '' END || '.mp4' AS file_name,
         start_frame / CAST({fx.FPS} AS DOUBLE) AS start_seconds, (end_frame - start_frame) / CAST({fx.FPS} AS DOUBLE) AS duration_seconds
  FROM num
)"""

BOXES = """
li AS (
  SELECT l_orderkey AS frame_index, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS INT)) - 1 AS INT) AS det_idx,
         CAST(l_quantity AS INT) AS q, CAST((l_partkey * 7 + l_suppkey * 13) % 620 AS INT) AS x1, CAST((l_partkey * 11 + l_suppkey * 5) % 1000 AS INT) AS y1,
         CAST((l_partkey * 17 + l_suppkey * 29) % 100 AS DOUBLE) / 100 AS score
  FROM lineitem
), box AS (
  SELECT frame_index, det_idx, x1, y1, x1 + 40 + q AS x2, y1 + 40 + 4 * q AS y2, score FROM li WHERE score >= CAST(0.4 AS DOUBLE) AND 40 + 4 * q >= 80
)"""


def _inside(px: str, py: str, zone) -> str:
    """Boundary included, by a crossing count in doubled whole numbers."""
    cross, on = [], []
    for e in edges(zone):
        ax, ay, bx, by = (2 * v for v in e)
        area = f"(({px} - {ax}) * ({by - ay}) - ({py} - {ay}) * ({bx - ax}))"
        on.append(f"({area} = 0 AND {px} BETWEEN {min(ax, bx)} AND {max(ax, bx)} AND {py} BETWEEN {min(ay, by)} AND {max(ay, by)})")
        cross.append(f"CASE WHEN (({ay} > {py}) <> ({by} > {py})) AND {area} * {1 if by > ay else -1} < 0 THEN 1 ELSE 0 END")
    return f"(({' + '.join(cross)}) % 2 = 1 OR {' OR '.join(on)})"


IN_ZONE = BOXES + ", zoned AS (\n" + "\nUNION ALL ".join(f"  SELECT *, '{x.name}' AS lane_name FROM box WHERE {_inside('(x1 + x2)', '(2 * y2)', x.approach_zone)}" for x in fx.LANES) + "\n)"

_LANE_NAMES = ", ".join(f"('{x.name}')" for x in fx.LANES)
OCCUPIED = IN_ZONE + f"""
, best AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY frame_index, lane_name ORDER BY score DESC, det_idx) AS k FROM zoned WHERE score > 0) WHERE k = 1
), occ AS (
  SELECT o_orderkey AS frame_index, v.lane_name AS lane_name, coalesce(score, 0) AS confidence, (x1 + x2) / CAST(2 AS DOUBLE) AS cx, (y1 + y2) / CAST(2 AS DOUBLE) AS cy
  FROM orders CROSS JOIN (VALUES {_LANE_NAMES}) AS v(lane_name) LEFT JOIN best ON best.frame_index = o_orderkey AND best.lane_name = v.lane_name
)"""

PIXELS = """
px AS (
  SELECT vec_id AS frame_index, CAST((i - 1) % 8 AS INT) AS x, CAST((i - 1) // 8 AS INT) AS y, CAST(trunc((CAST(embedding[i] AS DOUBLE) + CAST(1 AS DOUBLE)) * CAST(127.5 AS DOUBLE)) AS INT) AS gray
  FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS i FROM embeddings)
)"""

HIST = PIXELS + """
, hist AS (
  SELECT frame_index AS vec_id, y * 8 + x AS bin, CAST(gray - min(gray) OVER (PARTITION BY frame_index) AS BIGINT) AS n FROM px
)"""

COLOUR = HIST + """
, ref AS (
  SELECT bin, CAST(sum(n) AS DOUBLE) AS v FROM hist JOIN embeddings ON hist.vec_id = embeddings.vec_id WHERE label = 0 GROUP BY bin
), sums AS (
  SELECT vec_id, sum(sqrt(n * coalesce(ref.v, 0))) AS b, CAST(sum(n) AS DOUBLE) AS t FROM hist LEFT JOIN ref ON ref.bin = hist.bin GROUP BY vec_id
), col AS (
  SELECT vec_id, CASE WHEN sqrt(t * (SELECT sum(v) FROM ref)) > 0 THEN least(CAST(0.85 AS DOUBLE), greatest(CAST(0 AS DOUBLE), CAST(1 AS DOUBLE) - sqrt(greatest(CAST(0 AS DOUBLE), CAST(1 AS DOUBLE) - b / sqrt(t * (SELECT sum(v) FROM ref)))))) ELSE 0 END AS score
  FROM sums
)"""

RGB = """
rgb AS (
  SELECT p_partkey % 8 AS image_id, p_partkey AS pixel_idx, CAST((p_partkey * 37) % 256 AS INT) AS b, CAST((p_partkey * 91) % 256 AS INT) AS g, CAST((p_partkey * 53) % 256 AS INT) AS r FROM part
)"""

_HSV = RGB + """
, span AS (
  SELECT *, greatest(b, g, r) AS v, greatest(b, g, r) - least(b, g, r) AS d FROM rgb
), hsv AS (
  SELECT image_id, v, CASE WHEN v = 0 THEN 0 ELSE 255 * d // v END AS s,
         CASE WHEN d = 0 THEN 0 WHEN v = r THEN (CAST(floor(CAST(30 * (g - b) AS DOUBLE) / d) AS INT) + 180) % 180 WHEN v = g THEN 60 + CAST(floor(CAST(30 * (b - r) AS DOUBLE) / d) AS INT) ELSE 120 + CAST(floor(CAST(30 * (r - g) AS DOUBLE) / d) AS INT) END AS h
  FROM span
)"""


def _with(*parts: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + "".join(parts) + "\n"


def _chain(select: str, *more: str) -> str:
    return _with(SIGNALS, STEPS, *more, recursive=True) + select


def _overlay() -> str:
    a = round(ALPHA * 100)
    sql, k = PIXELS + ", o0 AS (SELECT frame_index, x, y, gray AS b, gray AS g, gray AS r FROM px)", 0
    for lane in fx.GRID_LANES:
        for z in ZONES:
            inside = _inside("(2 * x)", "(2 * y)", getattr(lane, z))
            mixed = ", ".join(f"CASE WHEN {inside} THEN ({a * v} + {100 - a} * {c} + 50) // 100 ELSE {c} END AS {c}" for c, v in zip("bgr", COLOURS[z], strict=True))
            sql += f", o{k + 1} AS (SELECT frame_index, x, y, {mixed} FROM o{k})"
            k += 1
    return _with(sql) + f"SELECT frame_index, x, y, CAST(b AS INT) AS b, CAST(g AS INT) AS g, CAST(r AS INT) AS r FROM o{k}"


def _vertices(lanes, factor: float = 1.0) -> list[tuple]:
    return [(k, x.name, z, i, px, py) for k, x in enumerate(lanes) for z in ZONES for i, (px, py) in enumerate(getattr(x, z))]


def _scaled() -> str:
    points = ", ".join(f"('{n}', '{z}', {i}, {x}, {y})" for _, n, z, i, x, y in _vertices(fx.LANES))
    factors = ", ".join(f"(CAST({f} AS DOUBLE))" for f in SCALE_FACTORS)
    return f"""
SELECT factor, lane_name, zone, CAST(i AS INT) AS vertex_idx, CAST(trunc(x * factor) AS INT) AS x, CAST(trunc(y * factor) AS INT) AS y, CAST(greatest(20, trunc(80 * factor)) AS INT) AS min_height
FROM (VALUES {points}) AS p(lane_name, zone, i, x, y) CROSS JOIN (VALUES {factors}) AS f(factor)"""


_FACTORS = ", ".join(f"(CAST({f} AS DOUBLE))" for f in SCALE_FACTORS)


def oracle_sql() -> dict[str, str]:
    interval, before, after = fx.PROBE
    presets = ", ".join(f"('{n}', {a}, {b})" for n, a, b in [("match play", 12, 21), ("doubles", 5, 11), ("baker", 1, 11), ("league", 12, 21), ("practice", 60, 80)])
    points = ", ".join(f"({k}, '{n}', '{z}', {i}, {x}, {y})" for k, n, z, i, x, y in _vertices(fx.LANES))
    mask = _inside("(2 * x)", "(2 * y)", fx.GRID_LANES[0].pin_zone)
    steps = ", ".join(f"({k}, '{n}', '{z}')" for k, (n, z) in enumerate((x.name, z) for x in fx.LANES for z in ZONES))
    shot = "lane_name, CAST(start_frame AS BIGINT) AS start_frame, CAST(end_frame AS BIGINT) AS end_frame"
    run = f"FROM runs WHERE j - i >= {P.stationary}"
    return {
        "q_shot_segments": _chain(f"SELECT {shot}, round(confidence, 6) AS confidence, gutter_fallback FROM shots"),
        "q_video_shots": _chain(f"SELECT {_VIDEO}, start_frame, end_frame, round(confidence, 6) AS confidence, gutter_fallback FROM shots").replace(*_VIDEOS),
        "q_video_clips": _chain(f"SELECT video_id, CAST(row_number() OVER (PARTITION BY video_id ORDER BY file_name) AS INT) AS reel_pos, file_name, round(coalesce(sum(seconds) OVER (PARTITION BY video_id ORDER BY file_name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 4) AS offset_seconds FROM named WHERE (SELECT count(*) FROM named AS o WHERE o.video_id = named.video_id) >= 2", _VIDEO_CLIPS).replace(*_VIDEOS),
        "q_setup_runs": _with(SIGNALS, STEPS, RUNS, recursive=True) + f"SELECT lane_name, i AS run_start, j AS run_end, round(confidence, 6) AS confidence {run}",
        "q_forward_onset": _with(SIGNALS, STEPS, RUNS, recursive=True) + f"SELECT lane_name, i AS run_start, j AS run_end, onset {run} AND onset IS NOT NULL",
        "q_impact_or_gutter": _with(SIGNALS, STEPS, RUNS, recursive=True) + f"SELECT lane_name, i AS run_start, onset, impact, gutter AS gutter_fallback {run} AND onset IS NOT NULL AND impact < n",
        "q_settle_streak": _with(SIGNALS, STEPS, RUNS, recursive=True) + f"SELECT lane_name, i AS run_start, impact, settle, settled {run} AND onset IS NOT NULL AND impact < n",
        "q_shot_segments_sql": _with(SIGNALS, STEPS, RUNS, recursive=True) + f"SELECT lane_name, count(*) AS n_candidates, count(*) FILTER (gutter) AS n_gutter, count(*) FILTER (settled) AS n_settled {run} AND onset IS NOT NULL AND impact < n GROUP BY lane_name",
        "q_shot_summary": _chain(f"SELECT lane_name, count(*) AS n_shots, count(*) FILTER (gutter_fallback) AS n_gutter, round(CAST(sum(end_frame - start_frame) AS BIGINT) / CAST({fx.FPS} AS DOUBLE), 6) AS total_seconds FROM shots GROUP BY lane_name"),
        "q_clip_manifest": _chain("SELECT shot_no, lane_name, file_name, round(start_seconds, 6) AS start_seconds, round(duration_seconds, 6) AS duration_seconds FROM clips", _CLIPS),
        "q_reel_manifest": _chain("SELECT CAST(row_number() OVER (ORDER BY file_name) AS INT) AS reel_pos, file_name, round(coalesce(sum(duration_seconds) OVER (ORDER BY file_name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 4) AS offset_seconds, 'file ''' || file_name || '''' AS list_line FROM clips WHERE (SELECT count(*) FROM clips) >= 2", _CLIPS),
        "q_lane_restricted": _chain(f"SELECT {shot}, gutter_fallback FROM shots WHERE lane_name = 'lane_2'"),
        "q_person_filter": _with(BOXES) + "SELECT * FROM box",
        "q_foot_points": _with(BOXES) + "SELECT frame_index, det_idx, (x1 + x2) / CAST(2 AS DOUBLE) AS foot_x, CAST(y2 AS DOUBLE) AS foot_y, (x1 + x2) / CAST(2 AS DOUBLE) AS cx, (y1 + y2) / CAST(2 AS DOUBLE) AS cy FROM box",
        "q_foot_in_zone": _with(IN_ZONE) + "SELECT frame_index, det_idx, lane_name FROM zoned",
        "q_zone_occupancy": _with(OCCUPIED) + "SELECT frame_index, lane_name, confidence FROM occ",
        "q_best_candidate": _with(OCCUPIED) + "SELECT frame_index, lane_name, score AS confidence, (x1 + x2) / CAST(2 AS DOUBLE) AS cx, (y1 + y2) / CAST(2 AS DOUBLE) AS cy FROM best",
        "q_pose_motion": _with(OCCUPIED) + "SELECT frame_index, lane_name, round(coalesce(sqrt((cx - lag(cx) OVER w) * (cx - lag(cx) OVER w) + (cy - lag(cy) OVER w) * (cy - lag(cy) OVER w)), 0), 6) AS pose_motion FROM occ WINDOW w AS (PARTITION BY lane_name ORDER BY frame_index)",
        "q_upper_back_crop": _with(BOXES, f", crop AS (SELECT frame_index, det_idx, CAST(greatest(0, y1 + trunc((y2 - y1) * CAST(0.18 AS DOUBLE))) AS INT) AS crop_top, CAST(least({fx.HEIGHT}, y1 + trunc((y2 - y1) * CAST(0.55 AS DOUBLE))) AS INT) AS crop_bottom, greatest(0, x1) AS crop_left, least({fx.WIDTH}, x2) AS crop_right FROM box)") + "SELECT *, crop_bottom <= crop_top OR crop_right <= crop_left AS crop_empty FROM crop",
        "q_scaled_zones": _scaled(),
        "q_snap_factor": f"SELECT requested, max(factor) AS factor FROM (SELECT DISTINCT round(CAST(1 AS DOUBLE) - l_discount * 5, 2) AS requested FROM lineitem) CROSS JOIN (VALUES {_FACTORS}) AS f(factor) WHERE requested >= CAST(0.25 AS DOUBLE) AND factor <= requested GROUP BY requested",
        "q_cache_names": f"SELECT lower(n_name) AS stem, factor, lower(n_name) || '.detect_' || rtrim(rtrim(printf('%.2f', factor), '0'), '.') || 'x.mp4' AS cache_name FROM nation CROSS JOIN (VALUES {_FACTORS}) AS f(factor)",
        "q_zone_mask": f"SELECT 'grid' AS lane_name, count(*) AS mask_pixels, CAST(sum(x) AS BIGINT) AS sum_x, CAST(sum(y) AS BIGINT) AS sum_y FROM (SELECT i % 8 AS x, i // 8 AS y FROM range(64) AS r(i)) WHERE {mask}",
        "q_pin_motion": _with(PIXELS, f", d AS (SELECT frame_index, coalesce(abs(gray - lag(gray) OVER (PARTITION BY x, y ORDER BY frame_index)), 0) AS d FROM px WHERE {mask})") + "SELECT frame_index, 'grid' AS lane_name, CAST(sum(d) AS BIGINT) AS diff_sum, count(*) AS mask_pixels, CAST(sum(d) AS DOUBLE) / count(*) AS pin_motion FROM d GROUP BY frame_index",
        "q_hsv_bins": _with(_HSV) + "SELECT image_id, CAST(((h * 16 // 180) * 8 + s * 8 // 256) * 8 + v * 8 // 256 AS INT) AS bin, count(*) AS n FROM hsv GROUP BY ALL",
        "q_histogram_norm": _with(HIST) + "SELECT vec_id, bin, round(CASE WHEN max(n) OVER w > min(n) OVER w THEN CAST(n - min(n) OVER w AS DOUBLE) / (max(n) OVER w - min(n) OVER w) ELSE 0 END, 6) AS v FROM hist WINDOW w AS (PARTITION BY vec_id)",
        "q_bhattacharyya": _with(COLOUR) + "SELECT vec_id, round(score, 6) AS colour_score FROM col",
        "q_identity_score": _with(COLOUR) + "SELECT vec_id, round(greatest(score, CASE WHEN vec_id % 3 > 0 THEN CAST(vec_id * 37 % 100 AS DOUBLE) / 100 ELSE 0 END), 6) AS score FROM col",
        "q_ocr_substring": "SELECT conv_id, count(*) AS n_hits FROM conversations WHERE contains(lower(text), 'the') GROUP BY conv_id",
        "q_probe_hits": _with(SIGNALS) + f"SELECT DISTINCT frame_index AS probe_frame FROM s WHERE frame_index % {interval} = 0 AND conf >= CAST({P.confidence} AS DOUBLE)",
        "q_probe_windows": _with(SIGNALS, f", n AS (SELECT min(n) AS n FROM s), hits AS (SELECT DISTINCT frame_index AS probe_frame FROM s, n WHERE frame_index % {interval} = 0 AND conf >= CAST(0.97 AS DOUBLE) AND frame_index < n.n), win AS (SELECT probe_frame, greatest(0, probe_frame - {before}) AS window_start, least(n.n, probe_frame + {after}) AS window_end FROM hits, n)")
        + "SELECT lane_name, probe_frame, window_start, window_end, count(*) AS n_frames, max(conf) AS max_confidence FROM win JOIN s ON frame_index >= window_start AND frame_index < window_end GROUP BY ALL",
        "q_venue_lanes": f"SELECT CAST(k AS INT) AS lane_pos, lane_name, zone, CAST(i AS INT) AS vertex_idx, CAST(x AS INT) AS x, CAST(y AS INT) AS y FROM (VALUES {points}) AS p(k, lane_name, zone, i, x, y)",
        "q_target_samples": _with(RGB) + "SELECT image_id, pixel_idx, b, g, r FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY (pixel_idx * 48271 + image_id * 40692) % 2147483647, pixel_idx) AS k FROM rgb) WHERE k <= 40",
        "q_reference_persons": _with(IN_ZONE, ", f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY frame_index, lane_name ORDER BY det_idx) AS k FROM zoned) WHERE k = 1)") + "SELECT o_orderkey AS image_id, CASE WHEN o_orderkey % 2 = 0 THEN 'left' ELSE 'right' END AS lane_name, det_idx, x1, y1, x2, y2 FROM orders LEFT JOIN f ON f.frame_index = o_orderkey AND f.lane_name = CASE WHEN o_orderkey % 2 = 0 THEN 'left' ELSE 'right' END",
        "q_overlay_blend": _overlay(),
        "q_overlay_plan": f"SELECT vec_id AS frame_index, CAST(k AS INT) AS draw_order, lane_name, zone FROM embeddings CROSS JOIN (VALUES {steps}) AS v(k, lane_name, zone)",
        "q_label_anchor": f"SELECT lane_name, zone, CAST(trunc(avg(x)) AS INT) AS x, CAST(trunc(avg(y)) AS INT) AS y FROM (VALUES {points}) AS p(k, lane_name, zone, i, x, y) GROUP BY lane_name, zone HAVING count(*) >= 3",
        "q_run_metrics": _chain(f"SELECT (SELECT count(DISTINCT lane_name) FROM s) AS n_lanes, (SELECT count(*) FROM s) AS n_signals, (SELECT count(DISTINCT frame_index) FROM s WHERE frame_index % {interval} = 0 AND conf >= CAST({P.confidence} AS DOUBLE)) AS n_probe_hits, count(*) AS n_shots, count(*) FILTER (gutter_fallback) AS n_gutter, CAST(sum(end_frame - start_frame + 1) AS BIGINT) AS frames_in_shots FROM shots"),
        "q_signal_arrays": _with(SIGNALS) + f"SELECT lane_name, CAST(count(*) AS INT) AS n, array_to_string(list_slice(list(CAST(round(conf * 100) AS INT) ORDER BY frame_index), -5, -1), ',') AS tail, CAST(count(*) FILTER (pin > {P.pin}) AS INT) AS n_hits FROM s GROUP BY lane_name",
        "q_signal_digests": _with(SIGNALS) + "SELECT lane_name, CAST(count(*) AS INT) AS n, " + ", ".join(f"sha256(string_agg(CAST(CAST(floor({c} * CAST({u} AS DOUBLE) + CAST(0.5 AS DOUBLE)) AS BIGINT) AS VARCHAR), ',' ORDER BY frame_index)) AS {n}" for c, u, n in (("conf", 100, "confidence_sha256"), ("pin", 1000, "pin_sha256"))) + " FROM s GROUP BY lane_name",
        "q_otsu": _with(PIXELS, ", c AS (SELECT frame_index, gray, count(*) AS n FROM px GROUP BY ALL), r AS (SELECT *, CAST(sum(n) OVER w AS BIGINT) AS ln, CAST(sum(n * gray) OVER w AS BIGINT) AS ls, CAST(sum(n) OVER p AS BIGINT) AS an, CAST(sum(n * gray) OVER p AS BIGINT) AS s FROM c WINDOW w AS (PARTITION BY frame_index ORDER BY gray ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), p AS (PARTITION BY frame_index)), v AS (SELECT frame_index, gray, CASE WHEN ln * (an - ln) > 0 THEN CAST(ls * an - ln * s AS DOUBLE) * CAST(ls * an - ln * s AS DOUBLE) / (ln * (an - ln)) ELSE 0 END AS score FROM r)")
        + "SELECT frame_index, CASE WHEN score > 0 THEN gray ELSE 0 END AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY frame_index ORDER BY score DESC, gray) AS k FROM v) WHERE k = 1",
        "q_format_sanity": _chain(f"SELECT lane_name, n_shots, count(format) AS n_formats, coalesce(string_agg(format, ',' ORDER BY format), '') AS formats FROM (SELECT lane_name, count(*) AS n_shots FROM shots GROUP BY lane_name) LEFT JOIN (VALUES {presets}) AS p(format, a, b) ON n_shots BETWEEN a AND b GROUP BY lane_name, n_shots"),
    }
