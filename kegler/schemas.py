"""Schemas of the tables."""

POINT = "struct<x:int,y:int>"
POLYGON = f"array<{POINT}>"
LANE = f"struct<name:string,approach_zone:{POLYGON},lane_zone:{POLYGON},pin_zone:{POLYGON}>"
#: As venue files have them: polygons are arrays of two-element arrays.
VENUE_JSON = "lanes array<struct<name:string,approach_zone:array<array<int>>,lane_zone:array<array<int>>,pin_zone:array<array<int>>>>, frame_width int, frame_height int"
TARGET_JSON = "name string, shirt_color_samples array<array<int>>"
FRAMES = "video_id string, frame_index long, width int, height int, pixels binary"
DETECTIONS = "video_id string, frame_index long, det_idx int, cls int, x1 double, y1 double, x2 double, y2 double, score double"
SIGNALS = "video_id string, lane_name string, frame_index long, bowler_confidence double, pose_motion double, pin_motion double, ball_reached_pins boolean"
SHOTS = "video_id string, lane_name string, start_frame long, end_frame long, bowler_confidence double, gutter_fallback boolean"
