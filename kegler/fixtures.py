"""Tables of the engine's kind, derived from the generic test tables. They exercise operators exactly; they aren't footage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kegler.config import FrameParams
from kegler.functions.geometry import Lane

PARAMS = FrameParams(confidence=0.30, stationary=3, pose=60.0, settle_run=6, pin=165.0, lookback=2, pad=1, release=40, impact=32, settle=20, gutter=16)
PROBE = (20, 30, 50)
FPS = 30.0
WIDTH, HEIGHT = 720, 1280
LANES = [
    Lane("left", ((60, 1240), (100, 760), (340, 760), (350, 1240)), ((100, 760), (200, 300), (330, 300), (340, 760)), ((215, 260), (290, 260), (290, 295), (215, 295))),
    Lane("right", ((370, 1240), (380, 760), (620, 760), (660, 1240)), ((380, 760), (390, 300), (520, 300), (620, 760)), ((425, 260), (500, 260), (500, 295), (425, 295))),
]
#: A pin zone on the 8 x 8 grid of the pixel fixture: x 2 to 5, y 1 to 4.
GRID_LANES = [Lane("grid", ((0, 5), (7, 5), (7, 7), (0, 7)), ((1, 2), (6, 2), (6, 5), (1, 5)), ((2, 1), (5, 1), (5, 4), (2, 4)))]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def signals(spark: SparkSession, sf_dir: str, videos: int = 1) -> DataFrame:
    """Four lanes of each of some videos from ``events``; one video is called v, more v0, v1 and so on."""
    lane = (F.col("user_id") % (4 * videos)).cast("int")
    rows = table(spark, sf_dir, "events").select(lane.alias("place"), "ts", "event_id", "value", F.regexp_extract("props", r"(\d+)", 1).cast("int").alias("k"))
    w = W.partitionBy("place").orderBy("ts", "event_id")
    pos = (F.col("place") % 4).cast("int")
    video = F.lit("v") if videos == 1 else F.concat(F.lit("v"), F.floor(F.col("place") / 4).cast("string"))
    moved = lambda n: F.coalesce(F.abs(F.col("value") - F.lag("value", n).over(w)), F.lit(0.0))
    return rows.select(
        video.alias("video_id"), F.concat(F.lit("lane_"), pos).alias("lane_name"), pos.alias("lane_pos"), (F.row_number().over(w) - 1).cast("long").alias("frame_index"),
        (F.col("k") / 100.0).alias("bowler_confidence"), moved(1).alias("pose_motion"), moved(2).alias("pin_motion"), F.lit(False).alias("ball_reached_pins"),
    )


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes from ``lineitem``: an order is a frame."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int").alias("q"))
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "q")
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    rows = li.withColumn("det_idx", F.row_number().over(w) - 1).withColumns({"x1": ((p * 7 + s * 13) % 620).cast("int"), "y1": ((p * 11 + s * 5) % 1000).cast("int"), "score": ((p * 17 + s * 29) % 100) / 100.0})
    return rows.select(F.lit("v").alias("video_id"), F.col("l_orderkey").alias("frame_index"), "det_idx", "x1", "y1", (F.col("x1") + 40 + F.col("q")).alias("x2"), (F.col("y1") + 40 + 4 * F.col("q")).alias("y2"), "score")


def frame_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8 x 8 grey frames from ``embeddings``."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame_index"), F.posexplode("embedding").alias("i", "e"))
    return rows.select("frame_index", (F.col("i") % 8).alias("x"), F.floor(F.col("i") / 8).cast("int").alias("y"), ((F.col("e").cast("double") + 1.0) * 127.5).cast("int").alias("gray"))


def hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64-bin histograms from ``embeddings``: grey less the frame's least."""
    px = frame_pixels(spark, sf_dir)
    low = px.groupBy("frame_index").agg(F.min("gray").alias("low"))
    return px.join(low, "frame_index").select(F.col("frame_index").alias("vec_id"), (F.col("y") * 8 + F.col("x")).alias("bin"), (F.col("gray") - F.col("low")).cast("long").alias("n"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coloured pixels of eight images from ``part``."""
    k = F.col("p_partkey")
    c = lambda f: ((k * f) % 256).cast("int")
    return table(spark, sf_dir, "part").select((k % 8).alias("image_id"), k.alias("pixel_idx"), c(37).alias("b"), c(91).alias("g"), c(53).alias("r"))
