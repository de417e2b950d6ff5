"""Targets from reference images."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kegler.config import PersonParams
from kegler.functions.geometry import Lane, foot_in_zone
from kegler.operators.detections import person_boxes, upper_back


def reference_persons(references: DataFrame, in_zone: DataFrame) -> DataFrame:
    """The first detection in the named lane's zone of each reference image.

    references: image_id, lane_name; in_zone: image_id, lane_name, det_idx and the box. An image
    without one keeps a row with null det_idx: ``require_persons`` turns that into an error.
    """
    w = W.partitionBy("image_id", "lane_name").orderBy("det_idx")
    first = in_zone.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")
    return references.join(first, ["image_id", "lane_name"], "left")


def require_persons(persons: DataFrame) -> DataFrame:
    said = F.concat(F.lit("no person in the approach zone of lane "), F.col("lane_name"), F.lit(" in image "), F.col("image_id").cast("string"))
    return persons.where(F.when(F.col("det_idx").isNull(), F.raise_error(said).cast("boolean")).otherwise(F.lit(True)))


def sample_pixels(pixels: DataFrame, per_image: int = 200, seed: int = 0) -> DataFrame:
    """At most ``per_image`` pixels of each image, without replacement: those with the least hash.

    pixels: image_id, pixel_idx, b, g, r. The hash is arithmetic on whole numbers, so that any engine
    can repeat the sample; row_number() <= k becomes a partial top-k before the shuffle.
    """
    order = (F.col("pixel_idx").cast("long") * 48271 + F.col("image_id").cast("long") * 40692 + F.lit(seed).cast("long") * 69621) % F.lit(2147483647)
    w = W.partitionBy("image_id").orderBy("_h", "pixel_idx")
    return pixels.withColumn("_h", order).withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= per_image).drop("_h", "_k")


def build_target(name: str, references: DataFrame, detections: DataFrame, pixels: DataFrame, lanes: list[Lane], width: int, height: int, params: PersonParams | None = None, per_image: int = 200, seed: int = 0) -> DataFrame:
    """The target's samples from all reference images: target_name, sample_idx, b, g, r.

    references: image_id (whole numbers), lane_name; detections and pixels (x, y, b, g, r) by image_id, at the
    images' own resolution. The first person in the approach zone of the image's lane is cropped; an image without
    one is an error, one with an empty crop gives nothing. Samples are numbered by image and pixel.
    """
    boxes = person_boxes(detections, params or PersonParams())
    first = require_persons(reference_persons(references, foot_in_zone(boxes, lanes)))
    crops = upper_back(first, width, height).where("not crop_empty").select("image_id", "lane_name", "crop_top", "crop_bottom", "crop_left", "crop_right")
    inside = (F.col("x") >= F.col("crop_left")) & (F.col("x") < F.col("crop_right")) & (F.col("y") >= F.col("crop_top")) & (F.col("y") < F.col("crop_bottom"))
    own = pixels.join(crops, "image_id").where(inside).withColumn("pixel_idx", F.col("y") * width + F.col("x"))
    sampled = sample_pixels(own.select("image_id", "pixel_idx", "b", "g", "r"), per_image, seed)
    number = F.row_number().over(W.orderBy("image_id", "pixel_idx")) - 1  # a target has some thousand samples
    return sampled.select(F.lit(name).alias("target_name"), number.alias("sample_idx"), "b", "g", "r")
