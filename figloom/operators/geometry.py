"""Boxes of detected pictures: ordinals, clamping, geometric filters, names of crops."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def number_pictures(detections: DataFrame, order: tuple[str, ...] = ("det_idx",)) -> DataFrame:
    """Pictures only, numbered from 1 in an image before any box is dropped, so names may have gaps."""
    w = Window.partitionBy("image_id").orderBy(*order)
    return detections.where("cls = 'Picture'").withColumn("ordinal", F.row_number().over(w))


def clamp(boxes: DataFrame) -> DataFrame:
    """Whole coordinates, cut towards zero, inside the image; empty and inverted boxes are dropped."""

    def side(c: str, most: str):  # noqa: ANN202
        return F.greatest(F.lit(0), F.least(F.col(most), F.col(c).cast("int")))

    cut = boxes.withColumns({"x1": side("x1", "img_w"), "x2": side("x2", "img_w"), "y1": side("y1", "img_h"), "y2": side("y2", "img_h")})
    return cut.where("x2 > x1 and y2 > y1")


def keep_boxes(boxes: DataFrame, least_side: int = 128, ratio: tuple[float, float] = (0.75, 0.9), aspect: tuple[float, float] = (0.33, 3.0)) -> DataFrame:
    """Boxes large enough, of a bearable shape, whose share of the image is not strictly between the two ratios."""
    w, h = (F.col("x2") - F.col("x1")).cast("int"), (F.col("y2") - F.col("y1")).cast("int")
    share = w.cast("double") * h / (F.col("img_w").cast("double") * F.col("img_h"))
    shape = w.cast("double") / h
    return boxes.withColumns({"width": w, "height": h}).where(
        ~((share > ratio[0]) & (share < ratio[1])) & (shape >= aspect[0]) & (shape <= aspect[1]) & (w >= least_side) & (h >= least_side)
    )


def name_crops(boxes: DataFrame) -> DataFrame:
    return boxes.withColumn("filename", F.format_string("%s_%02d.png", "image_id", "ordinal"))


def crops(detections: DataFrame, order: tuple[str, ...] = ("det_idx",)) -> DataFrame:
    """All steps, from detections to named crops."""
    return name_crops(keep_boxes(clamp(number_pictures(detections, order))))
