"""Filters over annotation and detection tables; all push down to the scan where the source allows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.rings import polygon_area, vertex_cosines


def drop_orphans(annotations: DataFrame, images: DataFrame) -> DataFrame:
    """Annotations whose image exists."""
    return annotations.join(images.select("image_id"), "image_id", "left_semi")


def min_polygon(df: DataFrame, ring: str = "ring", least: float = 2.0) -> DataFrame:
    return df.where((F.size(ring) >= 3) & (polygon_area(F.col(ring)) >= least))


def not_crowd(df: DataFrame) -> DataFrame:
    return df.where(F.coalesce(F.col("iscrowd"), F.lit(0)) == 0)


def score_filter(df: DataFrame, threshold: float, score: str = "score") -> DataFrame:
    return df.where(F.col(score) > threshold)


def relative_area_gate(df: DataFrame, w: Column, h: Column, low: float = 0.004, high: float = 0.20) -> DataFrame:
    """Sides relative to the image, floored at 0; both ends count."""
    return df.where((F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))).between(low, high))


def valid_segmentation(df: DataFrame, segmentation: str = "segmentation") -> DataFrame:
    return df.where(F.coalesce(F.size(F.get(F.col(segmentation), F.lit(0))), F.lit(0)) >= 6)


def min_object_area(df: DataFrame, w: Column, h: Column, least: float = 16.0) -> DataFrame:
    return df.where(w * h >= least)


def min_crop_mean(df: DataFrame, brightness: str, least: float = 5.0) -> DataFrame:
    return df.where(F.col(brightness) >= least)


def not_constant(df: DataFrame, low: str, high: str) -> DataFrame:
    return df.where(F.col(low) != F.col(high))


def subset_by_ids(images: DataFrame, annotations: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    keep = ids.select("image_id").distinct()
    return images.join(keep, "image_id", "left_semi"), annotations.join(keep, "image_id", "left_semi")


def vertex_audit(df: DataFrame, ring: str, prob: str) -> DataFrame:
    """(n_rescue, rescue_loss, n_suppress, suppress_loss) over all vertices: sharp ones (cosine under 0.25) of low
    probability (under 0.4) should be 1, straight ones (over 0.95) of high probability (over 0.5) should be 0; the
    losses are ten times the mean squared deviation, 0 without such vertices."""
    v = df.select(F.explode(F.arrays_zip(vertex_cosines(F.col(ring)).alias("c"), F.col(prob).alias("p"))).alias("v")).select(F.col("v.c").alias("c"), F.col("v.p").alias("p"))
    rescue, suppress = (F.col("c") < 0.25) & (F.col("p") < 0.4), (F.col("c") > 0.95) & (F.col("p") > 0.5)
    loss = lambda when, d: F.coalesce(F.avg(F.when(when, d * d)), F.lit(0.0)) * 10
    return v.agg(F.count_if(rescue).alias("n_rescue"), loss(rescue, 1 - F.col("p")).alias("rescue_loss"), F.count_if(suppress).alias("n_suppress"), loss(suppress, F.col("p")).alias("suppress_loss"))
