"""Queries over segments, pixels, samples, shards and names."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessella.functions import strings as S
from tessella.operators import aggregates as A
from tessella.operators import etl, sampling
from tessella.plans.registry import query, r6
from tessella.sources.shared import shared_dir

c = F.col


@query("e10_panoptic_quality", """WITH p AS (SELECT image_id, pred_seg, pred_cat AS cat, sum(pixels) AS pa FROM fx_segments GROUP BY ALL), g AS (SELECT image_id, gt_seg, gt_cat AS cat, sum(pixels) AS ga FROM fx_segments GROUP BY ALL),
  t AS (SELECT s.pred_cat AS cat, s.pixels/(pa + ga - s.pixels) AS iou FROM fx_segments s JOIN p ON s.image_id = p.image_id AND s.pred_seg = p.pred_seg AND s.pred_cat = p.cat JOIN g ON s.image_id = g.image_id AND s.gt_seg = g.gt_seg AND s.gt_cat = g.cat WHERE s.pred_cat = s.gt_cat),
  k AS (SELECT cat, count(*) AS tp, sum(iou) AS iou FROM t WHERE iou > 0.5 GROUP BY cat), n AS (SELECT coalesce(a.cat, b.cat) AS cat, coalesce(np, 0) AS np, coalesce(ng, 0) AS ng FROM (SELECT cat, count(*) AS np FROM p GROUP BY cat) a FULL JOIN (SELECT cat, count(*) AS ng FROM g GROUP BY cat) b ON a.cat = b.cat),
  q AS (SELECT n.cat, coalesce(iou, 0)/((np+ng)/2) AS pq, coalesce(iou/tp, 0) AS sq, coalesce(tp, 0)/((np+ng)/2) AS rq FROM n LEFT JOIN k ON n.cat = k.cat)
  SELECT grp, round(avg(pq), 6) AS pq, round(avg(sq), 6) AS sq, round(avg(rq), 6) AS rq, count(*) AS n FROM (SELECT *, 'All' AS grp FROM q UNION ALL SELECT *, CASE WHEN cat < 2 THEN 'Things' ELSE 'Stuff' END FROM q) u GROUP BY grp""")
def _(fx):
    things = fx.segments.select(c("pred_cat").alias("cat")).distinct().withColumn("isthing", c("cat") < 2)
    return A.panoptic_quality(fx.segments, things).select("grp", *[r6(c(k)).alias(k) for k in ("pq", "sq", "rq")], "n")


@query("e11_segment_areas")
def _(fx):
    pixels = fx.label_pixels.select("image_id", (c("px") % 16).alias("px"), (c("py") % 16).alias("py"), c("label").cast("long").alias("segment_id"), F.pmod(F.xxhash64("px", "py", "label"), F.lit(1000)).cast("double").alias("logit"))
    return A.segment_areas(pixels)


@query("e12_mask_to_box", "SELECT image_id, label, min(px) AS x1, min(py) AS y1, max(px) AS x2, max(py) AS y2 FROM fx_label_pixels GROUP BY ALL")
def _(fx):
    return A.mask_to_box(fx.label_pixels, ["image_id", "label"])


@query("e13_instances_from_labels", "SELECT row_number() OVER (ORDER BY image_id, label) AS id, * FROM (SELECT image_id, label, min(px) AS x, min(py) AS y, max(px)-min(px)+1 AS w, max(py)-min(py)+1 AS h, count(*) AS area FROM fx_label_pixels WHERE label NOT IN (1, -1) GROUP BY ALL HAVING count(*) >= 10) t")
def _(fx):
    d = A.instances_from_labels(fx.label_pixels)
    return etl.dense_ids(d, [c("image_id").asc(), c("label").asc()])


@query("e20_dice_loss", "SELECT image_id, round(1 - (2*sum(p*t)+1)/(sum(p)+sum(t)+1), 6) AS dice_loss FROM (SELECT image_id, px/64.0 AS p, py % 2 AS t FROM fx_label_pixels) x GROUP BY image_id")
def _(fx):
    d = fx.label_pixels.select("image_id", (c("px") / 64).alias("p"), (c("py") % 2).cast("double").alias("t"))
    return A.dice_loss(d, "image_id", "p", "t").select("image_id", r6(c("dice_loss")).alias("dice_loss"))


@query("e23_reconstruction_error", "WITH t AS (SELECT list_sum(list_transform(embedding, lambda x: pow(CAST(x AS DOUBLE) - CAST(x AS DOUBLE)*0.5, 2)))/len(embedding) AS e, CAST(vec_id % 2 AS DOUBLE) AS m FROM embeddings) SELECT round(sum(m*e)/(sum(m)+1e-6), 6) AS reconstruction_error FROM t")
def _(fx):
    v = F.transform("embedding", lambda x: x.cast("double"))
    d = fx.embeddings.select(v.alias("a"), F.transform(v, lambda x: x * 0.5).alias("b"), (c("vec_id") % 2).cast("double").alias("mask"))
    return A.reconstruction_error(d, "a", "b", "mask").select(r6(c("reconstruction_error")).alias("reconstruction_error"))


@query("f9_dense_ids", "SELECT det_id, row_number() OVER (ORDER BY score DESC, det_id) AS id FROM fx_detections")
def _(fx):
    return etl.dense_ids(fx.detections, [c("score").desc(), c("det_id").asc()]).select("det_id", "id")


@query("h1_order_by", "SELECT det_id, round(score, 6) AS score FROM fx_detections ORDER BY score DESC, det_id LIMIT 100")
def _(fx):
    return fx.detections.orderBy(c("score").desc(), "det_id").limit(100).select("det_id", r6(c("score")).alias("score"))


@query("h2_h3_hash_sample", "SELECT image_id FROM fx_images ORDER BY md5('42:' || image_id), image_id LIMIT 500")
def _(fx):
    return sampling.hash_sample(fx.images, "image_id", 500).select("image_id")


@query("h2_stored_sample", "SELECT image_id, file_name FROM fx_images WHERE image_id IN (SELECT image_id FROM fx_images WHERE image_id % 3 > 0 ORDER BY md5('42:' || image_id), image_id LIMIT 500)")
def _(fx):
    """Drawn from two thirds of the images, used again when all are there."""
    path = f"{shared_dir(fx.spark)}/{uuid.uuid4().hex}"
    sampling.stored_sample(fx.images.where("image_id % 3 > 0"), "image_id", 500, path)
    return sampling.stored_sample(fx.images, "image_id", 500, path).select("image_id", "file_name")


@query("h4_epoch_shards", """WITH r AS (SELECT image_id, row_number() OVER (ORDER BY md5('3:' || image_id), image_id) - 1 AS pos, count(*) OVER () AS n FROM fx_images),
  p AS (SELECT image_id, pos, n FROM r UNION ALL SELECT image_id, pos + n, n FROM r WHERE pos < CAST(ceil(n/7.0) AS BIGINT)*7 - n)
  SELECT image_id, pos, CAST(floor(pos / CAST(ceil(n/7.0) AS BIGINT)) AS INT) AS shard FROM p""")
def _(fx):
    return sampling.epoch_shards(fx.images, "image_id", 3, 7)


@query("h5_strided_shards", """WITH r AS (SELECT image_id, row_number() OVER (ORDER BY image_id) - 1 AS pos, count(*) OVER () AS n FROM fx_images), p AS (SELECT image_id, pos FROM r UNION ALL SELECT image_id, pos + n FROM r WHERE pos < CAST(ceil(n/7.0) AS BIGINT)*7 - n)
  SELECT image_id, pos, CAST(pos % 7 AS INT) AS shard FROM p""")
def _(fx):
    return sampling.strided_shards(fx.images, "image_id", 7)


@query("h6_union_all", "SELECT det_id AS id, image_id FROM fx_detections UNION ALL SELECT ann_id, image_id FROM fx_objects")
def _(fx):
    return sampling.union_all([fx.detections.select(c("det_id").alias("id"), "image_id"), fx.objects.select(c("ann_id").alias("id"), "image_id")])


@query("h7_key_differences", "SELECT ann_id, 'missing' AS side FROM fx_objects WHERE ann_id NOT IN (SELECT det_id FROM fx_detections WHERE score > 0.5) UNION ALL SELECT det_id, 'unexpected' FROM fx_detections WHERE score > 0.5 AND det_id NOT IN (SELECT ann_id FROM fx_objects)")
def _(fx):
    return sampling.key_differences(fx.detections.where("score > 0.5").select(c("det_id").alias("ann_id")), fx.objects, "ann_id")


@query("h8_string_functions", """SELECT image_id, file_name AS base, replace(file_name, '.jpg', '') AS stem, lpad(CAST(image_id AS VARCHAR), 12, '0') || '.jpg' AS padded, 'raw' AS header, replace(printf('%.2f', image_id/100.0), '.', 'p') AS tag FROM fx_images""")
def _(fx):
    path = F.concat(F.lit("a\\b/"), c("file_name"))
    return fx.images.select("image_id", S.basename(path).alias("base"), S.stem(path).alias("stem"), S.padded_name(c("image_id")).alias("padded"), S.header_name(F.lit("raw（label）")).alias("header"), S.number_tag(c("image_id") / 100).alias("tag"))
