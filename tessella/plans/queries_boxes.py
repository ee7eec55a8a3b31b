"""Queries over boxes and detections."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import boxes as B
from tessella.operators import aggregates as A
from tessella.operators import evaluation, filters, joins, suppression, windows
from tessella.plans.registry import b, greedy_sql, query, r6
from tessella.sources import coco
from tessella.sources.shared import discard, materialize, shared_dir

c = F.col
IOU = """greatest(least(a.x+a.w, b.x+b.w) - greatest(a.x, b.x), 0) * greatest(least(a.y+a.h, b.y+b.h) - greatest(a.y, b.y), 0)"""
PAIR_IOU = f"(({IOU}) / (a.w*a.h + b.w*b.h - ({IOU})))"


ROUND_TRIP = """SELECT i.image_id, width, height, CAST(count(o.ann_id) AS BIGINT) AS n_objects, round(coalesce(sum(w*h), 0), 6) AS area
  FROM fx_images i LEFT JOIN fx_objects o ON i.image_id = o.image_id GROUP BY ALL"""


def round_trip(fx, read, **how):
    import uuid

    path = f"{shared_dir(fx.spark)}/{uuid.uuid4().hex}"
    images = fx.images.withColumnRenamed("image_id", "id")
    stored = materialize(fx.objects)  # counted, asked for its categories and written
    x2, y2 = c("x") + c("w"), c("y") + c("h")
    anns = stored.select(c("ann_id").alias("id"), "image_id", "category_id", F.array(F.array("x", "y", x2, "y", x2, y2, "x", y2)).alias("segmentation"), F.array("x", "y", "w", "h").alias("bbox"), (c("w") * c("h")).alias("area"), "iscrowd")
    cats = stored.select(c("category_id").alias("id")).distinct().select("id", F.lit("building").alias("name"), F.lit("none").alias("supercategory"))
    coco.write_coco(images, anns, cats, path, compression="gzip", **how)
    discard(stored)
    got, objects, _ = read(fx.spark, path)
    n = objects.groupBy("image_id").agg(F.count("*").alias("n_objects"), F.sum("area").alias("area"))
    return got.join(n, got.id == n.image_id, "left").select(got.id.alias("image_id"), "width", "height", F.coalesce("n_objects", F.lit(0)).alias("n_objects"), r6(F.coalesce("area", F.lit(0.0))).alias("area"))


@query("a1_a2_coco_round_trip", ROUND_TRIP)
def _(fx):
    """Documents of about 20,000 objects, compressed, each read as one row."""
    return round_trip(fx, coco.read_coco, rows=20_000)


@query("a1_large_document", ROUND_TRIP)
def _(fx):
    """One document of all objects in compressed part files, each of which a task reads; what a piece is in comes from all before it."""
    return round_trip(fx, coco.read_large_coco, shards=1)


@query("a7_to_coco_results", "SELECT image_id, category_id, x, y, w, h, round(score, 6) AS score FROM (SELECT image_id, category_id, score, x, y, round(x+w-x, 6) AS w, round(y+h-y, 6) AS h FROM fx_detections) t")
def _(fx):
    r = coco.to_coco_results(b(fx.detections))
    return r.select("image_id", "category_id", *[r6(F.get("bbox", F.lit(i))).alias(k) for i, k in enumerate("xywh")], r6(c("score")).alias("score"))


@query("a9_batch_padding_plan", """SELECT image_id, max(width) OVER (PARTITION BY image_id % 64) AS pad_width, max(height) OVER (PARTITION BY image_id % 64) AS pad_height,
  round(1 - CAST(width*height AS DOUBLE) / (max(width) OVER (PARTITION BY image_id % 64) * max(height) OVER (PARTITION BY image_id % 64)), 6) AS padded_share FROM fx_images""")
def _(fx):
    from tessella.operators.etl import batch_padding_plan

    return batch_padding_plan(fx.images.withColumn("batch", c("image_id") % 64), "batch").select("image_id", "pad_width", "pad_height", r6(c("padded_share")).alias("padded_share"))


@query("b1_box_conversions", "SELECT ann_id, x+w/2 AS cx, y+h/2 AS cy, w, h, x AS x1, y AS y1, x+w AS x2, y+h AS y2 FROM fx_objects")
def _(fx):
    d = b(fx.objects).withColumn("m", B.box_xyxy_to_cxcywh(c("box"))).withColumn("back", B.box_cxcywh_to_xyxy(c("m.cx"), c("m.cy"), c("m.w"), c("m.h")))
    return d.select("ann_id", "m.cx", "m.cy", B.box_xyxy_to_xywh(c("back"))["w"].alias("w"), B.box_xyxy_to_xywh(c("back"))["h"].alias("h"), "back.x1", "back.y1", "back.x2", "back.y2")


@query("b2_box_iou", f"SELECT a.ann_id, round({PAIR_IOU}, 6) AS iou, round(a.w*a.h + b.w*b.h - ({IOU}), 6) AS union_area FROM fx_objects a JOIN fx_detections b ON a.ann_id = b.det_id")
def _(fx):
    d = b(fx.objects, "a").join(b(fx.detections, "b").select(c("det_id").alias("ann_id"), "b"), "ann_id")
    return d.select("ann_id", r6(B.box_iou(c("a"), c("b"), 1e-6)).alias("iou"), r6(B.union(c("a"), c("b"))).alias("union_area"))


HULL = "((greatest(a.x+a.w, b.x+b.w) - least(a.x, b.x)) * (greatest(a.y+a.h, b.y+b.h) - least(a.y, b.y)))"


@query("b3_generalized_box_iou", f"SELECT a.ann_id, round({PAIR_IOU} - ({HULL} - (a.w*a.h + b.w*b.h - ({IOU}))) / {HULL}, 6) AS giou FROM fx_objects a JOIN fx_detections b ON a.ann_id = b.det_id")
def _(fx):
    d = b(fx.objects, "a").join(b(fx.detections, "b").select(c("det_id").alias("ann_id"), "b"), "ann_id")
    return d.select("ann_id", r6(B.generalized_box_iou(c("a"), c("b"))).alias("giou"))


CLIP = "least(greatest({v}, 0), {m} - 1e-4)"


@query("b4_clip_and_fix_box", """SELECT ann_id, round(x1, 6) AS x, round(y1, 6) AS y, round(greatest(x2-x1, 1e-3), 6) AS w, round(greatest(y2-y1, 1e-3), 6) AS h FROM (
  SELECT ann_id, greatest(least(x, width-1e-4), 0) AS x1, greatest(least(y, height-1e-4), 0) AS y1, greatest(least(x+w, width-1e-4), 0) AS x2,
    greatest(least(y+h, height-1e-4), 0) AS y2 FROM fx_objects JOIN (SELECT image_id, CAST(width AS DOUBLE)/2 AS width, CAST(height AS DOUBLE)/2 AS height FROM fx_images) i USING (image_id)) t""")
def _(fx):
    d = b(fx.objects).join(fx.images.select("image_id", (c("width") / 2).alias("width"), (c("height") / 2).alias("height")), "image_id").withColumn("f", B.clip_and_fix_box(c("box"), c("width"), c("height")))
    return d.select("ann_id", *[r6(c(f"f.{k}")).alias(k) for k in "xywh"])


@query("b5_load_box", """SELECT ann_id, x1, y1, x2, y2 FROM (SELECT ann_id, least(x, width) AS x1, least(y, height) AS y1, least(x+w, width) AS x2, least(y+h, height) AS y2
  FROM fx_objects JOIN (SELECT image_id, CAST(width AS DOUBLE)/2 AS width, CAST(height AS DOUBLE)/2 AS height FROM fx_images) i USING (image_id)) t WHERE x2 > x1 AND y2 > y1""")
def _(fx):
    d = b(fx.objects).join(fx.images.select("image_id", (c("width") / 2).alias("width"), (c("height") / 2).alias("height")), "image_id").withColumn("f", B.clamp_to_image(c("box"), c("width"), c("height")))
    return d.where(B.is_proper(c("f"))).select("ann_id", "f.x1", "f.y1", "f.x2", "f.y2")


@query("b20_hflip_target", "SELECT ann_id, width - (x+w) AS x1, y AS y1, width - x AS x2, y+h AS y2 FROM fx_objects JOIN fx_images USING (image_id)")
def _(fx):
    d = b(fx.objects).join(fx.images, "image_id").withColumn("f", B.hflip_box(c("box"), c("width")))
    return d.select("ann_id", "f.x1", "f.y1", "f.x2", "f.y2")


@query("b21_resize_target", """SELECT ann_id, nw, nh, round(x*nw/width, 6) AS x1, round(y*nh/height, 6) AS y1, round(w*h*(CAST(nw AS DOUBLE)/width)*(CAST(nh AS DOUBLE)/height), 6) AS area FROM fx_objects JOIN (
  SELECT *, CAST(CASE WHEN s = g THEN width WHEN width < height THEN g ELSE floor(g*l/s) END AS INT) AS nw, CAST(CASE WHEN s = g THEN height WHEN width < height THEN floor(g*l/s) ELSE g END AS INT) AS nh FROM (
    SELECT *, CASE WHEN l/s*400 > 480 THEN round_even(480*s/l, 0) ELSE 400.0 END AS g FROM (
      SELECT *, CAST(least(width, height) AS DOUBLE) AS s, CAST(greatest(width, height) AS DOUBLE) AS l FROM fx_images) a) b2) i USING (image_id)""")
def _(fx):
    nw, nh = B.resize_dims(c("width").cast("double"), c("height").cast("double"), 400, 480)
    d = b(fx.objects).join(fx.images.withColumn("nw", nw).withColumn("nh", nh), "image_id")
    s = d.withColumn("sx", c("nw") / c("width")).withColumn("sy", c("nh") / c("height")).withColumn("f", B.scale_box(c("box"), c("sx"), c("sy")))
    return s.select("ann_id", "nw", "nh", r6(c("f.x1")).alias("x1"), r6(c("f.y1")).alias("y1"), r6(c("w") * c("h") * c("sx") * c("sy")).alias("area"))


@query("b22_crop_target", """SELECT ann_id, x1, y1, x2, y2, (x2-x1)*(y2-y1) AS area FROM (SELECT ann_id, greatest(least(x-40, 160), 0) AS x1, greatest(least(y-30, 120), 0) AS y1,
  greatest(least(x+w-40, 160), 0) AS x2, greatest(least(y+h-30, 120), 0) AS y2 FROM fx_objects) t WHERE x2 > x1 AND y2 > y1""")
def _(fx):
    d = b(fx.objects).withColumn("f", B.clamp_to_image(B.shift_box(c("box"), F.lit(40.0), F.lit(30.0)), F.lit(160.0), F.lit(120.0))).where(B.is_proper(c("f")))
    return d.select("ann_id", "f.x1", "f.y1", "f.x2", "f.y2", B.area(c("f")).alias("area"))


@query("b23_center_crop_region", "SELECT image_id, CAST(round_even((height-200)/2.0, 0) AS INT) AS crop_top, CAST(round_even((width-240)/2.0, 0) AS INT) AS crop_left FROM fx_images")
def _(fx):
    return fx.images.select("image_id", F.rint((c("height") - 200) / 2).cast("int").alias("crop_top"), F.rint((c("width") - 240) / 2).cast("int").alias("crop_left"))


@query("b23_random_transforms")
def _(fx):
    u = lambda seed: B.seeded_uniform(seed, c("image_id"), F.lit(3))
    return fx.images.select(
        "image_id", (u(1) < 0.5).alias("flip"), F.element_at(F.array(*[F.lit(s) for s in (320, 400, 480)]), (F.floor(u(2) * 3) + 1).cast("int")).alias("size"),
        F.floor(u(3) * (c("width") - 240 + 1)).cast("int").alias("crop_left"), F.floor(u(4) * (c("height") - 200 + 1)).cast("int").alias("crop_top"), F.floor(u(5) * 33).cast("int").alias("pad"),
    )


@query("b24_normalize_boxes", "SELECT ann_id, round((x+w/2)/width, 6) AS cx, round((y+h/2)/height, 6) AS cy, round(w/width, 6) AS w, round(h/height, 6) AS h FROM fx_objects JOIN fx_images USING (image_id)")
def _(fx):
    d = b(fx.objects).join(fx.images, "image_id").withColumn("f", B.normalize_box(c("box"), c("width"), c("height")))
    return d.select("ann_id", *[r6(c(f"f.{k}")).alias(k) for k in ("cx", "cy", "w", "h")])


@query("b25_sigmoid", "SELECT det_id, round(1/(1+exp(-p0)), 6) AS s, round(ln(greatest(p1, 1e-5)/greatest(1-p1, 1e-5)), 6) AS logit FROM fx_class_probs")
def _(fx):
    return fx.class_probs.select("det_id", r6(B.sigmoid(c("p0"))).alias("s"), r6(B.inverse_sigmoid(c("p1"))).alias("logit"))


@query("b26_rescale_detections", "SELECT det_id, round((x+w/2)/300*width - w/300*width/2, 6) AS x1, round((y+h/2)/300*height + h/300*height/2, 6) AS y2 FROM fx_detections JOIN fx_images USING (image_id)")
def _(fx):
    d = fx.detections.withColumn("n", B.normalize_box(B.box_from_xywh(*[c(k) for k in "xywh"]), F.lit(300.0), F.lit(300.0))).join(fx.images, "image_id")
    f = B.scale_box(B.box_cxcywh_to_xyxy(c("n.cx"), c("n.cy"), c("n.w"), c("n.h")), c("width"), c("height"))
    return d.withColumn("f", f).select("det_id", r6(c("f.x1")).alias("x1"), r6(c("f.y2")).alias("y2"))


@query("c1_drop_orphans", "SELECT ann_id, image_id FROM fx_objects WHERE image_id IN (SELECT image_id FROM fx_images WHERE image_id % 3 <> 0)")
def _(fx):
    return filters.drop_orphans(fx.objects, fx.images.where("image_id % 3 <> 0")).select("ann_id", "image_id")


@query("c3_not_crowd", "SELECT ann_id FROM fx_objects WHERE coalesce(iscrowd, 0) = 0")
def _(fx):
    return filters.not_crowd(fx.objects).select("ann_id")


@query("c4_score_filter", "SELECT det_id, round(score, 6) AS score FROM fx_detections WHERE score > 0.4")
def _(fx):
    return filters.score_filter(fx.detections, 0.4).select("det_id", r6(c("score")).alias("score"))


@query("c5_relative_area_gate", "SELECT det_id FROM fx_detections JOIN fx_images USING (image_id) WHERE greatest(w/width, 0) * greatest(h/height, 0) BETWEEN 0.004 AND 0.20")
def _(fx):
    return filters.relative_area_gate(fx.detections.join(fx.images, "image_id"), c("w") / c("width"), c("h") / c("height")).select("det_id")


@query("c6_valid_segmentation", "SELECT ann_id FROM fx_objects WHERE ann_id % 4 <> 0")
def _(fx):
    seg = F.when(c("ann_id") % 4 == 0, F.array(F.array("x", "y"))).otherwise(F.array(F.array("x", "y", c("x") + c("w"), "y", "x", c("y") + c("h"))))
    return filters.valid_segmentation(fx.objects.withColumn("segmentation", seg)).select("ann_id")


@query("c7_min_object_area", "SELECT ann_id FROM fx_objects WHERE w*h >= 400 AND (ann_id % 10) >= 5")
def _(fx):
    return filters.min_crop_mean(filters.min_object_area(fx.objects, c("w"), c("h"), 400.0).withColumn("bright", (c("ann_id") % 10).cast("double")), "bright").select("ann_id")


@query("c8_not_constant", "SELECT image_id, min(px) AS lo, max(px) AS hi FROM fx_label_pixels GROUP BY image_id HAVING min(px) <> max(px)")
def _(fx):
    return filters.not_constant(fx.label_pixels.groupBy("image_id").agg(F.min("px").alias("lo"), F.max("px").alias("hi")), "lo", "hi")


@query("c9_subset_by_ids", "SELECT o.ann_id, o.image_id FROM fx_objects o JOIN fx_images i ON o.image_id = i.image_id WHERE o.image_id % 7 = 1")
def _(fx):
    images, anns = filters.subset_by_ids(fx.images, fx.objects, fx.images.where("image_id % 7 = 1").select("image_id"))
    return anns.join(images, "image_id", "left_semi").select("ann_id", "image_id")


@query("d1_annotations_join_images", "SELECT ann_id, file_name, width FROM fx_objects JOIN fx_images USING (image_id)")
def _(fx):
    return joins.with_image(fx.objects, fx.images).select("ann_id", "file_name", "width")


@query("d2_images_left_join", "SELECT i.image_id, o.ann_id FROM fx_images i LEFT JOIN (SELECT * FROM fx_objects WHERE image_id % 2 = 0) o ON i.image_id = o.image_id")
def _(fx):
    return joins.images_with_annotations(fx.images, fx.objects.where("image_id % 2 = 0")).select("image_id", "ann_id")


@query("d3_case_fallback_join", "SELECT image_id, CASE image_id % 4 WHEN 3 THEN NULL WHEN 0 THEN upper(file_name) ELSE file_name END AS found FROM fx_images")
def _(fx):
    files = fx.images.where("image_id % 4 <> 3").select(F.when(c("image_id") % 4 == 0, F.upper("file_name")).otherwise(c("file_name")).alias("file_name"))
    names = fx.images.select("image_id", F.when(c("image_id") % 4 == 2, F.upper("file_name")).otherwise(c("file_name")).alias("file_name"))
    return joins.case_fallback_join(names, files).select("image_id", "found")


@query("d4_tile_overlap_join", """SELECT o.ann_id, CAST(t.c AS INT) AS c, CAST(t.r AS INT) AS r FROM fx_objects o CROSS JOIN (SELECT a.range AS c, b.range AS r FROM range(5) a, range(5) b) t
  WHERE o.x + o.w > t.c*60 AND o.x < t.c*60+100 AND o.y + o.h > t.r*60 AND o.y < t.r*60+100""")
def _(fx):
    grid = F.explode(F.sequence(F.lit(0), F.lit(4)))
    tiles = fx.images.select("image_id", grid.alias("c")).withColumn("r", grid).select("image_id", "c", "r", (c("c") * 60.0).alias("tx0"), (c("r") * 60.0).alias("ty0"), (c("c") * 60.0 + 100).alias("tx1"), (c("r") * 60.0 + 100).alias("ty1"))
    objects = fx.objects.select("ann_id", "image_id", c("x").alias("x1"), c("y").alias("y1"), (c("x") + c("w")).alias("x2"), (c("y") + c("h")).alias("y2"))
    return joins.overlap_join(tiles, objects, 100.0).select("ann_id", "c", "r")


@query("d5_box_pair_join", f"SELECT a.ann_id, b.det_id, round({PAIR_IOU}, 6) AS iou FROM fx_objects a JOIN fx_detections b ON a.image_id = b.image_id WHERE {PAIR_IOU} >= 0.5")
def _(fx):
    left, right = b(fx.objects, "a").select("ann_id", "image_id", "a"), b(fx.detections, "b").select("det_id", "image_id", "b")
    return joins.box_pairs(left, right, ["image_id"], 0.5, cell=64.0).select("ann_id", "det_id", r6(c("iou")).alias("iou"))


@query("d6_consecutive_epochs", """SELECT coalesce(a.image_id, p.image_id) AS image_id, CAST(coalesce(a.epoch, p.epoch + 1) AS BIGINT) AS epoch, a.n, p.n AS prev_n FROM
  (SELECT image_id, det_id % 2 AS epoch, count(*) AS n FROM fx_detections GROUP BY ALL) a FULL OUTER JOIN (SELECT image_id, det_id % 2 AS epoch, count(*) AS n FROM fx_detections GROUP BY ALL) p
  ON a.image_id = p.image_id AND a.epoch = p.epoch + 1""")
def _(fx):
    n = fx.detections.groupBy("image_id", (c("det_id") % 2).alias("epoch")).agg(F.count("*").alias("n"))
    return joins.consecutive(n, "image_id", "epoch", ["n"])


@query("d7_match_by_name", "SELECT image_id, CASE WHEN image_id % 5 = 0 THEN NULL ELSE replace(file_name, '.jpg', '.png') END AS mask FROM fx_images")
def _(fx):
    masks = fx.images.where("image_id % 5 <> 0").select(F.replace("file_name", F.lit(".jpg"), F.lit(".png")).alias("file_name"))
    found, missing = joins.match_by_name(fx.images, masks)
    return found.select("image_id", "mask").unionByName(missing.select("image_id", F.lit(None).cast("string").alias("mask")))


@query("d8_evaluation_cogroup", """SELECT coalesce(d.image_id, g.image_id) AS image_id, coalesce(d.category_id, g.category_id) AS category_id, coalesce(nd, 0) AS n_det, coalesce(ng, 0) AS n_gt FROM
  (SELECT image_id, category_id, CAST(count(*) AS INT) AS nd FROM fx_detections GROUP BY ALL) d FULL OUTER JOIN (SELECT image_id, category_id, CAST(count(*) AS INT) AS ng FROM fx_objects GROUP BY ALL) g
  ON d.image_id = g.image_id AND d.category_id = g.category_id""")
def _(fx):
    g = joins.cogroup(fx.detections, fx.objects, ["image_id", "category_id"], F.struct("det_id", "score"), F.struct("ann_id"))
    return g.select("image_id", "category_id", F.size("dets").alias("n_det"), F.size("gts").alias("n_gt"))


def _flat(fx):
    x2, y2 = (c("x") + c("w")).alias("x2"), (c("y") + c("h")).alias("y2")
    xy = [c("x").alias("x1"), c("y").alias("y1"), x2, y2]
    return fx.detections.select("image_id", "category_id", "det_id", "score", *xy), fx.objects.select("image_id", "category_id", "iscrowd", *xy)


@query("e7_coco_match")
def _(fx):
    m = evaluation.coco_match(*_flat(fx))
    return m.groupBy("area_range", r6(c("thr")).alias("thr")).agg(F.count_if("matched").alias("n_matched"), F.count_if("ignored").alias("n_ignored"), F.count("*").alias("n"))


@query("e8_coco_summary")
def _(fx):
    return evaluation.coco_summary(*_flat(fx)).select("metric", r6(c("value")).alias("value"))


@query("e14_vis_stability", f"""WITH p AS (SELECT a.image_id, a.det_id AS ia, b.det_id AS ib, {PAIR_IOU} AS iou FROM fx_detections a JOIN fx_detections b ON a.image_id = b.image_id WHERE a.det_id % 2 = 1 AND b.det_id % 2 = 0),
  ma AS (SELECT image_id, avg(v) AS m FROM (SELECT image_id, ia, max(iou) AS v FROM p GROUP BY ALL) GROUP BY image_id), mb AS (SELECT image_id, avg(v) AS m FROM (SELECT image_id, ib, max(iou) AS v FROM p GROUP BY ALL) GROUP BY image_id),
  n AS (SELECT i.image_id, count(d.det_id) FILTER (d.det_id % 2 = 1) AS na, count(d.det_id) FILTER (d.det_id % 2 = 0) AS nb FROM fx_images i LEFT JOIN fx_detections d ON i.image_id = d.image_id GROUP BY ALL)
  SELECT round(avg(CASE WHEN na = 0 AND nb = 0 THEN 1.0 WHEN na = 0 OR nb = 0 THEN 0.0 ELSE (ma.m + mb.m)/2 END), 6) AS stability FROM n LEFT JOIN ma USING (image_id) LEFT JOIN mb USING (image_id)""")
def _(fx):
    d = b(fx.detections)
    return A.vis_stability(d.where("det_id % 2 = 1"), d.where("det_id % 2 = 0"), fx.images).select(r6(c("stability")).alias("stability"))


@query("e16_accuracy", """SELECT round(avg(CASE WHEN (t = 0 AND p0 >= p1) OR (t = 1 AND p1 > p0) THEN 100.0 ELSE 0.0 END), 6) AS acc_1, 100.0 AS acc_2,
  round(100 - avg(CASE WHEN (t = 0 AND p0 >= p1) OR (t = 1 AND p1 > p0) THEN 100.0 ELSE 0.0 END), 6) AS class_error FROM (SELECT *, det_id % 2 AS t FROM fx_class_probs) x""")
def _(fx):
    d = fx.class_probs.select(F.array("p0", "p1").alias("probs"), (c("det_id") % 2).cast("int").alias("target"))
    return A.accuracy_at_k(d, "probs", "target", (1, 2)).select(*[r6(c(k)).alias(k) for k in ("acc_1", "acc_2", "class_error")])


@query("e17_cardinality_error", """SELECT round(avg(abs(coalesce(p, 0) - coalesce(t, 0))), 6) AS cardinality_error FROM fx_images i LEFT JOIN (SELECT image_id, count(*) AS p FROM fx_detections WHERE score > 0.2 GROUP BY 1) a USING (image_id)
  LEFT JOIN (SELECT image_id, count(*) AS t FROM fx_objects GROUP BY 1) o USING (image_id)""")
def _(fx):
    return A.cardinality_error(fx.detections, fx.objects, fx.images, c("score") > 0.2).select(r6(c("cardinality_error")).alias("cardinality_error"))


@query("e18_matched_box_error", f"""SELECT round(sum(abs(a.x-b.x)+abs(a.y-b.y)+abs(a.w-b.w)+abs(a.h-b.h))/1000, 6) AS loss_bbox, round(sum(1 - ({PAIR_IOU} - ({HULL} - (a.w*a.h + b.w*b.h - ({IOU}))) / {HULL}))/1000, 6) AS loss_giou
  FROM fx_objects a JOIN fx_detections b ON a.ann_id = b.det_id""")
def _(fx):
    d = b(fx.objects, "a").select("ann_id", "a", *[c(k).alias(f"a{k}") for k in "xywh"]).join(b(fx.detections, "b").withColumnRenamed("det_id", "ann_id").drop("image_id", "category_id"), "ann_id")
    l1 = F.abs(c("ax") - c("x")) + F.abs(c("ay") - c("y")) + F.abs(c("aw") - c("w")) + F.abs(c("ah") - c("h"))
    return A.matched_box_error(d, l1, B.generalized_box_iou(c("a"), c("b")), 1000).select(r6(c("loss_bbox")).alias("loss_bbox"), r6(c("loss_giou")).alias("loss_giou"))


@query("e19_focal_loss", """WITH t AS (SELECT image_id, ln(greatest(p0,1e-5)/greatest(1-p0,1e-5)) AS x, CAST(det_id % 2 AS DOUBLE) AS t FROM fx_class_probs), p AS (SELECT *, 1/(1+exp(-x)) AS p FROM t)
  SELECT round(sum(v)/100, 6) AS focal_loss FROM (SELECT image_id, avg((greatest(x,0) - x*t + ln(1+exp(-abs(x)))) * pow(1-(p*t+(1-p)*(1-t)), 2) * (0.25*t + 0.75*(1-t))) AS v FROM p GROUP BY image_id) q""")
def _(fx):
    d = fx.class_probs.select("image_id", B.inverse_sigmoid(c("p0")).alias("x"), (c("det_id") % 2).cast("double").alias("t"))
    return A.focal_loss(d, "image_id", "x", "t", 100.0).select(r6(c("focal_loss")).alias("focal_loss"))


@query("f2_top_k_per_image", "SELECT det_id, image_id FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, det_id) AS k FROM fx_detections) t WHERE k <= 5")
def _(fx):
    return windows.top_k(fx.detections, "image_id", 5, "score", "det_id").select("det_id", "image_id")


@query("f3_top_classes", """SELECT image_id, query_id, class_id FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, query_id, class_id) AS k FROM (
  SELECT image_id, det_id AS query_id, 0 AS class_id, p0 AS score FROM fx_class_probs UNION ALL SELECT image_id, det_id, 1, p1 FROM fx_class_probs) u) t WHERE k <= 10""")
def _(fx):
    return windows.top_classes(fx.class_probs.select("image_id", c("det_id").alias("query_id"), F.array("p0", "p1").alias("probs")), 10).select("image_id", "query_id", "class_id")


@query("f4_best_class", "SELECT det_id, round(greatest(p0, p1), 6) AS score, CAST(CASE WHEN p0 >= p1 THEN 0 ELSE 1 END AS INT) AS class_id, 0 AS first_only FROM fx_class_probs")
def _(fx):
    d = fx.class_probs.withColumn("b", windows.best_class(F.array("p0", "p1"))).withColumn("f", windows.best_class(F.array("p0", "p1"), without_last=True))
    return d.select("det_id", r6(c("b.score")).alias("score"), "b.class_id", c("f.class_id").alias("first_only"))


@query("p1_box_nms", greedy_sql("image_id", "det_id", "SELECT image_id, det_id, score FROM fx_detections",
  f"SELECT a.image_id, a.det_id, b.det_id AS better FROM fx_detections a JOIN fx_detections b ON a.image_id = b.image_id AND (b.score > a.score OR (b.score = a.score AND b.det_id < a.det_id)) WHERE {PAIR_IOU} > 0.4"))
def _(fx):
    return suppression.box_nms(b(fx.detections), 0.4).select("image_id", "det_id", r6(c("score")).alias("score"))


@query("p8_assign_pairs")
def _(fx):
    found = b(fx.detections).join(fx.images, "image_id").select("image_id", c("det_id").alias("query_id"), c("score").alias("p"), "box", "width", "height")
    truth = b(fx.objects).select("image_id", c("ann_id").alias("gt_id"), "box")
    return suppression.assign_pairs(found, truth).select("image_id", "query_id", "gt_id", r6(c("cost")).alias("cost"))


@query("e5_top_half_mean", """SELECT category_id, round(avg(score), 6) AS mean FROM (SELECT *, row_number() OVER (PARTITION BY category_id ORDER BY score DESC, det_id) AS k, count(*) OVER (PARTITION BY category_id) AS n FROM fx_detections) t
  WHERE k <= greatest(floor(n/2), 1) AND category_id IN (SELECT category_id FROM fx_objects) GROUP BY 1""")
def _(fx):
    return A.top_half_mean(fx.detections, "category_id", "score", "det_id", fx.objects).select("category_id", r6(c("mean")).alias("mean"))


@query("e6_foreground_stats", """WITH k AS (SELECT det_id % 10 AS step, score, row_number() OVER (PARTITION BY det_id % 10, image_id ORDER BY score DESC, det_id) AS k FROM fx_detections),
  s AS (SELECT step, count(*) FILTER (score > 0.25) AS n, avg(score) FILTER (score > 0.25) AS a, stddev_pop(score) FILTER (score > 0.25) AS b, avg(score) FILTER (k <= 5) AS c, stddev_pop(score) FILTER (k <= 5) AS d FROM k GROUP BY step)
  SELECT step, n, round(CASE WHEN n >= 8 THEN a ELSE c END, 6) AS mu, round(CASE WHEN n >= 8 THEN b ELSE d END, 6) AS sigma FROM s""")
def _(fx):
    return A.foreground_stats(fx.detections.withColumn("step", c("det_id") % 10), 2.0).select("step", "n", r6(c("mu")).alias("mu"), r6(c("sigma")).alias("sigma"))


@query("e9_merge_evaluations", "SELECT image_id, CAST(min(part) AS INT) AS part FROM (SELECT image_id, det_id % 3 AS part FROM fx_detections) t GROUP BY image_id")
def _(fx):
    parts = [fx.detections.where(c("det_id") % 3 == i).select("image_id").distinct().withColumn("part", F.lit(i)) for i in range(3)]
    return A.merge_evaluations(parts)


@query("e15_pseudo_label_stats", """SELECT det_id % 10 AS epoch, round(avg(score), 6) AS mean_score, round(avg(score) FILTER (score > 0.4), 6) AS mean_kept, count(*) FILTER (score > 0.4) AS n_kept,
  round(CAST(count(*) FILTER (score > 0.4) AS DOUBLE) / count(DISTINCT image_id), 6) AS per_image FROM fx_detections GROUP BY 1""")
def _(fx):
    s = A.pseudo_label_stats(fx.detections.withColumn("epoch", c("det_id") % 10), "epoch", 0.4)
    return s.select("epoch", *[r6(c(k)).alias(k) for k in ("mean_score", "mean_kept", "per_image")], "n_kept")
