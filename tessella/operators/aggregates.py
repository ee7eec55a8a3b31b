"""Aggregations: statistics of detections, segments, logs and losses."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.operators.batches import whole_groups
from tessella.operators.joins import box_pairs
from tessella.operators.selection import ranked_value

#: Least IoU of boxes that overlap.
OVERLAP = 1e-12
#: Candidates of an image whose segments are dealt within a task.
PIXELS = 1 << 18


def avg_objects_per_image(images: DataFrame, annotations: DataFrame) -> DataFrame:
    n = images.select("image_id").distinct().join(annotations, "image_id", "left").agg(F.count("ann_id").alias("objects"), F.count_distinct("image_id").alias("images"))
    return n.select((F.col("objects") / F.greatest("images", F.lit(1))).alias("avg_objects"))


def keyed_mean(df: DataFrame, key: str, value: str, mean: bool = True) -> DataFrame:
    return df.groupBy(key).agg((F.avg if mean else F.sum)(value).alias("value"))


def global_average(df: DataFrame, key: str, value: str, weight: str) -> DataFrame:
    return df.groupBy(key).agg(F.try_divide(F.sum(F.col(value) * F.col(weight)), F.sum(weight)).alias("average"))


def confidence_quantile(df: DataFrame, keys: list[str], score: str, q: float, approximate: bool = False) -> DataFrame:
    """Linear-interpolated quantile, q held within [0.5, 0.99], by histogram refinement: exact for groups of any size; the
    approximate one merges sketches in a single pass."""
    q = min(max(q, 0.5), 0.99)
    if approximate:
        return df.groupBy(*keys).agg(F.percentile_approx(score, q, 10000).alias("quantile"))
    place = q * (F.col("n") - 1)
    found = ranked_value(df, keys, score, F.floor(place))
    share = place - F.floor(place)
    upper = F.when(F.col("rank") + 1 < F.col("below") + F.col("equal"), F.col("at")).otherwise(F.coalesce("above", "at"))
    return found.select(*keys, (F.col("at") + (upper - F.col("at")) * share).alias("quantile"))


def top_half_mean(df: DataFrame, cls: str, score: str, tie: str, present: DataFrame) -> DataFrame:
    """Mean of each class's best max(1, n // 2) scores, for classes in ``present``. The least score that counts is found by
    histogram refinement, then what lies above is summed; of equal scores at the cut it doesn't matter to the mean which
    ones count, so ``tie`` isn't looked at. A class may hold all rows. Rows without a score don't count."""
    known = df.join(present.select(cls).distinct(), cls, "left_semi").select(cls, F.col(score).cast("double").alias("_s")).where("_s is not null and not isnan(_s)")
    half = F.greatest(F.floor(F.col("n") / 2), F.lit(1))
    cut = ranked_value(known, [cls], "_s", F.col("n") - half).withColumn("half", half).select(cls, "at", "half")
    above = F.col("_s") > F.col("at")
    sums = known.join(cut, cls).groupBy(cls, "at", "half").agg(F.count_if(above).alias("c"), F.coalesce(F.sum(F.when(above, F.col("_s"))), F.lit(0.0)).alias("s"))
    return sums.select(cls, ((F.col("s") + (F.col("half") - F.col("c")) * F.col("at")) / F.col("half")).alias("mean"))


def foreground_stats(df: DataFrame, avg_objects: float, key: str = "step", gate: float = 0.25, min_fg: int = 8, multiplier: float = 1.5) -> DataFrame:
    """(key, mu, sigma, n): mean and population deviation of scores over ``gate`` where there are at least min_fg of
    them, else of the pooled best K of each image, K = max(5, ceil(multiplier * max(1, avg_objects)))."""
    import math

    k = max(5, math.ceil(multiplier * max(1.0, avg_objects)))
    rank = F.row_number().over(Window.partitionBy(key, "image_id").orderBy(F.desc("score"), "det_id"))
    fg, top = F.col("score") > gate, F.col("_k") <= k
    stats = df.withColumn("_k", rank).groupBy(key).agg(F.count_if(fg).alias("n"), *[f(F.when(c, F.col("score"))).alias(n) for c, s in ((fg, "fg"), (top, "top")) for f, n in ((F.avg, f"mu_{s}"), (F.stddev_pop, f"sd_{s}"))])
    enough = F.col("n") >= min_fg
    return stats.select(key, F.when(enough, F.col("mu_fg")).otherwise(F.col("mu_top")).alias("mu"), F.when(enough, F.col("sd_fg")).otherwise(F.col("sd_top")).alias("sigma"), "n")


def merge_evaluations(parts: list[DataFrame], key: str = "image_id") -> DataFrame:
    """Workers' results as one, the first for each image in the order of ``parts``."""
    out = None
    for i, p in enumerate(parts):
        p = p.withColumn("_part", F.lit(i))
        out = p if out is None else out.unionByName(p)
    keep = Window.partitionBy(key).orderBy("_part", *[c for c in out.columns if c not in (key, "_part")])
    return out.withColumn("_k", F.row_number().over(keep)).where("_k = 1").drop("_k", "_part")


def panoptic_quality(overlaps: DataFrame, things: DataFrame | None = None) -> DataFrame:
    """(grp, pq, sq, rq, n): overlaps has image_id, pred_seg, gt_seg, pred_cat, gt_cat, pixels; ``things`` cat, isthing.

    A predicted and a true segment of one category match at IoU > 0.5 (then at most one does). Per category, PQ = sum of
    IoU / (tp + fp / 2 + fn / 2); groups All, Things and Stuff are means over their categories with any segment. Overlaps are
    exchanged once, by image; sizes and counts of segments come from windows inside images.
    """
    whole = ["image_id", "pred_seg", "gt_seg", "pred_cat", "gt_cat"]
    parts = overlaps.repartition("image_id").groupBy(*whole).agg(F.sum("pixels").alias("pixels"))
    pred, truth = Window.partitionBy("image_id", "pred_seg", "pred_cat"), Window.partitionBy("image_id", "gt_seg", "gt_cat")
    first = lambda w, by: (F.row_number().over(w.orderBy(by)) == 1).cast("long")
    sized = parts.withColumns({"pa": F.sum("pixels").over(pred), "np": first(pred, F.struct("gt_seg", "gt_cat"))}).withColumns({"ga": F.sum("pixels").over(truth), "ng": first(truth, F.struct("pred_seg", "pred_cat"))})
    iou = sized.withColumn("iou", F.when(F.col("pred_cat") == F.col("gt_cat"), F.col("pixels") / (F.col("pa") + F.col("ga") - F.col("pixels")))).withColumn("hit", F.coalesce(F.col("iou") > 0.5, F.lit(False)))
    mine = F.struct(F.col("pred_cat").alias("cat"), "np", F.lit(0).cast("long").alias("ng"), F.col("hit").cast("long").alias("tp"), F.when(F.col("hit"), F.col("iou")).otherwise(0.0).alias("iou"))
    other = F.struct(F.col("gt_cat").alias("cat"), F.lit(0).cast("long").alias("np"), "ng", F.lit(0).cast("long").alias("tp"), F.lit(0.0).alias("iou"))
    per = iou.select(F.inline(F.array(mine, other))).groupBy("cat").agg(*[F.sum(k).alias(k) for k in ("np", "ng", "tp", "iou")])
    half = (F.col("np") + F.col("ng")) / 2
    per = per.select("cat", (F.col("iou") / half).alias("pq"), F.coalesce(F.try_divide(F.col("iou"), F.col("tp")), F.lit(0.0)).alias("sq"), (F.col("tp") / half).alias("rq"))
    named = per.join(things, "cat", "left") if things is not None else per.withColumn("isthing", F.lit(True))
    groups = F.array(F.lit("All"), F.when(F.coalesce("isthing", F.lit(False)), "Things").otherwise("Stuff"))
    return named.withColumn("grp", F.explode(groups)).groupBy("grp").agg(*[F.avg(c).alias(c) for c in ("pq", "sq", "rq")], F.count("*").alias("n"))


def segment_areas(pixels: DataFrame, least: int = 4) -> DataFrame:
    """(image_id, segment_id, area) by the best segment of each pixel; segments of area <= ``least`` are taken out and
    pixels dealt again until none is left. ``pixels``: image_id, px, py, segment_id, logit (rows that are candidates, repeats do no
    harm), merged stuff segments having one id. Each round takes out at least one segment, and the loop ends when none went.

    Images are solved side by side on a task's batches, with one exchange of ``pixels`` by image; those with more than PIXELS
    rows pass through and are solved by rounds over tables.
    """
    from tessella.sources.shared import materialize

    columns = ["image_id", "px", "py", "segment_id", "logit"]
    held = pixels.select(*columns).withColumn("_rows", F.count("*").over(Window.partitionBy("image_id")))
    schema = T.StructType([held.schema[c] for c in columns] + [T.StructField("area", T.LongType())])
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])
    most = PIXELS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        for batch in batches:
            large = pc.or_(pc.greater(batch.column(5), most), pc.is_null(batch.column(0)))
            batch = batch.select(range(5))
            crowd = batch.filter(large)
            if crowd.num_rows:
                yield pa.RecordBatch.from_arrays([*crowd.columns, pa.nulls(crowd.num_rows, pa.int64())], names=schema.names)
            groups = list(whole_groups(iter([*rest, batch.filter(pc.invert(large))]), 0))
            rest = groups[-1:]  # the last image may go on
            yield from (areas_of(rows, least) for rows in groups[:-1])
        yield from (areas_of(rows, least) for rows in rest)

    solved = materialize(held.mapInArrow(run, schema))
    found = solved.where("area is not null").select("image_id", "segment_id", "area")
    large = solved.where("area is null").select(*columns)
    return found if large.isEmpty() else found.unionByName(large_segment_areas(large, least))


def areas_of(rows: pa.RecordBatch, least: int) -> pa.RecordBatch:
    """Areas of the segments of whole images: candidates are sorted by pixel and rank once, and the first that is left counts."""
    of, px, py, code = (pc.dictionary_encode(rows.column(i), null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4))
    number, logit = (pc.fill_null(rows.column(i), 0).to_numpy(zero_copy_only=False) for i in (3, 4))
    unnamed, unknown = (rows.column(i).is_null().to_numpy(zero_copy_only=False) for i in (3, 4))
    known = ~(unknown | np.isnan(logit))
    # as Spark sorts: NaN is the greatest logit, null the least; of equal ones the least segment wins, null the last
    order = np.lexsort((number, unnamed, np.where(known, -logit, 0), unknown.astype(int) * 2 + known, py, px, of))
    of, px, py, code = (v[order] for v in (of, px, py, code))
    pixel = np.concatenate([[0], ((of[1:] != of[:-1]) | (px[1:] != px[:-1]) | (py[1:] != py[:-1])).cumsum()])
    _, at, segment = np.unique(of * (code.max() + 1) + code, return_index=True, return_inverse=True)
    left = np.arange(len(order))
    while True:
        best = left[np.concatenate([[True], pixel[left][1:] != pixel[left][:-1]])] if len(left) else left
        area = np.bincount(segment[best], minlength=len(at))
        small = (area > 0) & (area <= least)
        if not small.any():
            break
        left = left[~small[segment[left]]]
    some = np.flatnonzero(area)
    ids = rows.select([0, 3]).take(pa.array(order[at[some]]))
    none = [pa.nulls(len(some), rows.column(i).type) for i in (1, 2, 4)]
    return pa.RecordBatch.from_arrays([ids.column(0), none[0], none[1], ids.column(1), none[2], pa.array(area[some])], names=[*rows.schema.names, "area"])


def large_segment_areas(pixels: DataFrame, least: int) -> DataFrame:
    """``segment_areas`` of images of any size, by rounds over tables."""
    from tessella.sources.shared import materialize

    left = pixels
    while True:
        best = left.groupBy("image_id", "px", "py").agg(F.max_by("segment_id", F.struct("logit", (-F.col("segment_id")).alias("t"))).alias("segment_id"))
        areas = materialize(best.groupBy("image_id", "segment_id").agg(F.count("*").alias("area")))
        small = areas.where(F.col("area") <= least).select(F.col("image_id").alias("_i"), F.col("segment_id").alias("_s"))
        if small.isEmpty():
            return areas
        left = materialize(left.join(small, F.col("image_id").eqNullSafe(F.col("_i")) & F.col("segment_id").eqNullSafe(F.col("_s")), "left_anti"))


def mask_to_box(pixels: DataFrame, keys: list[str]) -> DataFrame:
    return pixels.groupBy(*keys).agg(F.min("px").alias("x1"), F.min("py").alias("y1"), F.max("px").alias("x2"), F.max("py").alias("y2"))


def instances_from_labels(pixels: DataFrame, background: tuple[int, ...] = (1, -1), least: int = 10) -> DataFrame:
    """(image_id, label, x, y, w, h, area): labelled pixels as boxes, small ones left out."""
    kept = pixels.where(~F.col("label").isin(*background)).groupBy("image_id", "label")
    box = kept.agg(F.min("px").alias("x"), F.min("py").alias("y"), (F.max("px") - F.min("px") + 1).alias("w"), (F.max("py") - F.min("py") + 1).alias("h"), F.count("*").alias("area"))
    return box.where(F.col("area") >= least)


def vis_stability(current: DataFrame, previous: DataFrame | None, images: DataFrame) -> DataFrame:
    """One row ``stability``: mean over images of the mean best IoU in both directions; two empty sides give 1, one gives
    0; no previous epoch gives NULL. Boxes are columns ``box`` with ids ``det_id``."""
    if previous is None:
        return images.sparkSession.createDataFrame([(None,)], "stability double")
    a, b = current.select("image_id", F.col("det_id").alias("ia"), F.col("box").alias("a")), previous.select("image_id", F.col("det_id").alias("ib"), F.col("box").alias("b"))
    pairs = box_pairs(a, b, ["image_id"], OVERLAP, 64.0)  # boxes without an overlap have a best IoU of 0
    best = lambda k: pairs.groupBy("image_id", k).agg(F.max("iou").alias("v")).groupBy("image_id").agg(F.sum("v").alias(f"sum_{k}"))
    counts = images.select("image_id").join(a.groupBy("image_id").agg(F.count("*").alias("na")), "image_id", "left").join(b.groupBy("image_id").agg(F.count("*").alias("nb")), "image_id", "left").na.fill(0)
    s = counts.join(best("ia"), "image_id", "left").join(best("ib"), "image_id", "left")
    value = F.when((F.col("na") == 0) & (F.col("nb") == 0), 1.0).when((F.col("na") == 0) | (F.col("nb") == 0), 0.0).otherwise((F.coalesce("sum_ia", F.lit(0.0)) / F.col("na") + F.coalesce("sum_ib", F.lit(0.0)) / F.col("nb")) / 2)
    return s.agg(F.avg(value).alias("stability"))


def pseudo_label_stats(df: DataFrame, key: str, threshold: float, n_images: str = "image_id") -> DataFrame:
    """Per key: mean score, mean score over the threshold, kept labels and labels per image; NULL where nothing counts."""
    kept = F.col("score") > threshold
    return df.groupBy(key).agg(F.avg("score").alias("mean_score"), F.avg(F.when(kept, F.col("score"))).alias("mean_kept"), F.count_if(kept).alias("n_kept"), F.try_divide(F.count_if(kept), F.count_distinct(n_images)).alias("per_image"))


def accuracy_at_k(df: DataFrame, probs: str, target: str, ks: tuple[int, ...] = (1,)) -> DataFrame:
    """acc_k: percent of rows whose target class is among the k best (the first of ties); class_error = 100 - acc_1."""
    order = F.transform(F.sort_array(F.transform(probs, lambda p, i: F.struct((-p).alias("s"), i.alias("i")))), lambda s: s["i"])
    rank = F.array_position(order, F.col(target))
    hit = lambda k: F.avg(F.when((rank > 0) & (rank <= k), 100.0).otherwise(0.0))
    return df.agg(*[hit(k).alias(f"acc_{k}") for k in ks], (100 - hit(1)).alias("class_error"))


def cardinality_error(predictions: DataFrame, objects: DataFrame, images: DataFrame, is_object: Column) -> DataFrame:
    p = predictions.where(is_object).groupBy("image_id").agg(F.count("*").alias("np"))
    t = objects.groupBy("image_id").agg(F.count("*").alias("nt"))
    both = images.select("image_id").join(p, "image_id", "left").join(t, "image_id", "left").na.fill(0)
    return both.agg(F.avg(F.abs(F.col("np") - F.col("nt"))).alias("cardinality_error"))


def matched_box_error(pairs: DataFrame, l1: Column, giou: Column, n_objects: int) -> DataFrame:
    n = max(n_objects, 1)
    return pairs.agg((F.sum(l1) / n).alias("loss_bbox"), (F.sum(1 - giou) / n).alias("loss_giou"))


def focal_loss(df: DataFrame, key: str, logit: str, target: str, n: float, alpha: float = 0.25, gamma: float = 2.0) -> DataFrame:
    """Mean over each key's elements of the focal loss, summed over keys / n."""
    x, t = F.col(logit), F.col(target)
    p = 1 / (1 + F.exp(-x))
    ce = F.greatest(x, F.lit(0.0)) - x * t + F.log1p(F.exp(-F.abs(x)))
    pt = p * t + (1 - p) * (1 - t)
    loss = ce * F.pow(1 - pt, gamma) * (alpha * t + (1 - alpha) * (1 - t))
    return df.groupBy(key).agg(F.avg(loss).alias("v")).agg((F.sum("v") / n).alias("focal_loss"))


def dice_loss(df: DataFrame, key: str, p: str, t: str) -> DataFrame:
    return df.groupBy(key).agg((1 - (2 * F.sum(F.col(p) * F.col(t)) + 1) / (F.sum(p) + F.sum(t) + 1)).alias("dice_loss"))


def smooth_l1(a: Column, b: Column, beta: float = 0.1) -> Column:
    """Summed over the coordinates of two rings of one length."""
    one = lambda d: F.when(F.abs(d) < beta, 0.5 * d * d / beta).otherwise(F.abs(d) - 0.5 * beta)
    return F.aggregate(F.zip_with(a, b, lambda p, q: one(p["x"] - q["x"]) + one(p["y"] - q["y"])), F.lit(0.0), lambda s, v: s + v)


def polygon_error(df: DataFrame, a: str, b: str, n: float, beta: float = 0.1) -> DataFrame:
    return df.agg((F.sum(smooth_l1(F.col(a), F.col(b), beta)) / n).alias("polygon_error"))


def boundary_report(df: DataFrame, ring: str, boundary: str, corners: str) -> DataFrame:
    """boundary_error: mean squared distance of all vertices to the nearest boundary point; corner_error: mean over
    objects with corners of the mean squared distance of a corner to the nearest vertex."""
    from tessella.functions.rings import nearest_squared, settled

    add = lambda values: F.aggregate(values, F.lit(0.0), lambda s, v: s + v)
    rows = settled(df.select(ring, boundary, corners), "_s", F.struct(ring, boundary, corners))
    near = rows.select("_s", nearest_squared(F.col("_s")[ring], F.col("_s")[boundary]).alias("d"), nearest_squared(F.col("_s")[corners], F.col("_s")[ring]).alias("c"))
    d, c, ring, corners = F.col("d"), F.col("c"), F.col("_s")[ring], F.col("_s")[corners]
    sums = near.select(add(d).alias("d"), F.size(ring).alias("n"), F.try_divide(add(c), F.size(corners)).alias("c"))
    return sums.agg(F.try_divide(F.sum("d"), F.sum("n")).alias("boundary_error"), F.avg("c").alias("corner_error"))


def reconstruction_error(df: DataFrame, a: str, b: str, mask: str) -> DataFrame:
    """Mean over channels of the squared error of each cell, then over masked cells."""
    e = F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0).cast("double"), lambda s, v: s + v) / F.size(a)
    return df.agg((F.sum(F.col(mask) * e) / (F.sum(mask) + 1e-6)).alias("reconstruction_error"))


def pr_summary(df: DataFrame, run: str) -> DataFrame:
    p, r = F.avg("precision"), F.avg("recall")
    return df.groupBy(run).agg(p.alias("precision"), r.alias("recall"), F.avg("score").alias("score"), (2 * p * r / (p + r + 1e-8)).alias("f1"))


def trigger_counts(log: DataFrame) -> DataFrame:
    """Triggered epochs by cause: event if only the event is due, else schedule."""
    cause = F.when(F.col("event_due") & ~F.col("schedule_due"), "event").otherwise("schedule")
    return log.where("triggered").groupBy(cause.alias("cause")).agg(F.count("*").alias("n"))


def benchmark_summary(df: DataFrame, config: str, order: str, seconds: str, warm: int = 5, batch: int = 1) -> DataFrame:
    """Mean seconds without the first ``warm`` iterations, and the rate."""
    return df.where(F.col(order) >= warm).groupBy(config).agg(F.avg(seconds).alias("mean_s"), F.try_divide(F.lit(float(batch)), F.avg(seconds)).alias("rate"))


def scale_percentile(df: DataFrame, group: str, value: str, p: float = 2.0) -> DataFrame:
    """``scaled`` = (v - Pp) / max(P(100-p) - Pp, 1e-6) * 255, clipped and cut to an integer; at nine places, so that the last bits of
    a quotient don't decide between two integers."""
    bounds = df.groupBy(group).agg(F.percentile(value, F.array(F.lit(p / 100), F.lit(1 - p / 100))).alias("_q"))
    s = (F.col(value) - F.get("_q", F.lit(0))) / F.greatest(F.get("_q", F.lit(1)) - F.get("_q", F.lit(0)), F.lit(1e-6)) * 255
    return df.join(bounds, group).withColumn("scaled", F.floor(F.round(F.least(F.greatest(s, F.lit(0.0)), F.lit(255.0)), 9)).cast("int")).drop("_q")
