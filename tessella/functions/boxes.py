"""Box expressions: a box is struct(x1, y1, x2, y2); everything stays a Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))


def box_from_xywh(x: Column, y: Column, w: Column, h: Column) -> Column:
    return box(x, y, x + w, y + h)


def box_cxcywh_to_xyxy(cx: Column, cy: Column, w: Column, h: Column) -> Column:
    return box(cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2)


def box_xyxy_to_cxcywh(b: Column) -> Column:
    return F.struct(((b["x1"] + b["x2"]) / 2).alias("cx"), ((b["y1"] + b["y2"]) / 2).alias("cy"), (b["x2"] - b["x1"]).alias("w"), (b["y2"] - b["y1"]).alias("h"))


def box_xyxy_to_xywh(b: Column) -> Column:
    return F.struct(b["x1"].alias("x"), b["y1"].alias("y"), (b["x2"] - b["x1"]).alias("w"), (b["y2"] - b["y1"]).alias("h"))


def area(b: Column) -> Column:
    return (b["x2"] - b["x1"]) * (b["y2"] - b["y1"])


def intersection(a: Column, b: Column) -> Column:
    zero = F.lit(0.0)
    w = F.greatest(F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]), zero)
    h = F.greatest(F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]), zero)
    return w * h


def union(a: Column, b: Column, floor: float | None = None) -> Column:
    u = area(a) + area(b) - intersection(a, b)
    return u if floor is None else F.greatest(u, F.lit(floor))


def box_iou(a: Column, b: Column, floor: float | None = None) -> Column:
    """Intersection over union; NULL for two empty boxes unless the union has a floor."""
    return F.try_divide(intersection(a, b), union(a, b, floor))


def generalized_box_iou(a: Column, b: Column) -> Column:
    """IoU less the share of the hull that the union leaves; NULL where a box is inverted or the hull is empty."""
    hull = (F.greatest(a["x2"], b["x2"]) - F.least(a["x1"], b["x1"])) * (F.greatest(a["y2"], b["y2"]) - F.least(a["y1"], b["y1"]))
    proper = (a["x2"] >= a["x1"]) & (a["y2"] >= a["y1"]) & (b["x2"] >= b["x1"]) & (b["y2"] >= b["y1"])
    return F.when(proper, box_iou(a, b) - F.try_divide(hull - union(a, b), hull))


def clamp(v: Column, low: Column | float, high: Column | float) -> Column:
    return F.greatest(F.least(v, F.lit(high) if isinstance(high, (int, float)) else high), F.lit(low) if isinstance(low, (int, float)) else low)


def clip_and_fix_box(b: Column, w: Column, h: Column) -> Column:
    """xywh of the box clipped to [0, w - 1e-4] x [0, h - 1e-4], sides at least 1e-3."""
    x1, x2 = (clamp(b[k], 0.0, w - 1e-4) for k in ("x1", "x2"))
    y1, y2 = (clamp(b[k], 0.0, h - 1e-4) for k in ("y1", "y2"))
    return F.struct(x1.alias("x"), y1.alias("y"), F.greatest(x2 - x1, F.lit(1e-3)).alias("w"), F.greatest(y2 - y1, F.lit(1e-3)).alias("h"))


def clamp_to_image(b: Column, w: Column, h: Column) -> Column:
    return box(clamp(b["x1"], 0.0, w), clamp(b["y1"], 0.0, h), clamp(b["x2"], 0.0, w), clamp(b["y2"], 0.0, h))


def is_proper(b: Column) -> Column:
    return (b["x2"] > b["x1"]) & (b["y2"] > b["y1"])


def hflip_box(b: Column, w: Column) -> Column:
    return box(w - b["x2"], b["y1"], w - b["x1"], b["y2"])


def scale_box(b: Column, sx: Column, sy: Column) -> Column:
    return box(b["x1"] * sx, b["y1"] * sy, b["x2"] * sx, b["y2"] * sy)


def shift_box(b: Column, dx: Column, dy: Column) -> Column:
    return box(b["x1"] - dx, b["y1"] - dy, b["x2"] - dx, b["y2"] - dy)


def normalize_box(b: Column, w: Column, h: Column) -> Column:
    c = box_xyxy_to_cxcywh(b)
    return F.struct((c["cx"] / w).alias("cx"), (c["cy"] / h).alias("cy"), (c["w"] / w).alias("w"), (c["h"] / h).alias("h"))


def resize_dims(w: Column, h: Column, size: int, max_size: int | None = None) -> tuple[Column, Column]:
    """New (width, height): the short side becomes ``size``, less where the long side would pass ``max_size``; the other
    side is truncated to an integer. An image whose short side has the size already keeps both."""
    short, long = F.least(w, h), F.greatest(w, h)
    goal = F.lit(float(size))
    if max_size is not None:
        goal = F.when(long / short * size > max_size, F.rint(max_size * short / long)).otherwise(goal)
    other = F.floor(goal * long / short)
    same = short == goal
    return (
        F.when(same, w).when(w < h, goal).otherwise(other).cast("int"),
        F.when(same, h).when(w < h, other).otherwise(goal).cast("int"),
    )


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def inverse_sigmoid(p: Column, eps: float = 1e-5) -> Column:
    x = clamp(p, 0.0, 1.0)
    return F.ln(F.greatest(x, F.lit(eps)) / F.greatest(1 - x, F.lit(eps)))


def seeded_uniform(seed: int, *keys: Column) -> Column:
    """A reproducible draw from [0, 1) for the given keys."""
    return F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(1 << 52)) / F.lit(float(1 << 52))
