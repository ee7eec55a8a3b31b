"""Polygon expressions: a ring is array<struct<x double, y double>>, implicitly closed."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions.boxes import box, clamp

POINTS = "array<struct<x:double,y:double>>"
POINTS_TYPE = T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))


def let(value: Column, use) -> Column:
    """``use(value)``, the value computed once for a row: a lambda's argument isn't inlined where it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def _at(ring: Column, i: Column) -> Column:
    """Vertex i, cyclically."""
    return F.get(ring, F.pmod(i, F.size(ring)).cast("int"))


def xs(ring: Column) -> Column:
    return F.transform(ring, lambda p: p["x"])


def ys(ring: Column) -> Column:
    return F.transform(ring, lambda p: p["y"])


def polygon_bounds(ring: Column) -> Column:
    return box(F.array_min(xs(ring)), F.array_min(ys(ring)), F.array_max(xs(ring)), F.array_max(ys(ring)))


def polygon_bbox(ring: Column) -> Column:
    """xywh of the vertices; NULL fields for an empty ring."""
    x, y = F.array_min(xs(ring)), F.array_min(ys(ring))
    return F.struct(x.alias("x"), y.alias("y"), (F.array_max(xs(ring)) - x).alias("w"), (F.array_max(ys(ring)) - y).alias("h"))


def polygon_area(ring: Column) -> Column:
    """Shoelace area, never negative; 0 for fewer than three vertices."""
    turned = lambda r: F.concat(F.slice(r, 2, F.size(r)), F.slice(r, 1, 1))  # noqa: E731  each vertex's next one
    cross = let(ring, lambda r: F.zip_with(r, turned(r), lambda p, q: p["x"] * q["y"] - q["x"] * p["y"]))
    return F.abs(F.aggregate(cross, F.lit(0.0), lambda a, x: a + x)) / 2


def normalize_polygon(ring: Column, w: Column, h: Column) -> Column:
    return F.transform(ring, lambda p: point(p["x"] / w, p["y"] / h))


def denormalize_polygon(ring: Column, w: Column, h: Column) -> Column:
    return F.transform(ring, lambda p: point(p["x"] * w, p["y"] * h))


def flat_to_points(flat: Column) -> Column:
    n = F.floor(F.size(flat) / 2).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: point(F.get(flat, 2 * i), F.get(flat, 2 * i + 1)))).otherwise(F.array().cast(POINTS))


def points_to_flat(ring: Column) -> Column:
    return F.flatten(F.transform(ring, lambda p: F.array(p["x"], p["y"])))


def remove_close_vertices(ring: Column, eps: float = 0.1) -> Column:
    """Without the vertices that lie within ``eps`` of the next one (one pass, the last looks at the first)."""
    return let(ring, lambda r: F.filter(r, lambda p, i: F.hypot(p["x"] - _at(r, i + 1)["x"], p["y"] - _at(r, i + 1)["y"]) > eps))


def canonical_start(ring: Column) -> Column:
    """Rotated to begin with the first vertex of the least x + y."""
    least = lambda r: let(F.transform(r, lambda p: p["x"] + p["y"]), lambda v: F.array_position(v, F.array_min(v)).cast("int"))
    return let(ring, lambda r: F.when(F.size(r) > 0, F.concat(F.slice(r, least(r), F.size(r)), F.slice(r, F.lit(1), least(r) - 1))).otherwise(r))


def clip_polygon(ring: Column, w: Column, h: Column) -> Column:
    return F.transform(ring, lambda p: point(clamp(p["x"], 0.0, w - 1e-4), clamp(p["y"], 0.0, h - 1e-4)))


def hflip_polygon(ring: Column, w: Column) -> Column:
    return F.transform(ring, lambda p: point(w - p["x"], p["y"]))


def vertex_cosines(ring: Column) -> Column:
    """Cosine between the edge into each vertex and the edge out of it: 1 straight on, 0 a right angle, -1 back."""

    def cosine(r: Column, p: Column, i: Column) -> Column:
        a, b = _at(r, i - 1), _at(r, i + 1)
        ix, iy, ox, oy = p["x"] - a["x"], p["y"] - a["y"], b["x"] - p["x"], b["y"] - p["y"]
        return (ix * ox + iy * oy) / ((F.hypot(ix, iy) + 1e-6) * (F.hypot(ox, oy) + 1e-6))

    return let(ring, lambda r: F.transform(r, lambda p, i: cosine(r, p, i)))


def _turn(a: Column, b: Column, c: Column) -> Column:
    return F.signum((b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"]))


def _within(a: Column, b: Column, c: Column) -> Column:
    """c lies in the box of a and b."""
    return c["x"].between(F.least(a["x"], b["x"]), F.greatest(a["x"], b["x"])) & c["y"].between(F.least(a["y"], b["y"]), F.greatest(a["y"], b["y"]))


def segments_meet(a: Column, b: Column, c: Column, d: Column) -> Column:
    t1, t2, t3, t4 = _turn(a, b, c), _turn(a, b, d), _turn(c, d, a), _turn(c, d, b)
    touch = ((t1 == 0) & _within(a, b, c)) | ((t2 == 0) & _within(a, b, d)) | ((t3 == 0) & _within(c, d, a)) | ((t4 == 0) & _within(c, d, b))
    return ((t1 != t2) & (t3 != t4)) | touch


def is_self_intersecting(ring: Column) -> Column:
    """Do two edges that share no vertex meet? A collinear touch counts; rings of under four vertices don't."""
    edges = let(ring, lambda r: F.transform(r, lambda p, i: F.struct(p.alias("a"), _at(r, i + 1).alias("b"))))
    meet = lambda e, f: segments_meet(e["a"], e["b"], f["a"], f["b"])
    # edges i and j > i + 1, but for the last one with the first
    later = lambda es, i: F.slice(es, i + 3, F.when(i == 0, F.greatest(F.size(es) - 3, F.lit(0))).otherwise(F.size(es)))
    hit = let(edges, lambda es: F.exists(F.transform(es, lambda e, i: F.struct(e.alias("e"), later(es, i).alias("fs"))), lambda x: F.exists(x["fs"], lambda f: meet(x["e"], f))))
    return F.when(F.size(ring) < 4, F.lit(False)).otherwise(hit)


def repair_self_intersection(ring: Column) -> Column:
    """Self-intersecting rings get their vertices in order of angle about their mean."""
    mean = lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / F.size(v)

    def turned(r: Column) -> Column:
        return let(F.struct(mean(xs(r)).alias("x"), mean(ys(r)).alias("y")), lambda m: F.transform(F.sort_array(F.transform(r, lambda p, i: F.struct(F.atan2(p["y"] - m["y"], p["x"] - m["x"]).alias("t"), i.alias("i"), p.alias("p")))), lambda s: s["p"]))

    return let(ring, lambda r: F.when(is_self_intersecting(r), turned(r)).otherwise(r))


def densify_polygon(ring: Column, factor: int = 10) -> Column:
    """``factor`` points on every edge, its end left out."""
    steps = F.sequence(F.lit(0), F.lit(factor - 1))
    step = lambda p, q: F.transform(steps, lambda k: point(p["x"] + (q["x"] - p["x"]) * k / factor, p["y"] + (q["y"] - p["y"]) * k / factor))
    return let(ring, lambda r: F.flatten(F.transform(r, lambda p, i: step(p, _at(r, i + 1)))))


def box_to_ring(b: Column, n: int = 64) -> Column:
    """n // 4 points on each side, ends included, clockwise from the top left; the last point fills up to n."""
    per = n // 4
    steps = [i / (per - 1) if per > 1 else 0.0 for i in range(per)]
    unit = [(s, 0.0) for s in steps] + [(1.0, s) for s in steps] + [(1.0 - s, 1.0) for s in steps] + [(0.0, 1.0 - s) for s in steps]
    unit += [unit[-1]] * (n - len(unit))
    w, h = b["x2"] - b["x1"], b["y2"] - b["y1"]
    return F.transform(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in unit]), lambda p: point(b["x1"] + p["x"] * w, b["y1"] + p["y"] * h))


def settled(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with ``value`` computed in a step of its own: Arrow functions don't take arguments with lambdas."""
    return df.withColumn(name, F.explode(F.array(value)))


def points_of(rings: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """x and y of all points of a batch, end to end, and each ring's number of points (0 for a null one)."""
    x, y = (f.to_numpy(zero_copy_only=False).astype(float) for f in rings.flatten().flatten())
    return x, y, pc.list_value_length(rings).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def _rings(x: np.ndarray, y: np.ndarray, sizes: np.ndarray, null: np.ndarray | None = None) -> pa.Array:
    offsets = pa.array(np.concatenate([[0], sizes.cumsum()]), pa.int32(), mask=None if null is None else np.append(null, False))
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(x), pa.array(y)], ["x", "y"]))


def far_vertices(x: np.ndarray, y: np.ndarray, sizes: np.ndarray, tolerance: float) -> np.ndarray:
    """Douglas-Peucker flags of the points of many chains, end to end: all pieces of all chains are split side by side."""
    flags = np.zeros(len(x), dtype=bool)
    a = (sizes.cumsum() - sizes)[sizes > 0]
    b = a + sizes[sizes > 0] - 1
    flags[a] = flags[b] = True
    while True:
        long = b - a > 1
        a, b = a[long], b[long]
        if not len(a):
            return flags
        n = b - a - 1
        first = n.cumsum() - n
        piece = np.repeat(np.arange(len(a)), n)
        at = np.arange(len(piece)) + np.repeat(a + 1 - first, n)
        dx, dy = x[b] - x[a], y[b] - y[a]
        length = dx * dx + dy * dy
        dx, dy, ix, iy = dx[piece], dy[piece], x[at] - x[a][piece], y[at] - y[a][piece]
        with np.errstate(divide="ignore", invalid="ignore"):
            t = np.where(length[piece] != 0, np.clip((ix * dx + iy * dy) / length[piece], 0, 1), 0.0)
        d = (ix - t * dx) ** 2 + (iy - t * dy) ** 2
        most = np.maximum.reduceat(d, first)
        far = most > tolerance * tolerance
        hit = np.flatnonzero((d == most[piece]) & far[piece])
        hit = hit[np.diff(piece[hit], prepend=-1) > 0]  # the first of ties
        k = at[hit]
        flags[k] = True
        a, b = np.concatenate([a[far], k]), np.concatenate([k, b[far]])


#: Pairs of points, or of vertices and samples, that are compared at once.
AT_ONCE = 1 << 20


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def nearest_squared(ring: pa.Array, other: pa.Array) -> pa.Array:
    """Squared distance of each point of ``ring`` to the nearest point of ``other`` (null without any); all rows of a batch side by side.
    Arguments with lambdas must be ``settled`` first."""
    (x, y, sizes), (u, v, others) = points_of(ring), points_of(other)
    of = np.repeat(np.arange(len(sizes)), sizes)
    n, start = others[of], (others.cumsum() - others)[of]
    least = np.full(len(x), np.nan)
    some = np.flatnonzero(n)
    for part in np.array_split(some, max(1, -(-int(n.sum()) // AT_ONCE))):
        if len(part):
            ends = n[part].cumsum()
            p, q = np.repeat(part, n[part]), np.arange(ends[-1]) + np.repeat(start[part] - (ends - n[part]), n[part])
            least[part] = np.fmin.reduceat((x[p] - u[q]) * (x[p] - u[q]) + (y[p] - v[q]) * (y[p] - v[q]), ends - n[part])
    offsets = pa.array(np.concatenate([[0], sizes.cumsum()]), pa.int32(), mask=np.append(ring.is_null().to_numpy(zero_copy_only=False), False))
    return pa.ListArray.from_arrays(offsets, pa.array(least, mask=np.isnan(least)))


@F.arrow_udf(POINTS_TYPE)
def _simplified(ring: pa.Array, tolerance: pa.Array) -> pa.Array:
    """Douglas-Peucker has no end that built-in functions could know: it splits until nothing is far enough."""
    x, y, sizes = points_of(ring)
    kept = far_vertices(x, y, sizes, tolerance[0].as_py() if len(tolerance) else 0.0)
    so_far = np.concatenate([[0], kept.cumsum()])
    ends = sizes.cumsum()
    return _rings(x[kept], y[kept], so_far[ends] - so_far[ends - sizes], ring.is_null().to_numpy(zero_copy_only=False))


def simplify_polygon(ring: Column, tolerance: float = 0.01) -> Column:
    """Douglas-Peucker on the open chain from the first to the last vertex."""
    return _simplified(ring, F.lit(float(tolerance)))


def even_points(x: np.ndarray, y: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """x, y and corner flags of the n samples of rings with one number of vertices (rings x vertices)."""
    rows, m = x.shape
    ax, ay = np.roll(x, -1, axis=1) - x, np.roll(y, -1, axis=1) - y
    side = np.hypot(ax, ay)
    end = side.cumsum(axis=1)
    length = end[:, -1:] if m >= 3 else np.zeros((rows, 1))
    t = np.arange(n) * length / n
    # the side that a sample lies on: the first that ends beyond it
    on = np.zeros((rows, n), dtype=np.int64)
    for v in range(m - 1):
        on += end[:, v, None] <= t
    each = np.arange(rows)[:, None]
    along = t - (end - side)[each, on]
    with np.errstate(divide="ignore", invalid="ignore"):
        sx, sy = np.nan_to_num(ax / side), np.nan_to_num(ay / side)
    px, py = x[each, on] + along * sx[each, on], y[each, on] + along * sy[each, on]
    flat = length[:, 0] < 1e-6
    px[flat], py[flat] = x[flat, :1], y[flat, :1]
    fx, fy, corner = px.copy(), py.copy(), np.zeros((rows, n), dtype=np.int32)
    proper = np.flatnonzero(~flat)
    for v in range(m):
        taken = ((px - x[:, v, None]) ** 2 + (py - y[:, v, None]) ** 2).argmin(axis=1)[proper]
        fx[proper, taken], fy[proper, taken], corner[proper, taken] = x[proper, v], y[proper, v], 1
    return fx, fy, corner


def evenly(x: np.ndarray, y: np.ndarray, sizes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(x, y, corner flags, sizes) of the n samples of each ring, end to end. Rings that have the same number of vertices are worked on
    together, as one array."""
    starts, got = sizes.cumsum() - sizes, sizes > 0
    out = [np.zeros((len(sizes), n)), np.zeros((len(sizes), n)), np.zeros((len(sizes), n), dtype=np.int32)]
    for m in np.unique(sizes[got]).tolist():
        same = np.flatnonzero(sizes == m)
        for rows in np.array_split(same, -(-len(same) * max(m, n) // AT_ONCE)):
            at = starts[rows][:, None] + np.arange(m)
            for to, value in zip(out, even_points(x[at], y[at], n)):
                to[rows] = value
    return *(v[got].reshape(-1) for v in out), np.where(got, n, 0)


FLAGGED = T.StructType([T.StructField("ring", POINTS_TYPE), T.StructField("corners", T.ArrayType(T.IntegerType()))])


def flagged_rings(x: np.ndarray, y: np.ndarray, corner: np.ndarray, sizes: np.ndarray) -> pa.Array:
    corners = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], sizes.cumsum()]), pa.int32()), pa.array(corner))
    return pa.StructArray.from_arrays([_rings(x, y, sizes), corners], ["ring", "corners"])


@F.arrow_udf(FLAGGED)
def _even_points(ring: pa.Array, counts: pa.Array) -> pa.Array:
    return flagged_rings(*evenly(*points_of(ring), counts[0].as_py() if len(counts) else 0))


def resample_polygon(ring: Column, n: int = 64) -> Column:
    """struct(ring, corners): n points at equal steps along the closed ring from its first vertex. Every vertex then
    replaces its nearest sample (the first of ties; later vertices win) and flags it 1. Rings of under three vertices or
    without length repeat their first point, unflagged; empty and null ones give no points."""
    return _even_points(ring, F.lit(n))
