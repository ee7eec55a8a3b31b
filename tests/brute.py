"""Plain versions to compare with."""

import numpy as np


def fill_cells(ring: list, width: int, height: int, scale: int) -> tuple[int, int, np.ndarray]:
    """(first column, first row, cells): grid cells whose centre lies in the ring by the even-odd rule, within its box."""
    cols, rows = max(8, width // scale), max(8, height // scale)
    pts = np.array([(p["x"], p["y"]) for p in ring], dtype=float).reshape(-1, 2) * [cols / max(width, 1), rows / max(height, 1)]
    if len(pts) < 3:
        return 0, 0, np.zeros((0, 0), dtype=bool)
    x0, y0 = (int(max(0, v)) for v in np.floor(pts.min(axis=0)))
    x1, y1 = (int(v) for v in np.minimum(np.ceil(pts.max(axis=0)) + 1, [cols, rows]))
    if x1 <= x0 or y1 <= y0:
        return 0, 0, np.zeros((0, 0), dtype=bool)
    cx, cy = np.arange(x0, x1) + 0.5, np.arange(y0, y1) + 0.5
    inside = np.zeros((len(cy), len(cx)), dtype=bool)
    for (ax, ay), (bx, by) in zip(pts, np.roll(pts, -1, axis=0)):
        cross = (ay > cy) != (by > cy)
        if cross.any():
            at = ax + (cy[cross] - ay) * (bx - ax) / (by - ay)
            inside[cross] ^= cx[None, :] < at[:, None]
    return x0, y0, inside


def cells_iou(a: tuple, b: tuple) -> float:
    """IoU of two filled areas; 0 for an empty union."""
    (ax, ay, p), (bx, by, q) = a, b
    x0, y0, x1, y1 = max(ax, bx), max(ay, by), min(ax + p.shape[1], bx + q.shape[1]), min(ay + p.shape[0], by + q.shape[0])
    both = int((p[y0 - ay : y1 - ay, x0 - ax : x1 - ax] & q[y0 - by : y1 - by, x0 - bx : x1 - bx]).sum()) if x1 > x0 and y1 > y0 else 0
    total = int(p.sum()) + int(q.sum()) - both
    return both / total if total else 0.0


def greedy(rows: list, clash) -> set:
    """Ids of (group, id, score, shape) that greedy suppression keeps: by score, then id."""
    kept: dict = {}
    for g, i, _, shape in sorted(rows, key=lambda r: (-r[2], r[1])):
        if not any(clash(shape, other) for _, other in kept.setdefault(g, [])):
            kept[g].append((i, shape))
    return {(g, i) for g, some in kept.items() for i, _ in some}


def box_iou(a: tuple, b: tuple) -> float:
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    inner = max(w, 0) * max(h, 0)
    total = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inner
    return inner / total if total else 0.0
