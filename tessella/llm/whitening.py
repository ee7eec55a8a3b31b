"""Embedding whitening: distributed covariance, float32 eigenvectors refined by matrix products in higher precision."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Components returned, steps a unit of the vectors has, and what is added to every entry.
COMPONENTS, STEPS, SHIFT = 32, 64, 1_000_000
#: Largest whole number taken for 64 c: entries beyond it are taken as it (their deviations pass 64 bits anyway).
LARGEST = 1 << 40
#: Rows of a matrix in a partial sum's row, and partial sums that are added at a time.
BLOCK, FAN = 64, 32
#: Eigenvalues under this share of the largest, times the dimension, count as zero.
ZERO = 1e-14
WIDE = np.longdouble


def usable(vector: Column) -> Column:
    """Whether a vector is there and has finite entries only; an empty one is not usable."""
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))))
    return F.coalesce(finite & (F.size(vector) > 0), F.lit(False))


def whole_numbers(column: pa.Array, dim: int) -> np.ndarray:
    """floor(64 c), a row for each vector, as 64-bit whole numbers (SHIFT is left out: it is in every entry)."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    return np.clip(np.floor(flat * STEPS), -LARGEST, LARGEST).astype(np.int64)


def matrix_rows(task: int, m: np.ndarray, extra: np.ndarray, n: int) -> pa.RecordBatch:
    """A task's sums: one row for each BLOCK rows of the matrix, with the sums of the columns and the count of rows."""
    at = range(0, len(m), BLOCK)
    parts = [np.ascontiguousarray(m[i : i + BLOCK]).tobytes() for i in at]
    return pa.RecordBatch.from_arrays(
        [pa.array([task] * len(parts), pa.int32()), pa.array([i // BLOCK for i in at], pa.int32()), pa.array(parts, pa.binary()), pa.array([extra.tobytes()] * len(parts), pa.binary()), pa.array([n] * len(parts), pa.int64())],
        names=["task", "block", "m", "mean", "n"],
    )


PARTIAL = "task int, block int, m binary, mean binary, n long"


def merge(a: tuple, b: tuple, block: int) -> tuple:
    """Centred sums of two sets of rows as those of both (Chan): (n, means, rows of the matrix)."""
    (n, mean, m), (k, other, o) = a, b
    if not n or not k:
        return b if not n else a
    d = other - mean
    return n + k, mean + d * (k / (n + k)), m + o + np.outer(d[block * BLOCK : block * BLOCK + len(m)], d) * (n * k / (n + k))


def centred_sums(rows: DataFrame, as_floats, width: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, means, sum of the outer products of centred rows) of the vectors that ``as_floats`` makes of the column
    ``embedding``, in the order of a list. Every batch is centred before it is multiplied. Tasks hand on one matrix each; these are
    added block by block in three rounds, FAN at a time in the first two, and only the sum, bounded by the dimension, reaches the driver."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        n, mean, m = 0, np.zeros(width), np.zeros((width, width))
        for batch in batches:
            for x in as_floats(batch.column(0)):
                at = x.mean(axis=0)
                c = x - at
                k = len(x)
                d = at - mean
                m += c.T @ c + np.outer(d, d) * (n * k / (n + k))
                mean = mean + d * (k / (n + k))
                n += k
        if n:
            yield matrix_rows(TaskContext.get().partitionId(), m, mean, n)

    def add(table: pa.Table) -> pa.Table:
        got = sorted(table.to_pylist(), key=lambda r: r["task"])
        block = got[0]["block"]
        total = (0, None, None)
        for r in got:
            total = merge(total, (r["n"], np.frombuffer(r["mean"]), np.frombuffer(r["m"]).reshape(-1, width)), block)
        n, mean, m = total
        return pa.table({"task": pa.array([got[0]["task"] // FAN], pa.int32()), "block": pa.array([block], pa.int32()), "m": [m.tobytes()], "mean": [mean.tobytes()], "n": [n]})

    parts = rows.mapInArrow(sums, PARTIAL)
    few = F.floor(F.col("task") / FAN)
    for by in (["block", few], ["block", few], ["block"]):
        parts = parts.groupBy(*by).applyInArrow(add, PARTIAL)
    got = sorted(parts.collect(), key=lambda r: r.block)
    if not got:
        return 0, np.zeros(width), np.zeros((width, width))
    return got[0].n, np.frombuffer(got[0].mean), np.concatenate([np.frombuffer(r.m).reshape(-1, width) for r in got])


def batches_of(x: np.ndarray, size: int = 4096) -> Iterator[np.ndarray]:
    for i in range(0, len(x), size):
        yield x[i : i + size]


def exact_sums(rows: DataFrame, dim: int) -> tuple[int, list[int]]:
    """(n, sum of each dimension of x without its SHIFT), exact."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * dim
        for batch in batches:
            for x in batches_of(whole_numbers(batch.column(0), dim)):  # 2^12 rows of up to 2^40: no overflow
                n, total = n + len(x), [a + b for a, b in zip(total, x.sum(axis=0).tolist())]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array([n] * dim, pa.int64()), pa.array([v >> 40 for v in total], pa.int64()), pa.array([v & (LARGEST - 1) for v in total], pa.int64())], names=["dim", "n", "high", "low"])

    got = rows.mapInArrow(sums, "dim int, n long, high long, low long").groupBy("dim").agg(F.sum("n").alias("n"), F.sum("high").alias("high"), F.sum("low").alias("low")).collect()
    at = {r.dim: r for r in got}
    return (got[0].n if got else 0), [(at[j].high << 40) + at[j].low if j in at else 0 for j in range(dim)]


def clusters_of(values: np.ndarray, gap: float) -> list[range]:
    """Runs of ascending values that follow one another within ``gap``."""
    edges = [0, *(np.flatnonzero(np.diff(values) > gap) + 1).tolist(), len(values)]
    return [range(a, b) for a, b in zip(edges[:-1], edges[1:])]


def refine(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One Ogita-Aishima step in extended precision: (values, vectors, correction). From R = I - X'X and S = X'AX come the values
    s / (1 - r) and the correction E of X (I + E): (s_ij + v_j r_ij) / (v_j - v_i) where values are apart, r_ij / 2 where not."""
    r = np.eye(len(a), dtype=WIDE) - x.T @ x
    s = x.T @ (a @ x)
    s = (s + s.T) / 2  # else rounding over a small gap would cost orthogonality
    v = np.diag(s) / (1 - np.diag(r))
    off = s - np.diag(v)
    delta = 2 * (np.linalg.norm(off.astype(float)) + np.linalg.norm(a.astype(float)) * np.linalg.norm(r.astype(float)))
    apart = v[None, :] - v[:, None]
    far = np.abs(apart) > delta
    e = np.where(far, (s + v[None, :] * r) / np.where(far, apart, 1), r / 2)
    return v, x + x @ e, e


def eigen(a: np.ndarray, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """(values, unit vectors as columns), falling, of a symmetric matrix: float32 vectors refined until the correction is
    within double precision. Values that float32 doesn't tell apart are a cluster: its vectors span the right space
    after a step, and the eigenvectors of the cluster's own small matrix, its mean taken off, order them within; then the steps go on.
    Equal values keep any orthonormal vectors of their space. A zero matrix gives the unit axes."""
    d = len(a)
    scale = np.abs(a).max() if d else 0.0
    if not scale:
        return np.zeros(d), np.eye(d)
    low = np.linalg.eigh((a / scale).astype(np.float32))[1]
    wide, x = (a / scale).astype(WIDE), low.astype(WIDE)
    for turn in range(rounds):
        v, x, e = refine(wide, x)
        order = np.argsort(v, kind="stable")
        v, x = v[order], x[:, order]
        # in the first rounds a cluster is what float32 can't tell apart, then what doubles can't
        gap = float(np.abs(v).max()) * (1e-5 if turn < 3 else 1e-9) * np.sqrt(d)
        for c in clusters_of(v.astype(float), gap):
            if len(c) > 1:
                part = x[:, c.start : c.stop]
                middle = v[c.start : c.stop].mean()
                small = part.T @ (wide @ part) - middle * (part.T @ part)
                top = float(np.abs(small).max())
                if top:
                    turned = np.linalg.eigh(((small + small.T) / (2 * top)).astype(float))[1]
                    x[:, c.start : c.stop] = part @ turned.astype(WIDE)
        if turn >= 3 and float(np.abs(e).max()) < 1e-17 * d:
            break
    x = x + x @ (np.eye(d, dtype=WIDE) - x.T @ x) / 2
    v = (x * (wide @ x)).sum(axis=0)
    order = np.argsort(-v, kind="stable")
    return (v[order] * scale).astype(float), x[:, order].astype(float)


def whiten(rows: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for each usable row and component.

    ``rows`` needs ``vec_id`` and ``embedding`` (an array of numbers); other columns are left aside. Rows whose vector is null,
    empty, or holds null or non-finite entries go; so do rows of another length than the longest most frequent one. All
    others are fitted on and returned, repeated ids and vectors each. Components without variance have whitened null (explained
    0, or null if nothing varies) and count nothing for identity_error. A deviation that passes 64 bits is null. Without
    usable rows the result is empty. Three scans: exact sums, centred covariance, whitened values' own covariance; what the
    driver holds are square matrices of the dimension, whatever the number of rows.
    """
    spark = rows.sparkSession
    good = rows.where(usable(F.col("embedding"))).select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    lengths = good.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).limit(1).collect()
    dim = lengths[0].dim if lengths else 1
    good = good.where(F.size("embedding") == dim)
    vectors = good.select("embedding")
    n, totals = exact_sums(vectors, dim)
    base = [t // n if n else 0 for t in totals]
    rest = [t - b * n for t, b in zip(totals, base)]  # n x - S is n (x - base) - rest, and 0 <= rest < n
    whole = np.array(base, dtype=np.int64)
    part = np.array([r / n if n else 0.0 for r in rest])

    def centred(column: pa.Array) -> Iterator[np.ndarray]:
        for x in batches_of(whole_numbers(column, dim)):
            yield (x - whole) - part

    v = centred_sums(vectors, centred, dim)[2] / max(n, 1)
    values, axes = eigen((v + v.T) / 2)
    some = min(components, dim)
    alive = int((values[:some] > ZERO * dim * max(values[0], 0.0)).sum()) if n else 0
    to = axes[:, :alive] / np.sqrt(values[:alive])

    def projected(column: pa.Array) -> Iterator[np.ndarray]:
        for x in centred(column):
            yield x @ to

    error = 0.0
    if alive:
        k, _, m = centred_sums(vectors, projected, alive)
        error = float(np.abs(m / k - np.eye(alive)).max())
    trace = float(np.trace(v))
    explained = [max(float(values[c]), 0.0) / trace if c < alive else 0.0 for c in range(some)] if trace else [None] * some
    shared = spark.sparkContext.broadcast((to, rest))

    def deviations(x: np.ndarray) -> list[int | None]:
        near = ((n * ((x - whole) - part)) ** 2).sum(axis=1)
        if len(x) and near.max() < 2.0**61:  # then every n x - S fits in 31 bits
            y = (x - whole) * n - np.array(shared.value[1], dtype=np.int64)
            return (y * y).sum(axis=1).tolist()
        exact = [sum((n * (a - b) - r) ** 2 for a, b, r in zip(row, base, shared.value[1])) for row in x.tolist()]
        return [e if e < 1 << 63 else None for e in exact]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2048):
                rows = batch.slice(i, 2048)
                x = whole_numbers(rows.column(1), dim)
                white = np.full((len(x), some), np.nan)
                white[:, :alive] = ((x - whole) - part) @ shared.value[0]
                at = np.repeat(np.arange(len(x)), some)
                flat = white.reshape(-1)
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column(0).take(pa.array(at)),
                        pa.array(np.tile(np.arange(1, some + 1, dtype=np.int32), len(x))),
                        pa.array(deviations(x), pa.int64()).take(pa.array(at)),
                        pa.array(flat, mask=np.isnan(flat)),
                        pa.array(explained * len(x), pa.float64()),
                    ],
                    names=["vec_id", "component", "deviation", "whitened", "explained"],
                )

    id_type = good.schema["vec_id"].dataType.simpleString()
    out = good.mapInArrow(project, f"vec_id {id_type}, component int, deviation long, whitened double, explained double")
    return out.select("vec_id", "component", F.lit(n).cast("long").alias("n"), "deviation", "whitened", "explained", F.lit(error).alias("identity_error"))


def op11_refined_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
