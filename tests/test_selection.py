"""Order statistics by histogram refinement against sorting."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from tessella.operators import aggregates, selection


def groups(rng):
    return {
        None: [rng.random() for _ in range(700)] + [0.25] * 300, "tied": [1.5] * 400, "wide": [-1.7e308, 1.7e308, 0.0, -0.0] * 30 + [rng.gauss(0, 1) for _ in range(90)],
        "steps": [float(rng.randrange(5)) for _ in range(300)], "infinite": [math.inf, -math.inf] * 20 + [float(i) for i in range(41)], "one": [3.0], "none": [None, math.nan],
    }


def test_ranks_against_sorting(spark, monkeypatch):
    """Small and large buckets; ties, infinities and both ends of the doubles, NULL keys."""
    g = groups(random.Random(2))
    df = spark.createDataFrame([(k, v, 1) for k, vs in g.items() for v in vs], "k string, v double, n int").repartition(5)
    for buckets, few, shares in ((1024, 1024, (0.5,)), (64, 20, (0.0, 0.94))):
        monkeypatch.setattr(selection, "BUCKETS", buckets)
        monkeypatch.setattr(selection, "FEW", few)
        for share in shares:
            got = {r.k: r for r in selection.ranked_value(df, ["k"], "v", F.floor(share * (F.col("n") - 1))).collect()}
            assert got.keys() == g.keys() - {"none"}
            for k, r in got.items():
                vs = sorted(v for v in g[k] if v is not None and v == v)
                at = vs[math.floor(share * (len(vs) - 1))]
                assert (r.n, r.at, r.below, r.equal) == (len(vs), at, sum(v < at for v in vs), sum(v == at for v in vs))
                assert r.above == min((v for v in vs if v > at), default=None)
        assert selection.ranked_value(df, ["k"], "v", F.col("n")).count() == 0
    assert selection.ranked_value(df.limit(0), ["k"], "v", F.lit(0)).count() == 0


def test_quantile_and_top_half(spark):
    """One class holds nearly all rows."""
    rng = random.Random(5)
    rows = [("hot" if i % 20 else f"c{i % 7}", i, rng.choice([0.5, rng.random()])) for i in range(6000)]
    df = spark.createDataFrame(rows, "cls string, id int, s double").repartition(6)
    by = {}
    for k, _, s in rows:
        by.setdefault(k, []).append(s)
    for q in (0.1, 0.94):
        got = {r.cls: r.quantile for r in aggregates.confidence_quantile(df, ["cls"], "s", q).collect()}
        for k, vs in by.items():
            assert math.isclose(got[k], np.quantile(vs, min(max(q, 0.5), 0.99)), rel_tol=1e-12)
    present = df.where("cls <> 'c5'").select("cls")
    got = {r.cls: r.mean for r in aggregates.top_half_mean(df, "cls", "s", "id", present).collect()}
    assert got.keys() == by.keys() - {"c5"}
    for k, m in got.items():
        best = sorted(by[k], reverse=True)[: max(1, len(by[k]) // 2)]
        assert math.isclose(m, sum(best) / len(best), rel_tol=1e-12)
