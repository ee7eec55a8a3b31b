"""Ordered scans against loops: long runs over many tasks, short ones, gaps, both directions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import thresholds, windows
from tessella.operators.scan import Affine, Automaton, Last, Trail, ordered_scan


def test_long_run_over_many_tasks(spark):
    """A run of 10^6 steps lies in every task of the scan; short runs lie around it."""
    n = 1_000_000
    long = spark.range(n).select(F.lit("b").alias("run"), (F.col("id") * 2).alias("step"), F.when(F.col("id") % 1000 != 7, (F.col("id") * 7919 % 1000) / 1000).alias("x"))
    short = spark.range(60).select(F.when(F.col("id") % 3 > 0, F.when(F.col("id") % 3 == 1, "a").otherwise("c")).alias("run"), F.col("id").alias("step"), (F.col("id") % 7 / 7).alias("x"))
    got = windows.ema_fold(long.unionByName(short), ["run"], "step", "x", 0.4, 0.95, 0.35, 0.65)
    assert got.count() == n + 60
    assert got.where("run = 'b'").groupBy(F.spark_partition_id()).count().count() >= 4
    values = [(i * 7919 % 1000) / 1000 if i % 1000 != 7 else None for i in range(n)]
    v, want = 0.4, []
    for x in values:
        v = v if x is None else min(max(0.95 * v + x * (1 - 0.95), 0.35), 0.65)
        want.append(v)
    b = got.where("run = 'b'").orderBy("step").select("ema").toPandas().ema.to_numpy()
    assert np.abs(b - np.array(want)).max() < 1e-12
    for run, rest in ((None, 0), ("a", 1), ("c", 2)):
        v = 0.4
        for r in got.where(F.col("run").eqNullSafe(run)).orderBy("step").collect():
            v = min(max(0.95 * v + r.step % 7 / 7 * (1 - 0.95), 0.35), 0.65)
            assert r.step % 3 == rest and math.isclose(v, r.ema, rel_tol=1e-12)


@pytest.mark.parametrize("seed", range(3))
def test_every_monoid_against_loops(spark, seed):
    rng = random.Random(seed)
    rows = [(f"k{min(int(rng.expovariate(0.7)), 5)}", i, rng.choice([None, rng.random(), rng.random()]), [rng.randrange(3) for _ in range(3)]) for i in rng.sample(range(900), 300)]
    df = spark.createDataFrame(rows, "k string, o int, x double, t array<int>").repartition(6)
    table = [F.get("t", F.lit(i)).cast("double") for i in range(3)]
    scans = {"known": (Last, Last.step(F.col("x"), F.col("o"))), "trail": (Trail, Trail.step(F.col("x"))), "machine": (Automaton(3), table), "line": (Affine, Affine.step(F.col("x"), 0.5, F.col("x"), -0.2, 1.2))}
    for descending in (False, True):
        got = {(r.k, r.o): r for r in ordered_scan(df, ["k"], "o", scans, descending, before=("trail", "machine")).collect()}
        assert len(got) == len(rows)
        for k in {r[0] for r in rows}:
            known, last, greatest, state, v = None, None, None, [0, 1, 2], 0.25
            for _, o, x, t in sorted((r for r in rows if r[0] == k), key=lambda r: -r[1] if descending else r[1]):
                r = got[k, o]
                none = lambda f: None if math.isnan(f) else f
                assert (none(r.trail.s1), none(r.trail.s2)) == (last, greatest)
                assert [r.machine.s0, r.machine.s1, r.machine.s2] == state
                known = (o, x) if x is not None else known
                assert (r.known.s1, r.known.s2) == known if known else r.known.s0 == 0
                v = v if x is None else min(max(v * 0.5 + x, -0.2), 1.2)
                assert math.isclose(min(max(0.25 * r.line.s0 + r.line.s1, r.line.s2), r.line.s3), v, abs_tol=1e-12)
                greatest = max((y for y in (greatest, last) if y is not None), default=None)
                last, state = x, [t[s] for s in state]


def test_scan_without_rows_and_of_one_row(spark):
    schema = "run_id long, epoch int, conf_mean double, conf_kept double, src_ap double"
    empty = spark.createDataFrame([], schema)
    assert windows.retrain_policy(empty).count() == windows.fill_and_smooth(empty, "src_ap", 2.0).count() == 0
    one = spark.createDataFrame([(1, 31, None, None, None)], schema)
    assert [r.action for r in windows.retrain_policy(one).collect()] == ["none"]
    assert [(r.filled, r.smoothed) for r in windows.fill_and_smooth(one, "src_ap", 2.0).collect()] == [(None, None)]


def test_policy_with_gaps_between_epochs(spark):
    """Epochs that jump, against a loop."""
    rng = random.Random(4)
    rows, e = [], 0
    for _ in range(400):
        e += rng.choice([1, 1, 1, 2, 5, 9])
        rows.append((7, e, rng.choice([None, rng.random()]), rng.random()))
    got = {r.epoch: r for r in windows.retrain_policy(spark.createDataFrame(rows, "run_id int, epoch int, conf_mean double, conf_kept double")).collect()}
    last, before, best, older = -(10**9), None, None, []
    for _, e, mean, kept in rows:
        pm, pk = before if before else (None, None)
        stage, every = e - 30, 15 if e <= 60 else 20 if e <= 120 else 30
        schedule = stage > 0 and stage % every == 0
        event = stage > 0 and best is not None and pm is not None and best - pm >= 0.03
        gate = (pm is not None and pm <= 0.26) or (pk is not None and pk <= 0.55)
        action = "none" if not (schedule or event) else "skip_cooldown" if e - last < 6 else "retrain_event" if event else "retrain_schedule" if gate else "skip_gate"
        last = e if action.startswith("retrain") else last
        r = got[e]
        assert (r.schedule_due, r.event_due, r.action) == (schedule, event, action)
        best = max((x for x in (best, pm) if x is not None), default=None)
        before = (mean, kept)
    assert {"skip_cooldown", "retrain_event", "none"} <= {r.action for r in got.values()}


def test_sigma_threshold_of_many_steps(spark):
    n = 3000
    df = spark.range(n * 8).select((F.col("id") / 8).cast("int").alias("step"), F.lit(1).alias("image_id"), F.col("id").alias("det_id"), (0.3 + F.col("id") * 13 % 70 / 100).alias("score"))
    got = {r.step: r for r in thresholds.sigma_threshold(df, 2.0).collect()}
    mu, sigma = 0.4, 0.1
    for step in range(n):
        x = np.array([0.3 + i * 13 % 70 / 100 for i in range(step * 8, step * 8 + 8)])
        mu, sigma = 0.99 * mu + 0.01 * x.mean(), 0.99 * sigma + 0.01 * x.std()
        w = min((step + 1) / 10, 1)
        tau = w * (mu - sigma) + (1 - w) * 0.4
        tau = (tau + 0.4) / 2 if abs(tau - 0.4) > 0.3 else tau
        assert math.isclose(got[step].mu, mu, rel_tol=1e-9) and math.isclose(got[step].sigma, sigma, rel_tol=1e-9) and math.isclose(got[step].threshold, min(max(tau, 0.4), 0.75), rel_tol=1e-9)
