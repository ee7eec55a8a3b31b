"""Window functions and ordered scans over runs, epochs and scores."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.scan import Affine, Automaton, Last, Trail, ordered_scan


def smoothed_meter(df: DataFrame, keys: list[str], order: str, value: str, k: int = 20) -> DataFrame:
    """Over the last k updates: lower median, mean, max, last value; and the mean over all so far."""
    whole = Window.partitionBy(*keys).orderBy(order)
    last = whole.rowsBetween(-k + 1, 0)
    v = F.sort_array(F.collect_list(value).over(last))
    n = F.count(value).over(last)
    return df.select(
        *keys, order, value,
        F.element_at(v, F.greatest(F.floor((n + 1) / 2), F.lit(1)).cast("int")).alias("median"),
        F.avg(value).over(last).alias("mean"), F.max(value).over(last).alias("max"), F.last(value).over(last).alias("last"),
        F.avg(value).over(whole.rowsBetween(Window.unboundedPreceding, 0)).alias("global_mean"),
    )


def top_k(df: DataFrame, group: str, k: int, score: str, tie: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(score), tie))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_rank")


def top_classes(probs: DataFrame, k: int = 100) -> DataFrame:
    """(image_id, query_id, probs array) -> the k best (query, class) pairs of each image, ties by query then class."""
    flat = probs.select("image_id", "query_id", F.posexplode("probs").alias("class_id", "score"))
    rank = F.row_number().over(Window.partitionBy("image_id").orderBy(F.desc("score"), "query_id", "class_id"))
    return flat.withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_rank")


def best_class(probs: Column, without_last: bool = False) -> Column:
    """struct(score, class_id): the largest probability and the first class that has it."""
    p = F.slice(probs, F.lit(1), F.greatest(F.size(probs) - 1, F.lit(0))) if without_last else probs
    return F.struct(F.array_max(p).alias("score"), (F.array_position(p, F.array_max(p)) - 1).cast("int").alias("class_id"))


def epoch_context(log: DataFrame, run: str = "run_id", epoch: str = "epoch") -> DataFrame:
    """``log`` with prev_conf_mean, prev_conf_kept and the best conf_mean of all earlier epochs."""
    w = Window.partitionBy(run).orderBy(epoch)
    return log.select("*", F.lag("conf_mean").over(w).alias("prev_conf_mean"), F.lag("conf_kept").over(w).alias("prev_conf_kept"), F.max("conf_mean").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("best_conf"))


def carry_forward(log: DataFrame, value: str, anchor_epoch: int, run: str = "run_id", epoch: str = "epoch") -> DataFrame:
    """last_<value>: the last one known so far; anchor_<value>: the last one known at ``anchor_epoch``."""
    w = Window.partitionBy(run).orderBy(epoch)
    known = log.withColumn(f"last_{value}", F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return known.withColumn(f"anchor_{value}", F.max(F.when(F.col(epoch) == anchor_epoch, F.col(f"last_{value}"))).over(Window.partitionBy(run)))


def best_so_far(df: DataFrame, score: str, passes: Column, run: str = "run_id", epoch: str = "epoch") -> DataFrame:
    """is_best: passes, and scores above every earlier row of the run that passed."""
    earlier = Window.partitionBy(run).orderBy(epoch).rowsBetween(Window.unboundedPreceding, -1)
    best = F.max(F.when(passes, F.col(score))).over(earlier)
    return df.withColumn("best_before", best).withColumn("is_best", F.coalesce(passes & F.col(score).isNotNull() & (F.col("best_before").isNull() | (F.col(score) > F.col("best_before"))), F.lit(False)))


def fill_and_smooth(df: DataFrame, value: str, com: float, run: str = "run_id", order: str = "epoch") -> DataFrame:
    """filled: gaps on the line between their neighbours, later ones at the last value; smoothed: exponentially weighted
    mean with alpha = 1 / (1 + com) and adjusted weights. Leading gaps stay NULL. Three parallel scans, whatever a run's length."""
    known = (Last, Last.step(F.col(value), F.col(order)))
    near = ordered_scan(ordered_scan(df.select(run, order, value), [run], order, {"_b": known}), [run], order, {"_a": known}, descending=True)
    (b, bo), (a, ao) = ((Last.value(F.col(n)), Last.order(F.col(n))) for n in ("_b", "_a"))
    line = b + (a - b) * (F.col(order) - bo) / (ao - bo)
    filled = near.withColumn("filled", F.coalesce(F.col(value), F.when(a.isNotNull() & b.isNotNull(), line), b)).drop("_a", "_b")
    keep, free = F.lit(com / (1 + com)), [F.lit(-math.inf), F.lit(math.inf)]
    sums = {"_num": (Affine, [keep, F.coalesce("filled", F.lit(0.0)), *free]), "_den": (Affine, [keep, F.col("filled").isNotNull().cast("double"), *free])}
    done = ordered_scan(filled, [run], order, sums)
    return done.select(run, order, value, "filled", F.try_divide(*[Affine.apply(F.col(n), 0.0) for n in sums]).alias("smoothed"))


def ema_step(value: str, momentum: float, low: float | None = None, high: float | None = None) -> tuple:
    """A step of the running mean for ordered_scan."""
    x = F.col(value).cast("double")
    return Affine, Affine.step(x, momentum, x * (1 - momentum), -math.inf if low is None else low, math.inf if high is None else high)


def ema_fold(df: DataFrame, keys: list[str], order: str, value: str, start: float, momentum: float, low: float | None = None, high: float | None = None) -> DataFrame:
    """Running v <- m v + (1 - m) x in order, clamped at every step where bounds are given; NULL and NaN leave v as it is. A
    parallel scan: a run may be of any length."""
    run = ordered_scan(df.select(*keys, order, F.col(value).cast("double").alias(value)), keys, order, {"_v": ema_step(value, momentum, low, high)})
    return run.select(*keys, order, value, Affine.apply(F.col("_v"), start).alias("ema"))


def retrain_policy(log: DataFrame, burn_in: int = 30, cooldown: int = 6, drop: float = 0.03, low_mean: float = 0.26, low_kept: float = 0.55, gate: bool = True) -> DataFrame:
    """(run_id, epoch, schedule_due, event_due, action): replay of the retraining policy over a run's epochs.

    Due by schedule: the stage epoch (epoch - burn_in) is positive and divisible by 15 up to epoch 60, 20 up to 120, then
    30. Due by event: conf_mean of the epoch before fell at least ``drop`` under the best before it. A due epoch within
    ``cooldown`` of the last retraining is skipped; else an event fires past the gate; else the gate decides: the epoch
    before must exist and have conf_mean <= low_mean or conf_kept <= low_kept; a gate that is off passes.

    Two parallel scans: what is known of the epochs before; then a machine whose state is the epochs since the last
    retraining, up to ``cooldown``, so a row's step is a table of cooldown + 1 states.
    """
    past = {"_m": (Trail, Trail.step(F.col("conf_mean"))), "_k": (Trail, Trail.step(F.col("conf_kept"))), "_e": (Last, Last.step(F.col("epoch"), F.col("epoch")))}
    rows = ordered_scan(log.select("run_id", "epoch", "conf_mean", "conf_kept"), ["run_id"], "epoch", past, before=tuple(past))
    mean, kept, best = Trail.last(F.col("_m")), Trail.last(F.col("_k")), Trail.greatest(F.col("_m"))
    stage = F.col("epoch") - burn_in
    every = F.when(F.col("epoch") <= 60, 15).when(F.col("epoch") <= 120, 20).otherwise(30)
    schedule = (stage > 0) & (stage % every == 0)
    event = (stage > 0) & F.coalesce(best - mean >= drop, F.lit(False))
    passes = F.coalesce((mean <= low_mean) | (kept <= low_kept), F.lit(False)) if gate else F.lit(True)
    gap = F.coalesce(F.col("epoch") - Last.value(F.col("_e")), F.lit(float(cooldown)))
    rows = rows.select("run_id", "epoch", schedule.alias("schedule_due"), event.alias("event_due"), passes.alias("_g"), gap.alias("_gap"))
    due = F.col("schedule_due") | F.col("event_due")
    since = lambda s: F.least(s + F.col("_gap"), F.lit(float(cooldown)))
    table = [F.when(due & (F.col("event_due") | F.col("_g")) & (since(F.lit(s)) >= cooldown), 0.0).otherwise(since(F.lit(s))) for s in range(cooldown + 1)]
    done = ordered_scan(rows, ["run_id"], "epoch", {"_s": (Automaton(cooldown + 1), table)}, before=("_s",))
    waits = since(F.col("_s")[f"s{cooldown}"]) < cooldown
    action = F.when(~due, "none").when(waits, "skip_cooldown").when(F.col("event_due"), "retrain_event").when(F.col("_g"), "retrain_schedule").otherwise("skip_gate")
    return done.select("run_id", "epoch", "schedule_due", "event_due", action.alias("action"))
