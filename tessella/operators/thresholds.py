"""Adaptive confidence thresholds and run selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators.aggregates import confidence_quantile, foreground_stats, top_half_mean
from tessella.operators.scan import Affine, ordered_scan
from tessella.operators.windows import ema_fold, ema_step


def _clamped(v: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(v, F.lit(high)), F.lit(low))


def quantile_threshold(df: DataFrame, keys: list[str], step: str, score: str, q: float = 0.94, init: float = 0.40, low: float = 0.35, high: float = 0.65, momentum: float = 0.95, source: Column | float = 0.40, weights: tuple[float, float] = (0.2, 0.8)) -> DataFrame:
    """(keys, step, quantile, ema, threshold): each step's quantile, its clamped running mean, and the blend with the
    source threshold, clamped. Weights are scaled to one; both near zero count as equal."""
    total = weights[0] + weights[1]
    ws, wt = (0.5, 0.5) if abs(total) < 1e-12 else (weights[0] / total, weights[1] / total)
    steps = confidence_quantile(df, [*keys, step], score, q)
    ema = ema_fold(steps, keys, step, "quantile", init, momentum, low, high)
    src = source if isinstance(source, Column) else F.lit(float(source))
    return ema.withColumn("threshold", _clamped(ws * src + wt * F.col("ema"), low, high))


def sigma_threshold(df: DataFrame, avg_objects: float, step: str = "step", burn_in: int = 0, k: float = 1.0, momentum: float = 0.99, warm_up: int = 10, low: float = 0.40, high: float = 0.75, check: float = 0.3, source: float = 0.40, init_mu: float = 0.40, init_sigma: float = 0.10) -> DataFrame:
    """(step, mu, sigma, threshold): running mean and deviation of foreground scores; tau = mu - k * sigma, blended in from
    the source threshold over ``warm_up`` steps, averaged with it when further than ``check`` away, clamped."""
    stats = foreground_stats(df, avg_objects, step).withColumn("_run", F.lit(0))
    run = ordered_scan(stats, ["_run"], step, {"_mu": ema_step("mu", momentum), "_sigma": ema_step("sigma", momentum)})
    both = run.select(step, Affine.apply(F.col("_mu"), init_mu).alias("mu"), Affine.apply(F.col("_sigma"), init_sigma).alias("sigma"))
    w = _clamped((F.col(step) - burn_in + 1) / float(warm_up), 0.0, 1.0)
    tau = w * (F.col("mu") - k * F.col("sigma")) + (1 - w) * source
    far = (F.abs(tau - source) > check) if check > 0 else F.lit(False)
    return both.withColumn("threshold", _clamped(F.when(far, (tau + source) / 2).otherwise(tau), low, high))


def class_threshold(df: DataFrame, step: str, cls: str, score: str, tie: str, present: DataFrame, low: float = 0.30, init: float = 0.35, high: float = 0.55, gamma: float = 0.95, a: float = 0.8, b: float = 1.0) -> DataFrame:
    """(class, step, mean, ema): gamma * old + (1 - gamma) * a * mean ** b of each present class's best half, clamped."""
    keyed = df.withColumn("_sc", F.struct(F.col(cls), F.col(step)))
    both = present.select(cls).distinct().join(df.select(cls, step).distinct(), cls).select(F.struct(F.col(cls), F.col(step)).alias("_sc"))
    means = top_half_mean(keyed, "_sc", score, tie, both).select(F.col(f"_sc.{cls}").alias(cls), F.col(f"_sc.{step}").alias(step), (a * F.pow("mean", b)).alias("mean"))
    return ema_fold(means, [cls], step, "mean", init, gamma, low, high)


def class_threshold_of(detections: DataFrame, latest: DataFrame, cls: str, unknown: float = 0.4) -> DataFrame:
    """Detections with the latest threshold of their class; unknown classes get ``unknown``."""
    return detections.join(latest, cls, "left").withColumn("threshold", F.coalesce("threshold", F.lit(unknown)))


def gates_and_score(df: DataFrame, burn_in: int = 30, source_keep: float = 0.95, pseudo: tuple[float, float] = (0.5, 1.8), weight: float = 0.5, avg_pseudo: Column | None = None) -> DataFrame:
    """``df`` (epoch, conf_mean, stability, n_pseudo, last_src_ap, anchor_src_ap) with passes_gates and composite.

    Gates: past the burn-in; the source AP keeps its share of the anchor; the pseudo-label count is within bounds of the
    average. The score is weight * confidence + (1 - weight) * stability, a missing confidence counting 0; without
    stability it is the confidence.
    """
    ok = (F.col("epoch") >= burn_in) & F.coalesce(F.col("last_src_ap") >= source_keep * F.col("anchor_src_ap"), F.lit(False))
    if avg_pseudo is not None:
        ok = ok & F.coalesce(F.col("n_pseudo").between(pseudo[0] * avg_pseudo, pseudo[1] * avg_pseudo), F.lit(False))
    score = F.when(F.col("stability").isNotNull(), weight * F.coalesce("conf_mean", F.lit(0.0)) + (1 - weight) * F.col("stability")).otherwise(F.col("conf_mean"))
    return df.withColumn("passes_gates", ok).withColumn("composite", score)
