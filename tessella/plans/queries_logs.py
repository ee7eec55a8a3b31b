"""Queries over metric logs, thresholds, policies and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessella.operators import aggregates as A
from tessella.operators import thresholds, windows
from tessella.plans.registry import off_half, query, r6, r9
from tessella.sources import logs
from tessella.sources.shared import discard, materialize, shared_dir
from tessella.streaming import meters

c = F.col


def scratch(fx) -> str:
    return f"{shared_dir(fx.spark)}/{uuid.uuid4().hex}"


@query("a4_threshold_log", "SELECT run_id, epoch, round(conf_mean, 6) AS avg_confidence, CASE WHEN epoch % 3 = 0 THEN 1 ELSE 0 END AS retrain_triggered, 0 AS retrain_schedule_due FROM fx_epochs")
def _(fx):
    path = scratch(fx)
    d = fx.epochs
    cols = {"epoch(epoch no.)": c("epoch"), "raw_threshold": F.lit(0.4), "target_ema_threshold": F.lit(0.4), "quantile_threshold": F.lit("x"), "effective_threshold（used）": F.lit(0.4), "avg_confidence": F.round("conf_mean", 6), "avg_confidence_kept": c("conf_kept")}
    flags = {"retrain_triggered": F.when(c("epoch") % 3 == 0, "yes").otherwise("no"), "retrain_due": F.lit("2.7")}
    d.select(*[v.alias(k) for k, v in {**cols, **flags}.items()], "run_id").write.partitionBy("run_id").csv(path, sep="\t", header=True)
    got = logs.read_threshold_log(fx.spark, path)
    return got.select(c("run_id").cast("long").alias("run_id"), "epoch", r6(c("avg_confidence")).alias("avg_confidence"), "retrain_triggered", "retrain_schedule_due")


@query("a5_a6_metric_log", "SELECT 'run' AS run, run_id, epoch, round(conf_mean, 6) AS conf_mean, round(stability, 6) AS stability, 'a b' AS note FROM fx_epochs")
def _(fx):
    path = scratch(fx)
    logs.append_log(fx.epochs.select("run_id", "epoch", "conf_mean", "stability", F.lit("a\tb").alias("note")), f"{path}/run")
    got = logs.read_metric_log(fx.spark, [f"{path}/run"])
    return got.select("run", "run_id", c("epoch").cast("int").alias("epoch"), r6(c("conf_mean")).alias("conf_mean"), r6(c("stability")).alias("stability"), "note")


@query("b27_scale_percentile", """SELECT step, CAST(floor(round(least(greatest((value-a)/greatest(z-a, 1e-6)*255, 0), 255), 9)) AS INT) AS scaled FROM fx_steps JOIN (SELECT metric, quantile_cont(value, 0.02) AS a, quantile_cont(value, 0.98) AS z FROM fx_steps GROUP BY metric) q USING (metric)""")
def _(fx):
    return A.scale_percentile(fx.steps, "metric", "value").select("step", "scaled")


@query("e1_avg_objects_per_image", "SELECT round(CAST((SELECT count(*) FROM fx_objects WHERE image_id IN (SELECT image_id FROM fx_images)) AS DOUBLE) / greatest(count(*), 1), 6) AS avg_objects FROM fx_images")
def _(fx):
    return A.avg_objects_per_image(fx.images, fx.objects).select(r6(c("avg_objects")).alias("avg_objects"))


@query("e2_keyed_mean", "SELECT metric, round(avg(value), 6) AS value FROM fx_steps GROUP BY metric")
def _(fx):
    return A.keyed_mean(fx.steps, "metric", "value").select("metric", r6(c("value")).alias("value"))


@query("e3_global_average", "SELECT metric, round(sum(value*(step % 5 + 1))/sum(step % 5 + 1), 6) AS average FROM fx_steps GROUP BY metric")
def _(fx):
    return A.global_average(fx.steps.withColumn("n", c("step") % 5 + 1), "metric", "value", "n").select("metric", r6(c("average")).alias("average"))


@query("e4_confidence_quantile", "SELECT det_id % 10 AS step, round(quantile_cont(score, 0.94), 6) AS quantile FROM fx_detections GROUP BY 1")
def _(fx):
    return A.confidence_quantile(fx.detections.withColumn("step", c("det_id") % 10), ["step"], "score", 0.94).select("step", r6(c("quantile")).alias("quantile"))


@query("e24_pr_summary", "SELECT run_id, round(avg(p), 6) AS precision, round(avg(r), 6) AS recall, round(avg(s), 6) AS score, round(2*avg(p)*avg(r)/(avg(p)+avg(r)+1e-8), 6) AS f1 FROM (SELECT run_id, conf_kept AS p, conf_mean AS r, n_pseudo AS s FROM fx_epochs) t GROUP BY run_id")
def _(fx):
    d = A.pr_summary(fx.epochs.select("run_id", c("conf_kept").alias("precision"), c("conf_mean").alias("recall"), c("n_pseudo").alias("score")), "run_id")
    return d.select("run_id", *[r6(c(k)).alias(k) for k in ("precision", "recall", "score", "f1")])


@query("e25_trigger_counts", "SELECT CASE WHEN e AND NOT s THEN 'event' ELSE 'schedule' END AS cause, count(*) AS n FROM (SELECT epoch % 4 = 0 AS e, epoch % 6 = 0 AS s, epoch % 2 = 0 AS t FROM fx_epochs) x WHERE t GROUP BY 1")
def _(fx):
    return A.trigger_counts(fx.epochs.select((c("epoch") % 4 == 0).alias("event_due"), (c("epoch") % 6 == 0).alias("schedule_due"), (c("epoch") % 2 == 0).alias("triggered")))


@query("e26_benchmark_summary", "SELECT metric, round(avg(value), 6) AS mean_s, round(4/avg(value), 6) AS rate FROM fx_steps WHERE step >= 5 GROUP BY metric")
def _(fx):
    return A.benchmark_summary(fx.steps, "metric", "step", "value", 5, 4).select("metric", r6(c("mean_s")).alias("mean_s"), r6(c("rate")).alias("rate"))


@query("f1_smoothed_meter", """SELECT metric, step, round(list_sort(v)[CAST(floor((len(v)+1)/2) AS INT)], 9) AS median, round(list_avg(v), 9) AS mean, round(list_max(v), 9) AS max, round(g, 9) AS global_mean FROM (
  SELECT metric, step, list(value) OVER (PARTITION BY metric ORDER BY step ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS v, avg(value) OVER (PARTITION BY metric ORDER BY step ROWS UNBOUNDED PRECEDING) AS g FROM fx_steps) t""")
def _(fx):
    d = windows.smoothed_meter(fx.steps, ["metric"], "step", "value", 20)
    return d.select("metric", "step", *[r9(c(k)).alias(k) for k in ("median", "mean", "max", "global_mean")])


@query("f5_epoch_context", "SELECT run_id, epoch, round(lag(conf_mean) OVER w, 6) AS prev_conf_mean, round(lag(conf_kept) OVER w, 6) AS prev_conf_kept, round(max(conf_mean) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 6) AS best_conf FROM fx_epochs WINDOW w AS (PARTITION BY run_id ORDER BY epoch)")
def _(fx):
    d = windows.epoch_context(fx.epochs)
    return d.select("run_id", "epoch", *[r6(c(k)).alias(k) for k in ("prev_conf_mean", "prev_conf_kept", "best_conf")])


@query("f6_carry_forward", """SELECT run_id, epoch, round(l, 6) AS last_src_ap, round(max(CASE WHEN epoch = 29 THEN l END) OVER (PARTITION BY run_id), 6) AS anchor_src_ap FROM (
  SELECT run_id, epoch, last_value(src_ap IGNORE NULLS) OVER (PARTITION BY run_id ORDER BY epoch ROWS UNBOUNDED PRECEDING) AS l FROM fx_epochs) t""")
def _(fx):
    return windows.carry_forward(fx.epochs, "src_ap", 29).select("run_id", "epoch", r6(c("last_src_ap")).alias("last_src_ap"), r6(c("anchor_src_ap")).alias("anchor_src_ap"))


@query("f7_best_so_far", """SELECT run_id, epoch, coalesce(p AND (b IS NULL OR conf_mean > b), false) AS is_best FROM (SELECT *, epoch % 2 = 0 AS p, max(CASE WHEN epoch % 2 = 0 THEN conf_mean END) OVER (PARTITION BY run_id ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM fx_epochs) t""")
def _(fx):
    return windows.best_so_far(fx.epochs, "conf_mean", c("epoch") % 2 == 0).select("run_id", "epoch", "is_best")


@query("f8_fill_and_smooth", """WITH RECURSIVE k AS (SELECT run_id, epoch, src_ap, last_value(CASE WHEN src_ap IS NOT NULL THEN {'o': epoch, 'v': src_ap} END IGNORE NULLS) OVER (PARTITION BY run_id ORDER BY epoch ROWS UNBOUNDED PRECEDING) AS b,
  first_value(CASE WHEN src_ap IS NOT NULL THEN {'o': epoch, 'v': src_ap} END IGNORE NULLS) OVER (PARTITION BY run_id ORDER BY epoch ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS a FROM fx_epochs),
  f AS (SELECT run_id, epoch, coalesce(src_ap, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN b.v + (a.v - b.v)*CAST(epoch - b.o AS DOUBLE)/(a.o - b.o) END, b.v) AS filled FROM k),
  e(run_id, epoch, filled, num, den) AS (SELECT run_id, epoch, filled, CAST(coalesce(filled, 0) AS DOUBLE), CAST(CASE WHEN filled IS NULL THEN 0 ELSE 1 END AS DOUBLE) FROM f WHERE epoch = 0
    UNION ALL SELECT f.run_id, f.epoch, f.filled, e.num*2.0/3 + coalesce(f.filled, 0), e.den*2.0/3 + CASE WHEN f.filled IS NULL THEN 0 ELSE 1 END FROM e JOIN f ON f.run_id = e.run_id AND f.epoch = e.epoch + 1)
  SELECT run_id, epoch, round(filled + 1e-12, 9) AS filled, round(CASE WHEN den > 0 THEN num/den END + 1e-12, 9) AS smoothed FROM e""")
def _(fx):
    return windows.fill_and_smooth(fx.epochs, "src_ap", 2.0).select("run_id", "epoch", off_half(c("filled")).alias("filled"), off_half(c("smoothed")).alias("smoothed"))


EMA = """e(run_id, epoch, ema) AS (SELECT run_id, -1, CAST(0.4 AS DOUBLE) FROM fx_epochs GROUP BY run_id UNION ALL SELECT f.run_id, f.epoch, greatest(least(e.ema*0.95 + f.conf_kept*0.05, 0.65), 0.35) FROM e JOIN fx_epochs f ON f.run_id = e.run_id AND f.epoch = e.epoch + 1)"""


@query("f10_ema_fold", f"WITH RECURSIVE {EMA} SELECT run_id, epoch, round(ema + 1e-12, 9) AS ema FROM e WHERE epoch >= 0")
def _(fx):
    return windows.ema_fold(fx.epochs, ["run_id"], "epoch", "conf_kept", 0.4, 0.95, 0.35, 0.65).select("run_id", "epoch", off_half(c("ema")).alias("ema"))


@query("f10_long_run", """WITH RECURSIVE e(run_id, epoch, ema) AS (SELECT run_id, -1, CAST(0.4 AS DOUBLE) FROM fx_long_epochs GROUP BY run_id UNION ALL SELECT f.run_id, f.epoch, greatest(least(e.ema*0.95 + f.conf_kept*0.05, 0.65), 0.35)
  FROM e JOIN fx_long_epochs f ON f.run_id = e.run_id AND f.epoch = e.epoch + 1) SELECT run_id, epoch, round(ema + 1e-12, 9) AS ema FROM e WHERE epoch >= 0""")
def _(fx):
    """A third of all rows is one run."""
    return windows.ema_fold(fx.long_epochs, ["run_id"], "epoch", "conf_kept", 0.4, 0.95, 0.35, 0.65).select("run_id", "epoch", off_half(c("ema")).alias("ema"))


@query("f11_retrain_policy", """WITH RECURSIVE p AS (SELECT *, lag(conf_mean) OVER w AS pm, lag(conf_kept) OVER w AS pk FROM fx_epochs WINDOW w AS (PARTITION BY run_id ORDER BY epoch)),
  q AS (SELECT *, max(pm) OVER (PARTITION BY run_id ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bm FROM p),
  d AS (SELECT run_id, epoch, epoch > 30 AND (epoch-30) % (CASE WHEN epoch <= 60 THEN 15 WHEN epoch <= 120 THEN 20 ELSE 30 END) = 0 AS s, epoch > 30 AND coalesce(bm - pm >= 0.03, false) AS ev, coalesce(pm <= 0.26 OR pk <= 0.55, false) AS g FROM q),
  r(run_id, epoch, s, ev, last, action) AS (SELECT run_id, -1, false, false, -1000000000, '' FROM d GROUP BY run_id UNION ALL
    SELECT d.run_id, d.epoch, d.s, d.ev, CASE WHEN (d.s OR d.ev) AND d.epoch - r.last >= 6 AND (d.ev OR d.g) THEN d.epoch ELSE r.last END,
      CASE WHEN NOT (d.s OR d.ev) THEN 'none' WHEN d.epoch - r.last < 6 THEN 'skip_cooldown' WHEN d.ev THEN 'retrain_event' WHEN d.g THEN 'retrain_schedule' ELSE 'skip_gate' END
    FROM r JOIN d ON d.run_id = r.run_id AND d.epoch = r.epoch + 1)
  SELECT run_id, epoch, s AS schedule_due, ev AS event_due, action FROM r WHERE epoch >= 0""")
def _(fx):
    return windows.retrain_policy(fx.epochs)


@query("t6_gates_and_score", """WITH l AS (SELECT *, last_value(src_ap IGNORE NULLS) OVER (PARTITION BY run_id ORDER BY epoch ROWS UNBOUNDED PRECEDING) AS la, avg(n_pseudo) OVER (PARTITION BY run_id) AS ap FROM fx_epochs),
  a AS (SELECT *, max(CASE WHEN epoch = 29 THEN la END) OVER (PARTITION BY run_id) AS an FROM l)
  SELECT run_id, epoch, epoch >= 30 AND coalesce(la >= 0.95*an, false) AND coalesce(n_pseudo BETWEEN 0.5*ap AND 1.8*ap, false) AS passes_gates, round(CASE WHEN stability IS NOT NULL THEN 0.5*coalesce(conf_mean, 0) + 0.5*stability ELSE conf_mean END, 6) AS composite FROM a""")
def _(fx):
    from pyspark.sql import Window

    d = windows.carry_forward(fx.epochs, "src_ap", 29).withColumn("ap", F.avg("n_pseudo").over(Window.partitionBy("run_id")))
    return thresholds.gates_and_score(d, avg_pseudo=c("ap")).select("run_id", "epoch", "passes_gates", r6(c("composite")).alias("composite"))


@query("t7_quantile_threshold", """WITH RECURSIVE q AS (SELECT det_id % 10 AS step, quantile_cont(score, 0.94) AS q FROM fx_detections GROUP BY 1), n AS (SELECT *, row_number() OVER (ORDER BY step) AS k FROM q),
  e(step, k, ema) AS (SELECT CAST(-1 AS BIGINT), CAST(0 AS BIGINT), CAST(0.4 AS DOUBLE) UNION ALL SELECT n.step, n.k, greatest(least(e.ema*0.95 + n.q*0.05, 0.65), 0.35) FROM e JOIN n ON n.k = e.k + 1)
  SELECT step, round(ema + 1e-12, 9) AS ema, round(greatest(least(0.2*0.4 + 0.8*ema, 0.65), 0.35) + 1e-12, 9) AS threshold FROM e WHERE k > 0""")
def _(fx):
    d = thresholds.quantile_threshold(fx.detections.select((c("det_id") % 10).alias("step"), "score", F.lit(0).alias("run")), ["run"], "step", "score")
    return d.select("step", off_half(c("ema")).alias("ema"), off_half(c("threshold")).alias("threshold"))


T8 = """WITH RECURSIVE s AS (SELECT det_id % 10 AS step, avg(score) FILTER (score > 0.25) AS a, stddev_pop(score) FILTER (score > 0.25) AS b FROM fx_detections GROUP BY 1), n AS (SELECT *, row_number() OVER (ORDER BY step) AS k FROM s),
  e(step, k, mu, sd) AS (SELECT CAST(-1 AS BIGINT), CAST(0 AS BIGINT), CAST(0.4 AS DOUBLE), CAST(0.1 AS DOUBLE) UNION ALL SELECT n.step, n.k, e.mu*0.99 + n.a*0.01, e.sd*0.99 + n.b*0.01 FROM e JOIN n ON n.k = e.k + 1),
  t AS (SELECT step, mu, sd, least((step+1)/10.0, 1)*(mu - sd) + (1 - least((step+1)/10.0, 1))*0.4 AS tau FROM e WHERE k > 0)
  SELECT step, round(mu + 1e-12, 9) AS mu, round(sd + 1e-12, 9) AS sigma, round(greatest(least(CASE WHEN abs(tau-0.4) > 0.3 THEN (tau+0.4)/2 ELSE tau END, 0.75), 0.40) + 1e-12, 9) AS threshold FROM t"""


@query("t8_sigma_threshold", T8)
def _(fx):
    d = thresholds.sigma_threshold(fx.detections.withColumn("step", c("det_id") % 10), 2.0)
    return d.select("step", *[off_half(c(k)).alias(k) for k in ("mu", "sigma", "threshold")])


T9 = """WITH RECURSIVE r AS (SELECT category_id, det_id % 10 AS step, score, row_number() OVER (PARTITION BY category_id, det_id % 10 ORDER BY score DESC, det_id) AS k, count(*) OVER (PARTITION BY category_id, det_id % 10) AS n FROM fx_detections),
  m AS (SELECT category_id, step, 0.8*avg(score) AS m, row_number() OVER (PARTITION BY category_id ORDER BY step) AS i FROM r WHERE k <= greatest(floor(n/2), 1) GROUP BY category_id, step),
  e(category_id, step, i, ema) AS (SELECT category_id, CAST(-1 AS BIGINT), CAST(0 AS BIGINT), CAST(0.35 AS DOUBLE) FROM m GROUP BY category_id UNION ALL SELECT m.category_id, m.step, m.i, greatest(least(e.ema*0.95 + m.m*0.05, 0.55), 0.30) FROM e JOIN m ON m.category_id = e.category_id AND m.i = e.i + 1)
  SELECT category_id, step, round(ema + 1e-12, 9) AS threshold FROM e WHERE i > 0"""


@query("t9_class_threshold", T9)
def _(fx):
    d = thresholds.class_threshold(fx.detections.withColumn("step", c("det_id") % 10), "step", "category_id", "score", "det_id", fx.objects)
    return d.select("category_id", "step", off_half(c("ema")).alias("threshold"))


def written_in_order(df, order: str, path: str, rows: int) -> int:
    """Write ``df`` as folders of one file, about ``rows`` rows each, that arrive in the order of ``order``; their number."""
    stored = materialize(df)
    n = max(1, -(-stored.count() // rows))
    cuts = stored.agg(F.percentile_approx(order, [i / n for i in range(1, n)], 100 * n)).first()[0] if n > 1 else []
    ends = [None, *sorted(set(cuts)), None]
    for i, (low, high) in enumerate(zip(ends, ends[1:])):
        part = stored if low is None else stored.where(c(order) > low)
        (part if high is None else part.where(c(order) <= high)).coalesce(1).write.parquet(f"{path}/{i:06d}")
    discard(stored)
    return len(ends) - 1


@query("s1_running_meters", """SELECT metric, step, round(list_sort(v)[CAST(floor((len(v)+1)/2) AS INT)], 9) AS median, round(list_avg(v), 9) AS mean, round(g, 9) AS global_mean FROM (
  SELECT metric, step, list(value) OVER (PARTITION BY metric ORDER BY step ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS v, avg(value) OVER (PARTITION BY metric ORDER BY step ROWS UNBOUNDED PRECEDING) AS g FROM fx_steps) t""")
def _(fx):
    path = scratch(fx)
    written_in_order(fx.steps.select("metric", "step", "value"), "step", f"{path}/in", 1_000_000)
    stream = fx.spark.readStream.schema("metric string, step long, value double").option("maxFilesPerTrigger", 1).parquet(f"{path}/in/*")
    d = meters.drain(meters.running_meters(stream), fx.spark, path)
    return d.select("metric", "step", *[r9(c(k)).alias(k) for k in ("median", "mean", "global_mean")])


@query("s2_running_threshold", f"WITH RECURSIVE {EMA} SELECT CAST(run_id AS VARCHAR) AS stream, CAST(epoch AS BIGINT) AS step, round(ema + 1e-12, 9) AS ema FROM e WHERE epoch >= 0")
def _(fx):
    path = scratch(fx)
    fx.epochs.select(c("run_id").cast("string").alias("stream"), c("epoch").cast("long").alias("step"), c("conf_kept").alias("quantile")).write.parquet(f"{path}/in")
    stream = fx.spark.readStream.schema("stream string, step long, quantile double").parquet(f"{path}/in")
    return meters.drain(meters.running_threshold(stream), fx.spark, path).select("stream", "step", off_half(c("ema")).alias("ema"))


@query("s2_stream_thresholds", f"SELECT CAST(a.step AS BIGINT) AS step, mu, sigma, a.threshold AS threshold, category_id, b.threshold AS class_threshold FROM ({T8}) a JOIN ({T9}) b ON a.step = b.step")
def _(fx):
    """Steps arrive one file after the other, several micro-batches in all."""
    path = scratch(fx)
    d = fx.detections.select(F.lit("all").alias("stream"), (c("det_id") % 10).alias("step"), "image_id", "det_id", "category_id", "score")
    d.write.partitionBy("step").parquet(f"{path}/steps")  # objects are joined once, by all tasks
    stored = fx.spark.read.schema(d.schema).parquet(f"{path}/steps").select(d.columns)
    for i, step in enumerate(sorted(r.step for r in stored.select("step").distinct().collect())):
        stored.where(c("step") == step).coalesce(1).write.parquet(f"{path}/in/{i:03d}")
    schema = "stream string, step long, image_id long, det_id long, category_id int, score double"
    stream = fx.spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(f"{path}/in/*")
    got = meters.stream_thresholds(stream, fx.spark, path, 2.0)
    return got.select("step", *[off_half(c(k)).alias(k) for k in ("mu", "sigma", "threshold", "class_threshold")], "category_id")


@query("s3_deduplicated_results", "SELECT DISTINCT image_id FROM fx_detections")
def _(fx):
    path = scratch(fx)
    fx.detections.select("image_id", F.timestamp_seconds(F.lit(1_700_000_000) + c("det_id") % 600).alias("at")).write.parquet(f"{path}/in")
    stream = fx.spark.readStream.schema("image_id long, at timestamp").parquet(f"{path}/in")
    return meters.drain(meters.deduplicated_results(stream, "at"), fx.spark, path).select("image_id")
