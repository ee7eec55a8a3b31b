"""Metric and threshold logs."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.strings import scrub

# The columns of the file format.
REQUIRED = ["epoch", "raw_threshold", "target_ema_threshold", "quantile_threshold", "effective_threshold", "avg_confidence", "avg_confidence_kept", "retrain_triggered", "retrain_due"]
OPTIONAL = {"retrain_schedule_due": "0", "retrain_event_due": "0", "retrain_action": ""}
FLAGS = ("retrain_triggered", "retrain_due", "retrain_schedule_due", "retrain_event_due")


def parse_flag(text: Column) -> Column:
    """1/true/yes -> 1; 0/false/no/empty -> 0; else the number cut to an integer, or 0."""
    t = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    return F.when(t.isin("1", "true", "yes"), 1).when(t.isin("0", "false", "no", ""), 0).otherwise(F.coalesce(t.try_cast("double").cast("int"), F.lit(0)))


def parse_number(text: Column) -> Column:
    return F.coalesce(F.trim(text).try_cast("double"), F.lit(float("nan")))


def read_threshold_log(spark: SparkSession, path: str) -> DataFrame:
    """Typed columns of a TSV log whose headers may carry a label in brackets; missing required columns are listed in the
    error, optional ones get defaults. A folder of logs by ``run_id=...`` keeps the run."""
    raw = spark.read.csv(path, sep="\t", header=True, inferSchema=False)
    named = raw.toDF(*[re.split(r"[(（]", c)[0].strip() for c in raw.columns])
    missing = [c for c in REQUIRED if c not in named.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    for c, default in OPTIONAL.items():
        if c not in named.columns:
            named = named.withColumn(c, F.lit(default))
    kind = lambda c: parse_flag(F.col(c)) if c in FLAGS else F.coalesce(F.col(c), F.lit("")) if c == "retrain_action" else parse_number(F.col(c)).cast("int") if c == "epoch" else parse_number(F.col(c))
    return named.select(*[kind(c).alias(c) for c in [*REQUIRED, *OPTIONAL]], *[F.col(c) for c in named.columns if c == "run_id"])


def read_metric_log(spark: SparkSession, paths: list[str]) -> DataFrame:
    """JSON lines of several runs; run is the name of a log's folder, NaN becomes NULL."""
    df = spark.read.json(paths).withColumn("run", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1))
    return df.select(*[F.when(F.isnan(c), None).otherwise(F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def append_log(df: DataFrame, path: str, kind: str = "json") -> None:
    """Append rows as JSON lines or TSV; tabs and line ends in texts become spaces."""
    clean = df.select(*[scrub(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes])
    if kind == "json":
        clean.write.mode("append").json(path, ignoreNullFields=False)
    else:
        clean.write.mode("append").csv(path, sep="\t", header=True)
