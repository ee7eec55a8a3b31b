"""Reproducible samples, shards and set checks."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators.numbering import number_rows


def mixed(key: Column, seed: int) -> Column:
    """A seeded hash of a key, as hexadecimal text; the same in every engine."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def hash_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows in the order of a seeded hash of their key: a top-n, so every run and every engine of partitions agrees."""
    return df.orderBy(mixed(F.col(key), seed), key).limit(n)


def stored_sample(df: DataFrame, key: str, n: int, path: str, seed: int = 42) -> DataFrame:
    """Rows of ``df`` whose key is in the subset stored at ``path``. The first call draws the subset (hash_sample) and stores its
    keys; later calls read it, also when ``df`` has grown since. Keys are written beside and renamed, so there is never half
    a subset, and of two first calls at once one wins and both use its keys. Keys that ``df`` has lost give no row."""
    spark = df.sparkSession
    of = spark._jvm.org.apache.hadoop.fs.Path
    target, own = of(path), of(f"{path.rstrip('/')}.{uuid.uuid4().hex}")
    fs = target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not fs.exists(target):
        hash_sample(df.select(key).distinct(), key, n, seed).write.parquet(own.toString())
        if fs.exists(target) or not fs.rename(own, target):
            fs.delete(own, True)
    return df.join(spark.read.parquet(path), key, "left_semi")


def epoch_order(df: DataFrame, key: str, epoch: int) -> DataFrame:
    """``df`` with pos: the place in the epoch's permutation, and total."""
    return number_rows(df, [mixed(F.col(key), epoch).asc(), F.col(key).asc()], "pos", "total")


def _padded(order: DataFrame, key: str, workers: int) -> DataFrame:
    """The permutation, its head repeated up to a multiple of ``workers``."""
    goal = F.ceil(F.col("total") / workers) * workers
    head = order.where(F.col("pos") < goal - F.col("total")).withColumn("pos", F.col("pos") + F.col("total"))
    return order.unionByName(head).withColumn("per_worker", F.ceil(F.col("total") / workers).cast("long"))


def epoch_shards(df: DataFrame, key: str, epoch: int, workers: int) -> DataFrame:
    """(key, pos, shard): contiguous equal slices of the padded permutation."""
    p = _padded(epoch_order(df, key, epoch), key, workers)
    return p.select(key, "pos", F.floor(F.col("pos") / F.col("per_worker")).cast("int").alias("shard"))


def strided_shards(df: DataFrame, key: str, workers: int) -> DataFrame:
    """(key, pos, shard): the order of the key itself, padded, dealt round the workers."""
    p = _padded(number_rows(df, [F.col(key).asc()], "pos", "total"), key, workers)
    return p.select(key, "pos", (F.col("pos") % workers).cast("int").alias("shard"))


def union_all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def key_differences(found: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """(key, side): 'missing' for wanted keys that aren't found, 'unexpected' for the others."""
    f, w = found.select(key), wanted.select(key)
    only = lambda a, b, side: a.join(b, key, "left_anti").distinct().withColumn("side", F.lit(side))  # noqa: E731  what is left is fewer
    return only(w, f, "missing").unionByName(only(f, w, "unexpected"))


def missing_columns(df: DataFrame, required: list[str]) -> list[str]:
    return [c for c in required if c not in df.columns]
