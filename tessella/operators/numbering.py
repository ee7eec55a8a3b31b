"""Dense global row numbers without a one-task sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.sources.shared import materialize, partitions


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` doesn't have (compared without case)."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def number_rows(df: DataFrame, order: list[Column], number: str = "row_number", total: str | None = None, compression: str | None = None) -> DataFrame:
    """Add ``number``: 0, 1, ... in the order given, over all rows; ``total``, where named, gets the row count.

    Rows are range-partitioned and sorted once, written to the shared folder with their place within the
    partition, and numbered by adding each partition's offset (one small row per partition). Rows that tie in
    ``order`` are split over partitions by a salt, so one repeated key can't fill a task; make ``order`` cover
    all columns that matter and tied rows are interchangeable. Nulls sort as ``order`` says. Empty in, empty out.
    ``compression``: of the written rows, as in materialize().
    """
    place, salt, part = fresh(df, "_place"), fresh(df, "_salt"), fresh(df, "_part")
    keys = [F.xxhash64(F.monotonically_increasing_id())]
    stored = materialize(
        df.withColumn(salt, keys[0])
        .repartitionByRange(partitions(df.sparkSession), *order, salt)
        .sortWithinPartitions(*order)
        .drop(salt)
        .withColumn(place, F.monotonically_increasing_id()),
        compression,
    )
    of = F.shiftrightunsigned(F.col(place), 33).alias(part)
    first, rows = "first_number", "all_rows"
    offsets = (
        stored.groupBy(of)
        .agg(F.count("*").alias("n"))
        .select(
            part,
            (F.sum("n").over(Window.orderBy(part)) - F.col("n")).alias(first),
            F.sum("n").over(Window.partitionBy()).alias(rows),
        )
    )
    numbered = stored.alias("t").join(F.broadcast(offsets.alias("o")), F.shiftrightunsigned(F.col(f"t.{place}"), 33) == F.col(f"o.{part}"))
    within = F.col(f"t.{place}").bitwiseAND(F.lit((1 << 33) - 1))
    return numbered.select(
        *[F.col(f"t.`{c}`") for c in df.columns],
        (F.col(f"o.{first}") + within).alias(number),
        *([F.col(f"o.{rows}").alias(total)] if total else []),
    )
