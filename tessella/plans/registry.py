"""Registered queries of the detection-data operators and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.boxes import box_from_xywh
from tessella.plans.fixtures import Fixtures, duck

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(fixtures)`` under ``name``, with the DuckDB text that gives the same rows."""

    def wrap(fn: Callable[[Fixtures], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(Fixtures(spark, sf_dir))
        if sql is not None:
            SQL[name] = duck(sql)
        return fn

    return wrap


def r6(c: Column) -> Column:
    """Rounded to six places in binary, halves away from zero, without a negative zero."""
    return F.signum(c) * F.floor(F.abs(c) * 1e6 + 0.5) / 1e6 + 0.0


def r9(c: Column) -> Column:
    """Nine places, for short means of short decimals: at six they may fall on a half."""
    return F.signum(c) * F.floor(F.abs(c) * 1e9 + 0.5) / 1e9 + 0.0


def off_half(c: Column) -> Column:
    """Nine places, nudged by 1e-12: running means of short decimals fall on a half in some step, whatever the places."""
    return r9(c + F.lit(1e-12))


def b(df: DataFrame, name: str = "box") -> DataFrame:
    return df.withColumn(name, box_from_xywh(*[F.col(k) for k in "xywh"]))


def greedy_sql(group: str, det: str, rows: str, clashes: str) -> str:
    """Greedy suppression as one recursion over the ranks within each group: what has been kept so far travels as a list.
    ``rows`` gives (group, det, score), ``clashes`` (group, det, better)."""
    return f"""WITH RECURSIVE clash AS ({clashes}), bad AS (SELECT {group}, {det}, list(better) AS bad FROM clash GROUP BY ALL),
  ranked AS (SELECT r.*, row_number() OVER (PARTITION BY r.{group} ORDER BY r.score DESC, r.{det}) AS k, coalesce(bad, []) AS bad FROM ({rows}) r LEFT JOIN bad b ON b.{group} = r.{group} AND b.{det} = r.{det}),
  walk({group}, k, {det}, score, stays, kept) AS (SELECT DISTINCT {group}, CAST(0 AS BIGINT), CAST(-1 AS BIGINT), CAST(0 AS DOUBLE), false, CAST([] AS BIGINT[]) FROM ranked
    UNION ALL SELECT r.{group}, r.k, r.{det}, r.score, NOT list_has_any(w.kept, r.bad), CASE WHEN list_has_any(w.kept, r.bad) THEN w.kept ELSE list_append(w.kept, r.{det}) END
    FROM walk w JOIN ranked r ON r.{group} = w.{group} AND r.k = w.k + 1)
  SELECT {group}, {det}, round(score, 6) AS score FROM walk WHERE stays"""


from tessella.plans import queries_boxes, queries_logs, queries_rings, queries_sets  # noqa: E402, F401
