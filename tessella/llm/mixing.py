"""Mixing sources to target weights by hash-threshold histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.operators.numbering import fresh
from tessella.sources.shared import materialize

WEIGHTS = (5.0, 2.0, 1.0)
MAX_REPEATS = 3
#: A document's place in the nested order: the first 15 hex digits of a digest, refined 12 bits at a time.
HASH_BITS, STEP_BITS = 60, 12
WORDS = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """Number of words between ASCII white space; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def nested_hash(doc_id: Column, seed: int) -> Column:
    """A 60-bit number from the id alone: raising a budget only ever adds documents."""
    text = F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size) -> the same with ``target``: the whole size shared by weight, no target above
    max_repeats times its source's size, the excess reshared by weight. Sources rank by code point, null last,
    and take the weights in turn. One row per source, so the windows here are over a small table.

    Resharing until nothing is above its cap ends where a level x gives sum(min(cap, x * weight)) = total. With sources in
    order of cap / weight and the first ones capped, the level of the rest rises as long as the next one belongs among
    the capped and falls after that, so x is the highest of these levels.
    """
    ranked = sizes.select(
        "source",
        "source_size",
        F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1).cast("int")).alias("weight"),
        (F.col("source_size") * max_repeats).alias("cap"),
        F.sum("source_size").over(Window.partitionBy()).alias("total"),
    )
    before = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    level = ranked.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (F.sum("weight").over(Window.partitionBy()) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    met = F.max("level").over(Window.partitionBy())
    return level.withColumn("target", F.round(F.least(F.col("cap").cast("double"), met * F.col("weight")), 6)).select("source", "source_size", "target")


def thresholds(narrow: DataFrame, goals: DataFrame) -> DataFrame:
    """(source, hash, size) and (source, ..., rest) -> goals with ``threshold``: documents whose hash is below it sum
    to the nearest reachable total to ``rest``.

    Each pass sums words by source and by the next 12 bits of the hash inside the boundary bucket only, and moves the
    boundary to the bucket where the running sum passes the budget. No document is sorted; five passes fix all 60 bits.
    """
    bounds = goals.select("source", F.lit(0).cast("long").alias("low"), F.col("rest").cast("double").alias("left_over"))
    for shift in range(HASH_BITS - STEP_BITS, -1, -STEP_BITS):
        inside = narrow.alias("d").join(bounds.alias("b"), F.col("d.source").eqNullSafe(F.col("b.source")))
        if shift != HASH_BITS - STEP_BITS:
            inside = inside.where(F.shiftright("d.hash", shift + STEP_BITS) == F.shiftright("b.low", shift + STEP_BITS))
        histogram = inside.groupBy(F.col("d.source").alias("source"), F.shiftright("d.hash", shift).alias("bucket")).agg(F.sum("d.size").alias("words"), F.first("b.left_over").alias("left_over"))
        running = F.sum("words").over(Window.partitionBy("source").orderBy("bucket"))
        passed = histogram.withColumn("upto", running).where(F.col("upto") > F.col("left_over"))
        edge = passed.groupBy("source").agg(F.min(F.struct("bucket", "upto", "words", "left_over")).alias("e"))
        bounds = edge.select("source", F.shiftleft(F.col("e.bucket"), shift).alias("low"), (F.col("e.left_over") - (F.col("e.upto") - F.col("e.words"))).alias("left_over"), F.col("e.words").alias("edge_words"))
    nearest = bounds.select("source", (F.col("low") + F.when(F.col("edge_words") - F.col("left_over") < F.col("left_over"), 1).otherwise(0)).alias("threshold"))
    joined = goals.alias("g").join(nearest.alias("n"), F.col("g.source").eqNullSafe(F.col("n.source")), "left")
    return joined.select("g.*", F.coalesce("n.threshold", F.lit(1 << HASH_BITS)).alias("threshold"))


def mix_plan(docs: DataFrame, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """Per source: source_size, target, ``full`` (whole repeats) and ``threshold`` (who gets one more).

    Returns (narrow documents as stored: doc_id, source, size, hash; plan). Documents without words change nothing.
    """
    narrow = materialize(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), nested_hash(F.col("doc_id"), seed).alias("hash")))
    goals = targets(narrow.groupBy("source").agg(F.sum("size").alias("source_size")))
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(MAX_REPEATS))).otherwise(0).cast("long")
    goals = goals.withColumn("full", whole).withColumn("rest", F.col("target") - F.col("full") * F.col("source_size"))
    return narrow, materialize(thresholds(narrow, materialize(goals)))


def _copies(h: Column) -> Column:
    return F.least(F.col("p.full") + F.when(h < F.col("p.threshold"), 1).otherwise(0), F.lit(MAX_REPEATS))


def mix_documents(docs: DataFrame, seed: int = 1) -> DataFrame:
    """The mix itself: the columns of ``docs``, each row 0 to 3 times.

    Sources are matched null-safely; a document without words is repeated like its source's others. Tied hashes
    (repeated ids) are taken or left together. An empty table gives an empty mix.
    """
    _, plan = mix_plan(docs, seed)
    times = fresh(docs, "_times")
    joined = docs.alias("d").join(plan.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")))
    rows = joined.select("d.*", _copies(nested_hash(F.col("d.doc_id"), seed)).alias(times)).where(F.col(times) > 0)
    return rows.withColumn(times, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times)))).drop(times)


def op8_hash_threshold_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words taken from every document of ``documents``; a null text counts 0 words, a null source is a source."""
    narrow, plan = mix_plan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    joined = narrow.alias("d").join(plan.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")))
    return joined.select("d.doc_id", "d.size", "p.source_size", "p.target", (F.col("d.size") * _copies(F.col("d.hash"))).alias("taken"))


OP8_SQL = r"""
WITH d AS (SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':1'), 1, 15))::BIGINT AS hash FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT source, source_size, [5.0::DOUBLE, 2.0, 1.0][(row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1] AS weight,
    source_size * 3 AS cap, sum(source_size) OVER () AS total FROM s),
l AS (SELECT *, (total - coalesce(sum(cap) OVER w, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS level FROM r
    WINDOW w AS (ORDER BY cap / weight, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
m AS (SELECT source, source_size, cap, weight, max(level) OVER () AS x FROM l),
t AS (SELECT source, source_size, round(least(cap::DOUBLE, x * weight), 6) AS target FROM m),
g AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3)::BIGINT ELSE 0 END AS whole FROM t),
h AS (SELECT d.source, d.hash, sum(d.size) AS words FROM d GROUP BY ALL),
u AS (SELECT h.source, h.hash, h.words, sum(h.words) OVER (PARTITION BY h.source ORDER BY h.hash) AS upto FROM h),
e AS (SELECT g.*, u.hash, u.words, u.upto, target - whole * source_size AS rest,
    row_number() OVER (PARTITION BY g.source ORDER BY u.hash) AS k
  FROM g JOIN u ON g.source IS NOT DISTINCT FROM u.source WHERE u.upto > target - whole * source_size),
b AS (SELECT source, hash + CASE WHEN upto - rest < rest - (upto - words) THEN 1 ELSE 0 END AS threshold FROM e WHERE k = 1)
SELECT d.doc_id, d.size, g.source_size, g.target,
  d.size * least(g.whole + CASE WHEN d.hash < coalesce(b.threshold, 1152921504606846976) THEN 1 ELSE 0 END, 3) AS taken
FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source LEFT JOIN b ON d.source IS NOT DISTINCT FROM b.source"""
