"""Sharding by a Feistel permutation of global row numbers, with cycle walking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators.numbering import fresh, number_rows

PRIME = 2147483647
ROUND_KEYS = (1640531527, 374761393, 668265263, 1274126177, 961748927, 1103515245)
#: Steps of cycle walking that are unrolled. The walk leaves [0, a*b) \ [0, N) with chance 1 - 1/sqrt(N) a step.
WALK = 32


def _mix(v: Column, key: Column) -> Column:
    t = (v * F.lit(48271) + key) % F.lit(PRIME)
    return (t * (t % F.lit(65521) + F.lit(1))) % F.lit(PRIME)


def _permute(x: Column, a: Column, b: Column, keys: list[tuple[int, int]]) -> Column:
    """One pass of the alternating Feistel network on [0, a) x [0, b), a bijection for every a, b."""
    start = F.struct(F.floor(x / b).cast("long").alias("l"), (x % b).alias("r"))
    rounds = F.array(*[F.struct(F.lit(i % 2).alias("side"), F.lit(k).cast("long").alias("key")) for i, k in keys])

    def step(s: Column, k: Column) -> Column:
        left = F.when(k["side"] == 0, (s["l"] + _mix(s["r"], k["key"])) % a).otherwise(s["l"])
        right = F.when(k["side"] == 1, (s["r"] + _mix(s["l"], k["key"])) % b).otherwise(s["r"])
        return F.struct(left.alias("l"), right.alias("r"))

    return F.aggregate(rounds, start, step, lambda s: s["l"] * b + s["r"])


def round_keys(seed: int) -> list[tuple[int, int]]:
    return [(i, (k + seed * 2654435761) % PRIME) for i, k in enumerate(ROUND_KEYS)]


def feistel(x: Column, n: Column, seed: int) -> Column:
    """Place of row number ``x`` in a seeded permutation of [0, n): computable for one row without the others.

    The network permutes a grid a*b >= n with a = ceil(sqrt n); results outside [0, n) are permuted again (cycle
    walking). A walk that is not back after WALK steps raises an error instead of giving a wrong place.
    """
    keys = round_keys(seed)
    a = F.ceil(F.sqrt(n.cast("double"))).cast("long")
    b = F.ceil(n.cast("double") / a).cast("long")

    def again(y: Column, _: Column) -> Column:
        return F.when(y >= n, _permute(y, a, b, keys)).otherwise(y)

    def end(y: Column) -> Column:
        return F.when(y >= n, F.raise_error(F.lit("cycle walk too long")).cast("long")).otherwise(y)

    return F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), _permute(x, a, b, keys), again, end)


def shard_documents(docs: DataFrame, order: list[str], n_shards: int = 8, seed: int = 1, shard: str = "shard", slot: str = "slot") -> DataFrame:
    """All rows and columns of ``docs`` with ``shard`` and a gapless ``slot``; shard sizes are at most one apart.

    Rows are numbered by ``order`` (nulls first), the number is permuted, and place p goes to shard p mod n_shards,
    slot p div n_shards. Columns not in ``order`` break ties by their hash, so a rerun on other partitions agrees;
    fully equal rows are interchangeable. An empty table stays empty; a column named like an output is replaced.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in (shard.lower(), slot.lower())])
    number, rows = fresh(docs, "_number"), fresh(docs, "_rows")
    place = fresh(docs, "_where")
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in order]
    keys = [F.col(f"`{c}`").asc_nulls_first() for c in order] + ([F.xxhash64(*rest).asc()] if rest else [])
    placed = number_rows(docs, keys, number, rows).withColumn(place, feistel(F.col(number), F.col(rows), seed))
    return placed.withColumn(shard, (F.col(place) % n_shards).cast("int")).withColumn(slot, F.floor(F.col(place) / n_shards).cast("long")).drop(number, rows, place)


def op5_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards 0..7 of all ``documents`` by the ``rows`` law; a null text has size 1 and the checksum of no bytes."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        "doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32")
    )
    return shard_documents(docs, ["doc_id", "text_crc32", "size"]).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op5_sql(seed: int = 1, walk: int = 8) -> str:
    """DuckDB twin: one CTE for each Feistel round, ``walk`` cycle-walking steps. DuckDB has no crc32, so the table
    of byte remainders is built by recursion and folded over the text's bytes."""
    mix = lambda v, k: f"(((({v} * 48271 + {k}) % {PRIME}) * ((({v} * 48271 + {k}) % {PRIME}) % 65521 + 1)) % {PRIME})"
    ctes, prev = [], "grid"
    for w in range(walk + 1):
        ctes.append(f"s{w} AS (SELECT * EXCLUDE (x), x, x // b AS l, x % b AS r FROM {prev})")
        prev = f"s{w}"
        for i, k in round_keys(seed):
            new = f"(l + {mix('r', k)}) % a AS l, r" if i % 2 == 0 else f"l, (r + {mix('l', k)}) % b AS r"
            ctes.append(f"s{w}r{i} AS (SELECT * EXCLUDE (l, r), {new} FROM {prev})")
            prev = f"s{w}r{i}"
        keep = "l * b + r" if w == 0 else "CASE WHEN x >= n THEN l * b + r ELSE x END"
        ctes.append(f"p{w} AS (SELECT * EXCLUDE (x, l, r), {keep} AS x FROM {prev})")
        prev = f"p{w}"
    step = "CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END"
    return f"""
WITH RECURSIVE rem(k, i, v) AS (
  SELECT i, 0, i::BIGINT FROM range(256) t(i) UNION ALL SELECT k, i + 1, {step} FROM rem WHERE i < 8),
tab AS (SELECT list(v ORDER BY k) AS t FROM rem WHERE i = 8),
hexed AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n, hex(encode(coalesce(text, ''))) AS h FROM documents),
sized AS (SELECT doc_id, n + 1 AS size,
    xor(list_reduce(list_transform(range(0, n), lambda i: ('0x' || h[2 * i + 1 : 2 * i + 2])::BIGINT),
      lambda c, y: xor(c // 256, t[xor(c % 256, y) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) AS text_crc32
  FROM hexed, tab),
grid AS (SELECT doc_id, size, text_crc32, row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS x,
    count(*) OVER () AS n, ceil(sqrt(count(*) OVER ()))::BIGINT AS a,
    ceil(count(*) OVER () / ceil(sqrt(count(*) OVER ())))::BIGINT AS b FROM sized),
{", ".join(ctes)}
SELECT doc_id, size::BIGINT AS size, text_crc32, 'rows' AS law, (x % 8)::INTEGER AS shard, (x // 8)::BIGINT AS slot,
  NULL::INTEGER AS grown_shard FROM {prev}"""
