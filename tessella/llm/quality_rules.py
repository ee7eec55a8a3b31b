"""Quality rules with risk-controlled cutoffs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.sources.shared import materialize

SPACE = r"[\x20\x09-\x0D]+"
#: Share of good documents that all rules together may reject in a stratum, and the chance that this fails.
MAX_FALSE_REJECTION, CONFIDENCE_ERROR = 0.05, 0.05
#: Cutoffs tried for a rule: these quantiles of the bad and of the good documents in the learning half.
LADDER, GOOD_LADDER = tuple(i / 40 for i in range(1, 40)), (0.999, 1.0)
#: What a good document above a cutoff costs against a bad one, and how much gain is given up for a looser cutoff.
GOOD_COST, SLACK = 5.0, 0.005


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once for a row."""
    return F.transform(F.array(value), use)[0]


def _window(words: Column, i: Column) -> Column:
    return F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))


def _twins(sorted_items: Column, same) -> Column:
    """Items that have an equal neighbour."""
    beside = lambda x, k: F.coalesce(same(F.get(sorted_items, k), x), F.lit(False))
    return F.filter(sorted_items, lambda x, k: beside(x, k + 1) | ((k > 0) & beside(x, F.greatest(k - 1, F.lit(0)))))


def _repeated_words(words: Column) -> Column:
    """Words that lie in a 3-word window which the text has twice or more.

    Each window is a 64-bit number: hash bits above, its place below in as many bits as the text needs. Sorted,
    windows with equal hash bits are neighbours; of those, few in most texts, the words themselves are sorted and
    compared, so the count is exact however few hash bits a very long text leaves. The places of equal windows, sorted
    again, are spans of three whose union is counted.
    """
    bits = F.length(F.bin(F.size(words)))
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1
    packed = F.sort_array(F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: _window(words, i).bitwiseAND(F.bitwise_not(mask)).bitwiseOR(i.cast("long"))))

    def maybe(p: Column) -> Column:
        high = lambda v: F.bitwise_not(mask).bitwiseAND(v)
        spelled = lambda i: F.struct(F.get(words, i).alias("a"), F.get(words, i + 1).alias("b"), F.get(words, i + 2).alias("c"), i.alias("at"))
        return F.sort_array(F.transform(_twins(p, lambda x, y: high(x) == high(y)), lambda x: spelled(x.bitwiseAND(mask).cast("int"))))

    def starts(s: Column) -> Column:
        same = lambda x, y: (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"])
        return F.sort_array(F.transform(_twins(s, same), lambda x: x["at"]))

    def cover(s: Column) -> Column:
        start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
        return F.aggregate(s, start, lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(F.lit(3), x - a["last"])).alias("n")), lambda a: a["n"])

    return F.when(F.size(words) < 4, F.lit(0).cast("long")).otherwise(cover(_let(_let(packed, maybe), starts)))


def measures(docs: DataFrame) -> DataFrame:
    """Counts on whole texts: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper, n_bangs.

    Keeps ``doc_id`` and ``lang``. A null text counts as an empty one: all zero.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counted = docs.select(
        "doc_id",
        "lang",
        _let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.concat_ws("", w)).cast("long").alias("word_chars"), _repeated_words(w).alias("n_repeat_words"))).alias("w"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))).alias("l"),
        F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        F.regexp_count(text, F.lit("!")).cast("long").alias("n_bangs"),
    )
    return counted.select("doc_id", "lang", "w.*", "n_symbols", "l.*", "n_upper", "n_bangs")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def rules() -> dict[str, Column]:
    """Name -> value that is high for bad texts; 0 for texts without words."""
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    return {
        "symbols": share("n_symbols", "n_words"),
        "repeats": share("n_repeat_words", "n_words"),
        "dup_lines": share("n_dup_lines", "n_lines"),
        "upper": share("n_upper", "word_chars"),
        "bangs": share("n_bangs", "n_words"),
        "long_words": share("word_chars", "n_words"),
        "short_words": -share("word_chars", "n_words"),
    }


def binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """P(at most k successes in n trials of chance p), exact terms added up in logarithms; 1 where k exceeds n * p."""
    from math import log

    odds = log(p / (1 - p))
    start = F.struct((n * log(1 - p)).alias("term"), F.exp(n * log(1 - p)).alias("sum"))
    steps = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    grow = lambda a, j: a["term"] + F.log((n - j + 1) / j) + odds
    total = F.aggregate(steps, start, lambda a, j: F.struct(grow(a, j).alias("term"), (a["sum"] + F.exp(grow(a, j))).alias("sum")), lambda a: a["sum"])
    return F.when(k > n * p, F.lit(1.0)).otherwise(total)


def cutoffs(measured: DataFrame, labels: DataFrame, stratum: str = "lang") -> DataFrame:
    """(stratum, rule, cutoff, k, n, bound): certified cutoffs; a value above the cutoff rejects.

    Labelled documents that pass the base rules are split in halves by their id. The learning half gives each rule's
    ladder of cutoffs and the gain of each (share of bad minus GOOD_COST times the share of good documents above it). On the held-out
    half, k of n good documents of a stratum lie above a cutoff; it passes if a Binomial(n, a) has at most k with
    chance at most d, i.e. the exact upper confidence bound of its false rejection is at most a. Cutoffs are tested
    from the loosest down until one fails (a fixed sequence needs no correction), and a = MAX_FALSE_REJECTION / rules,
    d = CONFIDENCE_ERROR / (rules * strata) correct for the rest (Bonferroni). Of those that pass with a gain
    over 0, the loosest within SLACK of the largest gain is chosen; a rule without one is not used. Strata with too few labels reject nothing.
    """
    named = rules()
    a = MAX_FALSE_REJECTION / len(named)
    key = F.col(stratum)
    labelled = measured.join(labels.select("doc_id", "quality").where("quality is not null").distinct(), "doc_id").where(~base_failed())
    long = labelled.select(
        key.alias("stratum"), (F.crc32(F.col("doc_id").cast("string")) % 2 == 1).alias("held"), (F.col("quality") == 1).alias("good"),
        F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), v.alias("value")) for n, v in named.items()])).alias("r"),
    ).select("stratum", "held", "good", "r.rule", "r.value")
    learn = long.where(~F.col("held"))
    quantiles = lambda good, at: F.coalesce(F.percentile_approx(F.when(F.col("good") == good, F.col("value")), list(at), 10000), F.array().cast("array<double>"))
    ladder = learn.groupBy("rule").agg(F.concat(quantiles(False, LADDER), quantiles(True, GOOD_LADDER)).alias("c")).select("rule", F.explode(F.array_distinct("c")).alias("cutoff"))
    # values -> the number of cutoffs below them; counts by that number add up to counts above each cutoff
    steps = ladder.groupBy("rule").agg(F.sort_array(F.collect_list("cutoff")).alias("steps"))
    counted = long.join(F.broadcast(steps), "rule").select("stratum", "rule", "held", "good", F.size(F.filter("steps", lambda s: s < F.col("value"))).alias("above"))
    counted = counted.groupBy("stratum", "rule", "above").agg(*[F.count_if(c).alias(n) for n, c in {"hg": F.col("held") & F.col("good"), "lg": ~F.col("held") & F.col("good"), "lb": ~F.col("held") & ~F.col("good")}.items()])
    grid = counted.select("stratum", "rule").distinct().join(F.broadcast(steps), "rule").select("stratum", "rule", F.posexplode("steps").alias("i", "cutoff"))
    both = grid.alias("g").join(counted.alias("c"), F.col("g.stratum").eqNullSafe(F.col("c.stratum")) & (F.col("g.rule") == F.col("c.rule")))
    over = F.col("c.above") > F.col("g.i")
    tested = both.groupBy("g.stratum", "g.rule", "g.i", "g.cutoff").agg(
        F.sum("c.hg").alias("n"), *[F.sum(F.when(over, F.col(f"c.{x}")).otherwise(0)).alias(y) for x, y in (("hg", "k"), ("lg", "good_out"), ("lb", "bad_out"))], F.sum("c.lg").alias("lg"), F.sum("c.lb").alias("lb"),
    )
    strata = F.size(F.collect_set(F.coalesce(F.concat(F.lit("="), F.col("stratum").cast("string")), F.lit("null"))).over(Window.partitionBy()))
    tested = tested.withColumn("bound", binomial_cdf(F.col("k"), F.col("n"), a)).withColumn("strata", strata)
    fails = F.max(F.when(F.col("bound") > CONFIDENCE_ERROR / (len(named) * F.col("strata")), 1).otherwise(0)).over(Window.partitionBy("stratum", "rule").orderBy(F.desc("i")))
    gain = F.coalesce(F.try_divide(F.col("bad_out").cast("double"), F.col("lb")), F.lit(0.0)) - GOOD_COST * F.coalesce(F.try_divide(F.col("good_out").cast("double"), F.col("lg")), F.lit(0.0))
    passed = tested.withColumn("fails", fails).withColumn("gain", gain).where((F.col("fails") == 0) & (F.col("gain") > 0))
    near = passed.withColumn("top", F.max("gain").over(Window.partitionBy("stratum", "rule"))).where(F.col("gain") >= F.col("top") - SLACK)
    best = near.groupBy("stratum", "rule").agg(F.max(F.struct("i", "gain", "cutoff", "k", "n", "bound")).alias("b"))
    return best.select("stratum", "rule", "b.cutoff", "b.k", "b.n", "b.bound")


def judge(measured: DataFrame, chosen: DataFrame, stratum: str = "lang") -> DataFrame:
    """``measured`` with base_failed and kept; strata without cutoffs keep all that passes the base rules."""
    per = chosen.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cuts"))
    joined = measured.alias("m").join(per.alias("p"), F.col(f"m.{stratum}").eqNullSafe(F.col("p.stratum")), "left")
    bad = F.lit(False)
    for name, value in rules().items():
        bad = bad | F.coalesce(value > F.try_element_at(F.col("cuts"), F.lit(name)), F.lit(False))
    return joined.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~bad)


def op4_risk_controlled_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict for every document; strata are languages. Learns from ``labels.quality``."""
    measured = materialize(measures(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    chosen = materialize(cutoffs(measured, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return judge(measured, chosen).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
