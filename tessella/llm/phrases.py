"""Phrase collocations: Rabin-Karp fingerprints choose the frequent phrases, only these are materialised and counted by text."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm.tokens import LOWER, POWERS, INVERSES, U, Words, chunks, column_bytes, mix
from tessella.sources.shared import discard, materialize, partitions

#: A phrase counts from so many occurrences on, and has 2 to LONGEST words.
LEAST, LONGEST = 10, 3
#: A phrase goes if a longer candidate around it has this share of its occurrences (percent).
COVERED = 50
#: Phrases reported for each language: this limit is the feature.
TOP = 2000
#: Bits (a power of two) of the bitmap that tells tasks which fingerprints are frequent. It is all that is broadcast; where it
#: fills up, more phrases than necessary are materialised and the results stay the same.
BITS = 1 << 26
#: Fingerprints that a task holds before it hands them on, and bytes of text hashed at a time.
HELD, PIECE = 1 << 19, 1 << 20
BREAKS = np.zeros(256, dtype=bool)
BREAKS[[ord(c) for c in ".,;:!?\n\v\f\r"]] = True
SEPARATORS = BREAKS.copy()
SEPARATORS[[32, 9]] = True


def text_pieces(data: np.ndarray, offsets: np.ndarray, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """(bytes, offsets, documents, owned) of up to about ``limit`` bytes. A longer document comes in several: each ends
    after a word and is followed by the words that a phrase begun in it may need; words that begin before ``owned`` are its own."""
    for lo, hi in chunks(offsets, limit):
        if hi - lo > 1 or offsets[hi] - offsets[lo] <= limit:
            own = offsets[lo : hi + 1] - offsets[lo]
            yield data[offsets[lo] : offsets[hi]], own, np.arange(lo, hi), int(own[-1])
            continue
        at, end = int(offsets[lo]), int(offsets[hi])
        while at < end:
            cut = after_word(data, min(at + limit, end), end)
            tail = cut
            for _ in range(LONGEST - 1):
                tail = after_word(data, next_word(data, tail, end), end)
            yield data[at:tail], np.array([0, tail - at]), np.array([lo]), cut - at
            at = cut


def after_word(data: np.ndarray, at: int, end: int) -> int:
    """First separator from ``at`` on."""
    return at + first_true(SEPARATORS, data, at, end)


def next_word(data: np.ndarray, at: int, end: int) -> int:
    return at + first_true(~SEPARATORS, data, at, end)


def first_true(kind: np.ndarray, data: np.ndarray, at: int, end: int) -> int:
    start, step = at, 4096
    while at < end:
        hit = np.flatnonzero(kind[data[at : min(at + step, end)]])
        if len(hit):
            return at - start + int(hit[0])
        at, step = at + step, step * 2
    return end - start


class Piece:
    """Fingerprints of all phrases of a piece of text: prefix sums of the word hashes (the language mixed in) times powers
    of a base, so that each phrase costs one subtraction. ``grams(k)``: places of the first words of k-word phrases."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, owned: int, langs: np.ndarray):
        self.data = data
        self.words = w = Words(data, offsets, SEPARATORS)
        self.hash = mix(w.hash ^ langs[w.doc]) if len(w.hash) else w.hash
        self.owned = int(np.searchsorted(w.starts, owned))
        n = len(self.hash)
        breaks = np.concatenate(([0], np.cumsum(BREAKS[data], dtype=np.int64)))[w.starts]
        self.joined = np.zeros(n, dtype=bool)  # with the word before
        self.joined[1:] = (breaks[1:] == breaks[:-1]) & (w.doc[1:] == w.doc[:-1])
        self.sums = np.concatenate((np.zeros(1, U), np.cumsum(self.hash * POWERS.upto(n), dtype=U)))

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        n = max(0, len(self.hash) - k + 1)
        whole = np.ones(n, dtype=bool)
        for i in range(1, k):
            whole &= self.joined[i : i + n]
        at = np.flatnonzero(whole[: self.owned])
        return at, self.fingerprints(at, k)

    def fingerprints(self, at: np.ndarray, k: int) -> np.ndarray:
        return mix((self.sums[at + k] - self.sums[at]) * INVERSES.upto(len(self.sums))[at] + U(k))

    def frequent_grams(self, k: int, bitmaps: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases of k words all of whose parts of k - 1 words may be frequent."""
        at, prints = self.grams(k)
        if k > 1:
            may = np.ones(len(at), dtype=bool)
            for i in (0, 1):
                may &= marked(bitmaps[k - 2], self.fingerprints(at + i, k - 1))
            at, prints = at[may], prints[may]
        return at, prints


def marked(bitmap: np.ndarray, prints: np.ndarray) -> np.ndarray:
    bit = prints & U(64 * len(bitmap) - 1)
    return (bitmap[(bit >> U(6)).astype(np.int64)] >> (bit & U(63))) & U(1) == 1


def lang_hashes(langs: pa.Array) -> np.ndarray:
    coded = langs.dictionary_encode()
    known = np.array([xxhash.xxh64_intdigest(x.as_py() or "") for x in coded.dictionary], dtype=U)
    return known[coded.indices.to_numpy()] if len(langs) else np.zeros(0, U)


def pieces(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[Piece, pa.Array, np.ndarray]]:
    """(piece, languages, their row for each of the piece's documents) of batches of (lang, text)."""
    for batch in batches:
        data, offsets = column_bytes(batch.column(1))
        hashes = lang_hashes(batch.column(0))
        for body, own, docs, owned in text_pieces(data, offsets, size):
            yield Piece(body, own, owned, hashes[docs]), batch.column(0), docs


def summed(prints: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    keys, of = np.unique(np.concatenate(prints), return_inverse=True)
    return keys, np.bincount(of, weights=np.concatenate(counts), minlength=len(keys)).astype(np.int64)


def count_prints(texts: DataFrame, k: int, bitmaps: list, most: int, size: int) -> DataFrame:
    """(print, f): occurrences of the fingerprints of k words, those without frequent parts left out. A task sums what
    it holds before it hands rows on, Spark sums them before and after the exchange: a row for each fingerprint and task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = [b.value for b in bitmaps]
        prints, counts, held = [], [], 0
        for piece, _, _ in pieces(batches, size):
            found = np.unique(piece.frequent_grams(k, bits)[1], return_counts=True)
            prints.append(found[0])
            counts.append(found[1])
            held += len(found[0])
            if held >= most:
                merged = summed(prints, counts)
                prints, counts, held = [merged[0]], [merged[1]], len(merged[0])
                if held >= most // 2:
                    yield rows(*merged)
                    prints, counts, held = [], [], 0
        if held:
            yield rows(*summed(prints, counts))

    def rows(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], names=["print", "f"])

    return texts.mapInArrow(count, "print long, f long").groupBy("print").agg(F.sum("f").alias("f"))


def bitmap_of(counted: DataFrame, bits: int) -> np.ndarray:
    """The frequent fingerprints as a bitmap of ``bits`` bits: at most bits / 64 rows reach the driver, whatever the corpus."""
    bit = F.col("print").bitwiseAND(F.lit(bits - 1))
    cell = counted.where(F.col("f") >= LEAST).groupBy(F.shiftright(bit, 6).cast("int").alias("cell"))
    stored = materialize(cell.agg(F.bit_or(F.expr("shiftleft(1L, int(print & 63))")).alias("bits")))
    got = stored.toArrow()
    discard(stored)
    bitmap = np.zeros(bits // 64, dtype=U)
    bitmap[got.column("cell").to_numpy()] = got.column("bits").to_numpy().view(U)
    return bitmap


def exact_ids(piece: Piece, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of each of the words at ``at``, a place where each number stands): equal for words with equal hashes and equal
    bytes. The hash's first place is the pointer that every other place is compared with, byte by byte."""
    w, low = piece.words, LOWER[piece.data]
    starts, ends, hashes = w.starts[at], w.ends[at], piece.hash[at]
    _, first, ids = np.unique(hashes, return_index=True, return_inverse=True)
    size = ends - starts
    other = first[ids]
    differs = size != size[other]
    same = np.flatnonzero(~differs)
    each = size[same]
    begin = np.concatenate(([0], np.cumsum(each)[:-1])) if len(each) else each
    step = np.arange(int(each.sum())) - np.repeat(begin, each)
    unequal = low[np.repeat(starts[same], each) + step] != low[np.repeat(starts[other[same]], each) + step]
    if len(same):
        differs[same] = np.logical_or.reduceat(unequal, begin)
    seen: dict[tuple, int] = {}
    places = list(first)
    for i in np.flatnonzero(differs):
        key = (hashes[i], low[starts[i] : ends[i]].tobytes())
        if key not in seen:
            seen[key] = len(places)
            places.append(i)
        ids[i] = seen[key]
    return ids, at[np.array(places, dtype=np.int64)]


class Spelling:
    """Phrases of frequent words that a task has met: words are numbered by language and bytes, a phrase is its words' numbers
    packed in 63 bits, so nothing but bytes decides what is equal."""

    WIDTH = 21

    def __init__(self):
        self.number: dict[tuple, int] = {}
        self.keys: list[list] = [[] for _ in range(LONGEST)]
        self.counts: list[list] = [[] for _ in range(LONGEST)]
        self.held, self.merged = 0, False

    def numbers(self, piece: Piece, at: np.ndarray, langs: list[str]) -> np.ndarray:
        ids, places = exact_ids(piece, at)
        low, w = LOWER[piece.data].tobytes(), piece.words
        known = [self.number.setdefault((langs[d], low[a:b]), len(self.number)) for d, a, b in zip(w.doc[places].tolist(), w.starts[places].tolist(), w.ends[places].tolist())]
        out = np.full(len(piece.hash), -1, dtype=np.int64)
        out[at] = np.array(known, dtype=np.int64)[ids] if len(at) else ids
        return out

    def add(self, k: int, numbers: np.ndarray, at: np.ndarray) -> None:
        key = np.zeros(len(at), U)
        for i in range(k):
            key = (key << U(self.WIDTH)) | numbers[at + i].astype(U)
        keys, counts = np.unique(key, return_counts=True)
        self.keys[k - 1].append(keys)
        self.counts[k - 1].append(counts)
        self.held, self.merged = self.held + len(keys), False

    def merge(self) -> None:
        for k in range(LONGEST):
            if self.keys[k]:
                keys, counts = summed(self.keys[k], self.counts[k])
                self.keys[k], self.counts[k] = [keys], [counts]
        self.held, self.merged = sum(len(x) for keys in self.keys for x in keys), True

    def rows(self) -> Iterator[pa.RecordBatch]:
        self.merge()
        lang = pa.array([g for g, _ in self.number], pa.string())
        word = pa.array([b.decode("utf-8", "replace") for _, b in self.number], pa.string())
        for k in range(1, LONGEST + 1):
            for keys, counts in zip(self.keys[k - 1], self.counts[k - 1]):
                for i in range(0, len(keys), 1 << 16):
                    key = keys[i : i + (1 << 16)]
                    at = [((key >> U(self.WIDTH * (k - 1 - j))) & U((1 << self.WIDTH) - 1)).astype(np.int64) for j in range(k)]
                    phrase = pc.binary_join_element_wise(*[word.take(pa.array(x)) for x in at], " ") if k > 1 else word.take(pa.array(at[0]))
                    yield spelled_rows(k, lang.take(pa.array(at[0])), phrase, pa.array(counts[i : i + (1 << 16)], pa.int64()))
        self.__init__()


def spelled_rows(k: int, lang: pa.Array, phrase: pa.Array, f: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(f), k, np.int32)), lang, phrase, f], names=["k", "lang", "phrase", "f"])


def materialised(texts: DataFrame, bitmaps: list, most: int, size: int) -> DataFrame:
    """(k, lang, phrase, f): occurrences by text of the phrases whose fingerprints may be frequent; k = 0 has all words
    of the language. Within a task words are numbered by their bytes, between tasks rows are summed by text, so
    fingerprints that collide can't add up."""

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = [b.value for b in bitmaps]
        spelling, total = Spelling(), Counter()
        for piece, langs, docs in pieces(batches, size):
            lang = langs.take(pa.array(docs)).to_pylist()
            for d, n in enumerate(np.bincount(piece.words.doc[: piece.owned], minlength=len(docs)).tolist()):
                total[lang[d]] += n
            words = np.arange(len(piece.hash))
            words = words[marked(bits[0], piece.fingerprints(words, 1))]
            numbers = spelling.numbers(piece, words, lang)
            for k in range(1, LONGEST + 1):
                at, prints = piece.frequent_grams(k, bits)
                at = at[marked(bits[k - 1], prints)]
                for i in range(k):  # a phrase let through by chance may have a rare word, and is rare then
                    at = at[numbers[at + i] >= 0]
                spelling.add(k, numbers, at)
            if spelling.held >= 4 * most:
                spelling.merge()
            if spelling.held >= 2 * most and spelling.merged or len(spelling.number) > 1 << (Spelling.WIDTH - 1):
                yield from spelling.rows()
        yield from spelling.rows()
        yield spelled_rows(0, pa.array(list(total), pa.string()), pa.array([""] * len(total), pa.string()), pa.array(list(total.values()), pa.int64()))

    return texts.mapInArrow(spell, "k int, lang string, phrase string, f long").groupBy("k", "lang", "phrase").agg(F.sum("f").alias("f"))


def frequent_phrases(docs: DataFrame, bits: int = BITS, most: int = HELD, size: int = PIECE) -> DataFrame:
    """(k, lang, phrase, f) of all phrases of 1 to LONGEST words with f >= LEAST, stored; k = 0 has a language's words."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    bitmaps: list = []
    for k in range(1, LONGEST + 1):
        bitmaps.append(spark.sparkContext.broadcast(bitmap_of(count_prints(texts, k, bitmaps, most, size), bits)))
    found = materialize(materialised(texts, bitmaps, most, size).where((F.col("f") >= LEAST) | (F.col("k") == 0)))
    for b in bitmaps:
        b.destroy()
    return found


def words_of(phrase: Column, first: int, n: int | Column) -> Column:
    return F.array_join(F.slice(F.split(phrase, " "), first, n), " ")


def exact_score(a: Column, left: Column, right: Column) -> Column:
    """floor(1,000,000 a a / (left right)) in 38 decimal digits."""
    wide = [x.cast("decimal(19,0)") for x in (a, left, right)]
    return F.call_function("div", (wide[0] * wide[0]).cast("decimal(31,0)") * F.lit(1_000_000).cast("decimal(7,0)"), wide[1] * wide[2])


def collocations(docs: DataFrame, top: int = TOP, **fit) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's ``top`` best phrases of 2 to LONGEST words.

    ``docs`` needs ``lang`` and ``text``; a null language is ``und``, a null or empty text has no words, repeated rows
    count each time, further columns are left aside, no rows give no rows. Documents of any length are hashed in
    pieces. Ties in score go by occurrences, then by phrase in byte order. Hot words are summed before every exchange,
    joins on a hot word are left to Spark's skew join, and each task keeps its best phrases before the last ranking. ``fit``: bits,
    most and size of frequent_phrases.
    """
    spark = docs.sparkSession
    table = frequent_phrases(docs, **fit)
    counts = table.where("k > 0").select("lang", "phrase", "f")
    long = table.where("k > 1").select("lang", "phrase", "k", F.col("f").alias("a"))
    cuts = long.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    cuts = cuts.withColumns({"left": words_of(F.col("phrase"), 1, F.col("cut")), "right": words_of(F.col("phrase"), F.col("cut") + 1, F.col("k") - F.col("cut"))})
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    scored = cuts.withColumn("score", exact_score(F.col("a"), F.col("l"), F.col("r")))
    best = scored.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "cut", "l", "r")).alias("low"))
    inner = [(n, i) for n in range(2, LONGEST) for i in range(1, LONGEST - n + 2)]
    parts = F.array(*[F.when(F.col("k") >= i + n - 1, words_of(F.col("phrase"), i, n)) for n, i in inner])
    around = long.where("k > 2").select("lang", F.explode(parts).alias("phrase"), F.col("a").alias("longer"), F.length(F.col("phrase")).alias("size"))
    around = around.where(F.col("phrase").isNotNull() & (F.length("phrase") < F.col("size"))).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    left = best.join(around, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < COVERED * F.col("a")))
    kept = left.select("lang", "phrase", "a", F.col("low.l").alias("l"), F.col("low.r").alias("r"), F.col("low.score").alias("score"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    for salts in (partitions(spark), 8):
        some = kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(salts)))
        kept = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top).drop("salt", "rank")
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    ranked = ranked.join(table.where("k = 0").select("lang", F.col("f").alias("n")), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    result = materialize(ranked)
    discard(table)
    return result


def op13_rabin_karp_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP13_SQL = rf"""
with pieces as (
  select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
worded as (select lang, [x for x in regexp_split_to_array(piece, '[\x20\x09]+') if x <> ''] as w from pieces),
grams as (
  select lang, k, unnest([array_to_string(w[i:i + k - 1], ' ') for i in range(1, greatest(len(w) - k + 2, 1))]) as phrase
  from worded, (values (1), (2), (3)) t(k)),
f as (select lang, k, phrase, count(*) as f from grams group by all),
n as (select lang, sum(f)::bigint as n from f where k = 1 group by lang),
cand as (select lang, k, phrase, f as a, string_split(phrase, ' ') as w from f where k > 1 and f >= {LEAST}),
cuts as (select *, unnest(range(1, k)) as cut from cand),
parts as (select *, array_to_string(w[1:cut], ' ') as lw, array_to_string(w[cut + 1:k], ' ') as rw from cuts),
scored as (
  select p.lang, p.phrase, p.k, p.a, p.cut, x.f as l, y.f as r, ((1000000::hugeint * p.a * p.a) // (x.f::hugeint * y.f))::bigint as score
  from parts p join f x on x.lang = p.lang and x.phrase = p.lw and x.k = p.cut join f y on y.lang = p.lang and y.phrase = p.rw and y.k = p.k - p.cut),
best as (select *, row_number() over (partition by lang, phrase order by score, cut) as pick from scored),
around as (
  select lang, phrase, max(a) as longer from (
    select lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) as phrase from cand where k = 3) group by all),
kept as (
  select b.lang, b.phrase, b.a, b.l, b.r, b.score from best b left join around o on o.lang = b.lang and o.phrase = b.phrase
  where b.pick = 1 and (o.longer is null or 100 * o.longer < {COVERED} * b.a)),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept)
select r.lang, r.rank, r.phrase, r.a, r.l, r.r, n.n, r.score from ranked r join n on n.lang = r.lang where r.rank <= {TOP}
"""
