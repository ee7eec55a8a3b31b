"""Toxicity: noisy-channel restoration of disguised words, then a learnt lexicon."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.fitting import fold, logistic, sigmoid
from tessella.sources.shared import discard, materialize

#: Keys of texts that the driver looks for near copies in one after another; more are settled by tables first.
ON_DRIVER = 20_000
#: A word is known if more than one text is clean and has it, and more than one of so many clean texts.
KNOWN = 50_000
#: A lexicon entry is a word, or "abcd*": all longer words that begin so.
STEMS = (4, 5, 6)
#: Letters of a piece of a word that is written in pieces, and of the windows tried in a row of single letters.
PIECE, WINDOWS = 3, range(4, 13)
#: Tokens and restored forms that a task remembers.
REMEMBER = 200_000
# Characters that stand for letters.
LOOKS_LIKE = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "¢": "c",
}
SWAP, DROP, BREAK, DOUBLE, KEEP = math.log(0.3), math.log(0.5), math.log(0.5), math.log(0.4), math.log(0.9)
WORD = re.compile(r"[^\x20\x09-\x0D]+")
EDGES = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c not in "@$!|+(") + "«»“”„‘’…¿"
LETTER = r"[^\W_]"
HIDDEN = re.compile(rf"{LETTER}[^\s\w]+{LETTER}|[0-9@$!|+(€£¡¢]|_|(.)\1\1")
TWICE = re.compile(rf"({LETTER})\1")
SEPARATORS = str.maketrans("", "", ".-_*~,")


class Channel:
    """Viterbi decoder over a character model. Its lattice has a place for each run of a character, which came from one
    or two letters that it looks like, or is a separator: that came from nothing, or ends a word. Time is linear in
    the length; the states at a place are the last two source letters that are possible there.

    ``known`` holds the words of clean texts that might be taken for disguised ones: with a doubled letter, or short."""

    def __init__(self, pairs: dict[str, dict[str, float]], floor: float, known: frozenset[str] = frozenset()):
        self.pairs, self.floor, self.known = pairs, floor, known
        self.restore, self.piece, self.next = lru_cache(REMEMBER)(self.decode), lru_cache(REMEMBER)(piece), lru_cache(REMEMBER)(self.moves)

    @staticmethod
    def learn(words: Counter) -> tuple[dict[str, dict[str, float]], float]:
        """log P(next character | two before), "^" and "$" at the ends; unseen ones get a floor."""
        counts: dict[str, Counter] = defaultdict(Counter)
        for word, n in words.items():
            padded = f"^^{word}$"
            for i in range(2, len(padded)):
                counts[padded[i - 2 : i]][padded[i]] += n
        return Channel.model(counts)

    @staticmethod
    def model(counts: dict[str, Counter]) -> tuple[dict[str, dict[str, float]], float]:
        """The same from how often each character follows two others."""
        pairs = {}
        for context, c in counts.items():
            total = sum(c.values()) + 40
            pairs[context] = {x: math.log(n / total) for x, n in c.items()}
        return pairs, math.log(1e-6)

    def step(self, context: str, c: str) -> float:
        return self.pairs.get(context, {}).get(c, self.floor)

    @staticmethod
    def sources(c: str, n: int) -> list[tuple[str, float]]:
        """(source, log cost) of a character that stands n times; a space ends a word."""
        if c.isalpha():
            return [(c, KEEP if n == 1 else DROP)] + [(c * 2, KEEP if n == 2 else DOUBLE)] * (n > 1)
        if c in LOOKS_LIKE:
            return [(x * k, SWAP + (0 if n == k else DROP)) for x in LOOKS_LIKE[c] for k in ((1, 2) if n > 1 else (1,))]
        return [("", DROP), (" ", BREAK)]

    def follow(self, context: str, source: str) -> tuple[float, str]:
        """Log probability of ``source`` after ``context``, and the context then."""
        p = 0.0
        for x in source:
            if x == " ":
                p, context = p + self.step(context, "$"), "^^"
            else:
                p, context = p + self.step(context, x), context[1] + x
        return p, context

    def moves(self, context: str, c: str, n: int) -> list[tuple[float, str, str, float]]:
        """(log probability, context then, source, log cost) of what a character that stands n times may come from."""
        return [(*self.follow(context, source), source, cost) for source, cost in self.sources(c, n)]

    def decode(self, observed: str) -> str:
        """The likeliest source of lower-case text: words, with a space between them. Ties go to the later in the
        order of strings."""
        best: dict[str, tuple[float, tuple]] = {"^^": (0.0, ())}  # a source is a chain of (chain before, piece)
        for c, run in groupby(observed):
            times = len(list(run))
            nxt: dict[str, tuple[float, tuple]] = {}
            for context, (p, chain) in best.items():
                for q, at, source, cost in self.next(context, c, times):
                    q += p + cost
                    if at not in nxt or q > nxt[at][0]:
                        nxt[at] = (q, (chain, source))
            best = nxt
        return max((p + self.step(at, "$"), unchained(chain)) for at, (p, chain) in best.items())[1]

    def hidden(self, token: str) -> set[str]:
        """Words that a lower-case token may stand for, if it looks disguised: look-alikes, separators inside, a
        character three times, or a doubled letter in a word that clean texts don't have."""
        if token.isalpha() and not TWICE.search(token):
            return set()
        core = token.strip(EDGES)
        for ends in (core[-1:], core[:1]):
            if ends and not (ends.isalnum() or ends == "_") and (core.endswith(ends * 3) or core.startswith(ends * 3)):
                core = core.strip(ends)
        found: set[str] = set()
        for form in {core, core.strip("!(|")}:
            if any(x.isalpha() for x in form) and (HIDDEN.search(form) or (TWICE.search(form) and form not in self.known)):
                found.update((self.restore if len(form) <= 64 else self.decode)(form).split())
        return found

    def spelled_out(self, tokens: list[str]) -> set[str]:
        """Words that neighbouring short pieces may stand for ("f o z", "fo zz le"): rows of pieces of up to PIECE letters, one
        of which at least is no word of clean texts, decoded whole with their spaces as separators. In rows of single letters
        every window of WINDOWS letters is tried as well."""
        found: set[str] = set()
        row: list[str] = []
        pieces = {t: self.piece(t) for t in set(tokens) if len(t) <= 2 * PIECE + 1}
        for part in (*map(pieces.get, tokens), None):
            if part:
                row.append(part)
                continue
            if not row:
                continue
            if len(row) > 1 and any(x not in self.known for x in row) and sum(map(len, row)) > PIECE and any(x.isalpha() for x in row):
                text = " ".join(row)
                found.update((self.restore if len(text) <= 64 else self.decode)(text).split())
                for single, some in groupby(row, lambda x: len(x) == 1):
                    if single and len(letters := "".join(some)) >= WINDOWS[0]:
                        for n in WINDOWS:
                            for i in range(len(letters) - n + 1):
                                found.update(self.restore(letters[i : i + n]).split())
            row = []
        return found


def piece(token: str) -> str | None:
    """The letters and look-alikes of a token that may be a piece of a word."""
    part = token.strip(EDGES).translate(SEPARATORS)
    return part if part and len(part) <= PIECE and (part.isalpha() or all(x.isalpha() or x in LOOKS_LIKE for x in part)) else None


def unchained(chain: tuple) -> str:
    pieces = []
    while chain:
        chain, piece = chain
        pieces.append(piece)
    return "".join(reversed(pieces))


def plain(token: str) -> str:
    """A lower-case token without the punctuation around it."""
    return token.strip(EDGES).rstrip("!")


def letter_words(text: str) -> set[str]:
    return {w for t in set(WORD.findall(text.lower())) if (w := plain(t)).isalpha()}


def entries(word: str) -> list[str]:
    return [word] + [word[:n] + "*" for n in STEMS if len(word) > n]


class Lexicon:
    """Entries with weights; a text's evidence is (largest weight, log of 1 + distinct entries, log of 1 + hits)."""

    def __init__(self, weights: dict[str, float], channel: Channel):
        self.weights, self.channel = weights, channel
        self.starts = {e[: STEMS[0]] for e in weights if e.endswith("*")}
        self.of_token = lru_cache(REMEMBER)(lambda token: tuple({e for w in (plain(token), *channel.hidden(token)) for e in self.of_word(w)}))

    def of_word(self, word: str) -> list[str]:
        if word not in self.weights and word[: STEMS[0]] not in self.starts:
            return []
        return [e for e in entries(word) if e in self.weights]

    def evidence(self, text: str | None) -> tuple[float, float, float]:
        if not text or not self.weights:
            return 0.0, 0.0, 0.0
        tokens = WORD.findall(text.lower())
        hits: Counter = Counter()
        for token, n in Counter(tokens).items():
            for e in self.of_token(token) if len(token) <= 64 else self.of_token.__wrapped__(token):
                hits[e] += n
        hits.update(e for w in self.channel.spelled_out(tokens) for e in self.of_word(w))
        if not hits:
            return 0.0, 0.0, 0.0
        return max(self.weights[e] for e in hits), math.log1p(len(hits)), math.log1p(sum(hits.values()))


def band_keys(words: list[str], bands: int = 12, width: int = 4) -> list[int]:
    """Numbers of a text's distinct words, one for each band of min-hashes: near copies share one of them."""
    odd = (np.arange(1, bands * width + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    h = np.array([zlib.crc32(w.encode("utf-8", "replace")) for w in words], dtype=np.uint64) + np.uint64(1)
    low = np.array([((h[i : i + 4096, None] * odd) >> np.uint64(16)).min(axis=0) for i in range(0, len(h), 4096)]).min(axis=0)
    return [number(bytes([b]) + low[b * width : (b + 1) * width].tobytes()) for b in range(bands)]


def number(value: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(value, digest_size=8).digest(), "little", signed=True)


def word_rows(texts: DataFrame) -> DataFrame:
    """Stored (doc_id, same, n, label, words, keys) of (doc_id, label, text): a number of the text and one of the row, the text's distinct
    letter words, and the numbers that it has in common with near copies (with equal texts where it has no words)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, same, keys = [], [], []
            for text in batch.column(2).to_pylist():
                mine = sorted(letter_words(text))
                words.append(" ".join(mine))
                same.append(number(text.encode("utf-8", "replace")))
                keys.append(band_keys(mine) if mine else same[-1:])
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(words, pa.string()), pa.array(same, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "label", "words", "same", "keys"])

    made = texts.select("doc_id", "label", "text").mapInArrow(rows, "doc_id long, label int, words string, same long, keys array<long>")
    return materialize(made.select("doc_id", "same", F.monotonically_increasing_id().alias("n"), "label", "words", "keys"), "zstd")


def without_copies(rows: DataFrame) -> DataFrame:
    """``rows`` of word_rows() with one text of each id, without those that have a key in common with an earlier one that stays, in the
    order of ids: a word that is rare but for one text with many copies tells nothing about toxicity. What shares no key stays.
    Of the others, in each round, what is first in all its keys stays and what shares a key with it goes; the last ON_DRIVER
    keys are settled one after another. Only ids and keys are exchanged for it."""
    texts = rows.groupBy("doc_id").agg(F.min_by(F.struct("n", "keys"), F.struct("same", "n")).alias("t")).select(F.col("doc_id").alias("row"), "t.n", "t.keys")
    texts = materialize(texts)
    keys = texts.select("row", F.explode(F.array_distinct("keys")).alias("key"))
    left = materialize(keys.withColumn("many", F.count("*").over(Window.partitionBy("key"))).where("many > 1").select("row", "key"))
    shared = left
    kept: list[DataFrame] = []
    while left.count() > ON_DRIVER:
        firsts = materialize(left.withColumn("first", F.min("row").over(Window.partitionBy("key"))))
        kept.append(materialize(firsts.groupBy("row").agg(F.min(F.col("row") == F.col("first")).alias("stays")).where("stays").select("row")))
        # a key that a text has that stays is one that it is the first of
        settled = firsts.join(kept[-1].withColumnRenamed("row", "first"), "first", "left_semi").select("row").distinct()
        left = materialize(firsts.join(settled, "row", "left_anti").select("row", "key"))
        discard(firsts)
    seen: set[int] = set()
    last = []
    for r in sorted(left.groupBy("row").agg(F.collect_list("key").alias("keys")).collect(), key=lambda r: r["row"]):
        if not seen.intersection(r["keys"]):
            seen.update(r["keys"])
            last.append(r["row"])
    stay = rows.sparkSession.createDataFrame([(r,) for r in last], "row long")
    for some in kept:
        stay = stay.unionByName(some)
    gone = shared.select("row").distinct().join(stay, "row", "left_anti")
    return rows.join(texts.join(gone, "row", "left_anti").select("n"), "n", "left_semi")


#: Kinds of what is counted in texts: three neighbouring characters, words that may look disguised in clean ones, entries of toxic ones, and labels.
TRIPLE, PLAIN, TOXIC, LABEL = range(4)


def counted(rows: DataFrame) -> DataFrame:
    """Stored (kind, key, n): in how many of ``rows`` (label, words) each key is. Tasks add up before rows are exchanged, so many
    keys at a time as they hold; unique words of one text go no further."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for y, words in zip(batch.column(0).to_pylist(), (w.as_py().split() for w in batch.column(1))):
                held[LABEL, str(y)] += 1
                if y:
                    held.update((TOXIC, e) for e in {e for w in words if len(w) > 2 for e in entries(w)})
                else:
                    held.update((PLAIN, w) for w in words if len(w) <= PIECE or TWICE.search(w))
                if len(held) > REMEMBER:
                    yield counts_of(held)
                    held = Counter()
            held.update({(TRIPLE, k): n for k, n in triples(" ".join(batch.column(1).to_pylist()).split()).items()})
        yield counts_of(held)

    def counts_of(held: Counter) -> pa.RecordBatch:
        kinds, keys = zip(*held) if held else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(keys, pa.string()), pa.array(held.values(), pa.int64())], names=["kind", "key", "n"])

    parts = rows.select("label", "words").mapInArrow(run, "kind int, key string, n long")
    return materialize(parts.groupBy("kind", "key").agg(F.sum("n").alias("n")).where(f"kind in ({TRIPLE}, {LABEL}) or n > 1"))


def triples(words: list[str]) -> dict[str, int]:
    """How often each character follows the two before it in words, with "^^" before them and "$" after."""
    codes = np.frombuffer(("^^" + "$^^".join(words) + "$").encode("utf-32-le"), dtype=np.uint32).astype(np.int64) if words else np.zeros(2, np.int64)
    key, n = np.unique((codes[:-2] << 42 | codes[1:-1] << 21 | codes[2:])[codes[2:] != ord("^")], return_counts=True)
    low = (1 << 21) - 1
    return {chr(k >> 42) + chr(k >> 21 & low) + chr(k & low): c for k, c in zip(key.tolist(), n.tolist())}


#: Bits of the map that tells apart entries of toxic texts from most others.
MAP = 1 << 24


def learn_lexicon(rows: DataFrame, counts: DataFrame, n_toxic: int, n_clean: int, least: float = 18.0, pure: float = 0.95, often: int = 5) -> dict[str, float]:
    """Log odds of the entries that mark toxic texts, from all ``rows`` (label, words) and their ``counts``: at least ``pure`` of the texts that
    have one are toxic, and so many that chance is ruled out for any of millions of words (likelihood ratio of at least
    exp(least)). A stem must tell more than its words: it needs a third more texts than any one of them. Entries of
    fewer than ``often`` toxic texts can't reach that; of clean texts only the others are counted, by way of a map of their hashes."""
    if not n_toxic or not n_clean:
        return {}
    spark = rows.sparkSession
    toxic = counts.where((F.col("kind") == TOXIC) & (F.col("n") >= often)).select(F.col("key").alias("entry"), F.col("n").alias("t"))
    place = F.crc32("entry") % MAP
    bits = np.zeros((MAP >> 15, 4096), dtype=np.uint8)
    for r in toxic.groupBy((place / 32768).cast("int").alias("at")).agg(F.bitmap_construct_agg(place % 32768).alias("bits")).collect():
        bits[r["at"]] = np.frombuffer(r.bits, dtype=np.uint8)
    shared = spark.sparkContext.broadcast(bits.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.unpackbits(np.frombuffer(shared.value, dtype=np.uint8), bitorder="little").tobytes()
        held: Counter = Counter()
        for batch in batches:
            for words in batch.column(0):
                held.update({e for w in words.as_py().split() if len(w) > 2 for e in entries(w) if known[zlib.crc32(e.encode()) % MAP]})
                if len(held) > REMEMBER:
                    yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["entry", "c"])
                    held = Counter()
        yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["entry", "c"])

    clean = rows.where("label = 0").select("words").mapInArrow(run, "entry string, c long").groupBy("entry").agg(F.sum("c").alias("c"))
    share = n_toxic / (n_toxic + n_clean)
    both = toxic.join(clean, "entry", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    t, c = F.col("t"), F.col("c")
    ratio = t * F.log(t / (t + c) / share) + F.when(c > 0, c * F.log(c / (t + c) / (1 - share))).otherwise(0.0)
    telling = both.where((t >= pure * (t + c)) & (ratio >= least))
    # the most texts that a word with a stem is in
    stems = [F.when(F.length("entry") > n, F.concat(F.substring("entry", 1, n), F.lit("*"))) for n in STEMS]
    most = toxic.where("not endswith(entry, '*')").select(F.explode(F.array_compact(F.array(*stems))).alias("entry"), "t").groupBy("entry").agg(F.max("t").alias("most"))
    found = telling.join(most, "entry", "left").where("3 * t >= 4 * coalesce(most, 0)").orderBy("entry").collect()
    return {r.entry: math.log((r.t + 0.5) / (n_toxic + 1)) - math.log((r.c + 0.5) / (n_clean + 1)) for r in found}


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, keep: Column) -> DataFrame:
    """Stored (doc_id, label, part, text) of all rows with a label and a text; ``part`` deals texts to 0..3 by a hash, equal ones alike."""
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & keep)
    known = materialize(known.groupBy("doc_id").agg(F.max("label").alias("label")))  # its size is known, so texts aren't exchanged for a small one
    texts = docs.select("doc_id", "text").where("text is not null").join(known, "doc_id")
    part = F.pmod(F.xxhash64(F.lit("part"), "text"), F.lit(4)).cast("int")
    made = materialize(texts.select(F.col("doc_id").cast("long").alias("doc_id"), "label", part.alias("part"), "text"), "zstd")
    discard(known)
    return made


def fit(docs: DataFrame, labels: DataFrame, label: str, keep: Column) -> tuple[dict, float, frozenset, dict, list[float]]:
    """(character model, its floor, known words, lexicon, logistic weights) from all labelled rows, whole texts: three quarters of
    them without near copies give the lexicon and the character model, a quarter calibrates; a repeated id counts once in each. Texts
    are counted by tasks. The driver gets the lexicon, triples of characters, short or doubled words that several
    clean texts have (more than one in KNOWN), and how often the last quarter's texts have the same three numbers. Without labels the score is one half."""
    texts = labelled_texts(docs, labels, label, keep)
    words = word_rows(texts.where("part <> 0"))
    rows = materialize(without_copies(words).select("label", "words"), "zstd")
    discard(words)
    counts = counted(rows)
    n = {int(r.key): r.n for r in counts.where(f"kind = {LABEL}").collect()}
    n_toxic, n_clean = n.get(1, 0), n.get(0, 0)
    after: dict[str, Counter] = defaultdict(Counter)
    for r in counts.where(f"kind = {TRIPLE}").collect():
        after[r.key[:2]][r.key[2]] += r.n
    pairs, floor = Channel.model(after)
    known = frozenset(r.key for r in counts.where((F.col("kind") == PLAIN) & (F.col("n") > max(1, n_clean / KNOWN))).collect())
    model = (pairs, floor, known, learn_lexicon(rows, counts, n_toxic, n_clean))
    discard(counts, rows)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = reader_of(shared.value)
        for batch in batches:
            x = np.array([reader.evidence(t.as_py()) for t in batch.column(2)]).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array(x[:, k]) for k in range(3))], names=["doc_id", "label", "a", "b", "c"])

    held = texts.where("part = 0").select("doc_id", "label", "text").mapInArrow(evidence, "doc_id long, label int, a double, b double, c double")
    once = held.groupBy("doc_id").agg(F.min(F.struct("label", "a", "b", "c")).alias("x")).groupBy("x.label", "x.a", "x.b", "x.c").agg(F.count("*").alias("n"))
    held = np.array(sorted(map(tuple, once.collect())), dtype=float).reshape(-1, 5)
    discard(texts)
    return *model, logistic(held[:, 1:4], held[:, 0], ridge=0.1, times=held[:, 4]).tolist()


def reader_of(model: tuple) -> Lexicon:
    pairs, floor, known, weights = model[:4]
    return Lexicon(weights, Channel(pairs, floor, known))


def score_toxicity(docs: DataFrame, model: tuple) -> DataFrame:
    """``docs`` with a column ``score``: the chance that the whole text is toxic. Null and empty texts get that of a
    text without evidence; repeated rows are scored each. ``docs`` must have ``text`` and no ``score``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, w = reader_of(shared.value), np.array(shared.value[4])
        for batch in batches:
            x = np.array([reader.evidence(t.as_py()) for t in batch.column(at)]).reshape(-1, 3)
            z = np.column_stack([x, np.ones(len(x))]) @ w
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sigmoid(z))], names=[*batch.schema.names, "score"])

    return docs.mapInArrow(score, T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())]))


def drop_toxic(docs: DataFrame, labels: DataFrame, keep: Column) -> DataFrame:
    """Rows of ``docs`` that score under 0.5, with all their columns."""
    named = docs.select(F.col("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    kept = score_toxicity(named, fit(docs, labels, "toxic", keep)).where("score < 0.5")
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def op6_deobfuscated_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = score_toxicity(docs.select("doc_id", "text"), fit(docs, labels, "toxic", fold(F.col("doc_id"), 5) != 0))
    return scored.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
