"""Katz backoff model of any order: Good-Turing discounts, exactly normalised backoff weights, scored for every token."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.blobs import Sums, deal_ranges, pack, pack_sorted, unpack, unpack_sorted
from tessella.llm.fitting import fold
from tessella.llm.tokens import U, Words, chunks, column_bytes, mix
from tessella.sources.shared import discard, materialize

#: Counts up to K get Good-Turing discounts; larger ones give up SPARE of a count, so that every context leaves mass
#: for words not seen after it.
K, SPARE = 5, 0.01
#: Order of the model, unless told otherwise.
ORDER = 3
#: Tokens in a chunk of documents, bytes of text read at a time for it, and tokens for each partition of the tables.
CHUNK_TOKENS, PIECE_BYTES, PART_TOKENS = 600_000, 1 << 19, 1 << 20
#: Steps that send all chunks with their answers do so in this many rounds, so that not all of them lie in shuffle files at once.
ROUNDS = 2
END, START = (int(x) for x in mix(np.array([101, 202], dtype=U)))
STEP = U(0xA24BAED4963EE407)
CHUNK_SCHEMA = "chunk long, doc_ids array<long>, held array<boolean>, bounds array<long>, n_tokens long, n_train long, ids binary, vocab binary"
#: kind 0: a chunk, with what it knows of its n-grams so far; n: an answer, or keys and counts, of n-grams; -n: counts of counts.
ROWS_SCHEMA = f"kind int, slot long, {CHUNK_SCHEMA}, known array<binary>, keys binary, counts binary, stats array<long>"
ROWS = pa.schema(
    [("kind", pa.int32()), ("slot", pa.int64()), ("chunk", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("bounds", pa.list_(pa.int64()))]
    + [("n_tokens", pa.int64()), ("n_train", pa.int64()), ("ids", pa.binary()), ("vocab", pa.binary()), ("known", pa.list_(pa.binary())), ("keys", pa.binary()), ("counts", pa.binary()), ("stats", pa.list_(pa.int64()))]
)
#: Slots of one partition: n-grams of each order have their own.
LEVELS = 16


def chunk_documents(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, text, held) -> chunks: whole documents as places in the chunk's own vocabulary of hashes.

    Words are lower-cased (A-Z) and split at ASCII white space; each text ends with END, so a null text is END alone.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held, tokens, sizes, made = [], [], [], [], 0
        base = TaskContext.get().partitionId() << 33

        def chunk() -> pa.RecordBatch:
            nonlocal made
            vocab, places = np.unique(np.concatenate(tokens), return_inverse=True)
            bounds = np.cumsum([0, *sizes])
            train = int(sum(s for s, h in zip(sizes, held) if not h))
            out = [[base + made], [ids], [held], [bounds], [len(places)], [train], [pack(places.astype(np.int32))], [pack_sorted(vocab)]]
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
            made += 1
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds)], names=[f.split()[0] for f in CHUNK_SCHEMA.split(", ")])

        for batch in batches:
            data, offsets = column_bytes(batch.column(1))
            doc_ids, flags = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for lo, hi in chunks(offsets, PIECE_BYTES):
                words = Words(data, offsets[lo : hi + 1])
                tokens.append(np.insert(words.hash, words.first[1:], U(END)))
                sizes += (np.diff(words.first) + 1).tolist()
                ids += doc_ids[lo:hi]
                held += flags[lo:hi]
                if sum(map(len, tokens)) >= CHUNK_TOKENS:
                    yield chunk()
                    ids, held, tokens, sizes = [], [], [], []
        if ids:
            yield chunk()

    return docs.select("doc_id", "text", "held").mapInArrow(rows, CHUNK_SCHEMA)


class Chunk:
    """A chunk unpacked: its distinct n-grams of every order up to ``order``, by number. ``of[n]`` gives each token the n-gram
    that ends there (-1 where the text is too short for one; the start of a text counts as a word of contexts), ``left[n]`` and
    ``suffix[n]`` each n-gram's first and last n - 1 words, and ``keys[n]`` its hash."""

    def __init__(self, row: dict, order: int):
        self.row, self.order = row, order
        self.ids = unpack(row["ids"], np.int32)
        self.vocab = unpack_sorted(row["vocab"])
        self.bounds = np.array(row["bounds"], dtype=np.int64)
        self.held = np.array(row["held"], dtype=bool)
        self.train = np.repeat(~self.held, np.diff(self.bounds))
        size, n = len(self.vocab), len(self.ids)
        place = np.arange(n) - np.repeat(self.bounds[:-1], np.diff(self.bounds))
        self.names = np.append(self.vocab, U(START))
        self.of, self.keys, self.left, self.right, self.suffix = ({} for _ in range(5))
        self.of[1], self.keys[1] = self.ids, self.vocab
        for k in range(2, order + 1):
            where = np.flatnonzero(place >= k - 2)
            if k == 2:
                prefix, below = np.full(n, size, dtype=np.int64), self.names
                prefix[1:] = self.ids[:-1]
                prefix[self.bounds[:-1]] = size
            else:
                prefix, below = self.of[k - 1][where - 1].astype(np.int64), self.keys[k - 1]
            codes, first, of = np.unique(prefix * (size + 1) + self.ids[where], return_index=True, return_inverse=True)
            del prefix
            self.of[k] = np.full(n, -1, dtype=np.int32)
            self.of[k][where] = of
            self.left[k], self.right[k] = (x.astype(np.int32) for x in np.divmod(codes, size + 1))
            self.suffix[k] = self.of[k - 1][where][first]
            self.keys[k] = mix(below[self.left[k]] * STEP + self.vocab[self.right[k]])

    def counts(self, k: int) -> np.ndarray:
        """Twice the training count of each n-gram, plus 1 where held-out texts have it."""
        of, there = self.of[k], self.of[k] >= 0
        count = lambda w: np.bincount(of[there], weights=w[there], minlength=len(self.keys[k]))
        return (2 * count(self.train) + (count(~self.train) > 0)).astype(np.uint32)

    def guess(self, k: int, known: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(what is known of each n-gram from its two (n-1)-grams, which ones must be asked for). An n-gram with a part that
        training doesn't have isn't there; one with a part that stands once in training and never in held-out texts
        is that one place, so its count is 1 and no other chunk has it. Both are exact."""
        ends = np.stack((known[k - 1][self.left[k]], known[k - 1][self.suffix[k]]))
        absent = (ends >> 2 == 0).any(axis=0)
        single = ~absent & (ends >> 1 == 2).any(axis=0)
        return np.where(single, 5, 0), np.flatnonzero(~absent & ~single)

    def blocks(self, k: int, which: np.ndarray, parts: int) -> list[dict]:
        keys, counts = self.keys[k][which], self.counts(k)[which]
        order, bounds = deal_ranges(keys, parts)
        out = []
        for p in np.flatnonzero(np.diff(bounds)):
            at = order[bounds[p] : bounds[p + 1]]
            out.append({"kind": k, "slot": int(LEVELS * p + k), "chunk": self.row["chunk"], "keys": pack_sorted(keys[at]), "counts": pack(counts[at])})
        return out


def first_blocks(stored: DataFrame, order: int, parts: int) -> DataFrame:
    """Chunks -> blocks of keys and counts of words and bigrams for each partition of their tables."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                c = Chunk(batch.slice(i, 1).to_pylist()[0], min(order, 2))
                yield pa.RecordBatch.from_pylist([r for k in c.keys for r in c.blocks(k, np.arange(len(c.keys[k])), parts)], schema=ROWS)

    return stored.mapInArrow(rows, ROWS_SCHEMA)


def told(table: pa.Table, order: int, upto: int, parts: int) -> tuple[Chunk, dict[int, np.ndarray]]:
    """A chunk with what it knows of its n-grams of each order up to ``upto``: 4 * training count, plus 2 where held-out texts have it,
    plus 1 in the one chunk that stands for the n-gram. ``table`` holds the chunk and the answers that came last."""
    rows = table.to_pylist()
    state = next(r for r in rows if r["ids"] is not None)
    have = next(([unpack(v, np.int64) for v in r["known"]] for r in rows if r["known"]), [])
    c = Chunk(state, order)
    known = dict(enumerate(have, 1))
    for k in range(len(have) + 1, upto + 1):
        value, asked = (np.zeros(len(c.keys[k]), np.int64), np.arange(len(c.keys[k]))) if k < 3 else c.guess(k, known)
        deals, bounds = deal_ranges(c.keys[k][asked], parts)
        for r in rows:
            if r["kind"] == k:
                p = r["slot"] // LEVELS
                value[asked[deals[bounds[p] : bounds[p + 1]]]] = unpack(r["counts"], np.int64)
        known[k] = value
    return c, known


def next_blocks(k: int, parts: int):
    """A chunk with all answers of lower orders -> what it knows of them, blocks of the n-grams it must ask for, and
    how many single ones it holds."""

    def of(table: pa.Table) -> pa.Table:
        c, known = told(table, k, k - 1, parts)
        value, asked = c.guess(k, known)
        state = {"kind": 0, "chunk": c.row["chunk"], "known": [pack(known[n]) for n in range(1, k)]}
        singles = {"kind": -k, "stats": [0, int((value == 5).sum()), *[0] * (K + 1)]}
        return pa.Table.from_pylist([state, singles, *c.blocks(k, asked, parts)], schema=ROWS)

    return of


def total_counts(table: pa.Table) -> pa.Table:
    """One partition's blocks -> for each block the totals of its keys, and a row with counts of counts."""
    rows = sorted(table.to_pylist(), key=lambda r: r["chunk"])
    slot, k = rows[0]["slot"], rows[0]["kind"]
    sums = Sums([unpack_sorted(r["keys"]) for r in rows])
    counts = np.concatenate([unpack(r["counts"], np.uint32) for r in rows]).astype(np.int64)
    total, asked = sums.total([counts >> 1]).astype(np.int64), sums.total([counts & 1]) > 0
    mine = np.zeros(len(sums.of), dtype=np.int64)
    seen = np.flatnonzero(counts > 1)
    mine[seen[np.unique(sums.of[seen], return_index=True)[1]]] = 1
    values = (4 * total + 2 * asked)[sums.of] + mine
    out = [{"kind": k, "chunk": r["chunk"], "slot": slot, "counts": pack(values[a:b])} for r, a, b in zip(rows, sums.bounds[:-1], sums.bounds[1:])]
    out.append({"kind": -k, "slot": slot, "stats": np.bincount(np.minimum(total, K + 2), minlength=K + 3).tolist()})
    return pa.Table.from_pylist(out, schema=ROWS)


def discounts(n: list[int]) -> np.ndarray:
    """Katz's d_0..d_K from counts of counts n[r]. Where the counts give no ratio within
    (0, 1), an absolute discount of one half stands in."""
    d = np.ones(K + 1)
    common = (K + 1) * n[K + 1] / n[1] if n[1] else 1.0
    for r in range(1, K + 1):
        x = ((r + 1) * n[r + 1] / n[r] / r - common) / (1 - common) if n[r] and common < 1 else 0.0
        d[r] = x if 0 < x < 1 else 1 - 0.5 / r
    return d


def kept(c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Discounted counts; 0 stays 0."""
    return np.where(c <= K, d[np.minimum(c, K)] * c, c - SPARE)


def given_up(types: list, d: np.ndarray):
    """Sum of what kept() takes from types[r] types of count r, types[K + 1] being those over K."""
    return sum((1 - d[r]) * r * types[r] for r in range(1, K + 1)) + SPARE * types[K + 1]


@dataclass
class Model:
    """What all tokens share: N, V, the discounts of each order, counts of counted words, training documents."""

    n: int
    v: int
    discounts: dict[int, np.ndarray]
    counted: list[int]
    docs: int

    def unigram(self, c: np.ndarray) -> np.ndarray:
        """P(word) from its count; a count of 0 is the one unknown word, which gets what the discounts left."""
        if self.n == 0:
            return np.ones(len(c))
        over = self.v - sum(self.counted[1 : K + 1])
        return np.where(c > 0, kept(c, self.discounts[1]), given_up([*self.counted[: K + 1], over], self.discounts[1])) / self.n

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.5) / (self.n + 0.5 * (self.v + 1)))


PARTIAL_SCHEMA = "kind int, chunk long, slot long, keys binary, values binary, few binary, docs binary, contexts binary, doc_ids array<long>, held array<boolean>, n_tokens array<long>, n_known array<long>, base array<double>, score array<double>"
PARTIALS = pa.schema(
    [("kind", pa.int32()), ("chunk", pa.int64()), ("slot", pa.int64())] + [(x, pa.binary()) for x in ("keys", "values", "few", "docs", "contexts")]
    + [("doc_ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("n_tokens", pa.list_(pa.int64())), ("n_known", pa.list_(pa.int64())), ("base", pa.list_(pa.float64())), ("score", pa.list_(pa.float64()))]
)


def score_seen(model: Model, order: int, parts: int):
    """A chunk with its answers -> documents' scores without backoff weights, which contexts still owe theirs, and what
    its n-grams add to the sums of the contexts that held-out texts have.

    Each token goes down from the highest order: an n-gram with a count gives its discounted share of its context;
    without one the context, if training has it, owes its weight, and the next lower order decides.
    """

    def of(table: pa.Table) -> pa.Table:
        c, known = told(table, order, order, parts)
        counts = {k: v >> 2 for k, v in known.items()}
        p1 = model.unigram(counts[1])
        direct, before = {1: p1}, {}
        score, open_ = np.zeros(len(c.ids)), np.ones(len(c.ids), dtype=bool)
        owing, contexts, adds = [], [], []
        for k in range(2, order + 1):
            before[k] = np.append(counts[1], model.docs)[c.left[k]] if k == 2 else counts[k - 1][c.left[k]]
            with np.errstate(divide="ignore", invalid="ignore"):
                direct[k] = np.where(counts[k] > 0, kept(counts[k], model.discounts[k]) / before[k], 0.0)
        for k in range(order, 1, -1):
            at = np.flatnonzero(open_ & (c.of[k] >= 0))
            kind = c.of[k][at]
            seen = counts[k][kind] > 0
            score[at[seen]] = np.log10(direct[k][kind[seen]])
            open_[at[seen]] = False
            owes = ~seen & (before[k][kind] > 0)
            owing.append(at[owes])
            below = c.names if k == 2 else c.keys[k - 1]
            contexts.append(below[c.left[k][kind[owes]]])
            # this chunk's own n-grams whose context is asked for
            asked = np.append(known[1], 2) if k == 2 else known[k - 1]
            mine = np.flatnonzero((known[k] & 1 == 1) & (asked[c.left[k]] >> 1 & 1 == 1))
            adds.append((below[c.left[k][mine]], counts[k][mine], direct[k - 1][c.suffix[k][mine]], before[k][mine], np.full(len(mine), k)))
        score[open_] = np.log10(p1[c.ids[open_]])
        doc = np.repeat(np.arange(len(c.held)), np.diff(c.bounds))
        sums = lambda v: np.bincount(doc, weights=v, minlength=len(c.held))
        owing, contexts = (np.concatenate(x) if x else np.zeros(0, U) for x in (owing, contexts))
        key, count, lower, size, level = (np.concatenate(x) for x in zip(*adds)) if adds else [np.zeros(0, U)] * 5
        ask, rank = np.unique(contexts, return_inverse=True)
        used = np.unique(np.concatenate((key, ask)))
        at = np.searchsorted(used, key)
        classes = [np.bincount(at, weights=(count == r) if r <= K else (count > K), minlength=len(used)) for r in range(1, K + 2)]
        most = lambda v: np.maximum.reduceat(v[order_], starts) if len(at) else np.zeros(0)
        order_ = np.argsort(at, kind="stable")
        starts = np.flatnonzero(np.diff(at[order_], prepend=-1))
        about = np.zeros((2, len(used)))
        about[:, at[order_][starts]] = most(size), most(level)
        asks = np.isin(used, ask)
        few = np.stack([*classes, *about, asks]).astype(np.int32)
        mass = np.bincount(at, weights=lower, minlength=len(used))
        deals, bounds = deal_ranges(used, parts)
        # answers come in the order in which contexts are dealt, so they are kept by their places in it, without keys
        place = np.empty(len(used), dtype=np.int64)
        place[deals[asks[deals]]] = np.arange(len(ask))
        rank = place[asks][rank]
        out = []
        for p in np.flatnonzero(np.diff(bounds)):
            i = deals[bounds[p] : bounds[p + 1]]
            out.append({"kind": 1, "chunk": c.row["chunk"], "slot": int(p), "keys": pack_sorted(used[i]), "values": pack(mass[i]), "few": pack(few[:, i].reshape(-1))})
        known_words = (counts[1] > 0)[c.ids]
        out.append({
            "kind": 0, "chunk": c.row["chunk"], "docs": pack(doc[owing.astype(np.int64)].astype(np.int32)),
            "contexts": pack(rank.astype(np.int32)), "doc_ids": c.row["doc_ids"], "held": c.row["held"],
            "n_tokens": np.diff(c.bounds).tolist(), "n_known": sums(known_words).astype(np.int64).tolist(), "base": sums(model.base(counts[1])[c.ids]).tolist(), "score": sums(score).tolist(),
        })
        return pa.Table.from_pylist(out, schema=PARTIALS)

    return of


def backoff_weights(model: Model):
    """One partition's contexts -> log10 of each one's weight: left-over mass / mass that the lower order gives to the words
    not seen after it, so that the probabilities after a context add up to one."""

    def of(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["chunk"])
        sums = Sums([unpack_sorted(r["keys"]) for r in rows])
        few = [unpack(r["few"], np.int32).reshape(K + 4, -1) for r in rows]
        seen = [0, *(sums.total([f[r] for f in few]) for r in range(K + 1))]
        mass = sums.total([unpack(r["values"], np.float64) for r in rows])
        count, level = np.zeros(len(sums.keys)), np.zeros(len(sums.keys))
        for out, i in ((count, K + 1), (level, K + 2)):
            np.maximum.at(out, sums.of, np.concatenate([f[i] for f in few]))
        left = np.zeros(len(sums.keys))
        for k, d in model.discounts.items():
            left = np.where(level == k, given_up(seen, d), left)
        weight = np.log10(left / count / np.maximum(1 - mass, 1e-300))
        out = [{"kind": 1, "chunk": r["chunk"], "slot": r["slot"], "values": pack(v[f[-1] > 0])} for r, f, v in zip(rows, few, sums.answer(weight))]
        return pa.Table.from_pylist(out, schema=PARTIALS)

    return of


def finish(table: pa.Table) -> pa.Table:
    """A chunk's documents with the weights that their contexts owed."""
    rows = sorted(table.to_pylist(), key=lambda r: (r["kind"], r["slot"]))
    c = rows[0]
    weights = np.concatenate([np.zeros(0), *(unpack(r["values"], np.float64) for r in rows[1:])])
    doc, context = unpack(c["docs"], np.int32), unpack(c["contexts"], np.int32)
    score = np.array(c["score"]) + np.bincount(doc, weights=weights[context], minlength=len(c["doc_ids"]))
    return pa.table({"doc_id": pa.array(c["doc_ids"], pa.int64()), "held_out": pa.array(c["held"], pa.bool_()), "n_tokens": pa.array(c["n_tokens"], pa.int64()), "n_known": pa.array(c["n_known"], pa.int64()), "base_score": pa.array(c["base"], pa.float64()), "score": pa.array(score, pa.float64())})


def katz_scores(docs: DataFrame, held: Column, order: int = ORDER) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs``.

    The model learns from all rows where ``held`` is false. Empty and null texts are the end token alone; repeated
    rows count as often as they stand there. Without training rows every probability is 1 and scores are 0.

    Orders are counted from the lowest up. Counts are exchanged with tables partitioned by a hash of the n-gram, in the shared
    folder; n-grams that stand in one place only are kept with their chunk (see Chunk.guess()). Tables go once what is
    made from them is stored.
    """
    stored = materialize(chunk_documents(docs.select("doc_id", "text", held.alias("held"))))
    totals = stored.agg(F.sum("n_tokens").alias("n"), F.sum("n_train").alias("train"), F.sum(F.size(F.filter("held", lambda h: ~h))).alias("docs")).first()
    parts = max(4, (totals.n or 0) // PART_TOKENS)
    counted, known, stats = materialize(first_blocks(stored, order, parts).groupBy("slot").applyInArrow(total_counts, ROWS_SCHEMA)), None, []
    chunk_rows = stored.select(F.lit(0).alias("kind"), "*")

    def tell(*more: DataFrame) -> DataFrame:
        """Everything that chunks are told, beside what they hold."""
        out = chunk_rows
        for x in more:
            out = out.unionByName(x.where("kind >= 0 and chunk is not null"), allowMissingColumns=True)
        return out

    def by_chunk(rows: DataFrame, of, schema: str) -> DataFrame:
        """``of`` every chunk's rows, stored; each round's shuffle files go before the next."""
        mine = [rows.where(F.pmod(F.xxhash64("chunk"), F.lit(ROUNDS)) == i) for i in range(ROUNDS)]
        return functools.reduce(DataFrame.union, [materialize(m.groupBy("chunk").applyInArrow(of, schema)) for m in mine])

    def counts_of_counts(table: DataFrame) -> None:
        stats.extend(table.where("kind < 0").groupBy("kind").agg(*[F.sum(F.get("stats", F.lit(i))).alias(f"n{i}") for i in range(K + 3)]).collect())

    counts_of_counts(counted)
    for k in range(3, order + 1):
        found = tell(counted) if known is None else tell(known, counted)
        asked = by_chunk(found, next_blocks(k, parts), ROWS_SCHEMA)
        discard(counted, *([known] if known else []))
        counts_of_counts(asked)
        again = materialize(asked.where("kind > 0").groupBy("slot").applyInArrow(total_counts, ROWS_SCHEMA))
        counts_of_counts(again)
        known, counted = materialize(asked.where("kind = 0")), again
        discard(asked)
    found = tell(counted) if known is None else tell(known, counted)
    summed: dict[int, list[int]] = {}
    for r in stats:
        summed[-r.kind] = [x + y for x, y in zip(summed.get(-r.kind, [0] * (K + 3)), r[1:])]
    ones = summed.get(1, [0] * (K + 3))
    model = Model(totals.train or 0, sum(ones[1:]), {k: discounts(summed.get(k, [0] * (K + 3))) for k in range(1, order + 1)}, ones, totals.docs or 0)
    partial = by_chunk(found, score_seen(model, order, parts), PARTIAL_SCHEMA)
    discard(stored, counted, *([known] if known else []))
    weights = materialize(partial.where("kind = 1").groupBy("slot").applyInArrow(backoff_weights(model), PARTIAL_SCHEMA))
    answers = partial.where("kind = 0").unionByName(weights.where("kind = 1"))
    done = answers.groupBy("chunk").applyInArrow(finish, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return done.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"), "base_score", "score")


def op1_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), fold(F.col("doc_id"), 5) == 1)
