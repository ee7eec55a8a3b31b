"""Benchmark decontamination: latent semantic retrieval of passages, then common-subsequence and answer checks."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.tokens import CHUNK, MARKS, U, Words, chunks, column_bytes
from tessella.sources.shared import discard, materialize

#: Latent queries searched for in one pass over the documents; more are taken in blocks of items, all in one latent space.
QUERIES = 20_000
#: Words of items that have a fitted place in the latent space (those of most items), its size, and extra columns of the random
#: start. Further words share SHARED random directions, so that they count as well.
TERMS, RANK, EXTRA, SHARED = 1 << 17, 128, 16, 1 << 12
#: Words between passages, and in a passage: two strides. Longer items are searched for by pieces of QUERY words.
STRIDE, QUERY = 16, 32
#: Bytes of text searched at a time, so that what is looked up again and again stays in the processor's cache.
NEAR = 1 << 16
#: Power of the inverse document frequency.
WEIGHT = 0.8
#: Cosine of a candidate; shares of an item's words in order, and of its answer words, that confirm it; a stretch of DENSE
#: times the item's length with COMMON of its words in order confirms it whatever words were replaced.
COSINE, COMMON, ANSWER, DENSE = 0.52, 0.6, 0.5, 1.25


def item_words(texts: list[str | None]) -> list[np.ndarray]:
    """Hashes of each item's words, lower-cased, without ASCII punctuation."""
    data, offsets = column_bytes(pa.array(texts, pa.string()))
    words = Words(data, offsets, MARKS)
    return [words.hash[a:b] for a, b in zip(words.first[:-1], words.first[1:])]


def places(sorted_keys: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Place of each hash in ``sorted_keys``, -1 where it isn't there. A bitmap of the top bits spares most searches."""
    out = np.full(len(hashes), -1, dtype=np.int64)
    if len(sorted_keys):
        top = np.zeros(1 << 18, dtype=bool)
        top[(sorted_keys >> U(46)).astype(np.intp)] = True
        maybe = np.flatnonzero(top[(hashes >> U(46)).astype(np.intp)])
        at = np.minimum(np.searchsorted(sorted_keys, hashes[maybe]), len(sorted_keys) - 1)
        right = sorted_keys[at] == hashes[maybe]
        out[maybe[right]] = at[right]
    return out


def each_chunk(batches: Iterator[pa.RecordBatch], at: int, limit: int = CHUNK) -> Iterator[tuple[pa.RecordBatch, Words]]:
    for batch in batches:
        data, offsets = column_bytes(batch.column(at))
        for lo, hi in chunks(offsets, limit):
            yield batch.slice(lo, hi - lo), Words(data, offsets[lo : hi + 1], MARKS)


def coded(docs: DataFrame, terms: np.ndarray) -> DataFrame:
    """Stored (code, term, n): a row for each text with the terms of its words, in order (32-bit numbers: place + 1, 0 for words
    that are no term); rows for each task with the number of its texts that have a term (term -1: of all its texts)."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n = shared.value, 0
        df = np.zeros(len(known), dtype=np.int64)
        for batch, words in each_chunk(batches, 0):
            term = places(known, words.hash)
            hit = term >= 0
            df += np.bincount(np.unique(words.doc[hit] * len(known) + term[hit]) % max(len(known), 1), minlength=len(known))
            n += batch.num_rows
            none = pa.nulls(batch.num_rows, pa.int64())
            code = pa.LargeBinaryArray.from_buffers(pa.large_binary(), batch.num_rows, [None, pa.py_buffer(4 * words.first), pa.py_buffer((term + 1).astype(np.int32))])
            yield pa.RecordBatch.from_arrays([code.cast(pa.binary()), none, none], names=["code", "term", "n"])
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(at) + 1, pa.binary()), pa.array(np.append(at, -1)), pa.array(np.append(df[at], n))], names=["code", "term", "n"])

    return materialize(docs.select("text").mapInArrow(rows, "code binary, term long, n long"), "zstd")


def document_frequencies(codes: DataFrame, terms: int) -> tuple[np.ndarray, int]:
    """(documents with each term, documents), counted over all rows; only sums for the items' terms reach the driver."""
    out, total = np.zeros(terms, dtype=np.int64), 0
    for r in codes.where("term is not null").groupBy("term").agg(F.sum("n").alias("n")).collect():
        if r.term < 0:
            total = r.n
        else:
            out[r.term] = r.n
    return out, total


def code_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(codes of some texts, end to end; place of each code in its text)."""
    for batch in batches:
        column = batch.column(0).cast(pa.large_binary())
        offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
        for lo, hi in chunks(offsets, 2 * CHUNK):
            first = (offsets[lo : hi + 1] - offsets[lo]) // 4
            if first[-1]:
                yield np.frombuffer(column.buffers()[2], np.int32, first[-1], offsets[lo]), np.arange(first[-1]) - np.repeat(first[:-1], np.diff(first))


def gram_times(codes: DataFrame, column: np.ndarray, weight: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A'A @ right for the matrix A of tf-idf passages (rows of length one) of all texts; ``column`` is the matrix's column of each
    code, or -1. Each task adds up its passages' share, blocks of columns are summed by Spark in two steps, and columns x
    columns of ``right`` numbers reach the driver."""
    shared = codes.sparkSession.sparkContext.broadcast((column, weight, right.astype(np.float32)))
    block = 256

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        column, weight, q = shared.value
        gram = Gram(weight, q)
        for code, place in code_chunks(batches):
            col = column[code]
            hit = np.flatnonzero(col >= 0)
            if len(hit):
                number = np.cumsum(place % (2 * STRIDE) == 0)
                gram.add(col[hit], number[hit])
        total = gram.total
        if total.any():
            at = range(0, len(weight), block)
            salt = TaskContext.get().partitionId() % 16
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array([salt] * len(at), pa.int32()), pa.array([total[i : i + block].tobytes() for i in at], pa.binary())], names=["at", "salt", "part"])

    def add(table: pa.Table) -> pa.Table:
        total = None
        for v in table.column("part"):
            x = np.frombuffer(v.as_buffer())
            total = x.copy() if total is None else total + x
        return pa.table({"at": table.column("at")[:1], "salt": table.column("salt")[:1], "part": pa.array([total.tobytes()], pa.binary())})

    out, schema = np.zeros((len(weight), right.shape[1])), "at long, salt int, part binary"
    texts = codes.where("code is not null").select("code")
    for r in texts.mapInArrow(rows, schema).groupBy("at", "salt").applyInArrow(add, schema).groupBy("at").applyInArrow(add, schema).collect():
        got = np.frombuffer(r.part).reshape(-1, right.shape[1])
        out[r.at : r.at + len(got)] = got
    return out


class Gram:
    """A'A @ q, added up from passages given as (column, passage) occurrences, sorted by passage."""

    def __init__(self, weight: np.ndarray, q: np.ndarray):
        self.weight, self.q, self.total = weight, q, np.zeros(q.shape)

    def add(self, col: np.ndarray, passage: np.ndarray) -> None:
        new = np.concatenate(([True], passage[1:] != passage[:-1]))
        n, width = int(new.sum()), len(self.weight)
        pair, count = np.unique((np.cumsum(new) - 1) * width + col, return_counts=True)
        row, col = np.divmod(pair, width)
        value = count * self.weight[col]
        norm = np.sqrt(np.bincount(row, weights=value**2, minlength=n))
        value = (value / np.maximum(norm, 1e-12)[row]).astype(np.float32)
        bounds = np.searchsorted(row, np.arange(0, n + 64, 64))
        for a, b in zip(bounds[:-1], bounds[1:]):
            if a < b:
                used, at = np.unique(col[a:b], return_inverse=True)
                dense = np.zeros((int(row[b - 1] - row[a]) + 1, len(used)), dtype=np.float32)
                dense[row[a:b] - row[a], at] = value[a:b]
                self.total[used] += dense.T @ (dense @ self.q[used])


@dataclass
class Space:
    """The latent space of all items: their words (sorted hashes), the weight of each, and its latent vector times its
    weight: a fitted one, or one of SHARED random ones (row 0, of zeros, is for words of no item)."""

    terms: np.ndarray
    idf: np.ndarray
    row: np.ndarray
    vectors: np.ndarray

    def embed(self, term: np.ndarray) -> np.ndarray:
        return self.vectors[self.row[term]].sum(axis=0)


@dataclass
class Index:
    """A block of items in the space: ids, words, answer words, and latent queries with the item of each."""

    ids: list[int]
    words: list[np.ndarray]
    answers: list[np.ndarray]
    queries: np.ndarray
    owner: np.ndarray


def build_space(docs: DataFrame, benchmark: DataFrame, rank: int = RANK, seed: int = 3) -> Space | None:
    """Randomised SVD of the tf-idf passages of all documents, and of all items (weighted to count for as much), over the items' words:
    A'A times a random orthonormal start spans the space, and its leading directions are those of the Nystrom
    approximation, so documents are read as text once. It is one space whatever blocks the items are searched for in. None where
    no item has words."""
    held: dict[int, int] = {}
    n_items = 0
    for _, texts in item_blocks(benchmark):
        for w in item_words(texts):
            for h in set(w.tolist()):
                held[h] = held.get(h, 0) + 1
            n_items += len(w) > 0
    if not held:
        return None
    terms = np.array(sorted(held), dtype=U)
    codes = coded(docs, terms)
    df, n = document_frequencies(codes, len(terms))
    idf = (np.log((n + 1) / (df + 1)) + 0.1) ** WEIGHT
    times = np.array([held[h] for h in terms.tolist()])
    chosen = np.lexsort((terms, -times))[:TERMS]
    chosen = chosen[np.lexsort((terms[chosen], -df[chosen]))]  # words that meet often lie side by side
    row = np.zeros(len(terms) + 1, dtype=np.int32)
    row[chosen] = np.arange(1, len(chosen) + 1)
    column, weight = np.concatenate(([-1], row[:-1] - 1)).astype(np.int32), idf[chosen]
    width = min(rank + EXTRA, len(chosen))
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(chosen), width)))
    own = Gram(weight, q.astype(np.float32))
    for _, texts in item_blocks(benchmark):
        words = item_words(texts)
        col = row[places(terms, np.concatenate(words))] - 1
        item = np.repeat(np.arange(len(words)), [len(w) for w in words])
        if (col >= 0).any():
            own.add(col[col >= 0], item[col >= 0])
    z = gram_times(codes, column, weight, q) + max(1.0, n / n_items) * own.total
    discard(codes)
    core = q.T @ z
    value, vectors = np.linalg.eigh((core + core.T) / 2)
    some = value > 1e-9 * value[-1]
    basis = np.linalg.svd(z @ (vectors[:, some] / np.sqrt(value[some])), full_matrices=False)[0][:, : min(rank, width)]
    rest = np.flatnonzero(row[:-1] == 0)
    row[rest] = len(chosen) + 1 + (terms[rest] % U(SHARED)).astype(np.int64)
    drawn = np.random.default_rng(seed + 1).standard_normal((SHARED if len(rest) else 0, basis.shape[1]))
    drawn *= (idf[rest].mean() if len(rest) else 1) / np.maximum(np.linalg.norm(drawn, axis=1, keepdims=True), 1e-12)
    return Space(terms, idf, row, np.vstack([np.zeros((1, basis.shape[1])), weight[:, None] * basis, drawn]).astype(np.float32))


def build_index(space: Space, ids: list[int], texts: list[str | None]) -> Index:
    """Items as latent queries: whole, or by pieces of QUERY words that overlap by half; each also without the item's rarest
    third. Items without words have none."""
    found = Index([], [], [], np.zeros((0, space.vectors.shape[1]), np.float32), np.zeros(0, np.int64))
    queries, owner = [], []
    for item, w in zip(ids, item_words(texts)):
        if not len(w):
            continue
        term = places(space.terms, w)
        ranked = sorted(set(term.tolist()), key=lambda x: (-space.idf[x], x))
        plain = ~np.isin(term, ranked[: len(ranked) // 3])  # a paraphrase may lack the words that weigh most
        starts = [0] if len(w) <= QUERY else range(0, len(w) - QUERY // 2, QUERY // 2)
        for p in starts:
            part = slice(p, p + QUERY)
            for some in (term[part], term[part][plain[part]]):
                if len(some):
                    queries.append(unit(space.embed(some)))
                    owner.append(len(found.ids))
        found.ids.append(item)
        found.words.append(w)
        found.answers.append(np.array(ranked[: max(3, -(-len(ranked) // 3))]))
    if queries:
        found.queries, found.owner = np.array(queries, dtype=np.float32), np.array(owner)
    return found


def unit(v: np.ndarray) -> np.ndarray:
    return v / max(float(np.linalg.norm(v)), 1e-12)


def common_subsequence(item: np.ndarray, region: list[int]) -> int:
    """Length of the longest common subsequence, one bit for each word of the item."""
    masks: dict[int, int] = {}
    for i, w in enumerate(item.tolist()):
        masks[w] = masks.get(w, 0) | 1 << i
    full = (1 << len(item)) - 1
    s = full
    for w in region:
        u = s & masks.get(w, 0)
        s = ((s + u) | (s - u)) & full
    return len(item) - s.bit_count()


class Matcher:
    """Finds a block of items in chunks of documents."""

    def __init__(self, space: Space, index: Index, cosine: float = COSINE):
        self.space, self.x, self.cosine = space, index, cosine
        self.size = np.array([len(w) for w in index.words], dtype=np.int64)
        terms = [places(space.terms, w) for w in index.words]
        self.all_words = self.lookups(terms, COMMON * self.size)
        # where COMMON of the words are, the rarer half has what the other half can't make up for
        half = [t[np.argsort(-space.idf[t], kind="stable")[: -(-len(t) // 2)]] for t in terms]
        self.rare_words = self.lookups(half, COMMON * self.size - self.size // 2)

    @staticmethod
    def lookups(terms: list[np.ndarray], least: np.ndarray) -> tuple:
        """(terms of all items, first of each item, how many each has, how many must be there)."""
        sizes = np.array([len(t) for t in terms], dtype=np.int64)
        return np.concatenate(terms) if terms else np.zeros(0, np.int64), np.cumsum(sizes) - sizes, sizes, least

    def candidates(self, words: Words, term: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first word of the passage, item, cosine) of all passages of two strides whose cosine with a query of the item is
        enough. Every passage of the chunk is embedded: sums of word vectors by stride, two neighbours at a time."""
        sizes = np.diff(words.first)
        strides = -(-sizes // STRIDE)
        first = np.cumsum(strides) - strides
        known = np.flatnonzero(self.space.row[term] > 0)
        place = first[words.doc[known]] + (known - words.first[words.doc[known]]) // STRIDE
        sums = np.zeros((int(strides.sum()), self.queries.shape[1]), dtype=np.float32)
        for i in range(0, len(known), 1 << 15):
            p = place[i : i + (1 << 15)]
            starts = np.flatnonzero(np.concatenate(([True], p[1:] != p[:-1])))
            sums[p[starts]] += np.add.reduceat(self.space.vectors[self.space.row[term[known[i : i + (1 << 15)]]]], starts, axis=0)
        doc = np.repeat(np.arange(words.docs), strides)
        start = words.first[doc] + (np.arange(len(doc)) - first[doc]) * STRIDE
        same = np.flatnonzero(doc[:-1] == doc[1:])
        passages = sums.copy()
        passages[same] += sums[same + 1]
        passages /= np.maximum(np.linalg.norm(passages, axis=1), 1e-12)[:, None]
        found = []
        few = max(16, (1 << 22) // len(self.queries))  # 16 MB of cosines at a time
        for i in range(0, len(passages), few):
            cosines = passages[i : i + few] @ self.queries.T
            at, query = np.nonzero(cosines >= self.cosine)
            found.append((start[at + i], self.x.owner[query], cosines[at, query]))
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))

    @property
    def queries(self) -> np.ndarray:
        return self.x.queries

    def enough(self, term: np.ndarray, lo: np.ndarray, hi: np.ndarray, item: np.ndarray, lookups: tuple) -> np.ndarray:
        """Which regions [lo, hi) hold as many of the item's words as they must, in any order: an exact bound on those in
        order."""
        terms, first, sizes, least = lookups
        n = len(term) + 1
        at = np.flatnonzero(term >= 0)
        keys = np.sort(term[at] * n + at)
        out = np.zeros(len(item), dtype=bool)
        by_item = np.lexsort((lo, item))  # neighbours look up the same words
        for i in range(0, len(item), 1 << 14):
            part = by_item[i : i + (1 << 14)]
            size = sizes[item[part]]
            ends = np.cumsum(size)
            t = terms[np.repeat(first[item[part]] - (ends - size), size) + np.arange(ends[-1])]
            q = t * n + np.repeat(lo[part], size)
            next_at = keys[np.minimum(np.searchsorted(keys, q), len(keys) - 1)]
            there = (next_at >= q) & (next_at < t * n + np.repeat(hi[part], size))
            out[part] = np.add.reduceat(there, ends - size) >= least[item[part]]
        return out

    def near(self, term: np.ndarray, start: np.ndarray, lo: np.ndarray, hi: np.ndarray, item: np.ndarray) -> np.ndarray:
        """Which candidates have enough() rare words around them: those of an item that begin within the same few strides are looked up
        together, in the region that holds all of theirs."""
        key = item * (len(term) // (4 * STRIDE) + 1) + start // (4 * STRIDE)
        order = np.argsort(key, kind="stable")
        new = np.flatnonzero(np.concatenate(([True], np.diff(key[order]) != 0)))
        some = self.enough(term, np.minimum.reduceat(lo[order], new), np.maximum.reduceat(hi[order], new), item[order][new], self.rare_words)
        out = np.zeros(len(item), dtype=bool)
        out[order] = np.repeat(some, np.diff(np.append(new, len(order))))
        return out

    def share(self, item: int, region: np.ndarray) -> float:
        return common_subsequence(self.x.words[item], region.tolist()) / int(self.size[item])

    def confirm(self, item: int, term: np.ndarray, hashes: np.ndarray) -> tuple[float, float] | None:
        """(share of the item's words in order, share of its answer words) of a region that is a leak."""
        share = self.share(item, hashes)
        if share < COMMON:
            return None
        answer = float(np.isin(self.x.answers[item], term).mean())
        m = int(self.size[item])
        reach = math.ceil(DENSE * m)
        if answer >= ANSWER or any(self.share(item, hashes[o : o + reach]) >= COMMON for o in range(0, max(1, len(hashes) - reach + 1), max(1, m // 8))):
            return share, answer
        return None

    def matches(self, words: Words) -> dict[tuple[int, int], tuple[float, float, float]]:
        """(document, item) -> (cosine, share of the item's words in order, share of its answer words), for the likeliest
        passage that is confirmed."""
        best: dict[tuple[int, int], tuple[float, float, float]] = {}
        if not len(words.hash) or not len(self.queries):
            return best
        term = places(self.space.terms, words.hash)
        start, item, cosine = self.candidates(words, term)
        if not len(start):
            return best
        doc = words.doc[start]
        lo = np.maximum(words.first[doc], start - self.size[item])
        hi = np.minimum(words.first[doc + 1], start + 2 * STRIDE + self.size[item])
        keep = np.flatnonzero(self.near(term, start, lo, hi, item))
        keep = keep[self.enough(term, lo[keep], hi[keep], item[keep], self.all_words)]
        for c in keep[np.argsort(-cosine[keep], kind="stable")].tolist():
            key = int(doc[c]), int(item[c])
            if key not in best and (got := self.confirm(key[1], term[lo[c] : hi[c]], words.hash[lo[c] : hi[c]])):
                best[key] = (float(cosine[c]), *got)
        return best


def item_blocks(benchmark: DataFrame) -> Iterator[tuple[list[int], list[str | None]]]:
    """The items, as many at a time as have QUERIES latent queries (one at least); null texts are no items."""
    ids, texts, n = [], [], 0
    for r in benchmark.select("item_id", "text").where("text is not null").orderBy("item_id", "text").toLocalIterator():
        more = 2 * max(1, 2 * (r.text.count(" ") + 1) // QUERY)
        if ids and n + more > QUERIES:
            yield ids, texts
            ids, texts, n = [], [], 0
        ids.append(r.item_id)
        texts.append(r.text)
        n += more
    if ids:
        yield ids, texts


PAIRS = "doc_id long, item_id long, cosine double, common_share double, answer_share double"


def searches(docs: DataFrame, benchmark: DataFrame) -> Iterator:
    """A broadcast (space, index) for every block of items."""
    space = build_space(docs, benchmark)
    for ids, texts in item_blocks(benchmark) if space else ():
        yield docs.sparkSession.sparkContext.broadcast((space, build_index(space, ids, texts)))


def find_leaks(docs: DataFrame, benchmark: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(doc_id, item_id, cosine, common_share, answer_share): items whose words stand in a document, possibly paraphrased.

    Every passage of every whole text is embedded, and its cosine with every item taken; regions around candidates are
    leaks if they have COMMON of the item's words in order, and ANSWER of its rarest third or all that within DENSE times the
    item's length. Null and empty texts match nothing; repeated rows and repeated items give a row each for every
    distinct id; an empty benchmark gives no rows.
    """
    spark, out = docs.sparkSession, None
    for shared in searches(docs, benchmark):

        def rows(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(*shared.value, cosine)
            for batch, words in each_chunk(batches, 1, NEAR):
                got = matcher.matches(words)
                doc_ids = batch.column(0).to_pylist()
                cols = [[doc_ids[d] for d, _ in got], [matcher.x.ids[i] for _, i in got], *([v[k] for v in got.values()] for k in range(3))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 2 + [pa.float64()] * 3)], names=[f.split()[0] for f in PAIRS.split(", ")])

        part = docs.select("doc_id", "text").mapInArrow(rows, PAIRS)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], PAIRS)
    best = F.max(F.struct("common_share", "answer_share", "cosine")).alias("b")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.cosine", "b.common_share", "b.answer_share")


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of ``docs`` in which find_leaks() finds no item, with all their columns and no shuffle."""
    kept = docs.select(F.col("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    schema = T.StructType([kept.schema["text"], kept.schema["row"]])
    for shared in searches(docs, benchmark):

        def rows(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(*shared.value)
            for batch, words in each_chunk(batches, 0, NEAR):
                clean = np.ones(batch.num_rows, dtype=bool)
                clean[[d for d, _ in matcher.matches(words)]] = False
                yield batch.filter(pa.array(clean))

        kept = kept.mapInArrow(rows, schema)
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def op7_latent_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return find_leaks(docs, benchmark)
