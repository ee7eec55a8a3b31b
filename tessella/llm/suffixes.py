"""Exact removal of long repeated substrings by deep-shallow suffix sorting of anchored windows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.blobs import deal, pack, pack_sorted, unpack, unpack_sorted
from tessella.llm.tokens import BYTE, INVERSES, POWERS, U, chunks, column_bytes, mix
from tessella.sources.shared import materialize

#: Length of a repeat that counts, and of the anchor that stands for it.
SPAN, ANCHOR = 100, 32
REACH = SPAN - ANCHOR
#: Bytes that multikey sorting compares before blind tries take over.
SHALLOW = 48
#: Bytes of text in a chunk of documents, in a scan, and for each partition of the anchor table.
CHUNK_BYTES, SCAN_BYTES, PART_BYTES = 8 << 20, 1 << 20, 8 << 20

CHUNK_SCHEMA = "chunk long, doc_ids array<long>, bounds array<long>, h1 array<long>, h2 array<long>, body binary"


def chunk_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> chunks of whole documents: ids, bounds in the chunk, a 128-bit hash of each text, the bytes."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made = TaskContext.get().partitionId() << 33, 0
        for batch in batches:
            data, offsets = column_bytes(batch.column(1))
            ids = batch.column(0).to_pylist()
            for lo, hi in chunks(offsets, CHUNK_BYTES):
                body = data[offsets[lo] : offsets[hi]].tobytes()
                at = offsets[lo : hi + 1] - offsets[lo]
                digests = b"".join(hashlib.blake2b(body[a:b], digest_size=16).digest() for a, b in zip(at[:-1], at[1:]))
                h = np.frombuffer(digests, dtype=np.int64).reshape(-1, 2)
                out = [[base + made], [ids[lo:hi]], [at.tolist()], [h[:, 0].tolist()], [h[:, 1].tolist()], [zstandard.ZstdCompressor(level=3).compress(body)]]
                kinds = [pa.int64(), *[pa.list_(pa.int64())] * 4, pa.binary()]
                made += 1
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds)], names=[f.split()[0] for f in CHUNK_SCHEMA.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(rows, CHUNK_SCHEMA)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of values[p : p + width] for every p where it fits, by running minima of blocks from both sides."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, dtype=U)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


class Runs:
    """Runs of windows that share an anchor. Arrays: anchor position, first and last window start, document, the
    anchor's hash, and a hash of the run's bytes. Equal windows have their anchor at the same place, as it is the
    window's least ANCHOR-gram by hash (the leftmost on ties), so repeats are found among runs of equal anchors."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        parts = [self._scan(data, at, lo, hi) for lo, hi in chunks(at, SCAN_BYTES)]
        self.anchor, self.first, self.last, self.doc, self.key, self.whole = (np.concatenate(x) for x in zip(*parts)) if parts else [np.zeros(0, np.int64)] * 4 + [np.zeros(0, U)] * 2

    @staticmethod
    def _scan(data, at, lo, hi):
        start = at[lo]
        body = data[start : at[hi]]
        n = len(body)
        if n < SPAN:
            return [np.zeros(0, np.int64)] * 4 + [np.zeros(0, U)] * 2
        sums = np.zeros(n + 1, dtype=U)
        np.cumsum(BYTE[body] * POWERS.upto(n), out=sums[1:])
        inverse = INVERSES.upto(n + 1)
        grams = mix((sums[ANCHOR:] - sums[: n + 1 - ANCHOR]) * inverse[: n + 1 - ANCHOR])
        bits = U(n.bit_length())
        ranked = (grams >> bits << bits) | np.arange(len(grams), dtype=U)
        least = (sliding_min(ranked, REACH + 1) & ((U(1) << bits) - U(1))).astype(np.int64)
        doc = np.repeat(np.arange(lo, hi), np.diff(at[lo : hi + 1]))
        windows = np.flatnonzero(doc[: n - SPAN + 1] == doc[SPAN - 1 :])
        if not len(windows):
            return [np.zeros(0, np.int64)] * 4 + [np.zeros(0, U)] * 2
        anchor = least[windows]
        new = np.ones(len(windows), dtype=bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (np.diff(windows) != 1)
        i = np.flatnonzero(new)
        j = np.append(i[1:], len(windows)) - 1
        q, p0, p1 = anchor[i], windows[i], windows[j]
        whole = mix((sums[p1 + SPAN] - sums[p0]) * inverse[p0] + (q - p0).astype(U) * U(0xD6E8FEB86659FD93) + (p1 - p0).astype(U))
        return [q + start, p0 + start, p1 + start, doc[p0], grams[q], whole]


class Chunk:
    """A chunk with its runs; ``asked`` are the distinct anchors, in the order in which partitions are asked."""

    def __init__(self, row: dict, parts: int):
        self.row, self.parts = row, parts
        self.data = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["body"]), dtype=np.uint8) if row["bounds"][-1] else np.zeros(0, np.uint8)
        self.at = np.array(row["bounds"], dtype=np.int64)
        self.runs = Runs(self.data, self.at)
        self.keys, self.key_of = np.unique(self.runs.key, return_inverse=True)
        self.order, self.bounds = deal(self.keys, parts)

    def slots(self) -> np.ndarray:
        return np.flatnonzero(np.diff(self.bounds))

    def listen(self, rows: list[dict]) -> None:
        """Take in which anchors occur twice (kind 1) and which documents repeat an earlier text (kind 2). Of equal
        runs in the chunk only the earliest is sent on: the others repeat it."""
        again = np.zeros(len(self.keys), dtype=bool)
        self.copies = np.zeros(len(self.at) - 1, dtype=bool)
        for r in rows:
            if r["kind"] == 1:
                a, b = self.bounds[r["slot"]], self.bounds[r["slot"] + 1]
                again[self.order[a:b]] = unpack(r["flags"], np.uint8).astype(bool)
            elif r["kind"] == 2:
                self.copies[r["docs"]] = True
        live = np.flatnonzero(again[self.key_of] & ~self.copies[self.runs.doc])
        ids = np.array([-(1 << 63) if d is None else d for d in self.row["doc_ids"]], dtype=np.int64)
        self.ids = ids
        live = live[np.lexsort((self.runs.anchor[live], ids[self.runs.doc[live]]))]
        pairs = np.stack((self.runs.key[live], self.runs.whole[live]), axis=1).view([("k", U), ("w", U)]).reshape(-1)
        firsts = np.sort(np.unique(pairs, return_index=True)[1]) if len(live) else np.zeros(0, np.int64)
        self.sent = live[firsts]
        self.local = np.setdiff1d(live, self.sent, assume_unique=True)
        order, self.sent_bounds = deal(self.runs.key[self.sent], self.parts)
        self.sent = self.sent[order]

    def block(self, p: int) -> dict:
        at = self.sent[self.sent_bounds[p] : self.sent_bounds[p + 1]]
        r = self.runs
        size = r.last[at] - r.first[at] + SPAN
        ends = np.cumsum(size)
        body = self.data[np.repeat(r.first[at] - (ends - size), size) + np.arange(ends[-1])]
        return {
            "slot": int(p), "chunk": self.row["chunk"], "keys": pack_sorted(r.key[at]), "body": zstandard.ZstdCompressor(level=3).compress(body.tobytes()),
            "lead": pack((r.anchor[at] - r.first[at]).astype(np.uint8)), "windows": pack((r.last[at] - r.first[at] + 1).astype(np.uint8)),
            "docs": pack(self.ids[r.doc[at]]), "places": pack(r.anchor[at] - self.at[r.doc[at]]),
        }


KEY_BLOCKS = pa.schema([("slot", pa.int64()), ("chunk", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
ANSWERS = pa.schema([("kind", pa.int32()), ("chunk", pa.int64()), ("slot", pa.int64()), ("flags", pa.binary()), ("docs", pa.list_(pa.int32()))])
ANSWER_SCHEMA = "kind int, chunk long, slot long, flags binary, docs array<int>"
BLOCKS = pa.schema([("slot", pa.int64()), ("chunk", pa.int64())] + [(x, pa.binary()) for x in ("keys", "body", "lead", "windows", "docs", "places")])
BLOCK_SCHEMA = "slot long, chunk long, keys binary, body binary, lead binary, windows binary, docs binary, places binary"


def anchor_blocks(stored: DataFrame, parts: int) -> DataFrame:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                c = Chunk(batch.slice(i, 1).to_pylist()[0], parts)
                counts = np.minimum(np.bincount(c.key_of, minlength=len(c.keys)), 2).astype(np.uint8)
                out = []
                for p in c.slots():
                    at = c.order[c.bounds[p] : c.bounds[p + 1]]
                    out.append({"slot": int(p), "chunk": c.row["chunk"], "keys": pack_sorted(c.keys[at]), "counts": pack(counts[at])})
                yield pa.RecordBatch.from_pylist(out, schema=KEY_BLOCKS)

    return stored.mapInArrow(rows, "slot long, chunk long, keys binary, counts binary")


def repeated_anchors(table: pa.Table) -> pa.Table:
    rows = table.to_pylist()
    blocks = [unpack_sorted(r["keys"]) for r in rows]
    _, of = np.unique(np.concatenate(blocks), return_inverse=True)
    total = np.bincount(of, weights=np.concatenate([unpack(r["counts"], np.uint8) for r in rows]))
    flags, ends = (total[of] > 1).astype(np.uint8), np.cumsum([len(b) for b in blocks])
    return pa.Table.from_pylist([{"kind": 1, "chunk": r["chunk"], "slot": r["slot"], "flags": pack(flags[e - len(b) : e])} for r, b, e in zip(rows, blocks, ends)], schema=ANSWERS)


class BlindTrie:
    """Strings of one length in order. Inner nodes keep only the place of the byte that tells their children apart; a
    search goes down blindly, compares once with the leaf it ends at, and splits the path where they differ."""

    def __init__(self, first: bytes):
        self.root: list | bytes = first

    def insert(self, s: bytes) -> None:
        node, path = self.root, []
        while isinstance(node, list):
            path.append(node)
            node = node[1].get(s[node[0]]) or next(iter(node[1].values()))
        if node == s:
            return
        differ = int.from_bytes(node) ^ int.from_bytes(s)
        depth = len(s) - 1 - (differ.bit_length() - 1) // 8
        parent = None
        for x in path:
            if x[0] > depth:
                break
            parent = x
        if parent is not None and parent[0] == depth:
            parent[1][s[depth]] = s
            return
        below = self.root if parent is None else parent[1][s[parent[0]]]
        split = [depth, {node[depth]: below, s[depth]: s}]
        if parent is None:
            self.root = split
        else:
            parent[1][s[parent[0]]] = split

    def sorted(self) -> list[bytes]:
        out, todo = [], [self.root]
        while todo:
            node = todo.pop()
            if isinstance(node, list):
                todo += [x for _, x in sorted(node[1].items(), reverse=True)]
            else:
                out.append(node)
        return out


def deep_shallow_order(group: np.ndarray, strings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, lcp): rows of the byte matrix ``strings`` sorted within their groups, and each row's common prefix with
    the row before it in that order (0 at the start of a group).

    Shallow: multikey sorting by eight bytes at a time, in which each pass only tells apart what earlier words left
    equal. Deep: what is still equal after SHALLOW bytes is put into a blind trie, equal strings once.
    """
    n, width = strings.shape
    padded = np.zeros((n, -(-width // 8) * 8), dtype=np.uint8)
    padded[:, :width] = strings
    words = padded.view(">u8").astype(U)
    order = np.lexsort((*[words[:, i] for i in range(min(SHALLOW // 8, words.shape[1]) - 1, -1, -1)], group))
    head = padded[order][:, :SHALLOW]
    same = np.zeros(n, dtype=bool)
    same[1:] = (group[order][1:] == group[order][:-1]) & (head[1:] == head[:-1]).all(axis=1)
    starts = np.flatnonzero(~same)
    ends = np.append(starts[1:], n)
    rest = np.ascontiguousarray(strings[:, SHALLOW:])
    left = rest.shape[1]
    if left:
        raw = rest.tobytes()
        for a, b in zip(*(x[ends - starts > 1].tolist() for x in (starts, ends))):
            rows = order[a:b].tolist()
            leaves: dict[bytes, list[int]] = {}
            for i in rows:
                leaves.setdefault(raw[i * left : (i + 1) * left], []).append(i)
            if len(leaves) > 1:
                it = iter(leaves)
                trie = BlindTrie(next(it))
                for s in it:
                    trie.insert(s)
                order[a:b] = [i for s in trie.sorted() for i in leaves[s]]
    lcp = np.zeros(n, dtype=np.int64)
    for a in range(1, n, 1 << 18):
        b = min(n, a + (1 << 18))
        differ = strings[order[a:b]] != strings[order[a - 1 : b - 1]]
        lcp[a:b] = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    lcp[1:][group[order][1:] != group[order][:-1]] = -1
    lcp[:1] = -1
    return order, lcp


def repeated_windows(table: pa.Table) -> pa.Table:
    """One partition's runs -> for each block a bit for every window: does an equal window start earlier?

    Runs are sorted by what follows their anchor and by what precedes it, read backwards. A window that starts l bytes
    before the anchor equals another iff both sides agree: SPAN - l bytes to the right, l to the left. So for each l
    the sorted orders, cut where the common prefix is too short, give classes, and a class's first window is kept.
    """
    rows = sorted(table.to_pylist(), key=lambda r: r["chunk"])
    keys = [unpack_sorted(r["keys"]) for r in rows]
    lead, windows = (np.concatenate([unpack(r[x], np.uint8) for r in rows]).astype(np.int64) for x in ("lead", "windows"))
    docs, places = (np.concatenate([unpack(r[x], np.int64) for r in rows]) for x in ("docs", "places"))
    body = np.frombuffer(b"".join(zstandard.ZstdDecompressor().decompress(r["body"]) for r in rows), dtype=np.uint8)
    n = len(lead)
    size = windows - 1 + SPAN
    start = np.cumsum(size) - size
    _, group = np.unique(np.concatenate(keys), return_inverse=True)

    def side(length: int, step: int) -> tuple[np.ndarray, np.ndarray]:
        offset = np.arange(length) if step > 0 else -1 - np.arange(length)
        strings = np.zeros((n, length), dtype=np.uint8)
        for i in range(0, n, 1 << 14):
            at = lead[i : i + (1 << 14), None] + offset
            inside = (at >= 0) & (at < size[i : i + (1 << 14), None])
            strings[i : i + (1 << 14)][inside] = body[(start[i : i + (1 << 14), None] + at)[inside]]
        return deep_shallow_order(group, strings)

    right, right_lcp = side(SPAN, 1)
    before, before_lcp = side(REACH, -1)
    rank = np.lexsort((places, docs))
    bits = np.cumsum(windows) - windows
    flags = np.zeros(int(windows.sum()), dtype=bool)
    right_class, before_class = np.empty(n, np.int64), np.empty(n, np.int64)
    for l in range(REACH + 1):  # noqa: E741
        mine = rank[(l <= lead[rank]) & (l > lead[rank] - windows[rank])]
        if len(mine) < 2:
            continue
        right_class[right] = np.cumsum(right_lcp < SPAN - l)
        before_class[before] = np.cumsum(before_lcp < l)
        code = right_class[mine] * (n + 1) + before_class[mine]
        order = np.argsort(code, kind="stable")
        again = np.zeros(len(mine), dtype=bool)
        again[order[1:]] = code[order][1:] == code[order][:-1]
        flags[(bits + lead - l)[mine[again]]] = True
    out, ends = [], np.cumsum([len(k) for k in keys])
    for r, k, e in zip(rows, keys, ends):
        a, b = (int(bits[e - len(k)]), int(bits[e - 1] + windows[e - 1])) if len(k) else (0, 0)
        out.append({"kind": 3, "chunk": r["chunk"], "slot": r["slot"], "flags": pack(np.packbits(flags[a:b]))})
    return pa.Table.from_pylist(out, schema=ANSWERS)


def _told(table: pa.Table, parts: int) -> tuple[Chunk, list[dict]]:
    rows = table.to_pylist()
    c = Chunk(next(r for r in rows if r["kind"] == 0), parts)
    c.listen(rows)
    return c, rows


def run_blocks(parts: int):
    def of(table: pa.Table) -> pa.Table:
        c, _ = _told(table, parts)
        return pa.Table.from_pylist([c.block(p) for p in np.flatnonzero(np.diff(c.sent_bounds))], schema=BLOCKS)

    return of


def strip(parts: int):
    """A chunk with all answers -> what is left of each document."""

    def of(table: pa.Table) -> pa.Table:
        c, rows = _told(table, parts)
        r = c.runs
        change = np.zeros(len(c.data) + 1, dtype=np.int64)

        def cover(starts: np.ndarray) -> None:
            np.add.at(change, starts, 1)
            np.add.at(change, starts + SPAN, -1)

        np.add.at(change, r.first[c.local], 1)
        np.add.at(change, r.last[c.local] + SPAN, -1)
        for x in rows:
            if x["kind"] == 3:
                at = c.sent[c.sent_bounds[x["slot"]] : c.sent_bounds[x["slot"] + 1]]
                size = r.last[at] - r.first[at] + 1
                ends = np.cumsum(size)
                starts = np.repeat(r.first[at] - (ends - size), size) + np.arange(ends[-1])
                cover(starts[np.unpackbits(unpack(x["flags"], np.uint8), count=int(ends[-1])).astype(bool)])
        gone = np.cumsum(change[:-1]) > 0
        out = {"doc_id": c.row["doc_ids"], "n_bytes": np.diff(c.at).tolist(), "n_removed": [], "n_spans": [], "kept_sha256": [], "text": []}
        for d, (a, b) in enumerate(zip(c.at[:-1], c.at[1:])):
            mask = np.ones(b - a, dtype=bool) if c.copies[d] and b - a >= SPAN else gone[a:b]
            kept = c.data[a:b][~mask].tobytes()
            out["n_removed"].append(int(mask.sum()))
            out["n_spans"].append(int(mask[:1].sum() + (mask[1:] & ~mask[:-1]).sum()))
            out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            out["text"].append(kept)
        return pa.table(out, schema=pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("text", pa.binary())]))

    return of


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, text): ``docs`` without bytes covered by a SPAN-byte string that
    also starts earlier, in a smaller doc_id or in the same document. ``text`` holds the bytes left (removal may cut a
    character). Null and empty texts stay empty; texts under SPAN bytes lose nothing; a null doc_id is the smallest; of
    rows that repeat an id and a text, one counts as the first.

    Windows that are equal have equal anchors at equal places, so only runs of windows whose anchor occurs twice leave
    their chunk, the earliest of equal runs in a chunk once. A group of one anchor is as large as the number of chunks
    that hold it. Copies of whole texts are found first, by a 128-bit hash, and only the earliest is searched.
    """
    stored = materialize(chunk_texts(docs))
    total = stored.agg(F.sum(F.element_at("bounds", -1)).alias("n")).first().n or 0
    parts = max(4, int(total // PART_BYTES))
    texts = stored.select("chunk", F.posexplode(F.arrays_zip("doc_ids", "h1", "h2")).alias("at", "d")).select("chunk", "at", "d.*")
    order = F.struct(F.col("doc_ids"), F.col("chunk"), F.col("at"))
    firsts = texts.groupBy("h1", "h2").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1")
    copies = texts.join(firsts, ["h1", "h2"]).where((F.col("chunk") != F.col("first.chunk")) | (F.col("at") != F.col("first.at")))
    copies = copies.groupBy("chunk").agg(F.collect_list("at").alias("docs")).select(F.lit(2).alias("kind"), "chunk", "docs")
    again = anchor_blocks(stored, parts).groupBy("slot").applyInArrow(repeated_anchors, ANSWER_SCHEMA)
    answers = materialize(again.unionByName(copies, allowMissingColumns=True))
    told = stored.select(F.lit(0).alias("kind"), "chunk", "doc_ids", "bounds", "body").unionByName(answers, allowMissingColumns=True)
    runs = told.groupBy("chunk").applyInArrow(run_blocks(parts), BLOCK_SCHEMA)
    flags = materialize(runs.groupBy("slot").applyInArrow(repeated_windows, ANSWER_SCHEMA))
    return told.unionByName(flags, allowMissingColumns=True).groupBy("chunk").applyInArrow(strip(parts), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text binary")


def op3_deep_shallow_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("text")
