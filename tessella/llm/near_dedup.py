"""Near-duplicate components: fast similarity sketches, banding and exact verification on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.components import components
from tessella.llm.tokens import U, Words, chunks, column_bytes, mix, numbers, shingles
from tessella.operators.numbering import fresh
from tessella.sources.shared import materialize

#: Coordinates of a sketch, bands and their rows: a pair at similarity 0.8 shares none of 32 bands with chance 5e-8.
COORDINATES, BANDS, ROWS = 256, 32, 4
#: Pairs whose sketches agree in fewer coordinates are not verified: 5.6 deviations under 0.8.
SURE_BELOW = 0.66
#: Members of a hub's group that are compared with each other in one piece, and rows for a task's group.
PIECE, GROUP_ROWS = 1024, 4000
#: Pairs with one copy of a hub's sketch or set, and copies of what is joined with all rows of one content or component.
SPREAD, SALTS = 256, 16
#: Size of the bitmap that chooses documents to verify: 8 MB.
FILTER_BITS = 26
BITS = COORDINATES.bit_length() - 1
SEEDS = numbers(2 * COORDINATES, 77)


def sketch(items: np.ndarray) -> np.ndarray:
    """Fast similarity sketch of a set of hashes: every coordinate gets the least value thrown into its bin.

    Round i throws each item into one hashed bin with a value in [i, i+1); the first COORDINATES rounds go on until no
    bin is empty, and each round after those fills one bin with certainty, so every coordinate is filled.
    """
    got = np.full(COORDINATES, np.iinfo(np.uint64).max, dtype=U)
    for i in range(2 * COORDINATES):
        z = mix(items ^ SEEDS[i])
        value = ((z << U(BITS)) >> U(BITS + 2)) | (U(i) << U(64 - BITS - 2))
        if i < COORDINATES:
            np.minimum.at(got, (z >> U(64 - BITS)).astype(np.intp), value)
        else:
            b = i - COORDINATES
            got[b] = min(got[b], value.min())
        if got.max() != np.iinfo(np.uint64).max:
            break
    return got


def band_keys(got: np.ndarray) -> np.ndarray:
    rows = got[: BANDS * ROWS].reshape(BANDS, ROWS)
    keys = np.arange(1, len(rows) + 1, dtype=U) * U(0x9E3779B97F4A7C15)
    for k in range(ROWS):
        keys = mix(keys * U(0xA24BAED4963EE407) + rows[:, k])
    return keys.view(np.int64)


def describe(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, t, c1, c2, n_shingles, sketch, bands): t is a hash of the text, c1, c2 a 128-bit hash of the word sequence."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column_bytes(batch.column(1))
            for lo, hi in chunks(offsets):
                words = Words(data, offsets[lo : hi + 1])
                sets = shingles(words, width)
                got = [sketch(s) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[lo:hi],
                        batch.column(2)[lo:hi],
                        pa.array(words.sequences(1).view(np.int64)),
                        pa.array(words.sequences(2).view(np.int64)),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([None if g is None else mix(g).astype(np.uint8).tobytes() for g in got], pa.binary()),
                        pa.array([None if g is None else band_keys(g) for g in got], pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "t", "c1", "c2", "n_shingles", "sketch", "bands"],
                )

    return docs.select("doc_id", "text", text_hash()).mapInArrow(rows, "doc_id long, t long, c1 long, c2 long, n_shingles long, sketch binary, bands array<long>")


def text_hash() -> Column:
    return F.xxhash64("text").alias("t")


def row_bit(doc_id: Column, t: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id, t), F.lit(1 << FILTER_BITS))


def marked(wanted: DataFrame) -> np.ndarray:
    """A bitmap with the bits of the rows (doc_id, t) of ``wanted``: 2**FILTER_BITS bits, whatever their number."""
    bit = row_bit(F.col("doc_id"), F.col("t"))
    rows = wanted.groupBy(F.shiftright(bit, 15).alias("page")).agg(F.bitmap_construct_agg(bit.bitwiseAND(F.lit(32767).cast("long"))).alias("bits")).collect()
    out = np.zeros((1 << FILTER_BITS) // 8, dtype=np.uint8)
    for r in rows:
        out[r.page * 4096 : (r.page + 1) * 4096] = np.frombuffer(bytes(r.bits), dtype=np.uint8)
    return out


def shingle_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(node, items) for the rows (doc_id, t, node) of ``wanted``: sorted distinct 64-bit shingle hashes as bytes. A broadcast
    bitmap of fixed size passes over most other documents where they are read, so texts aren't shuffled; a join drops the
    rest. Repeated rows give one set."""
    shared = docs.sparkSession.sparkContext.broadcast(marked(wanted))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = shared.value
        for batch in batches:
            bit = batch.column(3).to_numpy()
            batch = batch.filter(pa.array((bitmap[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1))
            if not batch.num_rows:
                continue
            data, offsets = column_bytes(batch.column(1))
            for lo, hi in chunks(offsets):
                sets = shingles(Words(data, offsets[lo : hi + 1]), width)
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], batch.column(2)[lo:hi], pa.array([s.tobytes() for s in sets], pa.binary())], names=["doc_id", "t", "items"])

    named = docs.select("doc_id", "text", text_hash()).where("doc_id is not null").withColumn("bit", row_bit(F.col("doc_id"), F.col("t")))
    found = named.mapInArrow(rows, "doc_id long, t long, items binary").join(wanted, ["doc_id", "t"])
    return found.groupBy("doc_id", "t").agg(F.first("node").alias("node"), F.first("items").alias("items")).select("node", "items")


def with_both(pairs: DataFrame, values: DataFrame, value: str) -> DataFrame:
    """(hub, node, cell, x, y): ``pairs`` with the ``value`` of the hub and of the node. A hub's is copied once for each of its
    cells, which hold about SPREAD pairs, so a popular hub is no hot key; a node has few hubs."""
    hubs = pairs.groupBy(F.col("hub").alias("node")).agg(F.max("cell").alias("last")).join(values, "node")
    hubs = hubs.select(F.col("node").alias("hub"), F.explode(F.sequence(F.lit(0), F.col("last"))).alias("cell"), F.col(value).alias("x"))
    return pairs.join(values.select("node", F.col(value).alias("y")), "node").join(hubs, ["hub", "cell"]).select("hub", "node", "cell", "x", "y")


def likely(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (hub, node, cell) whose sketches agree in at least SURE_BELOW of the coordinates."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), dtype=np.uint8).reshape(-1, COORDINATES) for i in (3, 4))
            yield batch.select(["hub", "node", "cell"]).filter(pa.array((x == y).mean(axis=1) >= SURE_BELOW))

    return with_both(pairs, nodes, "sketch").mapInArrow(rows, "hub long, node long, cell int")


def confirmed(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) whose full sets have 100 * intersection >= 100 * least * union."""
    percent = round(100 * least)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [shares(np.frombuffer(x.as_buffer(), dtype=U), np.frombuffer(y.as_buffer(), dtype=U), percent) for x, y in zip(batch.column(3), batch.column(4))]
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return with_both(pairs, sets, "items").mapInArrow(rows, "a long, b long")


def shares(p: np.ndarray, q: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, for sorted sets."""
    if 100 * min(len(p), len(q)) < percent * max(len(p), len(q)):
        return False
    merged = np.sort(np.concatenate((p, q)))
    both = int((merged[1:] == merged[:-1]).sum())
    return 100 * both >= percent * (len(p) + len(q) - both)


def links_across(members: DataFrame, groups: int, least: float) -> DataFrame:
    """(a, b): links between different components of a group, enough of them to join all that are linked.

    ``members`` has hub, n (size of the hub's group), node, component, sketch, items. A group of n members is cut into pieces of
    about PIECE by a hash, and every two pieces meet once, so no task holds a group whole. Pairs whose sketches are
    alike are verified on full sets in the task, the likeliest first, and pairs that are joined by then are skipped: rows are
    made of links only, however many pairs were alike.
    """
    percent = round(100 * least)
    pieces = F.ceil(F.col("n") / PIECE).cast("int")
    cells = members.withColumn("own", F.pmod(F.xxhash64("node"), pieces).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), pieces - 1)))
    cells = cells.select("hub", "node", "component", "sketch", "items", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def compare(table: pa.Table) -> pa.Table:
        table = table.take(pa.array(np.lexsort([table.column(c).to_numpy() for c in ("node", "j", "i", "hub")])))
        cell = np.stack([table.column(c).to_numpy() for c in ("hub", "i", "j")])
        starts = np.flatnonzero(np.concatenate(([True], (cell[:, 1:] != cell[:, :-1]).any(axis=0))))
        node, component, own = (table.column(c).to_numpy() for c in ("node", "component", "own"))
        sketches = np.frombuffer(b"".join(table.column("sketch").to_pylist()), dtype=np.uint8).reshape(-1, COORDINATES)
        items = [np.frombuffer(v.as_buffer(), dtype=U) for v in table.column("items")]
        out = []
        for lo, hi in zip(starts, np.append(starts[1:], len(node))):
            same_piece = cell[1][lo] == cell[2][lo]
            pairs = []
            for x in range(lo, hi - 1):
                apart = component[x + 1 : hi] != component[x]
                if not same_piece:
                    apart &= own[x + 1 : hi] != own[x]
                apart = np.flatnonzero(apart) + x + 1
                if len(apart):
                    agree = (sketches[apart] == sketches[x]).mean(axis=1)
                    pairs += [(-e, x, y) for e, y in zip(agree[agree >= SURE_BELOW].tolist(), apart[agree >= SURE_BELOW].tolist())]
            root: dict[int, int] = {}

            def find(c: int) -> int:
                while (up := root.get(c, c)) != c:
                    root[c] = root.get(up, up)
                    c = up
                return c

            for _, x, y in sorted(pairs):
                p, q = find(int(component[x])), find(int(component[y]))
                if p != q and shares(items[x], items[y], percent):
                    root[max(p, q)] = min(p, q)
                    out.append((int(max(node[x], node[y])), int(min(node[x], node[y]))))
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return cells.groupBy(F.pmod(F.xxhash64("hub", "i", "j"), F.lit(groups))).applyInArrow(compare, "a long, b long")


def members(docs: DataFrame, width: int, least: float) -> DataFrame:
    """(doc_id, t, n_shingles, component_id, first) for every row of ``docs``; ``first`` marks the row that stands for its
    component, the least by (doc_id, t), and its repeats."""
    base = materialize(describe(docs, width))
    filled = base.where("n_shingles > 0 and doc_id is not null")
    named = filled.groupBy("c1", "c2").agg(F.min(F.struct("doc_id", "t")).alias("low"), F.count("*").alias("copies"), F.first("sketch").alias("sketch"), F.first("bands").alias("bands"))
    nodes = materialize(named.withColumn("node", F.monotonically_increasing_id()))
    keys = nodes.select("node", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count("*").alias("n")).where("low < high").select("key", "n")
    crowded = materialize(keys.join(shared, "key"))
    meets = crowded.groupBy("node").agg(F.sum("n").alias("meets"))
    hubs = crowded.join(meets, "node").groupBy("key").agg(F.max(F.struct("meets", (-F.col("node")).alias("less"))).alias("h")).select("key", (-F.col("h.less")).alias("hub"))
    met = materialize(crowded.join(hubs, "key").groupBy("hub", "node").agg(F.max("n").alias("n")))
    cell = F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / SPREAD)).cast("int").alias("cell")
    slim = nodes.select("node", "sketch")
    star = materialize(likely(met.where("node <> hub").select("hub", "node", cell), slim))
    wanted = nodes.join(met.select("node").distinct(), "node", "left_semi").select("low.doc_id", "low.t", "node")
    sets = materialize(shingle_sets(docs, wanted, width))
    links = materialize(confirmed(star, sets, least))
    known = met.select("hub", "node").join(components(links), "node", "left").select("hub", "node", F.coalesce("component", "node").alias("component"))
    split = materialize(known.groupBy("hub").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n")).where("lo < hi").select("hub", "n"))
    rows = split.agg(F.sum(F.col("n") * F.ceil(F.col("n") / PIECE))).first()[0] or 0
    more = links_across(known.join(split, "hub").join(slim, "node").join(sets, "node"), max(1, rows // GROUP_ROWS), least)
    joined = components(materialize(links.unionByName(more)))
    # what differs from a row's own values: contents of several rows, and of components of several contents
    alike = materialize(nodes.select("c1", "c2", "low", "copies", "node").join(joined, "node", "left").where("copies > 1 or component is not null"))
    salt = lambda c: F.pmod(F.xxhash64(c), F.lit(SALTS))
    all_salts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt")
    lowest = alike.where("component is not null").groupBy("component").agg(F.min("low").alias("least")).select("component", "least", all_salts)
    alike = alike.withColumn("salt", salt("node")).join(lowest, ["component", "salt"], "left").select("c1", "c2", F.coalesce("least", "low").alias("least"), all_salts)
    slim_rows = filled.select("doc_id", "t", "c1", "c2", "n_shingles").withColumn("salt", salt(F.struct("doc_id", "t", F.monotonically_increasing_id())))
    own = slim_rows.join(alike, ["c1", "c2", "salt"], "left").withColumn("least", F.coalesce("least", F.struct("doc_id", "t")))
    placed = own.select("doc_id", "t", "n_shingles", F.col("least.doc_id").alias("component_id"), (F.struct("doc_id", "t") == F.col("least")).alias("first"))
    alone = base.where("not (n_shingles > 0 and doc_id is not null)").select("doc_id", "t", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("first"))
    return placed.unionByName(alone)


def near_duplicates(docs: DataFrame, width: int = 5, least: float = 0.8) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``.

    Texts of the same words form one node; only nodes are compared. Nodes that share a band go to the band's hub, its node
    that meets the most others over all bands (a star); stars are verified exactly and joined to components. Where the nodes
    that met a hub are then still several components, pairs across them whose sketches are alike are verified too, so a
    link that passes by the hub isn't lost: nodes that share a band share its hub. No group is expanded into all its pairs
    as rows. A component is named by the least doc_id of its rows.

    A text with fewer words than ``width`` is one shingle; null, empty and blank texts have none and are linked with
    nothing. Rows that repeat a doc_id are documents of their own: each goes by its own text. A null doc_id has a null
    component.
    """
    return members(docs, width, least).select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, width: int = 5, least: float = 0.8) -> DataFrame:
    """Rows of ``docs`` without near duplicates of another: of each component the row of the least doc_id (of the least hash
    of its text, where several texts of a component have that id), once if it is repeated.

    Rows that share a doc_id but aren't near duplicates stay, each by its own text. Rows with a null doc_id and rows
    without words are linked with nothing and stay.
    """
    found = materialize(members(docs, width, least))
    gone = found.where("not first").select("doc_id", "t").distinct()
    t, repeat = fresh(docs, "_t"), fresh(docs, "_repeat")
    again = found.where("first and n_shingles > 0 and doc_id is not null").groupBy("doc_id", "t").count().where("count > 1").select("doc_id", "t", F.lit(True).alias(repeat))
    if again.isEmpty():
        left = docs.withColumn(t, F.xxhash64("text")).alias("d")
        return left.join(gone.alias("g"), (F.col("d.doc_id") == F.col("g.doc_id")) & (F.col(f"d.{t}") == F.col("g.t")), "left_anti").select(docs.columns)
    marks = materialize(gone.withColumn(repeat, F.lit(False)).unionByName(again)).alias("g")
    left = docs.withColumn(t, F.xxhash64("text")).alias("d").join(marks, (F.col("d.doc_id") == F.col("g.doc_id")) & (F.col(f"d.{t}") == F.col("g.t")), "left")
    left = materialize(left.where(f"{repeat} is null or {repeat}").select("d.*", repeat))
    return left.where(f"{repeat} is null").unionByName(left.where(repeat).dropDuplicates(["doc_id", t])).select(docs.columns)


def op10_sketch_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=4)
