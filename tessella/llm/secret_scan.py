"""Secret scans: rules, and a character convolutional network over every candidate with its context."""

from __future__ import annotations

import copy
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.fitting import logistic, sigmoid
from tessella.sources.shared import discard, materialize, partitions

KINDS = ("assign", "access", "hex", "network")
# The rules.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: Greedy runs, so a run that is long enough is all that a rule without its length would have found.
ACCESS, HEX = re.compile("AKIA[A-Z0-9]{16,}"), re.compile("[0-9a-f]{24,}")
LEAST_ASSIGNED = 6
#: A candidate is a run of so many of these characters, unless it is letters only after its first one and shorter than LETTERS.
CANDIDATE = re.compile("[A-Za-z0-9+/_.=-]{12,}")
LETTERS = 20
#: Characters of context on either side, and of the candidate in one window; longer ones have several windows, half overlapping.
CONTEXT, VALUE = 24, 48
WIDTH = 2 * CONTEXT + VALUE
#: Labelled windows of a piece of the fit, which has as many pieces as it takes. Share of held-out findings that the threshold must find.
PIECE, RECALL = 6000, 0.95
#: Logits are cut to steps of 1 / GRAIN within +-REACH, so that those of all held-out windows are counted in a bounded table.
GRAIN, REACH = 256, 50
#: Size of the network: values for a character, filters and their width; rounds of the fit, and steps of 64 rows at least.
EMBED, FILTERS, SPAN, EPOCHS, STEPS = 8, 24, 5, 12, 600
#: Parameters of pieces are summed as whole numbers of this unit: the mean is the same in any order.
UNIT = 2.0**-32
# Code of a character: 0 nothing, 1 to 95 printable ASCII, 96 white space, 97 a letter beyond ASCII, 98 anything else.
CODES = 99
CODE = np.zeros(0x110000, dtype=np.uint8)
CODE[:] = 98
CODE[32:127] = np.arange(1, 96)
CODE[[9, 10, 11, 12, 13, 32]] = 96
CODE[0xAA:0x2000] = 97
CODE[0x3040:0xD800] = 97


def rule_spans(text: str) -> list[tuple[int, int, str, int, int]]:
    """(start, kind, rule, end, start of the value) of each rule's leftmost matches that don't overlap, in order."""
    found = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        found += [(m.start(), 0, "assign", m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end() - m.start(2) >= LEAST_ASSIGNED]
    found += [(m.start(), 1, "access", m.end(), m.start()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, "hex", m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(found)


def candidates(text: str, rules: list[tuple]) -> list[tuple[int, int]]:
    """(start, end) of the candidates that no rule has touched."""
    taken = sorted((r[0], r[3]) for r in rules)
    out, i = [], 0
    for m in CANDIDATE.finditer(text):
        a, b = m.span()
        if b - a < LETTERS and text[a + 1 : b].isalpha() and (text[a + 1 : b].islower() or text[a:b].isupper()):
            continue
        while i < len(taken) and taken[i][1] <= a:
            i += 1
        if i == len(taken) or taken[i][0] >= b:
            out.append((a, b))
    return out


def codes(text: str) -> np.ndarray:
    return CODE[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]


def windows(text: str, start: int, end: int) -> list[bytes]:
    """Codes of a candidate with its context, in windows of WIDTH: CONTEXT characters that end at the value's start, VALUE
    characters of the value (0 beyond its end), CONTEXT characters from its end on. A long value has a window each VALUE / 2
    characters, all with the same context."""
    left, right = codes(text[max(0, start - CONTEXT) : start]), codes(text[end : end + CONTEXT])
    value, out = codes(text[start:end]), []
    for i in range(0, max(1, len(value) - VALUE // 2), VALUE // 2):
        w = np.zeros(WIDTH, dtype=np.uint8)
        w[CONTEXT - len(left) : CONTEXT] = left
        part = value[i : i + VALUE]
        w[CONTEXT : CONTEXT + len(part)] = part
        w[CONTEXT + VALUE : CONTEXT + VALUE + len(right)] = right
        out.append(w.tobytes())
    return out


SEGMENTS = [slice(0, CONTEXT), slice(CONTEXT, CONTEXT + VALUE), slice(CONTEXT + VALUE, WIDTH)]


class Network:
    """Characters are embedded, convolved with FILTERS filters of SPAN characters, rectified, and pooled by maximum and mean
    over the left context, the value and the right context apart; a logistic layer follows."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.embed = (rng.normal(size=(CODES, EMBED)) * 0.5).astype(np.float32)
        self.embed[0] = 0
        self.filters = (rng.normal(size=(SPAN * EMBED, FILTERS)) / np.sqrt(SPAN * EMBED)).astype(np.float32)
        self.bias = np.zeros(FILTERS, np.float32)
        self.out = (rng.normal(size=6 * FILTERS) * 0.1).astype(np.float32)
        self.shift = np.zeros(1, np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [self.embed, self.filters, self.bias, self.out, self.shift]

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, tuple]:
        """(logits, what the gradient needs) of rows of WIDTH codes."""
        n, half = len(x), SPAN // 2
        padded = np.zeros((n, WIDTH + 2 * half, EMBED), np.float32)
        padded[:, half:-half] = self.embed[x]
        cols = np.concatenate([padded[:, i : i + WIDTH] for i in range(SPAN)], axis=2).reshape(n * WIDTH, SPAN * EMBED)
        h = np.maximum(cols @ self.filters + self.bias, 0).reshape(n, WIDTH, FILTERS)
        full = x > 0
        h = h * full[:, :, None]
        pooled, tops, sizes = [], [], []
        for s in SEGMENTS:
            tops.append(h[:, s].argmax(axis=1))
            sizes.append(np.maximum(full[:, s].sum(axis=1), 1).astype(np.float32))
            pooled += [h[:, s].max(axis=1), h[:, s].sum(axis=1) / sizes[-1][:, None]]
        features = np.concatenate(pooled, axis=1)
        return features @ self.out + self.shift[0], (cols, h, full, tops, sizes, features)

    def gradients(self, x: np.ndarray, slope: np.ndarray, state: tuple) -> list[np.ndarray]:
        cols, h, full, tops, sizes, features = state
        n, half = len(x), SPAN // 2
        back = slope[:, None] * self.out[None, :]
        d = np.zeros_like(h)
        rows, each = np.arange(n)[:, None], np.arange(FILTERS)[None, :]
        for i, s in enumerate(SEGMENTS):
            d[:, s] += (back[:, (2 * i + 1) * FILTERS : (2 * i + 2) * FILTERS] / sizes[i][:, None])[:, None, :]
            d[rows, s.start + tops[i], each] += back[:, 2 * i * FILTERS : (2 * i + 1) * FILTERS]
        d = (d * (h > 0) * full[:, :, None]).reshape(n * WIDTH, FILTERS)
        back_cols = (d @ self.filters.T).reshape(n, WIDTH, SPAN, EMBED)
        padded = np.zeros((n, WIDTH + 2 * half, EMBED), np.float32)
        for i in range(SPAN):
            padded[:, i : i + WIDTH] += back_cols[:, :, i]
        embed = np.zeros_like(self.embed)
        np.add.at(embed, x.reshape(-1), padded[:, half:-half].reshape(-1, EMBED))
        embed[0] = 0
        return [embed, cols.T @ d, d.sum(axis=0), features.T @ slope, np.array([slope.sum()], np.float32)]

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self.forward(x[i : i + 256])[0] for i in range(0, len(x), 256)]) if len(x) else np.zeros(0, np.float32)


def train(net: Network, x: np.ndarray, y: np.ndarray, weights: dict[int, float], seed: list[int]) -> None:
    """Adam on the logistic loss, from ``net`` on: a pass, or as many as EPOCHS of these take for STEPS steps. ``weights``: of the rows
    of either label. Contexts are blanked in a third of the rows of each pass, so that the value has to tell by itself as well."""
    rng = np.random.default_rng(seed)
    weight = np.where(y == 1, weights[1], weights[0])
    slots = [(np.zeros_like(p), np.zeros_like(p)) for p in net.parameters()]
    turn = 0
    for _ in range(-(-STEPS * 64 // (EPOCHS * len(x)))):
        order = rng.permutation(len(x))
        for i in range(0, len(x), 64):
            at = order[i : i + 64]
            batch = x[at].copy()
            blank = rng.random(len(at)) < 1 / 3
            batch[blank, :CONTEXT] = 0
            batch[blank, CONTEXT + VALUE :] = 0
            z, state = net.forward(batch)
            slope = ((sigmoid(z) - y[at]) * weight[at] / len(at)).astype(np.float32)
            turn += 1
            for p, g, (m, v) in zip(net.parameters(), net.gradients(batch, slope, state), slots):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= 3e-3 * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.999**turn)) + 1e-8)


class Scorer:
    """A trained network, the logistic calibration of its logits, and the threshold on the calibrated chance."""

    def __init__(self, net: Network, slope: float = 1.0, shift: float = 0.0, threshold: float = 1.0):
        self.net, self.slope, self.shift, self.threshold = net, slope, shift, threshold

    def steps(self, x: np.ndarray) -> np.ndarray:
        """Logits in whole steps of 1 / GRAIN."""
        return np.floor(np.clip(self.net.logits(x).astype(float), -REACH, REACH) * GRAIN)

    def calibrated(self, steps: np.ndarray) -> np.ndarray:
        return sigmoid(steps / GRAIN * self.slope + self.shift)

    def chances(self, x: np.ndarray) -> np.ndarray:
        return self.calibrated(self.steps(x))


def pieces_of(labelled: DataFrame) -> tuple[DataFrame, dict[tuple[bool, int], int]]:
    """(held, piece, labels, wins), stored, and the counts by (held, label): every distinct window of ``labelled`` (label, win), dealt by a
    hash to pieces of about PIECE, a quarter of each held out. A piece is a row of joined bytes. Copies count once; a window
    with both labels is a finding."""
    distinct = materialize(labelled.groupBy("win").agg(F.max("label").alias("label")).where("label in (0, 1)"))
    held = (F.pmod(F.xxhash64(F.lit("part"), "win"), F.lit(4)) == 0).alias("held")
    counts = {(r.held, r.label): r.n for r in distinct.groupBy(held, "label").agg(F.count("*").alias("n")).collect()}
    n = max(1, -(-sum(counts.values()) // PIECE))
    dealt = distinct.select(held, F.pmod(F.xxhash64(F.lit("piece"), "win"), F.lit(n)).alias("piece"), "label", "win")
    # a given number of partitions, as small ones would else be put together and trained one after another
    dealt = dealt.repartition(min(2 * n, 4 * partitions(labelled.sparkSession)), "held", "piece")
    rows = dealt.groupBy("held", "piece").agg(F.sort_array(F.collect_list(F.struct("win", "label"))).alias("w"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r.as_py() for r in batch.column(2)]
            labels, wins = ([f(w) for w in rows] for f in (lambda w: bytes(v["label"] for v in w), lambda w: b"".join(v["win"] for v in w)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(labels, pa.binary()), pa.array(wins, pa.binary())], names=["held", "piece", "labels", "wins"])

    packed = materialize(rows.mapInArrow(pack, "held boolean, piece long, labels binary, wins binary"))
    discard(distinct)
    return packed, counts


def unpacked(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(piece, windows, labels) of rows (piece, labels, wins)."""
    for piece, labels, wins in zip(*(c.to_pylist() for c in batch.columns)):
        yield piece, np.frombuffer(wins, dtype=np.uint8).reshape(-1, WIDTH), np.frombuffer(labels, dtype=np.uint8).astype(int)


def fit(labelled: DataFrame, recall: float = RECALL) -> Scorer | None:
    """From every distinct window of ``labelled`` (label, win): three quarters train the network, the others calibrate it, and
    the threshold is the highest that still finds ``recall`` of their findings. None if a class is missing from either: then
    nothing is added.

    In each of EPOCHS rounds every piece trains on from the same network, on its own rows, and the mean of the pieces' networks is the
    next one; a task sends one row of sums. Both classes weigh the same.
    """
    spark = labelled.sparkSession
    pieces, counts = pieces_of(labelled)
    if len(counts) < 4:
        discard(pieces)
        return None
    n = sum(c for (held, _), c in counts.items() if not held)
    weights = {label: 0.5 * n / counts[False, label] for label in (0, 1)}
    net = Network()
    for turn in range(EPOCHS):

        def learn(batches: Iterator[pa.RecordBatch], turn: int = turn, shared=spark.sparkContext.broadcast(net)) -> Iterator[pa.RecordBatch]:
            total, number = 0, 0
            for batch in batches:
                for piece, x, y in unpacked(batch):
                    own = copy.deepcopy(shared.value)
                    train(own, x, y, weights, [7, turn, piece])
                    total, number = total + np.rint(np.concatenate([p.ravel() for p in own.parameters()]).astype(float) / UNIT).astype(np.int64), number + 1
            if number:
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([total], pa.list_(pa.int64()))], names=["number", "total"])

        sums = pieces.where("not held").select("piece", "labels", "wins").mapInArrow(learn, "number long, total array<long>").collect()
        mean = sum(np.array(r.total, dtype=np.int64) for r in sums) / sum(r.number for r in sums) * UNIT
        for p in net.parameters():
            p[...], mean = mean[: p.size].reshape(p.shape), mean[p.size :]
    scorer = Scorer(net)
    shared = spark.sparkContext.broadcast(scorer)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, x, y in unpacked(batch):
                both, n = np.unique(np.stack([shared.value.steps(x).astype(np.int64), y]), axis=1, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1]), pa.array(n)], names=["step", "label", "n"])

    found = pieces.where("held").select("piece", "labels", "wins").mapInArrow(count, "step long, label long, n long")
    rows = sorted(map(tuple, found.groupBy("step", "label").agg(F.sum("n").alias("n")).collect()))  # a row for each step and label
    discard(pieces)
    step, y, n = np.array(rows, dtype=float).T
    scorer.slope, scorer.shift = logistic((step / GRAIN)[:, None], y, times=n)
    chance, own = scorer.calibrated(step[y == 1]), n[y == 1]
    order = np.argsort(chance)
    scorer.threshold = float(chance[order][np.searchsorted(np.cumsum(own[order]), np.floor((1 - recall) * own.sum()), side="right")])
    return scorer


SPAN_TYPE = "struct<start:int, `end`:int, kind:int>"
CANDIDATE_TYPE = "struct<start:int, `end`:int, windows:array<binary>>"


def scanned(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) as (doc_id, rules, candidates, findings): the rules' spans, the other candidates with their windows, and
    the windows of what the rules found."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                rules, others, findings = [], [], []
                for text in part.column(1):
                    text = text.as_py() or ""
                    spans = rule_spans(text)
                    rules.append([{"start": a, "end": b, "kind": k} for a, k, _, b, _ in spans])
                    others.append([{"start": a, "end": b, "windows": windows(text, a, b)} for a, b in candidates(text, spans)])
                    findings.append([w for _, _, _, b, v in spans for w in windows(text, v, b)])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array(rules, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.int32())]))),
                        pa.array(others, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("windows", pa.list_(pa.binary()))]))),
                        pa.array(findings, pa.list_(pa.binary())),
                    ],
                    names=["doc_id", "rules", "candidates", "findings"],
                )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {id_type}, rules array<{SPAN_TYPE}>, candidates array<{CANDIDATE_TYPE}>, findings array<binary>")


def labelled_windows(found: DataFrame) -> DataFrame:
    """(label, win) of a scan: what the rules found are findings, other candidates are not."""
    good = found.select(F.lit(1).alias("label"), F.explode("findings").alias("win"))
    rest = found.select(F.explode("candidates.windows").alias("several")).select(F.lit(0).alias("label"), F.explode("several").alias("win"))
    return good.unionByName(rest)


def scan_secrets(docs: DataFrame, findings: DataFrame | None = None) -> DataFrame:
    """(doc_id, rules, added) for each row of ``docs`` (doc_id, text): spans (start, end, kind number) of the rules, in order,
    and those that the network adds, with their calibrated chances.

    Whole texts of any length; a null or empty text has no spans, repeated rows are scanned each, further columns are left
    aside, no rows give no rows. ``findings`` (doc_id, start, end, is_secret 0/1, in code points) labels spans to learn from; without it
    the rules' findings are the labels, and every candidate that no rule found is a counterexample. Candidates that touch
    a rule's span add nothing. The texts are scanned once; what is stored are spans and windows. Every labelled window takes part in the fit.
    """
    spark = docs.sparkSession
    found = materialize(scanned(docs))
    labelled = labelled_windows(found) if findings is None else given_windows(docs, findings)
    shared = spark.sparkContext.broadcast(fit(labelled))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = shared.value
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                rows = part.column(2).to_pylist()
                added = [[] for _ in rows]
                if scorer is not None:
                    flat = [(d, c) for d, row in enumerate(rows) for c in row or []]
                    own = np.repeat(np.arange(len(flat)), [len(c["windows"]) for _, c in flat])
                    best = np.zeros(len(flat))
                    np.maximum.at(best, own, scorer.chances(np.frombuffer(b"".join(w for _, c in flat for w in c["windows"]), dtype=np.uint8).reshape(-1, WIDTH)))
                    for (d, c), p in zip(flat, best):
                        if p >= scorer.threshold:
                            added[d].append({"start": c["start"], "end": c["end"], "chance": float(p)})
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(added, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("chance", pa.float64())])))],
                    names=["doc_id", "rules", "added"],
                )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return found.select("doc_id", "rules", "candidates").mapInArrow(add, f"doc_id {id_type}, rules array<{SPAN_TYPE}>, added array<struct<start:int, `end`:int, chance:double>>")


def given_windows(docs: DataFrame, findings: DataFrame) -> DataFrame:
    """(label, win) of labelled spans: findings of a document are joined with its text by id; rows without a text give none."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(y, w) for text, a, b, y in zip(*(c.to_pylist() for c in batch.columns)) if 0 <= a < b <= len(text) for w in windows(text, a, b)]
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.binary())], names=["label", "win"])

    joined = docs.select("doc_id", "text").join(findings.select("doc_id", "start", "end", F.col("is_secret").cast("int").alias("y")), "doc_id")
    usable = F.col("text").isNotNull() & F.col("start").isNotNull() & F.col("end").isNotNull() & F.col("y").isNotNull()
    return joined.where(usable).select("text", "start", "end", "y").mapInArrow(cut, "label int, win binary")


def spelled(spans: Column) -> Column:
    """kind:start:end of each span (start, kind, end), in order, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op12_network_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("rules", lambda s: s["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    ordered = lambda s, kind: F.struct(s["start"].alias("start"), kind.alias("kind"), s["end"].alias("end"))
    base = F.transform("rules", lambda s: ordered(s, s["kind"]))
    added = F.transform("added", lambda s: ordered(s, F.lit(KINDS.index("network"))))
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"), F.sha2(spelled(base), 256).alias("base_sha256"),
        spelled(F.concat(base, added)).alias("spans"), F.size("added").cast("long").alias("n_network"),
    )
