"""Quality classifier: sizes under zstandard dictionaries of good and of bad text, calibrated to a score."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.fitting import fold, labelled_sample, logistic, sigmoid

#: Bounds of the fit: labelled rows of each class, labelled blocks of each class that make a dictionary (chosen by a hash from
#: all blocks of these rows), bytes of a dictionary, and of samples for each of its bytes.
SAMPLE_ROWS, SAMPLE_BLOCKS, DICTIONARY_BYTES, SAMPLES = 3000, 10_000, 64_000, 20
#: Texts are compressed in blocks, so that the dictionary and not the text's own start explains each of them.
BLOCK, LEVEL = 2048, 3


def blocks(data: bytes) -> list[bytes]:
    return [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]


def dictionary(samples: list[bytes]) -> bytes:
    """A dictionary trained on blocks, as large as they can fill; where they are too few to train on, their own beginnings,
    the same share of each."""
    size = min(DICTIONARY_BYTES, sum(map(len, samples)) // SAMPLES)
    if size >= 1024:
        try:
            return zstandard.train_dictionary(size, samples, k=200, d=8).as_bytes()
        except zstandard.ZstdError:
            pass  # too few blocks, or all alike
    share = min(1.0, DICTIONARY_BYTES / max(1, sum(map(len, samples))))
    return b"".join(b[: int(len(b) * share)] for b in samples) or b" " * 64


class Sizes:
    """Sizes of whole texts under both dictionaries."""

    def __init__(self, good: bytes, bad: bytes):
        self.by = [zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False) for d in (good, bad)]

    def features(self, text: str | None) -> tuple[float, float]:
        """(bad - good) / (bad + good), and the good size for a byte; (0, 1) for an empty text."""
        data = (text or "").encode("utf-8", "replace")
        if not data:
            return 0.0, 1.0
        good, bad = (sum(len(c.compress(b)) for b in blocks(data)) for c in self.by)
        return (bad - good) / (bad + good), good / len(data)


def fit(docs: DataFrame, labels: DataFrame, label: str, keep: Column) -> tuple[bytes, bytes, list[float]]:
    """(good dictionary, bad dictionary, logistic weights). Half of the bounded sample trains the dictionaries, the
    other half calibrates on whole texts: a text in the dictionary would look better than it is. At most SAMPLE_BLOCKS blocks a
    class, and two numbers for each text of the other half, reach the driver. Without any labels the score is 0.5."""
    sample = labelled_sample(docs, labels, label, keep, {0: SAMPLE_ROWS, 1: SAMPLE_ROWS})

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for label, text in zip(batch.column(0), batch.column(1)):
                got = blocks(text.as_py().encode("utf-8", "replace"))
                yield pa.RecordBatch.from_arrays([pa.array([label.as_py()] * len(got), pa.int32()), pa.array(got, pa.binary())], names=["label", "block"])

    cut = sample.where("part < 2").select("label", "text").mapInArrow(some, "label int, block binary")
    taken = [[bytes(r.block) for r in cut.where(F.col("label") == v).orderBy(F.xxhash64("block"), "block").limit(SAMPLE_BLOCKS).collect()] for v in (1, 0)]
    good, bad = map(dictionary, taken)
    shared = docs.sparkSession.sparkContext.broadcast((good, bad))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = Sizes(*shared.value)
        for batch in batches:
            x = np.array([sizes.features(t.as_py()) for t in batch.column(1)]).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x[:, 0]), pa.array(x[:, 1])], names=["label", "a", "b"])

    held = np.array(sorted(map(tuple, sample.where("part > 1").select("label", "text").mapInArrow(measure, "label int, a double, b double").collect())), dtype=float).reshape(-1, 3)
    return good, bad, logistic(design(held[:, 1:]), held[:, 0]).tolist()


def design(x: np.ndarray) -> np.ndarray:
    return np.column_stack([100 * x[:, 0], 10 * x[:, 1], 10 * x[:, 1] ** 2, 100 * x[:, 0] * x[:, 1]])


def score_quality(docs: DataFrame, model: tuple[bytes, bytes, list[float]]) -> DataFrame:
    """(doc_id, score) for every row of ``docs``: the chance that a text is of label 1.

    Null and empty texts get the score of an empty text; repeated rows are scored each.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        good, bad, w = shared.value
        sizes, weights = Sizes(good, bad), np.array(w)
        for batch in batches:
            x = np.array([sizes.features(t.as_py()) for t in batch.column(1)]).reshape(-1, 2)
            z = np.column_stack([design(x), np.ones(len(x))]) @ weights
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sigmoid(z))], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(score, "doc_id long, score double")


def op2_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = fit(docs, labels, "quality", fold(F.col("doc_id"), 3) != 1)
    scored = score_quality(docs, model)
    return scored.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
