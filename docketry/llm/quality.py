"""Quality classifier: hashed word n-gram logistic regression, trained by follow-the-regularised-leader updates.

Tokens are runs of alphanumeric bytes (letters of any script, lower-cased A-Z) and runs of other marks; single tokens and
pairs are hashed to 2**BITS weights (all pairs of a token with itself share
one, so that repetition is seen whatever the word); a text's features are its counts over the square root of the number of tokens, and a
score is a sparse dot product through the logistic function. Scoring is one pass without a shuffle; only the weights
(2**BITS doubles, whatever the corpus) are sent to the executors.

Labels are learned from SAMPLE labelled rows at most (a documented bound of the fit, taken by a hash of the id); rows held
out by the caller are never among them. Nothing but the text enters a score.

Defined results: null or empty text gets the score of the bias alone; null doc_id stays null and counts as not held out;
repeated rows give one row each; labels that are null or lack a document are not used, of repeated ones the smallest
counts; with no label at all every score is 0.5; other columns are ignored (keep_good keeps them).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm import core

BITS = 18
SAMPLE = 6000
THRESHOLD = 0.3
REPEATED = np.uint64(0x5DEECE66D1234567)
_CLASS = np.where(core.SPACE, 0, np.where(core.NOT_ALNUM, 2, 1)).astype(np.uint8)


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed single tokens and pairs of all texts (each text's tokens, then its pairs, end to end), the texts' offsets in these, and their token counts."""
    flat = core.Flat(column, table=core.LOWER)
    kind = _CLASS[flat.buf]
    edge = np.flatnonzero(kind[1:] != kind[:-1]) + 1
    start = edge[kind[edge] > 0]
    end = edge[kind[edge - 1] > 0]
    power, inverse = core.powers(0, len(flat.buf) + 1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((flat.buf.astype(np.uint64) + np.uint64(1)) * power[:-1])))
    token = core.mix((total[end] - total[start]) * inverse[start])
    first, last = np.searchsorted(start, flat.start), np.searchsorted(start, flat.end)
    count = last - first
    text = np.repeat(np.arange(flat.n), count)
    inner = np.flatnonzero(text[1:] == text[:-1])
    pair = core.mix(token[inner] * np.uint64(3) + token[inner + 1])
    pair[token[inner] == token[inner + 1]] = REPEATED
    shift = np.uint64(64 - BITS)
    owner = np.concatenate((text, text[inner]))
    order = np.argsort(owner, kind="stable")
    index = (np.concatenate((token, pair)) >> shift).astype(np.int32)[order]
    size = count + np.maximum(count - 1, 0)
    return index, np.concatenate(([0], np.cumsum(size))), count


class Ftrl:
    """Follow-the-regularised-leader (proximal, per coordinate) for logistic loss; the last weight is the bias."""

    def __init__(self, size: int, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1):
        self.z, self.n = np.zeros(size), np.zeros(size)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z = self.z[at]
        return np.where(np.abs(z) > self.l1, (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2), 0.0)

    def update(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, epochs: int = 3, held_out=None) -> np.ndarray:
    """Weights learned from `sample` labelled rows at most; rows where `held_out` (a column of doc_id) holds are left out."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).dropna()
    if held_out is not None:
        rows = rows.filter(~held_out)
    rows = rows.groupBy("doc_id").agg(F.min("label").alias("label"))
    # at most `sample` rows of two numbers: a broadcast of a fixed bound
    chosen = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in core.slices(whole):
                index, at, count = features(part.column("text"))
                bags = []
                for i in range(part.num_rows):
                    bucket, times = np.unique(index[at[i] : at[i + 1]], return_counts=True)
                    bags.append((core.pack(bucket), core.pack(times.astype(np.int32))))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), pa.array([b[0] for b in bags], pa.binary()), pa.array([b[1] for b in bags], pa.binary()), pa.array(count, pa.int64())], ["doc_id", "label", "bucket", "times", "count"])

    texts = core.texts(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label")
    got = texts.mapInArrow(core.releasing(run), "doc_id long, label int, bucket binary, times binary, count long").toArrow()
    bags = [(i, y, core.unpack(b, np.int32), core.unpack(t, np.int32), c) for i, y, b, t, c in zip(*(got.column(k).to_pylist() for k in ("doc_id", "label", "bucket", "times", "count")), strict=True)]
    bags.sort(key=lambda x: (x[0], x[1], x[4]))
    model = Ftrl((1 << BITS) + 1)
    rng = np.random.default_rng(3)
    for _ in range(epochs):
        for i in rng.permutation(len(bags)):
            _, y, bucket, times, count = bags[i]
            model.update(np.append(bucket, 1 << BITS), np.append(times / np.sqrt(max(count, 1)), 1.0), y)
    return model.weights()


def scores(weights: np.ndarray, column: pa.Array) -> np.ndarray:
    index, at, count = features(column)
    sums = np.add.reduceat(np.append(weights[index], 0.0), at[:-1]) if len(count) else np.zeros(0)
    dot = np.where(count > 0, sums, 0.0) / np.sqrt(np.maximum(count, 1)) + weights[-1]
    return 1 / (1 + np.exp(-np.clip(dot, -35, 35)))


def held_out(doc_id: str = "doc_id"):
    """The evaluation fold: crc32 of the id as text divisible by 5."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    weights = fit(docs, labels, held_out=held_out())
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value.astype(np.float64)
        for whole in batches:
            for part in core.slices(whole):
                score = scores(w, part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    scored = core.texts(docs).mapInArrow(run, "doc_id long, score double, predicted int")
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """The rows of docs whose text scores `threshold` or more, as they are."""
    weights = fit(docs, labels, held_out=held_out())
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value.astype(np.float64)
        for whole in batches:
            for part in core.slices(whole, text):
                yield part.filter(pa.array(scores(w, part.column(text).cast(pa.string())) >= threshold))

    return docs.mapInArrow(core.releasing(run), docs.schema)
