"""A quality classifier: a factorisation machine over hashed words, structure and metadata."""

from __future__ import annotations

from collections.abc import Iterator
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import batches, labelled_sample, read_table, remainder, spaced_words, texts

#: Slots for hashed words, rank of the interactions, labelled rows at most fitted on, and passes over them.
SLOTS, RANK, SAMPLE, PASSES = 1 << 14, 8, 6000, 12
FOLDS, HELD = 3, 1
STRUCTURE = ("length", "words", "word_length", "upper", "digits", "symbols", "line_length", "distinct_words", "distinct_lines",
             "distinct_pairs", "ends_of_sentences", "declared_length")
_CLASSES = np.zeros(256, dtype=np.int64)
_CLASSES[[*range(0x41, 0x5B)]], _CLASSES[[*range(0x30, 0x3A)]] = 1, 2
_CLASSES[[b for b in range(0x21, 0x80) if not chr(b).isalnum() and chr(b) not in ",.'"]] = 3


class Slots(dict):
    """Slot of each word, kept for words seen before; emptied when it has grown large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 400_000:
            self.clear()
        self[word] = slot = zlib.crc32(word) % SLOTS
        return slot


def features(text: bytes, n_chars: int | None, slots: Slots) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of a document: words weigh by their share, structure in fixed ranges near 0 to 1."""
    words, lines = spaced_words(text), [line for line in text.split(b"\n") if line.strip()]
    n, size = max(len(words), 1), max(len(text), 1)
    kinds = np.bincount(_CLASSES[np.frombuffer(text, dtype=np.uint8)], minlength=4) / size
    places = np.fromiter(map(slots.__getitem__, words), dtype=np.int64, count=len(words))
    used, counts = np.unique(places, return_counts=True)
    pairs = places[:-1] * SLOTS + places[1:]
    structure = np.array([
        np.log1p(len(text)) / 12, np.log1p(len(words)) / 10, min(sum(map(len, words)) / n / 16, 2.0), kinds[1], kinds[2], kinds[3],
        np.log1p(size / max(len(lines), 1)) / 10, len(used) / n, len(set(lines)) / max(len(lines), 1),
        len(np.unique(pairs)) / max(len(pairs), 1), min(text.count(b". ") * 10 / n, 2.0),
        0.0 if n_chars is None else np.log1p(max(n_chars, 0)) / 12])
    norm = np.sqrt(float((counts * counts).sum())) or 1.0
    return np.concatenate([used, SLOTS + np.arange(len(STRUCTURE))]), np.concatenate([counts / norm, structure])


class FactorisationMachine:
    """score = bias + sum w x + half the sum over factors of (sum v x)^2 - sum (v x)^2."""

    def __init__(self, size: int, rank: int = RANK, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.bias, self.weights = 0.0, np.zeros(size)
        self.factors = rng.normal(0, 0.03, (size, rank))

    def raw(self, at: np.ndarray, x: np.ndarray) -> tuple[float, np.ndarray]:
        vx = self.factors[at] * x[:, None]
        sums = vx.sum(axis=0)
        return float(self.bias + self.weights[at] @ x + 0.5 * (sums @ sums - (vx * vx).sum())), sums

    def score(self, at: np.ndarray, x: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.raw(at, x)[0], -30, 30))))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, passes: int = PASSES, rate: float = 0.1,
            decay: float = 1e-5, seed: int = 7) -> FactorisationMachine:
        """AdaGrad over rows in a fixed shuffled order; the two classes weigh the same."""
        rng = np.random.default_rng(seed)
        share = min(max(labels.mean(), 1e-3), 1 - 1e-3)
        squares_w, squares_v, square_b = np.full(len(self.weights), 1e-2), np.full(self.factors.shape, 1e-2), 1e-2
        for _ in range(passes):
            for i in rng.permutation(len(rows)):
                at, x = rows[i]
                z, sums = self.raw(at, x)
                slope = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[i]) * (0.5 / share if labels[i] else 0.5 / (1 - share))
                v = self.factors[at]
                g_w = slope * x + decay * self.weights[at]
                g_v = slope * (x[:, None] * sums - v * (x * x)[:, None]) + decay * v
                squares_w[at] += g_w * g_w
                squares_v[at] += g_v * g_v
                square_b += slope * slope
                self.weights[at] -= rate * g_w / np.sqrt(squares_w[at])
                self.factors[at] -= 0.3 * rate * g_v / np.sqrt(squares_v[at])
                self.bias -= rate * slope / np.sqrt(square_b)
        return self


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> FactorisationMachine:
    """Fit on documents (doc_id, text, n_chars) with labels (doc_id, label), on ``sample`` of them at most."""
    chosen = texts(labelled_sample(docs, labels, sample, "quality"), "doc_id", "n_chars", "label")
    schema = pa.schema([("at", pa.list_(pa.int64())), ("x", pa.list_(pa.float64())), ("label", pa.int32())])

    def extract(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = Slots()
        for batch in stream:
            rows = zip(*(batch.column(c).to_pylist() for c in ("text", "n_chars", "label")))
            yield from batches(((*(a.tolist() for a in features(t, n, slots)), y) for t, n, y in rows), schema, 256)

    found = sorted(chosen.mapInArrow(extract, "at array<long>, x array<double>, label int").collect())
    machine = FactorisationMachine(SLOTS + len(STRUCTURE))
    if not found:
        return machine
    return machine.fit([(np.array(r["at"]), np.array(r["x"])) for r in found], np.array([float(r["label"]) for r in found]))


def score(docs: DataFrame, machine: FactorisationMachine) -> DataFrame:
    """(doc_id, score) of every whole text.

    NULL counts as empty; empty texts get the score of their structure, and NULL n_chars adds nothing. With nothing
    to learn from, scores are those of the first random factors, near 0.5. Other columns are ignored.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = Slots()
        for batch in stream:
            rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2))
            yield from batches(((d, machine.score(*features(t.as_py(), n, slots))) for d, n, t in rows), schema)

    return texts(docs, "doc_id", F.col("n_chars").cast("long").alias("n_chars")).mapInArrow(run, "doc_id long, score double")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    labels = read_table(spark, sf_dir, "labels").where(remainder("doc_id", FOLDS) != HELD)
    scored = score(docs, train(docs, labels.select("doc_id", F.col("quality").alias("label"))))
    return scored.select("doc_id", (remainder("doc_id", FOLDS) == HELD).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
