"""Language identification by rank-order n-gram profiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
import regex

from spanloom.llm.common import batches, read_table, remainder, texts

#: n-grams of one to so many letters inside blank-padded words; n-grams in a profile.
LONGEST, PROFILE = 3, 300
FOLDS, UNKNOWN = 5, "und"
#: Counts a training task holds before it passes them on; n-grams that wait to be counted; letters looked at in one go.
HELD_COUNTS, WAITING, SLICE = 200_000, 1_000_000, 250_000
_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
_BITS = 21


def grams(text: str, slice_size: int = SLICE) -> Iterator[np.ndarray]:
    """Every n-gram of the text's words as a number, slice by slice: 21 bits a character, padded words, no lone blank.

    A word is a letter and the letters and marks after it. A slice holds the n-grams that begin in it.
    """
    words = _WORD.findall(text.lower())
    if not words:
        return
    line = np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le"), dtype=np.uint32)
    for begin in range(0, len(line), slice_size):
        yield _grams(line[begin:begin + slice_size + LONGEST - 1].astype(np.int64), min(slice_size, len(line) - begin))


def _grams(points: np.ndarray, begins: int) -> np.ndarray:
    """The n-grams that begin at one of the first ``begins`` points."""
    blank = points == 0x20
    found = [points[:begins][~blank[:begins]]]
    for n in range(2, LONGEST + 1):
        size = max(min(len(points) - n + 1, begins), 0)
        key = points[:size].copy()
        inside = np.ones(size, dtype=bool)
        for k in range(1, n):
            key |= points[k:k + size] << (_BITS * k)
            if k < n - 1:
                inside &= ~blank[k:k + size]
        if n == 2:
            inside &= ~(blank[:size] & blank[1:1 + size])
        found.append(key[inside])
    return np.concatenate(found)


class Counts:
    """Occurrences of numbers, added up whenever many wait."""

    def __init__(self, waiting: int = WAITING):
        self.limit, self.parts, self.size = waiting, [], 0
        self.keys, self.counts = np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, keys: np.ndarray) -> None:
        self.parts.append(keys)
        self.size += len(keys)
        if self.size >= self.limit:
            self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray]:
        if self.parts:
            keys, counts = np.unique(np.concatenate(self.parts), return_counts=True)
            self.parts, self.size = [], 0
            if len(self.keys):
                merged, place = np.unique(np.concatenate([self.keys, keys]), return_inverse=True)
                counts = np.bincount(place, np.concatenate([self.counts, counts])).astype(np.int64)
                keys = merged
            self.keys, self.counts = keys, counts
        return self.keys, self.counts


def ranked(text: str, size: int = PROFILE) -> np.ndarray:
    """The most frequent n-grams of the whole text, by falling count, then by number."""
    seen = Counts()
    for some in grams(text):
        seen.add(some)
    keys, counts = seen.settle()
    if len(keys) > size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        keys, counts = keys[counts >= least], counts[counts >= least]
    return keys[np.lexsort((keys, -counts))[:size]]


def train_profiles(labelled: DataFrame, size: int = PROFILE) -> dict[str, np.ndarray]:
    """Profiles from all rows (lang, text): counts are summed by Spark, and ``size`` n-grams a language come back."""
    schema = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])

    def count(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counts] = {}

        def passed_on() -> Iterator[pa.RecordBatch]:
            for lang, seen in held.items():
                yield from batches(((lang, int(k), int(c)) for k, c in zip(*seen.settle())), schema)
            held.clear()

        for batch in stream:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                seen = held.setdefault(lang, Counts(WAITING // 4))
                for some in grams(text.as_py().decode()):
                    seen.add(some)
                if sum(len(s.keys) for s in held.values()) > HELD_COUNTS or sum(s.size for s in held.values()) > WAITING:
                    yield from passed_on()
        yield from passed_on()

    counts = texts(labelled.where(F.col("lang").isNotNull()), "lang").mapInArrow(count, "lang string, gram long, n long")
    totals = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram")
    best = totals.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size).collect()
    profiles: dict[str, list] = {}
    for row in sorted(best, key=lambda r: (r["lang"], r["rank"])):
        profiles.setdefault(row["lang"], []).append(row["gram"])
    return {lang: np.array(keys, dtype=np.int64) for lang, keys in profiles.items()}


class Ranks:
    """Out-of-place distances of a document's ranking to all profiles at once."""

    def __init__(self, profiles: dict[str, np.ndarray], size: int = PROFILE):
        self.langs, self.size = sorted(profiles), size
        self.keys = np.unique(np.concatenate([np.empty(0, np.int64), *profiles.values()]))
        self.places = np.full((len(self.langs), len(self.keys) + 1), -1, dtype=np.int64)
        for i, lang in enumerate(self.langs):
            self.places[i, np.searchsorted(self.keys, profiles[lang])] = np.arange(len(profiles[lang]))

    def predict(self, text: str) -> tuple[str, float]:
        order = ranked(text, self.size)
        if not len(order) or not self.langs:
            return UNKNOWN, 0.0
        at = np.searchsorted(self.keys, order)
        known = (at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] == order)
        place = self.places[:, np.where(known, at, len(self.keys))]
        out = np.where(place >= 0, np.abs(place - np.arange(len(order))), self.size).sum(axis=1) / (self.size * len(order))
        best = int(np.argmin(out))
        return self.langs[best], float(1.0 - out[best])


def identify(docs: DataFrame, profiles: dict[str, np.ndarray]) -> DataFrame:
    """(doc_id, lang_pred, score) of every document; score is 1 less the mean share of places a rank is out.

    NULL texts, and texts without a letter (numerals and marks alone are none), are ``und`` with score 0; so is everything
    where nothing could be learned. Equal distances go to the language that sorts first. Repeated rows are separate, and a
    NULL doc_id stays. A long text is counted in slices. Other columns are ignored.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])
    ranks = Ranks(profiles)

    def predict(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            rows = zip(batch.column(0).to_pylist(), batch.column(1))
            yield from batches(((doc_id, *ranks.predict(text.as_py().decode())) for doc_id, text in rows), schema)

    return texts(docs, "doc_id").mapInArrow(predict, "doc_id long, lang_pred string, score double")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    profiles = train_profiles(docs.where(remainder("doc_id", FOLDS) != 0).select("lang", "text"))
    return identify(docs, profiles).select("doc_id", (remainder("doc_id", FOLDS) == 0).alias("held_out"), "lang_pred", "score")
