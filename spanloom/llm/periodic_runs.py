"""Runs of repeated word sequences, found in a grammar of the text.

The words' numbers are compressed by Re-Pair. A run that stands in the text stands whole in one symbol of the derivation
and crosses the boundary between that symbol's two halves, so each nonterminal is searched at its boundary once, however
often it occurs; what is found is moved to all its positions, and pieces of one run are merged.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
import hashlib
from itertools import compress, groupby
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import batches, read_table, texts

#: Fixed values of the contract: a run has so many words, and so many periods, at least.
SHORTEST, TIMES = 24, 3


class Grammar:
    """Re-Pair over several sequences at once: rules symbol -> (left, right), and each sequence as symbols.

    Symbols below ``terminals`` are words. In each round every pair that occurs twice or more is weighed by its number
    of occurrences; an occurrence becomes a nonterminal where it outweighs the pairs it overlaps, so the most frequent
    pair is always replaced, and others beside it in the same pass.
    """

    def __init__(self, numbers: np.ndarray, terminals: int):
        """``numbers``: words, sequences being parted by negative numbers that are all different."""
        self.terminals = terminals
        self.left, self.right, self.sizes = np.empty(0, np.int64), np.empty(0, np.int64), np.ones(terminals, np.int64)
        line = numbers
        while len(line) > 1:
            line, replaced = self._round(line)
            if not replaced:
                break
        self.line = line

    def _round(self, line: np.ndarray) -> tuple[np.ndarray, bool]:
        first, second = line[:-1], line[1:]
        codes = np.where((first >= 0) & (second >= 0), first << 32 | second, -1)
        kinds, place, counts = np.unique(codes, return_inverse=True, return_counts=True)
        counts[kinds < 0] = 0
        if counts.max(initial=0) < 2:
            return line, False
        # A smaller weight wins: more occurrences first, ties in an order without a pattern along the line.
        mixed = kinds.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        weight = np.empty(len(kinds), np.int64)
        weight[np.lexsort((mixed ^ mixed >> np.uint64(29), -counts))] = np.arange(len(kinds))
        weight[counts < 2] = len(kinds)
        weights = weight[place]
        able = weights < len(kinds)
        # In a stretch of one symbol every second pair is taken; each overlaps only pairs of its own kind.
        same = np.concatenate(([False], codes[1:] == codes[:-1]))
        begins = np.maximum.accumulate(np.where(same, 0, np.arange(len(codes))))
        odd = (np.arange(len(codes)) - begins) % 2 == 1
        before, after = np.full(len(weights), len(kinds)), np.full(len(weights), len(kinds))
        before[1:], after[:-1] = weights[:-1], weights[1:]
        take = able & ~odd & (weights <= before) & (weights <= after)
        if not take.any():
            return line, False
        at = np.flatnonzero(take)
        used, number = np.unique(place[at], return_inverse=True)
        out = line.copy()
        out[at] = self.terminals + len(self.left) + number
        left, right = kinds[used] >> 32, kinds[used] & 0xFFFFFFFF
        self.sizes = np.concatenate((self.sizes, self.sizes[left] + self.sizes[right]))
        self.left, self.right = np.concatenate((self.left, left)), np.concatenate((self.right, right))
        keep = np.ones(len(line), bool)
        keep[at + 1] = False
        return out[keep], True


class Names:
    """Equal stretches of 2**k words have equal names; so common extensions take a step per power, exactly."""

    def __init__(self, numbers: np.ndarray):
        self.levels = [numbers - numbers.min(initial=0)]
        size = 1
        while 2 * size <= len(numbers):
            last = self.levels[-1]
            self.levels.append(np.unique(last[:-size] * (last.max() + 1) + last[size:], return_inverse=True)[1])
            size *= 2

    def forward(self, a: np.ndarray, b: np.ndarray, end: int) -> np.ndarray:
        """How many words from ``a`` on equal those from ``b`` on (a < b), before ``end``."""
        a, b, out = a.copy(), b.copy(), np.zeros(len(a), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            size, names = 1 << k, self.levels[k]
            able = np.flatnonzero(b + size <= end)
            able = able[names[a[able]] == names[b[able]]]
            for part in (a, b, out):
                part[able] += size
        return out

    def backward(self, a: np.ndarray, b: np.ndarray, begin: int) -> np.ndarray:
        """How many words before ``a`` equal those before ``b`` (a < b), from ``begin`` on."""
        a, b, out = a.copy(), b.copy(), np.zeros(len(a), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            size, names = 1 << k, self.levels[k]
            able = np.flatnonzero(a - size >= begin)
            able = able[names[a[able] - size] == names[b[able] - size]]
            a[able] -= size
            b[able] -= size
            out[able] += size
        return out


def crossing(numbers: np.ndarray, names: Names, begin: int, middle: int, end: int, shortest: int, times: int) -> list[tuple[int, int, int]]:
    """(begin, end, period) of the runs inside [begin, end) that hold the words on both sides of ``middle``."""
    # Of a run's two parts the longer has more than a period: there the boundary's two words come again, a period on or back.
    most = (end - begin) // times
    a, b = numbers[middle - 1], numbers[middle]
    right = numbers[middle:min(middle + most + 1, end)]
    later = np.flatnonzero((right[:-1] == a) & (right[1:] == b)) + 1
    left = numbers[max(middle - most - 1, begin):middle]
    sooner = len(left) - 1 - np.flatnonzero((left[:-1] == a) & (left[1:] == b))
    periods = np.union1d(later, sooner)
    periods = periods[(periods >= 1) & (periods <= most)]
    found = {}
    for forth in (True, False):
        some = periods[middle + periods <= end] if forth else periods[middle - periods >= begin]
        at = np.full(len(some), middle) if forth else middle - some
        ahead = names.forward(at, at + some, end)
        back = names.backward(at, at + some, begin)
        starts, ends = at - back, at + some + ahead
        good = (ends - starts >= np.maximum(shortest, times * some)) & (starts < middle) & (ends > middle)
        for start, stop, period in zip(starts[good].tolist(), ends[good].tolist(), some[good].tolist()):
            found[start, stop] = min(period, found.get((start, stop), period))
    return [(start, stop, period) for (start, stop), period in found.items()]


def runs(numbers: np.ndarray, shortest: int = SHORTEST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of word numbers 0, 1, ..., by start, then period.

    A run is a longest stretch with smallest period q and at least ``shortest`` words and ``times`` periods; ``times``
    is 3 or more.
    """
    parts = _repetitive(numbers, shortest, times)
    if not parts:
        return []
    pieces, starts, at = [], [], 0
    for k, (low, high) in enumerate(parts):
        pieces += [numbers[low:high], np.array([-1 - k])]
        starts.append((at, low))
        at += high - low + 1
    line = np.concatenate(pieces).astype(np.int64)
    found = _runs_of_line(line, int(numbers.max()) + 1, shortest, times)
    offsets = np.array([a for a, _ in starts])
    out = []
    for start, stop, period in found:
        a, low = starts[int(np.searchsorted(offsets, start, "right")) - 1]
        out.append((start - a + low, stop - start, period))
    return sorted(out, key=lambda r: (r[0], r[2]))


def _repetitive(numbers: np.ndarray, shortest: int, times: int) -> list[tuple[int, int]]:
    """Stretches [low, high) outside which no run can be: in a run every word occurs ``times`` times, every pair once less."""
    if len(numbers) < shortest:
        return []
    frequent = np.bincount(numbers)[numbers] >= times
    _, place, counts = np.unique(numbers[:-1] * (int(numbers.max()) + 1) + numbers[1:], return_inverse=True, return_counts=True)
    linked = (counts[place] >= times - 1) & frequent[:-1] & frequent[1:]
    edges = np.flatnonzero(np.diff(np.concatenate(([False], linked, [False])).astype(np.int8)))
    return [(low, high + 1) for low, high in zip(edges[::2].tolist(), edges[1::2].tolist()) if high + 1 - low >= shortest]


def _runs_of_line(line: np.ndarray, terminals: int, shortest: int, times: int) -> list[tuple[int, int, int]]:
    grammar, names = Grammar(line, terminals), Names(line)
    sizes, top = grammar.sizes, grammar.line
    found: list[tuple[int, int, int]] = []
    # The symbols left over: halves of halves, each boundary searched where it stands.
    lengths = np.where(top >= 0, sizes[np.maximum(top, 0)], 1)
    begins = np.concatenate(([0], np.cumsum(lengths)))
    cuts = np.flatnonzero(top < 0)
    waiting = [(int(a), int(b)) for a, b in zip(np.concatenate(([0], cuts + 1)), np.concatenate((cuts, [len(top)])))]
    while waiting:
        a, b = waiting.pop()
        if b - a < 2 or begins[b] - begins[a] < shortest:
            continue
        middle = (a + b) // 2
        found += crossing(line, names, int(begins[a]), int(begins[middle]), int(begins[b]), shortest, times)
        waiting += [(a, middle), (middle, b)]
    # Where each nonterminal occurs, from the last rule to the first: a rule's parts occur where it does.
    places: dict[int, list[np.ndarray]] = {}
    for symbol in np.unique(top[top >= terminals]).tolist():
        if sizes[symbol] >= shortest:
            places[symbol] = [begins[:-1][top == symbol]]
    for symbol in range(len(sizes) - 1, terminals - 1, -1):
        if symbol not in places:
            continue
        at = np.concatenate(places.pop(symbol))
        left, right = int(grammar.left[symbol - terminals]), int(grammar.right[symbol - terminals])
        for part, skip in ((left, 0), (right, int(sizes[left]))):
            if part >= terminals and sizes[part] >= shortest:
                places.setdefault(part, []).append(at + skip)
        begin = int(at[0])
        for start, stop, period in crossing(line, names, begin, begin + int(sizes[left]), begin + int(sizes[symbol]), shortest, times):
            found += [(start - begin + x, stop - begin + x, period) for x in at.tolist()]
    return _merged(found)


def _merged(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Longest intervals: those of one period that share a period's length are one run."""
    whole: dict[tuple[int, int], int] = {}
    for period, same in groupby(sorted(set(found), key=lambda r: (r[2], r[0], r[1])), key=lambda r: r[2]):
        start = stop = None
        for a, b, _ in same:
            if stop is not None and a <= stop - period:
                stop = max(stop, b)
                continue
            if stop is not None:
                whole[start, stop] = min(period, whole.get((start, stop), period))
            start, stop = a, b
        whole[start, stop] = min(period, whole.get((start, stop), period))
    return [(a, b, period) for (a, b), period in whole.items()]


def numbered_words(words: list[bytes]) -> np.ndarray:
    """A number for each distinct word, from 0."""
    seen: dict[bytes, int] = {}
    return np.array([seen.setdefault(w, len(seen)) for w in words], dtype=np.int64)


def text_runs(words: list[bytes], shortest: int = SHORTEST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """The runs of a text. Texts where no stretch of ``shortest`` words is made of words that occur often enough have none."""
    counts = Counter(words)
    if max(counts.values(), default=0) < times:
        return []
    frequent = {w for w, n in counts.items() if n >= times}
    if b"\1" * shortest not in bytes(map(frequent.__contains__, words)):
        return []
    return runs(numbered_words(words), shortest, times)


def kept_words(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """The words outside every run's repetitions; the first period of a run stays, if no other run drops it."""
    if not found:
        return words
    edges = np.zeros(len(words) + 1, np.int64)
    for start, length, period in found:
        edges[start + period] += 1
        edges[start + length] -= 1
    return list(compress(words, (np.cumsum(edges[:-1]) == 0).tolist()))


def with_planted_run(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The contract's words: in one document of ten, by its id's crc32, the words from a place on repeat with a period."""
    if doc_id is None or not words:
        return words
    h, n = zlib.crc32(b"%d" % doc_id), len(words)
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    period = words[a:a + p]
    return words[:a] + (period * ((n - a) // p + 1))[:n - a]


_SPAN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def periodic_runs(docs: DataFrame, words_of=None, shortest: int = SHORTEST, times: int = TIMES) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every row: all runs by start, then period, and the text with each run once.

    ``words_of`` (words, doc_id) may replace the words of a text before they are searched. NULL and empty texts have no
    words and no runs. Rows with equal doc_ids are separate; a NULL doc_id stays. Words are parted by ASCII white space;
    ``collapsed`` joins those kept with single blanks. An empty table gives an empty result. Other columns are ignored.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(_SPAN)), ("collapsed", pa.binary())])

    def rows(batch: pa.RecordBatch) -> Iterator[tuple]:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            words = text.as_py().split()
            if words_of is not None:
                words = words_of(words, doc_id)
            found = text_runs(words, shortest, times)
            yield doc_id, len(words), [dict(zip(("start", "length", "period"), r)) for r in found], b" ".join(kept_words(words, found))

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            yield from batches(rows(batch), schema, 256)

    return texts(docs, "doc_id").mapInArrow(run, "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed binary")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(read_table(spark, sf_dir, "documents"), with_planted_run)
    # Falling length / period, compared without fractions; then start, then period.
    best = F.array_sort("runs", lambda a, b: F.coalesce(
        F.nullif(F.sign(b["length"] * a["period"] - a["length"] * b["period"]), F.lit(0.0)),
        F.nullif(F.sign(a["start"] - b["start"]), F.lit(0.0)), F.sign(a["period"] - b["period"])).cast("int"))
    found = found.withColumn("best", F.get(best, 0))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
                        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
                        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
