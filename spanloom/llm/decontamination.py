"""Benchmark decontamination by a generalised suffix automaton of the test items."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.llm.common import alnum_words, lean, read_table, texts, without

#: Words of a window, and words of test items one automaton takes; more items go into further automata.
WINDOW, BLOCK_WORDS = 10, 400_000
#: A document loses its hit passages; past this share of hit words it goes as a whole.
COVERAGE = 0.8
#: Columns that ``marked`` adds.
MARKS = ("__n_words", "__spans", "__items")
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


class ItemAutomaton:
    """All word sequences inside the items, as one automaton; states know the items their sequences occur in."""

    def __init__(self, items: Sequence[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window, self.names = window, [name for name, _ in items]
        self.vocabulary: dict[bytes, int] = {}
        self.moves: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: dict[int, set[int]] = {}
        whole: list[tuple[int, int, int]] = []
        for i, (_, words) in enumerate(items):
            state = 0
            for word in words:
                state = self._extend(state, self.vocabulary.setdefault(word, len(self.vocabulary)))
        for i, (_, words) in enumerate(items):
            state = 0
            for word in words:
                state = self.moves[state][self.vocabulary[word]]
                ends.setdefault(state, set()).add(i)
            if 0 < len(words) < window:
                whole.append((state, len(words), i))
        self._mark(ends, whole)

    def _extend(self, last: int, c: int) -> int:
        if c in self.moves[last]:
            q = self.moves[last][c]
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, c, q)
        new = self._state(self.length[last] + 1, {})
        p = last
        while p >= 0 and c not in self.moves[p]:
            self.moves[p][c] = new
            p = self.link[p]
        if p < 0:
            self.link[new] = 0
        else:
            q = self.moves[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, c, q)
        return new

    def _state(self, length: int, moves: dict[int, int]) -> int:
        self.moves.append(moves)
        self.length.append(length)
        self.link.append(0)
        return len(self.moves) - 1

    def _clone(self, p: int, c: int, q: int) -> int:
        copy = self._state(self.length[p] + 1, dict(self.moves[q]))
        self.link[copy], self.link[q] = self.link[q], copy
        while p >= 0 and self.moves[p].get(c) == q:
            self.moves[p][c] = copy
            p = self.link[p]
        return copy

    def _mark(self, ends: dict[int, set[int]], whole: list[tuple[int, int, int]]) -> None:
        """Per state: the items of its last ``window`` words, and the short items that may end there."""
        order = sorted(range(1, len(self.link)), key=self.length.__getitem__)
        shorts: dict[int, list[tuple[int, int]]] = {}
        for state, n, i in whole:
            shorts.setdefault(state, []).append((n, i))
        holder = [0] * len(self.link)
        self.short: dict[int, list[tuple[int, int]]] = {}
        for s in order:
            up = self.link[s]
            holder[s] = (s if self.length[up] < self.window else holder[up]) if self.length[s] >= self.window else 0
            if near := [*self.short.get(up, ()), *shorts.get(s, ())]:
                self.short[s] = near
        self.items: dict[int, set[int]] = {}
        for state, names in ends.items():
            s = state
            if holder[s]:
                self.items.setdefault(holder[s], set()).update(names)
        self.holder = holder

    def scan(self, words: list[bytes]) -> tuple[list[list[int]], set[int]]:
        """Passages [start, end) of words inside windows that occur, and the items they are from."""
        spans: list[list[int]] = []
        items: set[int] = set()
        state = length = 0
        moves, link, lengths, known, window, short = self.moves, self.link, self.length, self.vocabulary.get, self.window, self.short
        for at, word in enumerate(words):
            c = known(word)
            if c is None:
                state = length = 0
                continue
            while state and c not in moves[state]:
                state = link[state]
                length = lengths[state]
            if c not in moves[state]:
                continue
            state = moves[state][c]
            length += 1
            start = at + 1
            if length >= window:
                start = at + 1 - window
                items |= self.items[self.holder[state]]
            if state in short:
                for n, i in short[state]:
                    if n <= length:
                        start = min(start, at + 1 - n)
                        items.add(i)
            if start <= at:
                while spans and spans[-1][0] >= start:
                    spans.pop()
                if spans and spans[-1][1] >= start:
                    spans[-1][1] = at + 1
                else:
                    spans.append([start, at + 1])
        return spans, items


def item_blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Items with words, in blocks of bounded size; the driver holds one partition and one block at a time."""
    block, size = [], 0
    for item_id, text in texts(benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text"), "item_id").toLocalIterator():
        if words := alnum_words(bytes(text)):
            block.append((item_id, words))
            size += len(words)
        if size >= block_words:
            yield block
            block, size = [], 0
    yield block


def marked(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS,
           then: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] | None = None) -> DataFrame:
    """The columns of ``docs``, and __n_words, __spans (hit passages, [start, end) in words) and __items (their ids).

    Each block of items becomes an automaton sent to the tasks; whole documents stream through it. Further blocks
    mark the same rows again, so no row is shuffled. ``then`` takes the marked batches in the worker of the last block:
    a step of its own would have each task hold one more worker, which stays beside later tasks.
    """
    docs = without(docs, *MARKS)
    out = T.StructType([*docs.schema.fields, T.StructField("__n_words", T.LongType()),
                        T.StructField("__spans", T.ArrayType(T.ArrayType(T.LongType()))), T.StructField("__items", T.ArrayType(T.StringType()))])
    names = out.names
    types = (pa.int64(), pa.list_(pa.list_(pa.int64())), pa.list_(pa.string()))
    at, width = docs.columns.index("text"), len(docs.columns)

    def through(automaton: ItemAutomaton):
        def scan(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in stream:
                counts, spans, items = [], [], []
                for text in batch.column(at):
                    words = alnum_words((text.as_py() or "").encode())
                    found, hits = automaton.scan(words)
                    counts.append(len(words))
                    spans.append(found)
                    items.append(sorted({name for i in hits if (name := automaton.names[i]) is not None}))
                columns = batch.columns
                if batch.num_columns > width:
                    columns, (_, before, named) = columns[:-3], (c.to_pylist() for c in columns[-3:])
                    spans = [union_of([*a, *b]) for a, b in zip(before, spans)]
                    items = [sorted({*a, *b}) for a, b in zip(named, items)]
                new = [pa.array(x, t) for x, t in zip((counts, spans, items), types)]
                yield pa.RecordBatch.from_arrays([*columns, *new], names=names)
        return scan

    def followed(scan, step):
        return lambda stream: step(scan(stream))

    scans = [through(ItemAutomaton(block, window)) for block in item_blocks(benchmark, block_words)]
    if then is not None:
        scans[-1] = followed(scans[-1], then)
    found = docs
    for scan in scans:
        found = found.mapInArrow(lean(scan), out)
    return found


def union_of(spans: list[list[int]]) -> list[list[int]]:
    """The same words as passages that neither overlap nor touch."""
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Hit words and items of each document.

    A word is hit inside any occurrence of a window: ``window`` consecutive words of an item, or a whole item that is
    shorter. NULL and empty texts have no words and are clean; so is every document where no item has words. Items
    repeated under one id count once; an item without id marks words but is not listed. One row per input row; other
    columns are ignored.
    """
    found = marked(docs.select("doc_id", "text"), benchmark, window, block_words)
    hit = F.aggregate("__spans", F.lit(0).cast("long"), lambda total, s: total + s[1] - s[0])
    return found.select(
        "doc_id", F.col("__n_words").alias("n_words"), hit.alias("n_hit"), F.size("__items").cast("long").alias("n_items"),
        F.sha2(F.array_join("__items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def cut(text: str, spans: list[list[int]]) -> str:
    """The text without the words of the passages and what stands between them."""
    raw, pieces, end = text.encode(), [], 0
    places = [m.span() for m in _WORD.finditer(raw.lower())]
    for first, after in spans:
        pieces.append(raw[end:places[first][0]])
        end = places[after - 1][1]
    return b"".join([*pieces, raw[end:]]).decode()


def cleaned(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = COVERAGE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` without passages of the benchmark: hit words are cut out of the text, and n_chars follows.

    A document with more than ``coverage`` of its words hit goes as a whole. Clean documents, NULL and empty texts
    among them, are left as they are. The columns stay those of ``docs``; an empty table stays empty.
    """
    names, kinds = docs.columns, {f.name: f.dataType for f in docs.schema.fields}
    at = without(docs, *MARKS).columns.index("text")

    def rewrite(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            n_words, spans, _ = (c.to_pylist() for c in batch.columns[-len(MARKS):])
            stays = [sum(end - start for start, end in s) <= coverage * n for n, s in zip(n_words, spans)]
            columns = batch.columns
            columns[at] = pa.array([cut(t, s) if s and ok else t for t, s, ok in zip(columns[at].to_pylist(), spans, stays)], pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names).filter(pa.array(stays, pa.bool_()))

    done = marked(docs, benchmark, window, block_words, rewrite)
    if "n_chars" in names:
        done = done.withColumn("n_chars", F.when(F.size("__spans") > 0, F.length("text").cast(kinds["n_chars"])).otherwise(F.col("n_chars")))
    return done.select(*[F.col(f"`{c}`") for c in names])


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM windows),
grams AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lengths WHERE len(w) >= n)),
found AS (SELECT doc_id, i, n, item_id FROM grams JOIN windows USING (n, g)),
hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM found)) GROUP BY doc_id),
items AS (
  SELECT doc_id, list_sort(list(DISTINCT item_id::VARCHAR)) AS x FROM found GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(x), 0)::BIGINT AS n_items,
  sha256(coalesce(array_to_string(x, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""
