"""License notices: exact phrases, and fuzzy short notices found by pigeonhole seeds and bounded-error matching."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
import regex

from spanloom.llm.common import alnum_words, batches, read_table, texts

#: Phrases whose words stand consecutively, and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Short notices searched for with so many edits (insertions, deletions, substitutions) at most, and their labels.
NOTICES = {
    "gnu general public license": (3, "gpl"),
    "gnu lesser general public license": (3, "lgpl"),
    "apache license": (1, "apache"),
    "mit license": (1, "mit"),
    "bsd license": (1, "bsd"),
    "mozilla public license": (2, "mpl"),
    "eclipse public license": (2, "epl"),
    "creative commons attribution": (3, "cc-by"),
    "redistribution and use in source and binary forms": (5, "bsd"),
    "permission is hereby granted free of charge to any person obtaining a copy": (7, "mit"),
    "this is free and unencumbered software released into the public domain": (7, "unlicense"),
    "all rights reserved": (2, "proprietary"),
}


def pieces(notice: str, edits: int) -> list[tuple[int, bytes]]:
    """``edits`` + 1 pieces: with no more edits than that, one of them stands unchanged (offset, piece)."""
    cuts = [round(i * len(notice) / (edits + 1)) for i in range(edits + 2)]
    return [(a, notice[a:b].encode()) for a, b in zip(cuts, cuts[1:])]


class NoticeSearch:
    """Matches in the words of a text, joined by single blanks; spans are [first word, word after the last)."""

    def __init__(self, phrases: dict[str, str] = PHRASES, notices: dict[str, tuple[int, str]] = NOTICES):
        self.phrases = [(f" {p} ".encode(), label) for p, label in phrases.items()]
        self.notices = [(n, edits, label, pieces(n, edits), regex.compile(f"(?<= )(?:{regex.escape(n)}){{e<={edits}}}(?= )", regex.BESTMATCH))
                        for n, (edits, label) in notices.items()]

    def exact(self, line: bytes) -> list[tuple[int, str]]:
        """(byte place, label) of every phrase in the line, which has a blank at both ends."""
        found = []
        for phrase, label in self.phrases:
            at = line.find(phrase)
            while at >= 0:
                found.append((at, label))
                at = line.find(phrase, at + 1)
        return found

    def fuzzy(self, line: bytes) -> list[tuple[int, int, int, str, float]]:
        """(first byte, byte after the last, edits, label, likeness) of matches, verified around each seed."""
        found = []
        for notice, edits, label, parts, pattern in self.notices:
            looked: list[tuple[int, int]] = []
            for offset, piece in parts:
                at = line.find(piece)
                while at >= 0:
                    looked.append((max(at - offset - edits, 0), at - offset + len(notice) + edits))
                    at = line.find(piece, at + 1)
            done = -1
            for low, high in sorted(looked):
                # The blanks around a match are looked at too. The next notice may begin within the margin after the last match.
                low, high = max(low - 1, done, 0), high + 1
                if high - low < len(notice) - edits + 2:
                    continue
                m = pattern.search(line[low:high].decode("latin-1"))
                if m and m.end() > m.start():
                    errors = sum(m.fuzzy_counts)
                    found.append((low + m.start(), low + m.end(), errors, label, 1 - errors / len(notice)))
                    done = low + m.end()
        return found

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, str]], list[tuple[int, int, int, str, float]]]:
        """(words, exact places by word, fuzzy spans by word) of a whole text."""
        words = alnum_words(text)
        line = b" %b " % b" ".join(words)
        exact, fuzzy = self.exact(line), self.fuzzy(line)
        if not exact and not fuzzy:
            return len(words), [], []
        starts = np.cumsum([1, *(len(w) + 1 for w in words)])[:-1].tolist()
        places = sorted((bisect_right(starts, at + 1) - 1, label) for at, label in exact)
        spans = sorted((max(bisect_right(starts, a) - 1, 0), bisect_right(starts, b - 1), e, label, likeness) for a, b, e, label, likeness in fuzzy)
        return len(words), places, spans


def scan_licenses(docs: DataFrame, search: NoticeSearch | None = None) -> DataFrame:
    """License mentions of whole texts, one row per input row.

    n_base, first_word, last_word and base_labels come from exact phrases; labels adds those of notices matched with
    a bounded number of edits. ``spans`` holds those matches as [first word, word after, edits, label]. score is the
    likeness of the best match: 1 for an exact phrase, 0 without any. NULL and empty texts have no words and no
    labels (empty strings). A fuzzy match begins and ends where words do, and edits may bridge blanks within it; non-ASCII
    characters count an edit per byte. Words one edit off a short notice ("omit license") are within its bound and count. Other columns are ignored.
    """
    search = search or NoticeSearch()
    span = pa.struct([("first", pa.int64()), ("after", pa.int64()), ("edits", pa.int64()), ("label", pa.string())])
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
                        ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.list_(span))])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            yield from batches((row(d, *search.scan(t.as_py())) for d, t in zip(batch.column(0).to_pylist(), batch.column(1))), schema)

    def row(doc_id, n, places, spans):
        base = {label for _, label in places}
        labels = base | {s[3] for s in spans}
        best = 1.0 if places else max((s[4] for s in spans), default=0.0)
        return (doc_id, n, len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted(base)),
                ",".join(sorted(labels)), best, [dict(zip(("first", "after", "edits", "label"), s)) for s in spans])

    return texts(docs, "doc_id").mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, "
                                                 "labels string, score double, spans array<struct<first: long, after: long, edits: long, label: string>>")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
