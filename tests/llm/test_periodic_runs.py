"""Periodic runs against a plain search of every period, and the grammar against its text."""

import hashlib
import zlib

import numpy as np
import pytest

from spanloom.llm import periodic_runs as pr


def plain_runs(words, shortest=24, times=3):
    """Every period tried over the whole text; an interval keeps its smallest period."""
    found, n = {}, len(words)
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(shortest, times * q):
                found.setdefault((i, j + q), q)
            i = j
    return sorted(((a, b - a, q) for (a, b), q in found.items()), key=lambda r: (r[0], r[2]))


def samples():
    rng = np.random.default_rng(5)
    for k in range(120):
        size = int(rng.integers(1, 400))
        words = [b"%d" % x for x in rng.integers(0, int(rng.integers(1, 6)) if k % 2 else 60, size)]
        for _ in range(int(rng.integers(0, 4))):
            at, p = int(rng.integers(0, len(words))), int(rng.integers(1, 30))
            words[at:at] = (words[at:at + p] or [b"x"]) * int(rng.integers(2, 12))
        yield words
    yield [b"a"] * 1000
    yield ([b"a"] * 30 + [b"b"]) * 30
    yield ([b"a", b"b"] * 20 + [b"c"]) * 7 + [b"a", b"b"] * 13
    fib = [[b"a"], [b"a", b"b"]]
    while len(fib[-1]) < 600:
        fib.append(fib[-1] + fib[-2])
    yield fib[-1]
    yield []
    yield [b"w"]
    yield [b"a"] * 23
    yield [b"a"] * 24


def test_runs_match_every_period_tried():
    seen = 0
    for words in samples():
        want = plain_runs(words)
        assert pr.text_runs(words) == want, words
        for shortest, times in ((6, 3), (8, 4)):
            assert pr.text_runs(words, shortest, times) == plain_runs(words, shortest, times)
        seen += len(want)
    assert seen > 60


def test_grammar_gives_its_text_back():
    for words in samples():
        if not words:
            continue
        numbers = pr.numbered_words(words)
        grammar = pr.Grammar(numbers, int(numbers.max()) + 1)

        def expand(symbol):
            if symbol < grammar.terminals:
                return [symbol]
            k = symbol - grammar.terminals
            return expand(int(grammar.left[k])) + expand(int(grammar.right[k]))

        assert [x for s in grammar.line.tolist() for x in expand(s)] == numbers.tolist()
        pairs = list(zip(grammar.line.tolist(), grammar.line.tolist()[1:]))
        assert len(set(pairs)) == len(pairs)  # no pair is left twice
    assert pr.Grammar(np.zeros(4096, np.int64), 1).line.tolist() == [11, 11]


def test_long_repetitive_text_stays_cheap():
    rng = np.random.default_rng(1)
    words = [b"%d" % x for x in rng.integers(0, 2, 200_000)] + [b"x", b"y", b"z"] * 20_000
    assert (200_000, 60_000, 3) in pr.text_runs(words)


@pytest.fixture(scope="module")
def docs(spark):
    line = "one two three four five six seven eight "
    rows = [(i, " ".join(f"w{(i * j * j) % 97}" for j in range(300))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, " \t\n "), (103, line * 4), (103, line * 4), (104, line * 2 + "x " + line * 3), (None, line * 5), (None, None),
             (105, "é é " * 15 + "É " * 30), (106, "a b " * 40_000)]
    return spark.createDataFrame([(d, t, "x", 1, "y") for d, t in rows], "doc_id long, text string, runs string, best long, Collapsed string")


def expected(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    if doc_id is not None and n and zlib.crc32(str(doc_id).encode()) % 10 == 0:
        g = zlib.crc32(str(doc_id).encode()) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = plain_runs(words) if n < 5000 else pr.text_runs(words)
    dropped = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda r: (-r[1] * 10 ** 9 // r[2], r[0], r[2]), default=None)
    digest = [hashlib.sha256(x).hexdigest() for x in ("".join("%d,%d,%d\n" % r for r in found).encode(), b" ".join(w for i, w in enumerate(words) if i not in dropped))]
    return (doc_id, len(found), *(best or (None, None, None)), best and 1000 * best[1] // best[2], *digest)


def test_query_matches_plain_version(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in pr.op11_periodic_runs(spark, str(tmp_path)).collect()]
    want = [expected(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert sum(r[1] > 0 for r in want) > 5
    assert pr.periodic_runs(docs.limit(0)).count() == 0
