"""The Merkle manifest against a plain builder, with awkward rows and groups of many sizes."""

import hashlib

import pytest
from pyspark.sql import functions as F

from spanloom.llm import merkle
from spanloom.llm.common import LOWER, UPPER


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def digest(row, text):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row["doc_id"], row["source"], row["lang"], row["n_chars"], text)])


def fold(nodes):
    """(root, for each node its [(left, right), ...])"""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(level) > 1:
        groups = [level[i:i + 8] for i in range(0, len(level), 8)]
        for k, place in enumerate(at):
            group, own = groups[place // 8], place % 8
            paths[k].append(("".join(group[:own]), "".join(group[own + 1:])))
            at[k] = place // 8
        level = [h(*g) for g in groups]
    return level[0], paths


def plain(rows, chosen=lambda row: False, change=lambda text: text):
    first = lambda v: (v is not None, v if v is not None else 0)
    langs = {}
    for row in rows:
        langs.setdefault(row["lang"], []).append((first(row["doc_id"]), digest(row, row["text"]), row))
    order = sorted(langs, key=lambda lang: (lang is not None, (lang or "").encode()))
    trees = {lang: fold([d for _, d, _ in sorted(langs[lang], key=lambda x: x[:2])]) for lang in order}
    root, over = fold([trees[lang][0] for lang in order])
    out = []
    for lang, up in zip(order, over):
        subroot, paths = trees[lang]
        for (_, leaf, row), path in zip(sorted(langs[lang], key=lambda x: x[:2]), paths):
            folded = digest(row, change(row["text"])) if chosen(row) else leaf
            for left, right in path + up:
                folded = h(left, folded, right)
            out.append((row["doc_id"], leaf, subroot, root, "".join(a + b for a, b in path + up), folded, folded == root))
    return sorted(out, key=repr)


SHAPE = "doc_id long, text string, lang string, source string, n_chars long, leaf string, Pos int, path string"
COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof", "folded_root", "verified")


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "z") for r in rows], SHAPE)


def upper_a(text):
    return text.translate(str.maketrans(UPPER, LOWER)) if text is not None else None


@pytest.mark.parametrize("sizes", [{"en": 1}, {"en": 9, None: 1}, {"en": 70, "de": 8, "fr": 65, "zz": 1, None: 3}, {f"l{i:02d}": 1 + i % 3 for i in range(20)}])
def test_matches_plain_tree(spark, sizes):
    rows, k = [], 0
    for lang, n in sizes.items():
        for i in range(n):
            k += 1
            rows.append((k * 7919 % 1000 - 100, [None, "", "Some TEXT é", "lower only " + "w " * i][i % 4], lang, [None, "s", "ü"][i % 3], [None, i][i % 2]))
    docs = table(spark, rows)
    got = merkle.manifest(docs, F.col("doc_id") % 3 == 0, F.translate("text", UPPER, LOWER))
    want = plain([r.asDict() for r in docs.collect()], lambda r: r["doc_id"] is not None and r["doc_id"] % 3 == 0, upper_a)
    assert sorted((tuple(r) for r in got.select(*COLUMNS).collect()), key=repr) == want


def test_nulls_repeats_and_empty_tables(spark):
    rows = [(None, "A", "en", None, None)] * 3 + [(5, "B", "en", "s", 1)] * 10 + [(None, None, None, None, None)] * 2 + [(5, "C " * 50_000, "en", "s", 1)]
    docs = table(spark, rows)
    got = merkle.manifest(docs)
    assert sorted((tuple(r) for r in got.select(*COLUMNS).collect()), key=repr) == plain([r.asDict() for r in docs.collect()])
    assert merkle.manifest(docs.limit(0)).count() == 0


def test_numbering_spreads_one_group(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("k"), F.when(F.col("id") % 5 > 0, "big").otherwise(F.lit(None)).alias("g"))
    rows = merkle.numbered(df, "g", ["k"], rows_a_part=100).collect()
    for g in ("big", None):
        mine = sorted((r.pos, r.k, r.n) for r in rows if r.g == g)
        assert [p for p, _, _ in mine] == list(range(len(mine))) and {n for _, _, n in mine} == {len(mine)}
        assert [k for _, k, _ in mine] == sorted(k for _, k, _ in mine)
