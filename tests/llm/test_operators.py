"""Operators against brute force, round trips and held-out accuracy, on small fixtures with awkward rows."""

import os
import re
import tracemalloc
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanloom.llm import (common, decontamination, exact_dedup, language_id, license_scan, mixing, near_duplicates, quality, quotation,
                          token_shards, toxicity)
from spanloom.llm.common import WordHashes, lean

SHAPE = "doc_id long, text string, lang string, source string, n_chars long, Text2 string, size string, kept int"
LONG = " ".join(f"w{i}" for i in range(30_000))


@pytest.fixture(scope="module")
def docs(spark):
    base = " ".join(f"word{i}" for i in range(60))
    rows = [(1, base, "en", "a"), (2, base.upper(), "en", "a"), (3, base + " tail", None, "b"), (4, None, None, None), (5, "", "de", None),
            (6, "!!! 123", "en", "a"), (7, "MIT License", "en", "b"), (8, LONG, "en", "c"), (None, "no id here", "en", "c"), (7, "MIT License", "en", "b"),
            (9, base + " more words at the end of it all here now", None, "b"), (10, "a  b\n c", "fr", "a")]
    return spark.createDataFrame([(d, t, lang, s, None if t is None else len(t), "x", "y", 1) for d, t, lang, s in rows], SHAPE)


def collected(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def test_exact_duplicates(spark, docs):
    rows = docs.collect()
    groups = {}
    for r in rows:
        groups.setdefault(lower(r.text), []).append(r.doc_id)
    keep = {t: max((d for d in ids if d is not None), default=None) for t, ids in groups.items()}
    expected = sorted(((r.doc_id, keep[lower(r.text)], len(groups[lower(r.text)]), r.doc_id == keep[lower(r.text)]) for r in rows), key=repr)
    assert collected(exact_dedup.exact_duplicates(docs, owner_bytes=2000), "doc_id", "keep_id", "group_size", "kept") == expected
    assert exact_dedup.exact_duplicates(docs.limit(0)).count() == 0


def test_extendible_index_splits_and_chains():
    index = exact_dedup.ExtendibleIndex(capacity=4)
    for i in range(200):
        index.add((i * 0x9E3779B97F4A7C15) % 2 ** 64, b"t%d" % i, i, 1)
    index.add(5, b"one", 1, 1)
    index.add(5, b"other", 2, 3)
    index.add(5, b"one", 9, 1)
    assert index.find(5, b"one")[1:] == [9, 2] and index.find(5, b"other")[1:] == [2, 3] and index.find(5, b"none") is None
    assert all(index.find((i * 0x9E3779B97F4A7C15) % 2 ** 64, b"t%d" % i)[1] == i for i in range(200))
    assert len(index.directory) == 1 << index.depth and all(len(b) <= 4 for b in index.buckets)
    single = exact_dedup.ExtendibleIndex()
    single.add(exact_dedup.xxhash.xxh3_64_intdigest(b"text"), b"text", 3, 2)
    head, blobs = (b"".join(x) for x in single.dump())
    assert exact_dedup.look_up(head, blobs, b"TEXT") == (3, 2) and exact_dedup.look_up(head, blobs, b"no") is None


def brute_components(rows):
    sets = []
    for _, text in rows:
        w = lower(text).split()
        sets.append({tuple(w[i:i + 5]) for i in range(max(len(w) - 4, 1))} if w else set())
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    least = {}
    for (d, _), g in zip(rows, group):
        least[g] = min(least.get(g, d), d)
    return sorted(((d, len(s), least[g]) for (d, _), s, g in zip(rows, sets, group)), key=repr)


def test_near_duplicates_match_brute_force(spark):
    rng = np.random.default_rng(3)
    vocabulary = [f"t{i}" for i in range(400)]
    passage = list(rng.choice(vocabulary, 40))
    rows = []
    for g in range(12):
        base = list(rng.choice(vocabulary, 30 + 10 * g)) + passage * (g % 3 == 0)
        for copy in range(30 if g == 1 else 4):
            text = list(base)
            for _ in range(copy % 5):
                text[int(rng.integers(len(text)))] = str(rng.choice(vocabulary))
            rows.append((len(rows), " ".join(text)))
    rows += [(500 + i, t) for i, t in enumerate(["", "a b", "A B", "a b c", None, "x"])]
    found = near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert collected(found, "doc_id", "n_shingles", "component_id") == brute_components([(d, t or "") for d, t in rows])


def test_near_duplicates_edges(spark, docs):
    found = {(r.doc_id, r.component_id) for r in near_duplicates.near_duplicates(docs).collect()}
    assert {(1, 1), (2, 1), (3, 1), (9, 1), (4, 4), (5, 5), (None, None), (7, 7)} <= found
    kept = near_duplicates.first_of_groups(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == [1, 4, 5, 6, 7, 8, 10]
    assert near_duplicates.near_duplicates(docs.limit(0)).count() == 0


def test_prefixes_of_linked_sets_share_enough():
    rng, classes = np.random.default_rng(1), np.random.default_rng(2).integers(0, 6, near_duplicates.CELLS).astype(np.uint8)
    for _ in range(200):
        n = int(rng.integers(1, 120))
        x = np.unique(rng.integers(0, 2 ** 63, n).astype(np.uint64))
        y = np.unique(np.concatenate([x[rng.random(len(x)) > 0.1], rng.integers(0, 2 ** 63, int(rng.integers(0, 6))).astype(np.uint64)]))
        if len(y) and near_duplicates.links(x.tobytes(), y.tobytes()):
            (m, p), (k, q) = (near_duplicates.adaptive_prefix(s, classes) for s in (x, y))
            assert len(np.intersect1d(p, q)) >= min(m, k)


def test_blocks_compare_like_pairs():
    import pyarrow as pa

    rng = np.random.default_rng(5)
    base = rng.integers(0, 2 ** 63, 50).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[rng.random(50) > 0.12], rng.integers(0, 2 ** 63, 3).astype(np.uint64)])) for _ in range(40)]
    left = pa.table({"a": list(range(20)), "x": [s.tobytes() for s in sets[:20]]})
    right = pa.table({"b": list(range(20, 40)), "y": [s.tobytes() for s in sets[20:]]})
    got = set(near_duplicates._compare_blocks(left, right)["b"].to_pylist())
    assert got == {j for j in range(20, 40) if any(near_duplicates.links(sets[i].tobytes(), sets[j].tobytes()) for i in range(20))}


def _crowd(size):
    """Near copies of one text, most of them not linked with each other, and a few clusters of close copies among them."""
    rng = np.random.default_rng(11)
    base, rows = [f"b{i}" for i in range(120)], []
    for i in range(size):
        text = list(rows[i - 1][1].split()) if i % 5 == 1 else list(base)
        for at in rng.choice(120, 1 if i % 5 == 1 else 6, replace=False):
            text[int(at)] = f"x{i}-{at}"
        rows.append((i, " ".join(text)))
    return rows


def test_crowds_are_compared_in_blocks(spark, monkeypatch):
    rows = _crowd(300)
    monkeypatch.setattr(near_duplicates, "BLOCK", 64)
    found = near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    got = collected(found, "doc_id", "n_shingles", "component_id")
    assert got == brute_components(rows)
    assert 20 < len({c for _, _, c in got}) < 300


def test_crowds_are_not_listed_in_pairs(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "BLOCK", 64)
    rows = {}
    for size in (300, 600):
        docs = spark.createDataFrame(_crowd(size), "doc_id long, text string")
        signed = near_duplicates.stored(near_duplicates.signatures(docs, np.zeros(near_duplicates.CELLS, np.uint8)), "signed")
        nodes = spark.createDataFrame([], "member long, component long")
        shared = near_duplicates.node_postings(signed, nodes)
        crowded = near_duplicates.crowded_tokens(shared)
        placed, pairs = near_duplicates.crowd_blocks(signed, nodes, crowded)
        shipped = pairs.join(placed, placed["block"] == pairs["row"]).count()
        rows[size] = (near_duplicates.node_pairs(shared, crowded).count(), shipped)
    assert rows[600][0] <= 2.2 * rows[300][0] + near_duplicates.CROWD * 10
    assert rows[600][1] < 600 * 599 / 8


def test_sets_are_dealt_in_rounds_and_steps_leave_little(spark, monkeypatch):
    rows = _crowd(160)
    monkeypatch.setattr(near_duplicates, "BLOCK", 64)
    asked = []

    def in_rounds(pairs, room, find, whole=near_duplicates.in_rounds):
        def found(some):
            asked[-1] += 1
            return find(some)

        asked.append(0)
        return whole(pairs, 4 * room, found)

    monkeypatch.setattr(near_duplicates, "ROUND_BYTES", 1)
    monkeypatch.setattr(near_duplicates, "in_rounds", in_rounds)
    folder = common.shared_folder(spark)
    before = set(os.listdir(folder))
    found = near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert collected(found, "doc_id", "n_shingles", "component_id") == brute_components(rows)
    assert max(asked) > 2
    left = {name.rsplit("-", 1)[0] for name in set(os.listdir(folder)) - before}
    assert "measured" in left and not left & {"signatures", "postings", "sets", "crowd-postings", "graph", "blocks"}


def test_joined_blocks_give_a_forest():
    import pyarrow as pa

    rng = np.random.default_rng(6)
    base = rng.integers(0, 2 ** 63, 60).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[rng.random(60) > 0.06], rng.integers(0, 2 ** 63, 2).astype(np.uint64)])) for _ in range(30)]
    both = pa.table({"doc_id": list(range(30)), "label": [min(i, 3) if i < 6 else i for i in range(30)], "set": [x.tobytes() for x in sets]})
    found = near_duplicates._join_blocks(both, both).to_pylist()
    assert all(near_duplicates.links(sets[e["a"]].tobytes(), sets[e["b"]].tobytes()) for e in found)
    label = {i: min(i, 3) if i < 6 else i for i in range(30)}
    for e in found:
        old, new = label[e["a"]], label[e["b"]]
        assert old != new
        label = {k: new if v == old else v for k, v in label.items()}
    assert all(label[i] == label[j] for i in range(30) for j in range(i) if near_duplicates.links(sets[i].tobytes(), sets[j].tobytes()))


def test_decontamination(spark, docs):
    item = " ".join(f"word{i}" for i in range(5, 25))
    bench = spark.createDataFrame([(1, item), (2, "mit license"), (3, None), (4, item), (5, "w7 w8"), (None, "no id here"), (6, "...")], "item_id long, text string")
    for block in (10 ** 6, 5):
        found = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.contaminated) for r in decontamination.contamination(docs, bench, block_words=block).collect()}
        assert found[1] == found[2] == (60, 20, 2, True) and found[7] == (2, 2, 1, True) and found[8] == (30000, 2, 1, True)
        assert found[4] == (0, 0, 0, False) and found[6] == (1, 0, 0, False) and found[None] == (3, 3, 0, True)
    clean = decontamination.cleaned(docs, bench)
    assert clean.columns == docs.columns
    texts = {r.doc_id: r for r in clean.collect()}
    assert 7 not in texts and None not in texts and "word10" not in texts[1].text and texts[1].text.startswith("word0 ")
    assert texts[1].n_chars == len(texts[1].text) and texts[4].text is None and texts[10].text == "a  b\n c"
    assert decontamination.contamination(docs, bench.limit(0)).where("contaminated").count() == 0
    assert decontamination.cleaned(docs.limit(0), bench).count() == 0


def test_cleaning_takes_one_worker_a_task(spark, docs):
    item = " ".join(f"word{i}" for i in range(5, 25))
    bench = spark.createDataFrame([(1, item), (2, "mit license"), (5, "w7 w8")], "item_id long, text string")
    whole, parts = (decontamination.cleaned(docs, bench, block_words=n) for n in (10 ** 6, 5))
    plan = whole._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1
    assert collected(whole, *docs.columns) == collected(parts, *docs.columns)
    half = collected(decontamination.cleaned(docs, bench, coverage=20 / 60), "doc_id")
    assert (1,) in half and (7,) not in half and (1,) not in collected(decontamination.cleaned(docs, bench, coverage=19 / 60), "doc_id")


def test_automaton_against_windows():
    rng = np.random.default_rng(4)
    words = [b"a", b"b", b"c"]
    for _ in range(150):
        items = [(str(i), list(rng.choice(words, int(rng.integers(1, 9))))) for i in range(4)]
        text = list(rng.choice(words, 40))
        hit, names = set(), set()
        for name, w in items:
            n = min(len(w), 4)
            for g in {tuple(w[i:i + n]) for i in range(len(w) - n + 1)}:
                for i in range(len(text) - n + 1):
                    if tuple(text[i:i + n]) == g:
                        hit |= set(range(i, i + n))
                        names.add(name)
        spans, found = decontamination.ItemAutomaton(items, window=4).scan(text)
        assert {p for a, b in spans for p in range(a, b)} == hit and {items[i][0] for i in found} == names


def test_mixing(spark, docs):
    found = mixing.systematic_mix(docs)
    rows = found.collect()
    assert len(rows) == docs.count() and all(r.taken <= 2 * r.size for r in rows) and found.columns.count("size") == 1
    by = {}
    for r in rows:
        by.setdefault(r.source, [r.target, 0, r.source_size])[1] += r.taken
    assert all(t <= 2 * s + 1e-6 for t, _, s in by.values()) and abs(sum(t for t, _, _ in by.values()) - 1.5 * sum(s for _, _, s in by.values())) < 1e-6
    assert {r.size for r in rows if r.doc_id in (4, 5)} == {0}
    assert collected(mixing.systematic_mix(docs), "doc_id", "taken") == collected(found, "doc_id", "taken")
    assert mixing.systematic_mix(docs.limit(0)).count() == 0 and mixing.mixed(docs).columns == docs.columns
    assert mixing.mixed(docs).count() == sum(r.copies for r in rows)


def test_mixing_reaches_targets(spark):
    many = spark.range(5000).selectExpr("id AS doc_id", "repeat('w ', cast(1 + id % 97 as int)) AS text", "concat('s', id % 7) AS source")
    rows = mixing.systematic_mix(many).groupBy("source").agg({"taken": "sum", "target": "max"}).collect()
    assert all(abs(r["sum(taken)"] - r["max(target)"]) <= 97 for r in rows)


def test_wavelet_matrix_round_trip():
    rng = np.random.default_rng(0)
    ids = rng.integers(0, 3000, 20_000).astype(np.uint32)
    wavelet, doc_ids, lengths = token_shards.load_shard(token_shards.dump_shard(ids, [4, None], [12_000, 8_000]))
    assert (wavelet.decode() == ids).all() and doc_ids == [4, None] and lengths.tolist() == [12_000, 8_000]
    for at in (0, 511, 512, 19_999):
        assert wavelet.access(at) == ids[at]
    for token in (int(ids[5]), 2999, 2 ** 20):
        places = np.flatnonzero(ids == token)
        assert wavelet.count(token) == len(places) and wavelet.count(token, 100, 9000) == ((places >= 100) & (places < 9000)).sum()
        assert [wavelet.occurrence(token, k) for k in range(len(places) + 1)] == [*places, -1]


def test_token_shards(spark, docs):
    tool = token_shards.Encoder(token_shards.vocabulary_path())
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    expected, start = [], 0
    for r in rows:
        ids = np.array([*tool.tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        expected.append((r.doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert collected(token_shards.token_shards(docs, shard_bytes=50_000), "doc_id", "start", "n_tokens", "ids_crc32") == sorted(expected, key=repr)
    assert token_shards.token_shards(docs.limit(0)).count() == 0


def test_planes_are_dealt_and_read_in_stretches():
    rng = np.random.default_rng(11)
    for n in (token_shards.STRETCH - 1, token_shards.STRETCH, token_shards.STRETCH + 1, 3 * token_shards.STRETCH + 5):
        ids = rng.integers(0, 50_000, n).astype(np.uint16)
        assert (token_shards.WaveletMatrix.build(ids).decode() == ids).all()
    ids = rng.integers(0, 50_000, 1 << 22).astype(np.uint16)
    wavelet = token_shards.WaveletMatrix.build(ids)
    for run in (lambda: token_shards.WaveletMatrix.build(ids), wavelet.decode):
        tracemalloc.start()
        run()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 5 * ids.nbytes


def test_a_shard_is_sent_in_small_batches(spark, monkeypatch):
    def watched(run):
        def wrapped(stream):
            def small():
                for batch in stream:
                    assert batch.nbytes < 3 << 20
                    yield batch
            yield from run(small())
        return wrapped

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    monkeypatch.setattr(token_shards, "trimmed", watched)
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("abc "), 700).alias("text"))
    rows = token_shards.token_shards(docs).agg(F.count("*"), F.max("start"), F.min("n_tokens")).first()
    assert rows[0] == 3000 and rows[1] == 2999 * rows[2] and spark.conf.get(key) == before


def test_small_batches_are_gathered():
    batches = [pa.RecordBatch.from_arrays([pa.array(["x" * n])], names=["text"]) for n in (10, 10, 10, 200, 10)]
    assert [b.num_rows for b in token_shards.gathered(iter(batches), 60)] == [3, 1, 1] and list(token_shards.gathered(iter(()))) == []


@pytest.mark.parametrize("text", ["a  b", "a \n b", "it's don't  x", "", " lead", "trail ", "é ñ 12 3 x", "<|endoftext|> hi", "a\n\nb c", "x  y", "a 　b", "tab\t x"])
def test_encoder_pieces(text):
    tool = token_shards.encoder(token_shards.vocabulary_path())
    assert tool.encode([text, f"plain words {text}"]) == [np.array(tool.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in (text, f"plain words {text}")]


def test_encoder_asks_once_for_words_with_other_signs_and_lines(monkeypatch):
    tool, asked = token_shards.Encoder(token_shards.vocabulary_path()), []
    plain, ids = tool.tokenizer, tool.ids
    monkeypatch.setattr(tool, "ids", lambda text: asked.append(text) or ids(text))
    words = [f"lengthyword{chr(97 + i)}" for i in range(20)]
    texts_ = [" ".join(["x", *(w + sign for w in words)]) for sign in ("", ".", ",", "!!", ".\nNext,", "?\nNext")]
    assert tool.encode(texts_) == [np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts_]
    assert sum(text.count("lengthyword") for text in asked) == 20


def test_encoder_cuts_are_those_of_the_plain_library(monkeypatch):
    monkeypatch.setattr(token_shards, "HELD_PIECES", 500)
    tool, rng = token_shards.Encoder(token_shards.vocabulary_path()), np.random.default_rng(3)
    parts = ["a", "the", "'s", "'", "n't", ".", ",", "!!", "$", "-", "\n", "\n", " ", " ", " ", " ", "\t", "\n\n", "\u00a0", "é", "²", "漢", "\u0301", "<|endoftext|>", "|>", "12", "\u1e900"]
    for _ in range(20):
        texts_ = ["".join(rng.choice(parts, rng.integers(0, 40))) for _ in range(50)]
        texts_ += [" ".join("".join(rng.choice([p for p in parts if p.strip() or p == "\n"], rng.integers(1, 4))) for _ in range(8)) for _ in range(50)]
        assert tool.encode(texts_) == [np.array(tool.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts_]
    assert [len(x) for x in token_shards.portions(pa.array(["a" * 10, "b", "", "c" * 30, "d"]), 10)] == [3, 2] and tool.encode([]) == []


def test_lean_tasks_drop_what_other_tasks_kept():
    path = token_shards.vocabulary_path()
    tool = token_shards.encoder(path)
    assert token_shards.encoder(path) is tool
    assert list(lean(iter)(iter(()))) == [] and token_shards.encoder(path) is not tool


def test_trimmed_tasks_free_memory_and_keep_what_is_kept(monkeypatch):
    freed, tool = [], token_shards.encoder(token_shards.vocabulary_path())
    monkeypatch.setattr(common, "free", lambda: freed.append(1))
    assert list(common.trimmed(iter)(iter([1]))) == [1] and freed == [1]
    assert token_shards.encoder(token_shards.vocabulary_path()) is tool


def test_token_ids_are_those_of_the_plain_library(spark):
    from tokenizers import Tokenizer

    plain, mark = Tokenizer.from_file(token_shards.vocabulary_path()), "<|endoftext|>"
    texts_ = [f"one {mark} two", mark, f"{mark}a b", f"a {mark}{mark} b", f"x{mark}y z{mark} w", f"a  {mark} b", f"{mark} {mark}  c", f" {mark} ", f"a\n{mark}\n b", "one two"]
    expected = [plain.encode(t, add_special_tokens=False).ids for t in texts_]
    assert expected[0] == [505, 220, 50256, 734]
    tool = token_shards.Encoder(token_shards.vocabulary_path())
    assert [np.frombuffer(b, "<u4").tolist() for b in tool.encode(texts_)] == expected
    assert [np.frombuffer(b, "<u4").tolist() for t in texts_ for b in tool.encode([t])] == expected
    rows, start = [], 0
    for i, ids in enumerate(expected):
        rows.append((i, start, len(ids) + 1, zlib.crc32(np.array([*ids, token_shards.END_ID], "<u4").tobytes())))
        start += len(ids) + 1
    shards = token_shards.token_shards(spark.createDataFrame(list(enumerate(texts_)), "doc_id long, text string"))
    assert collected(shards, "doc_id", "start", "n_tokens", "ids_crc32") == sorted(rows, key=repr)


def plain_grams(text):
    found = []
    for word in re.findall(r"[^\W\d_][\w\u0900-\u097F]*", "".join(c if c.isalpha() or unicodedata.category(c)[0] == "M" else " " for c in text.lower())):
        padded = f" {word} "
        found += [padded[i:i + n] for n in (1, 2, 3) for i in range(len(padded) - n + 1) if padded[i:i + n].strip()]
    return [sum(ord(c) << (21 * k) for k, c in enumerate(g)) for g in found]


def plain_ranking(keys):
    counts = {}
    for g in keys:
        counts[g] = counts.get(g, 0) + 1
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))][:language_id.PROFILE]


def plain_distance(ranking, profile):
    out = sum(abs(i - profile.index(g)) if g in profile else language_id.PROFILE for i, g in enumerate(ranking))
    return out / (language_id.PROFILE * max(len(ranking), 1))


def test_language(spark, docs):
    english, german = "the cat sat on the mat with the hat", "der hund und die katze sind nicht hier"
    labelled = spark.createDataFrame([("en", english)] * 3 + [("de", german)] * 3 + [(None, "zzz"), ("en", None)], "lang string, text string")
    profiles = language_id.train_profiles(labelled)
    ranks = language_id.Ranks(profiles)
    assert ranks.predict("the hat and the cat")[0] == "en" and ranks.predict("die katze und der hund")[0] == "de" and ranks.predict("12 !") == ("und", 0.0)
    for text in (english, german, "ab " * 40 + "x" * 90, "नमस्ते दुनिया", "½ ① Ⅷ ²³ 12 !", "", "a"):
        plain = plain_grams(text)
        for size in (7, 50, 250_000):
            assert sorted(g for some in language_id.grams(text, size) for g in some.tolist()) == sorted(plain)
        assert language_id.ranked(text).tolist() == plain_ranking(plain)
        best = min(sorted(profiles), key=lambda lang: plain_distance(plain_ranking(plain), profiles[lang].tolist()))
        want = (best, 1 - plain_distance(plain_ranking(plain), profiles[best].tolist())) if plain else ("und", 0.0)
        got = ranks.predict(text)
        assert got[0] == want[0] and got[1] == pytest.approx(want[1])
    assert profiles["en"].tolist() == plain_ranking(plain_grams(english) * 3)
    assert language_id.identify(docs.limit(0), profiles).count() == 0 and language_id.train_profiles(labelled.limit(0)) == {}
    assert ranks.predict("½ ① Ⅷ ²³")[0] == "und"
    found = {r.doc_id: r for r in language_id.identify(docs, profiles).collect()}
    assert found[4].lang_pred == found[5].lang_pred == found[6].lang_pred == "und" and all(0 <= r.score <= 1 for r in found.values())
    assert {r.lang_pred for r in language_id.identify(docs, {}).collect()} == {"und"}


def test_licenses(spark, docs):
    search = license_scan.NoticeSearch()
    text = b"Some MIT License here. Under the Apachee License, and GNU-General.Public LICENSE; mit\nlicense"
    n, places, spans = search.scan(text)
    assert n == 15 and places == [(1, "mit"), (9, "gpl"), (13, "mit")]
    assert (6, 8, 1, "apache") in [s[:4] for s in spans]
    assert search.scan(b"permission is herby granted, free of charge, to any persn obtaining a copy")[2][0][2:4] == (2, "mit")
    for notice, (edits, label) in license_scan.NOTICES.items():
        for k in range(edits):
            at = k * (len(notice) // (edits + 1)) + 1
            notice = notice[:at] + "q" + notice[at + 1:]
        assert label in {s[3] for s in search.scan(f"x {notice} y".encode())[2]}
    found = {r.doc_id: r for r in license_scan.scan_licenses(docs).collect()}
    assert (found[7].n_base, found[7].first_word, found[7].labels, found[7].score) == (1, 0, "mit", 1.0)
    assert (found[4].n_words, found[4].first_word, found[4].labels) == (0, None, "") and found[8].n_words == 30_000


def test_adjacent_repeats_of_notices_are_all_found():
    search = license_scan.NoticeSearch()
    assert [s[:3] for s in search.scan(b"all rights reservd all rights reserved")[2] if s[3] == "proprietary"] == [(0, 3, 1), (3, 6, 0)]
    for notice, (edits, label) in license_scan.NOTICES.items():
        n, middle = len(notice.split()), len(notice) // 2
        for first, errors in ((notice, 0), (notice[:middle] + notice[middle + 1:], 1), (notice[:middle] + "q" + notice[middle + 1:], 1)):
            if len(first.split()) != n:
                continue
            found = search.scan(f"{first} {notice} {notice}".encode())[2]
            spans = [s for s in found if s[3] == label and s[1] - s[0] >= n]
            assert [s[2] for s in spans] == [errors, 0, 0], notice
            assert [s[:2] for s in spans] == [(0, n), (n, 2 * n), (2 * n, 3 * n)], notice


def test_factorisation_machine(spark, docs):
    machine = quality.FactorisationMachine(20, 3)
    machine.weights[:] = np.arange(20) / 10
    at, x = np.array([2, 5, 9]), np.array([1.0, -2.0, 0.5])
    plain = machine.weights[at] @ x + sum(machine.factors[at[i]] @ machine.factors[at[j]] * x[i] * x[j] for i in range(3) for j in range(i))
    assert machine.raw(at, x)[0] == pytest.approx(plain)
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 11)] + [(None, 1), (3, None)], "doc_id long, label int")
    scores = quality.score(docs, quality.train(docs, labels))
    assert scores.count() == docs.count() and scores.where("score between 0 and 1").count() == docs.count()
    assert quality.score(docs, quality.train(docs, labels.limit(0))).count() == docs.count()


def test_network_gradients():
    rng = np.random.default_rng(2)
    net = toxicity.Network(1)
    inputs = rng.normal(0, 1, (9, toxicity.WIDTH)).astype(np.float32)
    ids = rng.integers(0, 9, (6, 5))
    ids[4:, 1] = toxicity.PAD
    target, weights = np.array([1, 0, 1, 0, 1.0]), np.full(5, 0.2)

    def loss():
        z = net.forward(net.project(inputs), ids).astype(np.float64)
        return float((weights * (np.log1p(np.exp(z)) - target * z)).sum())

    dense, d_in = net.gradients(inputs, ids, target, weights)
    for array, g in [*((net.p[k], v) for k, v in dense.items()), (inputs, d_in)]:
        for at in [tuple(rng.integers(0, s) for s in array.shape) for _ in range(4)]:
            old = array[at]
            array[at] = old + 1e-2
            up = loss()
            array[at] = old - 1e-2
            down = loss()
            array[at] = old
            assert (up - down) / 2e-2 == pytest.approx(float(g[at]), abs=3e-3)


def test_toxicity_learns_and_scores_all_windows(spark, docs):
    rng = np.random.default_rng(6)
    rows = []
    for i in range(400):
        words = [f"n{int(x)}" for x in rng.integers(0, 60, 80)]
        if i % 4 == 0:
            words[int(rng.integers(80))] = f"nasty{'abc'[i % 3]}"
        rows.append(([w.encode() for w in words], int(i % 4 == 0)))
    net = toxicity.Trainer(rows[:300]).fit()
    held = np.array(list(toxicity.worst_logits(net, [b" ".join(w) for w, _ in rows[300:]], toxicity.Inputs(net)))) + net.shift
    assert ((held >= 0) == np.array([y for _, y in rows[300:]], dtype=bool)).mean() > 0.97
    late = (" ".join(f"n{i % 60}" for i in range(5000)) + " nastya").encode()
    assert next(toxicity.worst_logits(net, [late], toxicity.Inputs(net))) + net.shift > 0
    scored = toxicity.score(docs, net)
    assert scored.count() == docs.count() and scored.columns == [*docs.columns, "toxic_score"]
    for n in (0, 1, 23, 24, 25, 40, 41, 100):
        assert set(range(1, n + 1)) <= set(toxicity.windows_of(np.arange(1, n + 1)).ravel().tolist())
    assert {r.toxic_score for r in toxicity.score(docs, toxicity.Trainer([]).fit()).collect()} == {0.5}


def test_toxicity_sends_a_text_once_to_its_tasks(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None), (3, "")], "doc_id long, Text string")
    scored = toxicity.score(docs, toxicity.Trainer([([b"a"], 0), ([b"b"], 1)] * 20).fit(1))
    assert "coalesce" not in scored._jdf.queryExecution().optimizedPlan().toString()
    rows = {r.doc_id: r for r in scored.collect()}
    assert [rows[i].Text for i in (1, 2, 3)] == ["a b", None, ""] and rows[2].toxic_score == rows[3].toxic_score


def test_toxicity_reads_every_byte_of_long_runs():
    for n in (1, 63, 64, 65, 66, 67, 1000):
        for step in (toxicity.PIECE_STEP, toxicity.FIT_PIECE_STEP):
            text = bytes(i % 23 + 97 for i in range(n))
            found, at = list(toxicity.units(b"ab " + text, step)), 0
            assert found[0] == b"ab" and (n > toxicity.LONG_RUN or found[1:] == [text])
            for i, piece in enumerate(found[1:]):
                assert i * step <= at and text[i * step:][:len(piece)] == piece
                at = i * step + len(piece)
            assert at == n
    rng = np.random.default_rng(6)
    rows = []
    for i in range(400):
        words = [f"n{int(x)}" for x in rng.integers(0, 60, 80)]
        if i % 4 == 0:
            words[int(rng.integers(80))] = f"nasty{'abc'[i % 3]}"
        rows.append(([w.encode() for w in words], int(i % 4 == 0)))
    net = toxicity.Trainer(rows).fit()
    clean = "".join(f"n{i % 60}" for i in range(1000))
    runs = [clean, *(clean[:at] + "nastya" + clean[at:] for at in (70, 1000, 1005, 1800))]
    logits = np.array(list(toxicity.worst_logits(net, [r.encode() for r in runs], toxicity.Inputs(net)))) + net.shift
    assert logits[0] < 0 and (logits[1:] > 0).all()


def test_phrases_of_many_words_stand_whole_in_a_window():
    for n in (24, 25, 60, 100):
        held = {tuple(w) for w in toxicity.windows_of(np.arange(1, n + 1)).tolist()}
        for size in (10, 11, 12, 19):
            for at in range(1, n - size + 2):
                assert any(set(range(at, at + size)) <= set(w) for w in held), (n, size, at)


def test_long_texts_are_scored_in_parts(monkeypatch):
    net = toxicity.Network(3)
    texts_ = [b"one two", b" ".join(b"w%d" % i for i in range(1000)), b"", b"z" * 5000]
    inputs = toxicity.Inputs(net)
    inputs.learn([u for t in texts_ for u in toxicity.units(t)])
    whole = list(toxicity.worst_logits(net, texts_, inputs))
    for span in (1, 3, 50):
        monkeypatch.setattr(toxicity, "SPAN", toxicity.STEP * span)
        assert list(toxicity.worst_logits(net, texts_, inputs, 1)) == pytest.approx(whole)


def test_quotation(spark):
    rows = [(1, 0, "user", "Hello there friend\nHow are you?\n\nSecond para line."), (1, 1, "assistant", "Bob wrote:\n> Hello there friend\n> How are you?\n\nI am fine."),
            (1, 2, "user", "> > Hello there friend\n> I am  FINE.\nGreat to hear"), (2, 0, "user", ">> I am fine.\n> Great to hear\nother conv"), (2, 1, "user", None),
            (None, None, None, "> nope\nx"), (1, 1, "assistant", "Bob wrote:\n> Hello there friend\n> How are you?\n\nI am fine."), (3, 0, "user", "> x y z\n" * 5000)]
    chat = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = {(r.conv_id, r.turn): r for r in quotation.reply_ordered(chat).collect()}
    assert [(found[k].thread_conv, found[k].position, found[k].depth) for k in ((1, 0), (1, 1), (1, 2), (2, 0))] == [(1, 1, 0), (1, 2, 1), (1, 3, 2), (1, 4, 3)]
    assert found[1, 1].text == "I am fine." and found[1, 1].copies == 2 and (found[1, 2].max_level, found[1, 2].parent_turn) == (2, 1)
    assert found[2, 1].text == "" and found[None, None].text == "x" and found[3, 0].n_quotes == 1
    assert quotation.reply_ordered(chat.limit(0)).count() == 0


def test_shingles_are_words_between_white_space():
    hashes = WordHashes()
    assert len(near_duplicates.shingle_set("a b c\td".encode(), hashes)) == 1
    assert (near_duplicates.shingle_set(b"A b C d E f", hashes) == near_duplicates.shingle_set(b"a B c D e F", hashes)).all()


def test_cut_counts_words_of_any_case():
    assert decontamination.cut("ONE Two, three É Four. FIVE", [[1, 3]]) == "ONE  É Four. FIVE"
    text = "The QUICK (brown) Fox-jumps über Ärger"
    assert len(decontamination.alnum_words(text.encode())) == len(list(decontamination._WORD.finditer(text.encode().lower())))


def plain_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_notices_stand_at_word_ends():
    search = license_scan.NoticeSearch()
    for words in ("please submit license form", "a permit license was issued", "we commit licenses to", "transmit license plates", "emit licensed light", "the summit license fee",
                  "unapache licensed", "subsd licenses", "overall rights reservedly", "limit licensee", "admit license holders", "vomit license", "remit license dues"):
        n, places, spans = search.scan(words.encode())
        assert places == [] and spans == [], (words, spans)
    rng = np.random.default_rng(2)
    texts = []
    for notice, (edits, label) in license_scan.NOTICES.items():
        for _ in range(6):
            letters = list(notice)
            for _ in range(int(rng.integers(0, edits + 1))):
                at = int(rng.integers(1, len(letters) - 1))
                letters[at:at + int(rng.integers(0, 2))] = ["", "q", "zz"][int(rng.integers(0, 2))]
            texts.append(("".join(letters), notice, edits, label))
    for said, notice, edits, label in texts:
        words = license_scan.alnum_words(f"foo {said} bar".encode())
        _, _, spans = search.scan(b" ".join(words))
        for first, after, errors, found, likeness in spans:
            piece = b" ".join(words[first:after]).decode()
            assert errors == min(plain_edits(piece, n) for n, (e, what) in license_scan.NOTICES.items() if what == found), (piece, spans)
        if plain_edits(b" ".join(words[1:-1]).decode(), notice) <= edits:
            assert label in {s[3] for s in spans}, (said, spans)
