"""Toxicity: a bidirectional gated recurrent network with attention pooling over words and their characters."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from itertools import chain, islice
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import alnum_words, labelled_sample, lean, read_table, remainder, texts, without

#: Words of a window, and how far on the next one begins: passages of up to WINDOW - STEP + 1 words stand whole in one.
#: Units a direction, input width, hashed slots.
WINDOW, STEP, UNITS, WIDTH, SLOTS = 24, 6, 6, 8, 1 << 16
#: Labelled rows fitted on at most, windows a pass takes of each clean text besides its worst, and passes.
SAMPLE, WINDOWS_A_TEXT, PASSES = 6000, 3, 6
#: One labelled row in so many is set apart to place the boundary; folds of the query.
CALIBRATION, FOLDS = 5, 5
#: Steps a pass has at least, where there are rows enough for that.
STEPS = 50
#: A run of more bytes than this (of a script without blanks, say) is read as overlapping pieces of so many bytes. How far
#: on the next one begins: in scoring, where a piece should meet a word about whole, and in fitting, where all are held.
LONG_RUN, PIECE, PIECE_STEP, FIT_PIECE_STEP = 64, 10, 2, 5
#: Windows scored in one go, words whose inputs a task keeps, and units of a long text taken in one go.
BLOCK, HELD_WORDS, SPAN = 1024, 200_000, STEP << 13
PAD = 0
_PRIMES = np.array([2654435761, 2246822519], dtype=np.uint64)


def pieces(word: bytes, step: int) -> Iterable[bytes]:
    """The word; a run of over ``LONG_RUN`` bytes as pieces that overlap and together hold every byte."""
    return [word] if len(word) <= LONG_RUN else (word[at:at + PIECE] for at in range(0, len(word) - PIECE + step, step))


def units(text: bytes, step: int = PIECE_STEP) -> Iterator[bytes]:
    """Words of a text in order, long runs in pieces."""
    words = alnum_words(text)
    long = len(max(words, key=len, default=b"")) > LONG_RUN
    return chain.from_iterable(pieces(w, step) for w in words) if long else iter(words)


def char_slots(words: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the 4- and 5-byte character grams of many words, ends marked, and where each word's slots begin."""
    raw = np.frombuffer(b"".join([b"<%b>\x00\x00\x00" % w for w in words]), dtype=np.uint8).astype(np.uint64)
    padded = np.concatenate([raw, np.zeros(5, np.uint64)])
    size = len(raw)
    four = padded[:size] | padded[1:size + 1] << np.uint64(8) | padded[2:size + 2] << np.uint64(16) | padded[3:size + 3] << np.uint64(24)
    five = four ^ (padded[4:size + 4] << np.uint64(32))
    ends = np.cumsum([len(w) + 5 for w in words])
    begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    first = np.zeros(size, dtype=bool)
    first[begins] = True
    keys = np.stack([four, five * np.uint64(31) + np.uint64(7)], axis=1)
    keep = np.stack([(padded[3:size + 3] > 0) | first, padded[4:size + 4] > 0], axis=1)
    slots = ((keys * _PRIMES) >> np.uint64(13)) % np.uint64(SLOTS)
    counts = np.add.reduceat(keep.sum(axis=1), begins)
    return slots[keep].astype(np.int64), np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64)


def word_slots(words: Sequence[bytes]) -> np.ndarray:
    return np.array([zlib.crc32(w) % SLOTS for w in words], dtype=np.int64)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return 1 / (1 + np.exp(-x))


def _tanh(x: np.ndarray) -> np.ndarray:
    return 2 * _sigmoid(2 * x) - 1


def _sums(values: np.ndarray, index: np.ndarray, size: int) -> np.ndarray:
    """Sum of the rows of each index."""
    order = np.argsort(index, kind="stable")
    ranked = index[order]
    begins = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    out = np.zeros((size, values.shape[1]), values.dtype)
    out[ranked[begins]] = np.add.reduceat(values[order], begins)
    return out


class Network:
    """Word input: word slot plus mean of character slots. Two recurrent passes; attention pools a window to one logit."""

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)

        def near(*shape: int) -> np.ndarray:
            return rng.normal(0, 1 / np.sqrt(shape[-2] if len(shape) > 1 else shape[0]), shape).astype(np.float32)

        self.p = {"words": 0.1 * near(1, SLOTS, WIDTH)[0] * np.sqrt(SLOTS), "chars": 0.1 * near(1, SLOTS, WIDTH)[0] * np.sqrt(SLOTS),
                  "W": near(2, WIDTH, 3 * UNITS), "b": np.zeros((2, 1, 3 * UNITS), np.float32), "U": near(2, UNITS, 3 * UNITS),
                  "A": near(2, UNITS, UNITS), "a": near(UNITS), "o": near(2, UNITS), "c": np.zeros(1, np.float32)}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.shift, self.constant = 0.0, None

    def word_inputs(self, words: np.ndarray, slots: np.ndarray, begins: np.ndarray) -> np.ndarray:
        counts = np.diff(np.concatenate([begins, [len(slots)]]))[:, None].astype(np.float32)
        return self.p["words"][words] + np.add.reduceat(self.p["chars"][slots], begins) / counts

    def project(self, inputs: np.ndarray) -> np.ndarray:
        """What both directions see of inputs: (2, rows, gates)."""
        return np.matmul(inputs[None], self.p["W"]) + self.p["b"]

    def forward(self, seen: np.ndarray, ids: np.ndarray, memo: list | None = None):
        """Logits of windows; ids (steps, windows) are rows of ``seen``, row 0 pads."""
        steps, n = ids.shape
        flat = seen.reshape(-1, 3 * UNITS)
        h, states = np.zeros((2, n, UNITS), np.float32), np.empty((steps, 2, n, UNITS), np.float32)
        for t in range(steps):
            x = flat[np.concatenate([ids[t], ids[steps - 1 - t] + seen.shape[1]])].reshape(2, n, 3 * UNITS)
            u = np.matmul(h, self.p["U"])
            gates = _sigmoid(x[..., :2 * UNITS] + u[..., :2 * UNITS])
            z, r = gates[..., :UNITS], gates[..., UNITS:]
            new = _tanh(x[..., 2 * UNITS:] + r * u[..., 2 * UNITS:])
            before, h = h, new + z * (h - new)
            states[t, 0], states[steps - 1 - t, 1] = h
            if memo is not None:
                memo.append((before, z, r, new, u[..., 2 * UNITS:]))
        key = _tanh(states[:, 0] @ self.p["A"][0] + states[:, 1] @ self.p["A"][1])
        e = np.where(ids != PAD, key @ self.p["a"], np.float32(-1e9))
        e = np.exp(e - e.max(axis=0))
        weight = e / e.sum(axis=0)
        pooled = np.einsum("tn,tdnu->dnu", weight, states)
        logit = pooled[0] @ self.p["o"][0] + pooled[1] @ self.p["o"][1] + self.p["c"][0]
        return logit if memo is None else (logit, states, key, weight, pooled)

    def gradients(self, inputs: np.ndarray, ids: np.ndarray, target: np.ndarray, weights: np.ndarray):
        """Of the dense parameters and of the input rows, for the weighted log loss."""
        memo: list = []
        steps, n = ids.shape
        logit, states, key, weight, pooled = self.forward(self.project(inputs), ids, memo)
        slope = ((_sigmoid(logit) - target) * weights).astype(np.float32)
        g = {"o": np.einsum("dnu,n->du", pooled, slope), "c": np.array([slope.sum()], np.float32)}
        d_pool = slope[None, :, None] * self.p["o"][:, None, :]
        d_states = weight[:, None, :, None] * d_pool[None]
        d_weight = np.einsum("tdnu,dnu->tn", states, d_pool)
        d_e = weight * (d_weight - (weight * d_weight).sum(axis=0))
        g["a"] = np.einsum("tn,tnu->u", d_e, key)
        d_key = d_e[..., None] * self.p["a"] * (1 - key * key)
        g["A"] = np.einsum("tdnu,tnv->duv", states, d_key)
        d_states += np.einsum("tnv,duv->tdnu", d_key, self.p["A"])
        d_x, g["U"] = np.empty((steps, 2, n, 3 * UNITS), np.float32), np.zeros_like(self.p["U"])
        back = np.zeros((2, n, UNITS), np.float32)
        for t in range(steps - 1, -1, -1):
            before, z, r, new, u_new = memo[t]
            total = back + np.stack([d_states[t, 0], d_states[steps - 1 - t, 1]])
            d_new = total * (1 - z) * (1 - new * new)
            d_u = np.concatenate([total * (before - new) * z * (1 - z), d_new * u_new * r * (1 - r), d_new * r], axis=2)
            d_x[t] = d_u
            d_x[t, ..., 2 * UNITS:] = d_new
            g["U"] += np.matmul(before.transpose(0, 2, 1), d_u)
            back = total * z + np.matmul(d_u, self.p["U"].transpose(0, 2, 1))
        d_seen = np.stack([_sums(d_x[:, d].reshape(-1, 3 * UNITS), (ids, ids[::-1])[d].ravel(), len(inputs)) for d in (0, 1)])
        g["W"], g["b"] = np.einsum("rw,drx->dwx", inputs, d_seen), d_seen.sum(axis=1, keepdims=True)
        return g, np.einsum("drx,dwx->rw", d_seen, self.p["W"])


def windows_of(ids: np.ndarray) -> np.ndarray:
    """All windows of a text as rows: they overlap, together hold every word, and the last is padded."""
    count = max(-(-(len(ids) - (WINDOW - STEP)) // STEP), 1)
    padded = np.zeros((count - 1) * STEP + WINDOW, dtype=ids.dtype)
    padded[:len(ids)] = ids
    return np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::STEP]


class Trainer:
    """Fits the network to windows of labelled texts.

    A toxic text teaches by the window that looks most toxic so far, a clean one by its worst and by some others.
    """

    def __init__(self, rows: Iterable[tuple[list[bytes], int]], seed: int = 11):
        self.net, self.rng = Network(seed), np.random.default_rng(seed)
        vocabulary: dict[bytes, int] = {b"": PAD}
        self.windows, self.labels = [], []
        for words, label in rows:  # of the texts, word numbers alone are kept
            self.windows.append(windows_of(np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in words), np.int32, len(words))))
            self.labels.append(label)
        spelled = list(vocabulary)
        del vocabulary
        self.words = word_slots(spelled)
        # Some words at a time: on the way, a slot takes many times the bytes that are kept of it.
        pieces = [char_slots(spelled[at:at + 20_000]) for at in range(0, len(spelled), 20_000)]
        pieces = [(slots.astype(np.int32), begins) for slots, begins in pieces]
        before = np.cumsum([0, *(len(slots) for slots, _ in pieces)])
        self.slots = np.concatenate([slots for slots, _ in pieces])
        self.begins = np.concatenate([begins + n for (_, begins), n in zip(pieces, before)])
        del spelled, pieces
        self.ends = np.concatenate([self.begins[1:], [len(self.slots)]])
        self.moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.net.p.items()}
        self.steps = 0

    def fit(self, passes: int = PASSES, rate: float = 0.02) -> Network:
        kept = np.arange(len(self.labels)) % CALIBRATION == 0
        toxic, clean = ([w for w, y, k in zip(self.windows, self.labels, kept) if y == label and not k] for label in (1, 0))
        if not toxic or not clean:
            self.net.constant = 0.5 if not toxic and not clean else 0.99 if toxic else 0.01
            return self.net
        picks = self._unlike(toxic, clean)
        for number in range(passes):
            chosen = [w[self.rng.choice(len(w), min(len(w), WINDOWS_A_TEXT), replace=False)] for w in clean]
            if number:
                picks = np.stack([w[i] for w, i in zip(toxic, self._worst(toxic)[1])])
                chosen.append(np.stack([w[i] for w, i in zip(clean, self._worst(clean)[1])]))
            others = np.concatenate(chosen)
            ids = np.concatenate([picks, others])
            target = np.concatenate([np.ones(len(picks)), np.zeros(len(others))]).astype(np.float32)
            weights = np.where(target == 1, 0.5 / len(picks), 0.5 / len(others)) * len(ids)
            order = self.rng.permutation(len(ids))
            batch = min(max(len(order) // STEPS, 16), 256)
            for at in range(0, len(order), batch):
                part = order[at:at + batch]
                self._step(ids[part].T, target[part], weights[part] / len(part), rate / (1 + number))
        apart = [[w for w, y, k in zip(self.windows, self.labels, kept) if y == label and k] for label in (1, 0)]
        self.net.shift = -self._boundary(*(self._worst(a or b)[0] for a, b in zip(apart, (toxic, clean))))
        return self.net

    def _unlike(self, toxic: list[np.ndarray], clean: list[np.ndarray]) -> np.ndarray:
        """First picks: the window with the word whose character slots are most of all those of toxic texts."""
        odds = []
        for group in (toxic, clean):
            uses = np.zeros(len(self.begins), dtype=np.int64)
            for w in group:
                uses[np.unique(w)] += 1
            uses[PAD] = 0
            odds.append((np.bincount(self.slots, np.repeat(uses, self.ends - self.begins), minlength=SLOTS) + 0.5) / len(group))
        slot = np.where(odds[0] * len(toxic) > 3, np.log(odds[0] / odds[1]), -99.0)
        word = np.maximum.reduceat(slot[self.slots], self.begins)
        word[PAD] = -99.0
        return np.stack([w[int(np.argmax(word[w].max(axis=1)))] for w in toxic])

    def _worst(self, texts_: list[np.ndarray]) -> tuple[np.ndarray, list[int]]:
        """Per text, its largest logit and the window it is from."""
        seen = np.empty((2, len(self.begins), 3 * UNITS), np.float32)
        for at in range(0, len(self.begins), 20_000):
            begins, ends = self.begins[at:at + 20_000], self.ends[at:at + 20_000]
            seen[:, at:at + len(begins)] = self.net.project(
                self.net.word_inputs(self.words[at:at + len(begins)], self.slots[begins[0]:ends[-1]], begins - begins[0]))
        most, places = [], []
        for at in range(0, len(texts_), 32):
            group = texts_[at:at + 32]
            rows, ends = np.concatenate(group), np.cumsum([0, *map(len, group)])
            logits = np.concatenate([self.net.forward(seen, part.T) for part in np.array_split(rows, -(-len(rows) // BLOCK))])
            for a, b in zip(ends, ends[1:]):
                places.append(int(np.argmax(logits[a:b])))
                most.append(logits[a + places[-1]])
        return np.array(most), places

    def _step(self, ids: np.ndarray, target: np.ndarray, weights: np.ndarray, rate: float) -> None:
        used, local = np.unique(np.concatenate([[PAD], ids.ravel()]), return_inverse=True)
        counts = self.ends[used] - self.begins[used]
        begins = np.concatenate([[0], np.cumsum(counts)[:-1]])
        slots = self.slots[np.arange(counts.sum()) + np.repeat(self.begins[used] - begins, counts)]
        inputs = self.net.word_inputs(self.words[used], slots, begins)
        g, d_in = self.net.gradients(inputs, local[1:].reshape(ids.shape), target, weights)
        self.steps += 1
        for k, value in g.items():
            self._adam(k, slice(None), value, rate)
        for k, at, value in (("words", self.words[used], d_in), ("chars", slots, np.repeat(d_in / counts[:, None], counts, axis=0))):
            rows, place = np.unique(at, return_inverse=True)
            self._adam(k, rows, _sums(value, place, len(rows)), rate)

    def _adam(self, k: str, at, g: np.ndarray, rate: float) -> None:
        first, second = self.moments[k]
        first[at] = 0.9 * first[at] + 0.1 * g
        second[at] = 0.99 * second[at] + 0.01 * g * g
        fix = np.sqrt(1 - 0.99 ** self.steps) / (1 - 0.9 ** self.steps)
        self.net.p[k][at] -= rate * fix * first[at] / (np.sqrt(second[at]) + 1e-6)

    @staticmethod
    def _boundary(toxic: np.ndarray, clean: np.ndarray) -> float:
        """The logit that parts the classes best; in the middle where many do."""
        ranked = np.concatenate([toxic, clean])
        order = np.argsort(ranked)
        share = np.concatenate([np.ones(len(toxic)), -np.ones(len(clean))])[order]
        wrong = np.concatenate([[0], np.cumsum(share)])
        places = np.flatnonzero(wrong <= wrong.min() + 1e-9)
        at, ranked = places[len(places) // 2], ranked[order]
        return float(ranked[max(at - 1, 0)] + ranked[min(at, len(ranked) - 1)]) / 2


class Inputs(dict):
    """Row of each word in a table of what the network sees of it; emptied when large. Row 0 pads."""

    def __init__(self, net: Network):
        super().__init__()
        self.net, self.used = net, 1
        self.seen = np.zeros((2, 1 << 14, 3 * UNITS), np.float32)
        self._fill([b""], 0)

    def _fill(self, words: list[bytes], at: int) -> None:
        self.seen[:, at:at + len(words)] = self.net.project(self.net.word_inputs(word_slots(words), *char_slots(words)))

    def learn(self, words: Iterable[bytes]) -> None:
        """Make rows for words not met before."""
        new = sorted(set(words).difference(self))
        if self.used + len(new) > HELD_WORDS and self:
            self.clear()
            self.used = 1
            new = sorted(set(words))
        while self.used + len(new) > self.seen.shape[1]:
            self.seen = np.concatenate([self.seen, np.zeros_like(self.seen)], axis=1)
        for at in range(0, len(new), 20_000):
            part = new[at:at + 20_000]
            self._fill(part, self.used)
            self.update(zip(part, range(self.used, self.used + len(part))))
            self.used += len(part)


def worst_logits(net: Network, contents: Iterable[bytes], inputs: Inputs, group_bytes: int = 1 << 20) -> Iterator[float]:
    """Per text the largest logit of all its windows. Texts are taken in groups of some size, a long one in parts."""
    group: list[bytes] = []
    size = 0
    for text in contents:
        if group and size + len(text) >= group_bytes:
            yield from _unit_logits(net, [list(units(t)) for t in group], inputs)
            group, size = [], 0
        if len(text) >= group_bytes:
            yield max(_unit_logits(net, [part], inputs)[0] for part in _parts(units(text)))
        else:
            group.append(text)
            size += len(text)
    if group:
        yield from _unit_logits(net, [list(units(t)) for t in group], inputs)


def _parts(stream: Iterator[bytes]) -> Iterator[list[bytes]]:
    """The units of a text, ``SPAN`` at a time and those that the next windows share: the windows are those of the whole."""
    shared = WINDOW - STEP
    part = list(islice(stream, SPAN + shared))
    yield part
    while len(part) == SPAN + shared:
        part = part[SPAN:] + list(islice(stream, SPAN))
        if len(part) > shared:
            yield part


def _unit_logits(net: Network, words: list[list[bytes]], inputs: Inputs) -> list[float]:
    inputs.learn([w for ws in words for w in ws])
    windows = [windows_of(np.fromiter(map(inputs.__getitem__, ws), dtype=np.int64, count=len(ws))) for ws in words]
    rows = np.concatenate(windows)
    logits = np.concatenate([net.forward(inputs.seen, part.T) for part in np.array_split(rows, -(-len(rows) // BLOCK))])
    return np.maximum.reduceat(logits, np.cumsum([0, *map(len, windows)])[:-1]).tolist()


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Network:
    """Fit on documents (doc_id, text) with labels (doc_id, label), on ``sample`` of them at most."""
    chosen = texts(labelled_sample(docs, labels, sample, "toxicity"), "doc_id", "label").orderBy("doc_id")
    return Trainer((list(units(bytes(r["text"]), FIT_PIECE_STEP)), int(r["label"])) for r in chosen.toLocalIterator()).fit()


def score(docs: DataFrame, net: Network) -> DataFrame:
    """The columns of ``docs`` with toxic_score: of the most toxic of all overlapping windows of the whole text.

    NULL texts and texts without words have one empty window, and so the score of the empty text. With one class
    only in the labels every score says that class; without labels it is 0.5. An input column of the result's name is
    dropped.
    """
    docs = without(docs, "toxic_score", "__text")
    names = docs.columns
    at = [name.lower() for name in names].index("text")  # read where it stands: a copy of it would double what a batch holds

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inputs = Inputs(net)
        for batch in stream:
            contents = (t.as_py() or b"" for t in batch.column(at).cast(pa.binary()))
            logits = np.fromiter(worst_logits(net, contents, inputs), dtype=np.float64, count=batch.num_rows)
            scores = _sigmoid(logits + net.shift) if net.constant is None else np.full(len(logits), net.constant)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*names, "toxic_score"])

    return docs.mapInArrow(lean(run), docs.withColumn("toxic_score", F.lit(0.0)).schema)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read_table(spark, sf_dir, "labels").where(remainder("doc_id", FOLDS) != 0)
    scored = score(docs, train(docs, labels.select("doc_id", F.col("toxic").alias("label"))))
    return scored.select("doc_id", (remainder("doc_id", FOLDS) == 0).alias("held_out"), F.col("toxic_score").alias("score"),
                         (F.col("toxic_score") >= 0.5).cast("int").alias("predicted"))
