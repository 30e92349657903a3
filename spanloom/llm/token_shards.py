"""Token ids in binary shards: a wavelet matrix per shard, in one compressed file."""

from __future__ import annotations

from collections.abc import Callable, Iterator
import os
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
import zstandard

from spanloom.llm.common import free, kept, read_table, setting, stored, trimmed, work_folder, write_file

#: Id put after each document, bytes of text a shard takes about, bits between stored rank counts.
END_ID, SHARD_BYTES, RANK_STEP = 2, 12 << 20, 512
VOCABULARY = "byte_bpe_50k.json"
#: How a blank and a line feed are written in the vocabulary's tokens (fixed). Pieces of text a worker keeps the ids of,
#: and bytes of text it encodes in one go.
LINE, HELD_PIECES, PORTION = "\n", 600_000, 6 << 20
#: Bytes of a batch that Spark sends a writing task, and ids (a multiple of 8) that are dealt to the next plane at a time.
BATCH, STRETCH = "2m", 1 << 18
WRITTEN = {"Ġ": " ", "Ċ": LINE}
#: Signs that are cut off the end of a word, behind a letter or digit before this character.
TAIL, LATIN_END = ".,;:!?*$&%#@", "\u0250"
_HEADER = struct.Struct("<4sHHQQ")


def stretches(size: int, step: int = STRETCH) -> Iterator[slice]:
    return (slice(a, min(a + step, size)) for a in range(0, size, step))


class WaveletMatrix:
    """A sequence of ids as one plane of bits per binary digit. Each plane puts ids with a 0 before those with a 1."""

    def __init__(self, planes: list[np.ndarray], size: int):
        self.planes, self.size, self.bits = planes, size, len(planes)
        self.ones = [self._counts(p) for p in planes]
        self.zeros = [size - int(c[-1]) for c in self.ones]

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        bits = max(int(ids.max()).bit_length() if len(ids) else 1, 1)
        ids, planes = ids.astype(np.uint16 if bits <= 16 else np.uint32), []
        for b in range(bits - 1, -1, -1):
            one, dealt = np.empty(len(ids), dtype=bool), np.empty_like(ids)
            for part in stretches(len(ids)):  # on the way, an id takes many times its bytes
                np.not_equal(ids[part] & ids.dtype.type(1 << b), 0, out=one[part])
            planes.append(np.packbits(one, bitorder="little"))
            at, at_one = 0, len(ids) - np.count_nonzero(one)
            for part in stretches(len(ids)):
                for kind, to in ((~one[part], at), (one[part], at_one)):
                    found = np.compress(kind, ids[part])
                    dealt[to:to + len(found)] = found
                at, at_one = at + len(kind) - len(found), at_one + len(found)
            ids = dealt
        return cls(planes, len(ids))

    def _counts(self, plane: np.ndarray) -> np.ndarray:
        """Ones before every RANK_STEP bits, and in all."""
        step = RANK_STEP // 8
        padded = np.zeros(-(-max(len(plane), 1) // step) * step, np.uint8)
        padded[:len(plane)] = plane
        return np.concatenate([[0], np.cumsum(np.bitwise_count(padded).reshape(-1, step).sum(axis=1, dtype=np.int64))])

    def _rank(self, level: int, at: int) -> int:
        """Ones among the first ``at`` bits of a plane."""
        block = at // RANK_STEP
        low = block * RANK_STEP // 8
        part = np.unpackbits(self.planes[level][low:-(-at // 8)], bitorder="little")[:at - block * RANK_STEP]
        return int(self.ones[level][block]) + int(part.sum())

    def access(self, at: int) -> int:
        """The id at a place."""
        value = 0
        for level in range(self.bits):
            bit = int(self.planes[level][at >> 3] >> (at & 7) & 1)
            one = self._rank(level, at)
            at = self.zeros[level] + one if bit else at - one
            value = value << 1 | bit
        return value

    def _range(self, token: int, low: int, high: int) -> tuple[int, int]:
        """Where the places [low, high) that hold the token stand after the last plane."""
        for level in range(self.bits):
            a, b = self._rank(level, low), self._rank(level, high)
            if token >> (self.bits - 1 - level) & 1:
                low, high = self.zeros[level] + a, self.zeros[level] + b
            else:
                low, high = low - a, high - b
        return low, high

    def count(self, token: int, low: int = 0, high: int | None = None) -> int:
        """How often a token stands in [low, high)."""
        if token >> self.bits:
            return 0
        a, b = self._range(token, low, self.size if high is None else high)
        return b - a

    def _select(self, level: int, bit: int, k: int) -> int:
        """Place of the k-th (from 0) bit of a kind in a plane."""
        counts = self.ones[level] if bit else np.arange(len(self.ones[level])) * RANK_STEP - self.ones[level]
        block = int(np.searchsorted(counts, k, side="right")) - 1
        low = block * RANK_STEP // 8
        part = np.unpackbits(self.planes[level][low:low + RANK_STEP // 8], bitorder="little")
        return block * RANK_STEP + int(np.flatnonzero(part == bit)[k - int(counts[block])])

    def occurrence(self, token: int, k: int) -> int:
        """Place of the k-th (from 0) occurrence of a token; -1 if there are fewer."""
        if token >> self.bits:
            return -1
        low, high = self._range(token, 0, self.size)
        if k >= high - low:
            return -1
        at = low + k
        for level in range(self.bits - 1, -1, -1):
            bit = token >> (self.bits - 1 - level) & 1
            at = self._select(level, bit, at - self.zeros[level] if bit else at)
        return at

    def decode(self) -> np.ndarray:
        """All ids, from the last plane up."""
        ids = np.zeros(self.size, np.uint16 if self.bits <= 16 else np.uint32)
        for level in range(self.bits - 1, -1, -1):
            one = np.unpackbits(self.planes[level], count=self.size, bitorder="little").astype(bool)
            before, bit, at, at_one = np.empty_like(ids), ids.dtype.type(1 << (self.bits - 1 - level)), 0, self.zeros[level]
            for part in stretches(self.size):
                places = np.flatnonzero(~one[part])
                before[part][places] = ids[at:at + len(places)]
                at += len(places)
                places = np.flatnonzero(one[part])
                before[part][places] = ids[at_one:at_one + len(places)] | bit
                at_one += len(places)
            ids = before
        return ids


def dump_shard(ids: np.ndarray, doc_ids: list[int | None], lengths: list[int]) -> bytes:
    """Header, compressed document table (ids, whether known, lengths), then each plane compressed by itself."""
    wavelet, packer = WaveletMatrix.build(ids), zstandard.ZstdCompressor(level=3)
    table = b"".join([np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array([d is not None for d in doc_ids], "u1").tobytes(), np.array(lengths, "<i8").tobytes()])
    blocks = [packer.compress(b) for b in (table, *(p.tobytes() for p in wavelet.planes))]
    return b"".join([_HEADER.pack(b"WVM1", wavelet.bits, len(blocks), len(ids), len(doc_ids)), np.array([len(b) for b in blocks], "<u8").tobytes(), *blocks])


def load_shard(content: bytes) -> tuple[WaveletMatrix, list[int | None], np.ndarray]:
    magic, bits, n_blocks, size, n = _HEADER.unpack_from(content)
    if magic != b"WVM1":
        raise ValueError("not a shard of token ids")
    lengths = np.frombuffer(content, "<u8", n_blocks, _HEADER.size)
    ends = _HEADER.size + 8 * n_blocks + np.cumsum(np.concatenate([[0], lengths])).astype(np.int64)
    table, *planes = (zstandard.ZstdDecompressor().decompress(content[a:b]) for a, b in zip(ends, ends[1:]))
    ids, known = np.frombuffer(table, "<i8", n), np.frombuffer(table, "u1", n, 8 * n)
    return WaveletMatrix([np.frombuffer(p, np.uint8) for p in planes], size), [int(d) if k else None for d, k in zip(ids, known)], np.frombuffer(table, "<i8", n, 9 * n)


def _runs(pool: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Runs of ids, one after another."""
    out, size = [pool[:0]], 1 << 18
    for at in range(0, len(lengths), size):  # on the way, an id takes many times its bytes
        part = lengths[at:at + size]
        ends = np.cumsum(part, dtype=np.int64)
        places = np.repeat(begins[at:at + size] - (ends - part), part)
        places += np.arange(len(places))
        out.append(pool[places])
    return np.concatenate(out)


def _spaced(words: pa.Array) -> np.ndarray:
    """Whether a word is empty, or begins or ends with white space."""
    changed = pc.not_equal(pc.binary_length(pc.utf8_trim_whitespace(words)), pc.binary_length(words))
    return pc.or_(changed, pc.equal(words, "")).to_numpy(zero_copy_only=False)


class Encoder:
    """Ids of texts by the tokenizers library, which is asked once for each piece of text that recurs.

    The vocabulary's own rule lets no token cross from a letter, digit or sign to the blank after it. So a text in
    which blanks stand alone falls into words that begin with their blank. By the same rule a word falls apart before a
    line feed that stands alone and, behind a letter or digit, before the signs of ``TAIL`` that it ends with. New pieces
    are encoded many in one string: a token that begins with a blank, or a line feed, begins a piece. Any other text is
    encoded whole. The added token neither strips blanks nor begins with one, so it stands where the library puts it: in
    the text, as its own id. Nothing is cut at a sign it holds.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.kind = np.dtype(np.uint16 if size <= 1 << 16 else np.uint32)
        self.begins = {mark: np.zeros(size, dtype=bool) for mark in WRITTEN.values()}
        for token, i in self.tokenizer.get_vocab().items():
            if token[0] in WRITTEN:
                self.begins[WRITTEN[token[0]]][i] = True
        added = "".join(token.content for token in self.tokenizer.get_added_tokens_decoder().values())
        self.tail, self.lines = "".join(c for c in TAIL if c not in added), LINE not in added
        self._forget()

    def _forget(self) -> None:
        """Pieces that are held, where the ids of each begin, how many it has, and all ids."""
        self.held, self.at, self.sizes, self.pool = pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, self.kind)

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=self.kind)

    def encode(self, texts_: list[str]) -> list[bytes]:
        ids, lengths = self.encoded(pa.array(texts_, pa.string()))
        return [x.astype("<u4").tobytes() for x in np.split(ids, np.cumsum(lengths))[:-1]]

    def encoded(self, texts_: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and how many each has."""
        if not len(texts_):
            return self.pool[:0], np.zeros(0, np.int64)
        split = pc.split_pattern(texts_, " ")
        firsts, later = split.offsets.to_numpy()[:-1], np.ones(len(split.values), dtype=bool)
        later[firsts] = False
        openers = split.values.take(pa.array(firsts))
        coded = split.values.filter(pa.array(later)).dictionary_encode()
        del split
        pool, at, sizes, bad = self._words(coded.dictionary)
        rows = coded.indices.to_numpy()
        begins, lengths, wrong = np.zeros(len(later), np.int64), np.zeros(len(later), np.int32), np.zeros(len(later), dtype=bool)
        begins[later], lengths[later], wrong[later], wrong[firsts] = at[rows], sizes[rows], bad[rows], _spaced(openers)
        del coded, rows, later
        whole = np.logical_or.reduceat(wrong, firsts)
        lengths[np.repeat(whole, np.diff(firsts, append=len(lengths)))] = 0
        heads, size = [pool], len(pool)
        for i, (first, opener) in enumerate(zip(firsts.tolist(), openers.to_pylist())):
            heads.append(self.ids(texts_[i].as_py() if whole[i] else opener))
            begins[first], lengths[first] = size, len(heads[-1])
            size += len(heads[-1])
        return _runs(np.concatenate(heads), begins, lengths), np.add.reduceat(lengths, firsts, dtype=np.int64)

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids; where those of each word (after a blank) begin, how many it has, and whether it may not be taken by itself."""
        if not len(words):
            return self.pool[:0], np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, bool)
        bad, alone, counts = _spaced(words), np.zeros(len(words), dtype=bool), np.ones(len(words), np.int64)
        parts = words.filter(pa.array(~bad))
        if self.lines:
            split = pc.split_pattern(words, LINE)
            counts = np.diff(split.offsets.to_numpy()).astype(np.int64)
            alone = ~np.logical_or.reduceat(_spaced(split.values), split.offsets.to_numpy()[:-1])
            parts = pa.concat_arrays([split.values.filter(pa.array(np.repeat(alone, counts))), words.filter(pa.array(~alone & ~bad))])
            del split
        # Words that fall into lines first, then those that stay whole.
        order = np.concatenate([np.flatnonzero(alone), np.flatnonzero(~alone & ~bad)])
        counts = np.where(alone, counts, 1)[order]
        opening = np.concatenate([[0], np.cumsum(counts)])
        leads = np.zeros(len(parts), dtype=bool)
        leads[opening[:-1]] = True
        core = pc.utf8_rtrim(parts, characters=self.tail)
        last = pc.utf8_slice_codeunits(core, start=-1)
        core = pc.if_else(pc.and_(pc.utf8_is_alnum(last), pc.less(last, LATIN_END)), core, parts)
        tailed = pc.not_equal(core, parts)
        tails = [p[len(c):] for p, c in zip(parts.filter(tailed).to_pylist(), core.filter(tailed).to_pylist())]
        tailed = tailed.to_numpy(zero_copy_only=False)
        core = pc.binary_join_element_wise(pc.if_else(pa.array(leads), " ", LINE), core, "")
        rows = self._rows(pa.concat_arrays([core, pa.array(tails, pa.string())]))
        place = np.arange(len(parts)) + np.cumsum(tailed) - tailed
        pieces = np.empty(len(rows), np.int64)
        pieces[place], pieces[place[tailed] + 1] = rows[:len(parts)], rows[len(parts):]
        ends = np.concatenate([[0], np.cumsum(self.sizes[pieces], dtype=np.int64)])[np.append(place, len(pieces))[opening]]
        at, sizes = np.zeros(len(words), np.int64), np.zeros(len(words), np.int32)
        at[order], sizes[order] = ends[:-1], np.diff(ends)
        return _runs(self.pool, self.at[pieces], self.sizes[pieces]), at, sizes, bad

    def _rows(self, pieces: pa.Array) -> np.ndarray:
        """Rows of pieces among those held; new ones are encoded."""
        coded = pa.concat_arrays([self.held, pieces]).dictionary_encode()
        if len(coded.dictionary) > HELD_PIECES and len(self.held):
            self._forget()
            coded = pieces.dictionary_encode()
        rows = coded.indices.to_numpy()[len(self.held):]
        new = coded.dictionary[len(self.held):]
        at, sizes, found, size = np.zeros(len(new), np.int64), np.zeros(len(new), np.int32), [self.pool], len(self.pool)
        mark = pc.utf8_slice_codeunits(new, start=0, stop=1)
        for lead in (" ", LINE, None):
            group = np.flatnonzero((pc.equal(mark, lead) if lead else pc.invert(pc.is_in(mark, pa.array([" ", LINE])))).to_numpy(zero_copy_only=False))
            for part in (group[i:i + 2048] for i in range(0, len(group), 2048)):
                ids, lengths = self._learn(new.take(pa.array(part)).to_pylist(), lead)
                at[part], sizes[part] = size + np.cumsum(lengths) - lengths, lengths
                found.append(ids)
                size += len(ids)
        self.held, self.at, self.sizes = coded.dictionary, np.concatenate([self.at, at]), np.concatenate([self.sizes, sizes])
        self.pool = np.concatenate(found)
        return rows

    def _learn(self, pieces: list[str], lead: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces that all begin with ``lead``, and how many each has."""
        if lead:
            ids = self.ids("".join(pieces))
            return ids, np.diff(np.flatnonzero(self.begins[lead][ids]), append=len(ids))
        found = [self.ids(p) for p in pieces]
        return np.concatenate(found), np.array([len(x) for x in found])


def encoder(path: str) -> Encoder:
    """One for each worker and vocabulary."""
    return kept(f"encoder {path}", lambda: Encoder(path))


def portions(texts_: pa.Array, limit: int = PORTION) -> Iterator[pa.Array]:
    """Texts, about so many bytes at a time; a longer one by itself or with some."""
    before = np.cumsum(pc.binary_length(texts_).to_numpy(), dtype=np.int64) // limit
    edges = [0, *(np.flatnonzero(np.diff(before)) + 1).tolist(), len(texts_)]
    return (texts_.slice(a, b - a) for a, b in zip(edges, edges[1:]))


def gathered(stream: Iterator[pa.RecordBatch], limit: int = PORTION) -> Iterator[pa.RecordBatch]:
    """Small batches joined to at most so many bytes; a larger one by itself."""
    held, size = [], 0
    for batch in stream:
        if held and size + batch.nbytes > limit:
            yield pa.concat_batches(held)
            held, size = [], 0
        held.append(batch)
        size += batch.nbytes
    if held:
        yield pa.concat_batches(held)


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def write_shards(docs: DataFrame, folder: str, shard_bytes: int = SHARD_BYTES, path: Callable[[], str] | None = None) -> DataFrame:
    """Write shards of all documents in order of doc_id (NULL first) and return a row per shard (shard, n_tokens).

    Texts are dealt by ranges of doc_id and of a hash of the text, sorted, encoded and written by the same task.
    ``path`` names the vocabulary file where the task runs. An empty table writes no shard.
    """
    where = path or vocabulary_path
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    total = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1)).first()[0] or 0
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    dealt = docs.repartitionByRange(max(1, -(-int(total) // shard_bytes)), *order).sortWithinPartitions(*order)
    schema = pa.schema([("shard", pa.int64()), ("n_tokens", pa.int64())])

    def write(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tool, doc_ids, parts, counts = encoder(where()), [], [], []
        for batch in gathered(stream):
            doc_ids += batch.column(0).to_pylist()
            for texts_ in portions(batch.column(1).cast(pa.string()).fill_null("")):
                ids, lengths = tool.encoded(texts_)
                parts.append(np.insert(ids, np.cumsum(lengths), END_ID))
                counts += (lengths + 1).tolist()
        if doc_ids:
            shard, ids = TaskContext.get().partitionId(), np.concatenate(parts)
            del parts, batch, texts_
            free()  # what encoding leaves does not stand beside the planes
            write_file(f"{folder}/shard-{shard:08d}.wvm", [dump_shard(ids, doc_ids, counts)])
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([len(ids)], pa.int64())], schema=schema)

    with setting(docs.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch", BATCH):  # else a shard's texts are sent in one batch
        return stored(dealt.mapInArrow(trimmed(write), "shard long, n_tokens long"), "token-shards")


def read_shards(spark: SparkSession, folder: str) -> DataFrame:
    """(shard, place, doc_id, before, n_tokens, ids_crc32) of every document in the files of a folder."""
    schema = pa.schema([("shard", pa.int64()), ("place", pa.int64()), ("doc_id", pa.int64()), ("before", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                wavelet, doc_ids, lengths = load_shard(content.as_buffer().to_pybytes())
                ids, ends = wavelet.decode(), np.cumsum(lengths)
                crcs = [zlib.crc32(ids[e - n:e].astype("<u4")) for e, n in zip(ends.tolist(), lengths.tolist())]
                size = len(doc_ids)
                shard = int(path.rsplit("-", 1)[1].split(".")[0])
                columns = (np.full(size, shard), np.arange(size), doc_ids, ends - lengths, lengths, crcs)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=schema)

    shape = T.StructType([T.StructField(n, T.LongType()) for n in schema.names])
    files = spark.read.schema("path string, modificationTime timestamp, length long, content binary").format("binaryFile")
    return files.option("pathGlobFilter", "*.wvm").load(folder).select("path", "content").mapInArrow(trimmed(run), shape)


def token_shards(docs: DataFrame, folder: str | None = None, shard_bytes: int = SHARD_BYTES, path: Callable[[], str] | None = None) -> DataFrame:
    """Encode, write and read back: (doc_id, start, n_tokens, ids_crc32), one row per document.

    NULL and empty texts have the end id alone. Repeated rows are each written. Columns besides doc_id and text are
    ignored; an empty table gives an empty result.
    """
    from pyspark.sql import Window

    spark = docs.sparkSession
    folder = folder or work_folder(spark, "shards")
    sizes = write_shards(docs, folder, shard_bytes, path)
    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("shard", before.alias("offset"))
    if not sizes.take(1):
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    found = read_shards(spark, folder).join(F.broadcast(offsets), "shard")  # one row of two numbers per shard
    return found.select("doc_id", (F.col("before") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def op3_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_shards(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
