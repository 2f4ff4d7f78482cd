"""Token-id files with Elias-Fano document boundaries.

``write_token_files`` deals the documents by ranges of ``doc_id`` (and the beginning of the text, so that
one doc id, or none, may belong to any number of rows), encodes each range and
writes it as files of at most ``FILE_IDS`` ids, or one document; ``read_token_files`` reads a folder of them back.  A file holds

* a header: magic, bytes per id, counts of null doc ids, documents and tokens, smallest doc id,
* the doc ids (less the smallest) as an Elias-Fano sequence,
* the document ends as an Elias-Fano sequence with a sampled select structure,
* the concatenated ids, little-endian, two bytes each where the vocabulary allows it.

An Elias-Fano sequence of n values below u takes about n * (2 + log2(u / n)) bits, so no
64-bit offset table exists on disk or in memory; ``select`` gives any single boundary from a
sample and a scan of a few bytes.

Files bear names of their own for each attempt and only those named in the manifest, which
Spark commits, are read; a lost executor's half-written files are therefore never seen.

Defined cases: a null text is empty (a document of the end id alone); null doc ids sort first;
rows that share a doc id keep a place each, ordered by text; extra columns are not stored; an
empty table gives no file and an empty result.
"""

from __future__ import annotations

import itertools
import struct
import uuid
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_map, arrow_rows, fresh_path, give_back, stored, table

MAGIC = b"FLTOKEN1"
HEADER = struct.Struct("<8sBxxxIqqqqq")
END_ID = 2
#: Files of a range, as a power of two.
SHARD_BITS = 20
#: Text given to the tokenizer at once, in bytes.
SLICE_BYTES = 4 << 20
#: Rows of a batch that Spark hands to a task.
BATCH_ROWS = 1_000
#: Ids after which a task closes its file and begins another: what it holds in memory.
FILE_IDS = 16 << 20
#: Characters of the text that part the rows of one doc id into ranges.
RANGE_CHARS = 24
#: Ids that a reader hands on at once.
READ_IDS = 1 << 19
#: Words whose ids a worker remembers.
MEMORY_WORDS = 300_000
#: New words that go through the tokenizer at once, which holds some hundred bytes a character meanwhile.
ABREAST = 2_048


class EliasFano:
    """A non-decreasing sequence of integers in near-minimal space."""

    SAMPLE = 256
    HEAD = struct.Struct("<QQB")

    def __init__(self, n: int, universe: int, low_bits: int, lows: np.ndarray, highs: np.ndarray, samples: np.ndarray):
        self.n, self.universe, self.low_bits, self.lows, self.highs, self.samples = n, universe, low_bits, lows, highs, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, dtype=np.uint64)
        n, universe = len(v), int(v[-1]) + 1 if len(v) else 1
        low_bits = max(0, (universe // max(n, 1)).bit_length() - 1)
        shift = np.uint64(low_bits)
        place = (v >> shift).astype(np.int64) + np.arange(n)
        high = np.zeros(n + (universe >> low_bits) + 1, dtype=np.uint8)
        high[place] = 1
        low = ((v[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        return cls(n, universe, low_bits, np.packbits(low.ravel(), bitorder="little"), np.packbits(high, bitorder="little"), place[:: cls.SAMPLE].astype(np.uint32))

    def _low(self, first: int, count: int) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(count, dtype=np.uint64)
        bit = first * self.low_bits
        bits = np.unpackbits(self.lows[bit // 8 : (bit + count * self.low_bits + 7) // 8], bitorder="little")
        bits = bits[bit % 8 : bit % 8 + count * self.low_bits].reshape(count, self.low_bits)
        return bits.astype(np.uint64) @ (np.uint64(1) << np.arange(self.low_bits, dtype=np.uint64))

    def select(self, i: int) -> int:
        """The i-th value: from the sample before it, skip ones byte by byte."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        k = i // self.SAMPLE
        at = int(self.samples[k])
        left = i - k * self.SAMPLE  # ones to pass after the sampled one
        byte = at // 8
        bits = np.unpackbits(self.highs[byte : byte + 1], bitorder="little")
        bits[: at % 8] = 0
        left += 1
        while (ones := int(bits.sum())) < left:
            left -= ones
            byte += 1
            bits = np.unpackbits(self.highs[byte : byte + 1], bitorder="little")
        at = byte * 8 + int(np.flatnonzero(bits)[left - 1])
        return ((at - i) << self.low_bits) | int(self._low(i, 1)[0])

    def decode(self) -> np.ndarray:
        place = np.flatnonzero(np.unpackbits(self.highs, bitorder="little"))[: self.n]
        return ((place - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits)) | self._low(0, self.n)

    def to_bytes(self) -> bytes:
        return self.HEAD.pack(self.n, self.universe, self.low_bits) + self.lows.tobytes() + self.highs.tobytes() + self.samples.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes | memoryview) -> EliasFano:
        n, universe, low_bits = cls.HEAD.unpack_from(data)
        at = cls.HEAD.size
        parts = []
        for size, kind in (((n * low_bits + 7) // 8, np.uint8), ((n + (universe >> low_bits) + 8) // 8, np.uint8), (-(-n // cls.SAMPLE), np.uint32)):
            parts.append(np.frombuffer(data, dtype=kind, count=size, offset=at))
            at += size * np.dtype(kind).itemsize
        return cls(n, universe, low_bits, *parts)


def shard_parts(doc_ids: list[int | None], counts: np.ndarray, ids: list[np.ndarray]) -> Iterator[bytes | memoryview]:
    """The pieces of one file from doc ids in ascending order (nulls first), ids per document and the ids, which are not copied."""
    known = np.array([x for x in doc_ids if x is not None], dtype=np.int64)
    least = int(known[0]) if len(known) else 0
    docs = EliasFano.of(known.astype(np.uint64) - np.uint64(least % (1 << 64))).to_bytes()
    ends = EliasFano.of(np.cumsum(counts)).to_bytes()
    yield HEADER.pack(MAGIC, ids[0].dtype.itemsize, len(doc_ids) - len(known), len(doc_ids), sum(map(len, ids)), least, len(docs), len(ends))
    yield docs
    yield ends
    for part in ids:
        yield memoryview(np.ascontiguousarray(part, part.dtype.newbyteorder("<")).view(np.uint8))


def pack_shard(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray) -> bytes:
    """One file as bytes."""
    return b"".join(shard_parts(doc_ids, counts, [ids]))


def unpack_shard(data: bytes | memoryview) -> tuple[list[int | None], EliasFano, np.ndarray]:
    magic, width, nulls, n, tokens, least, docs_size, ends_size = HEADER.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a token file")
    view = memoryview(data)[HEADER.size :]
    docs = (EliasFano.from_bytes(view[:docs_size]).decode() + np.uint64(least % (1 << 64))).astype(np.int64)
    ends = EliasFano.from_bytes(view[docs_size : docs_size + ends_size])
    ids = np.frombuffer(view, dtype=f"<u{width}", count=tokens, offset=docs_size + ends_size)
    return [None] * nulls + docs.tolist(), ends, ids


class TextEncoder:
    """Ids of whole texts from a tokenizer that drops white space between words.

    Such a tokenizer maps each word on its own, so a worker encodes each word once and
    remembers it.  Plain lower-case words go straight to the tokenizer's model, all new ones of a slice as one text;
    all others, and all words of tokenizers of another kind, take its full path.
    """

    #: Letters that normalisation leaves alone, beside a-z.
    LETTERS = "ßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿœ"

    def __init__(self, path: str, end_id: int):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = "H" if max(self.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else "I"
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = json.dumps([spec.get("normalizer"), spec.get("pre_tokenizer")])
        self.by_word = '"Lowercase"' in steps and '"Removed"' in steps and spec["model"].get("end_of_word_suffix") is not None and not any(x["lstrip"] or x["rstrip"] for x in spec["added_tokens"])
        self.marks = [x["content"].lower() for x in spec["added_tokens"]]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.spelt = np.arange(256, dtype="<u4")  # the character by which the vocabulary writes a byte
        hidden = np.setdiff1d(self.spelt, shown)
        self.spelt[hidden] = 256 + np.arange(len(hidden))
        self.spelt[32] = 32  # parts the words
        tails = {c: self.tokenizer.encode(c, add_special_tokens=False).ids for c in ".,"}
        suffix, self.bare = spec["model"].get("end_of_word_suffix"), None
        if self.by_word and suffix and all(len(x) == 1 for x in tails.values()):
            self.tails = {c: x[0] for c, x in tails.items()}
            self.is_end = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
            self.is_end[[i for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if token.endswith(suffix)]] = True
            self.bare = Tokenizer(self.tokenizer.model)
            self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.index: dict[str, int] = {}
        self.pool = array(self.kind, [end_id])
        self.starts = array("q", [0, 1])  # entry 0: the end

    def _plain(self, bodies: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of words that normalisation leaves alone, and where each word's end; None if the model does not mark every end."""
        parts = []
        for k in range(0, len(bodies), ABREAST):
            joined = " ".join(bodies[k : k + ABREAST])
            if not joined.isascii():
                joined = self.spelt[np.frombuffer(joined.encode(), np.uint8)].tobytes().decode("utf-32-le")
            parts.append(np.array(self.bare.encode_batch_fast([joined], add_special_tokens=False)[0].ids, dtype=np.uint32))
        ids = np.concatenate(parts)
        ends = np.flatnonzero(self.is_end[ids]) + 1
        return (ids, ends) if len(ends) == len(bodies) and (not len(ends) or ends[-1] == len(ids)) else None

    def _learn(self, words: pa.Array) -> list[str]:
        """Words that are not known yet; the plain ones go through the model as one text, whose words end with marked tokens."""
        plain = pc.match_substring_regex(words, f"^[a-z{self.LETTERS}]+[.,]?$").to_numpy(zero_copy_only=False)
        where = np.flatnonzero(plain)
        names = words.to_numpy(zero_copy_only=False)
        quick, slow, tails = names[where].tolist(), names[~plain].tolist(), []
        if quick:
            taken = words.take(pa.array(where))
            bodies = pc.utf8_rtrim(taken, ".,").to_numpy(zero_copy_only=False).tolist()
            found = self._plain(bodies) if self.bare else None
            if found is None:
                slow, quick = quick + slow, []
            else:
                ids, ends = found
                tails = np.where(pc.ends_with(taken, ".").to_numpy(zero_copy_only=False), self.tails["."], np.where(pc.ends_with(taken, ",").to_numpy(zero_copy_only=False), self.tails[","], -1))
                with_tail = tails >= 0
                ids = np.insert(ids, ends[with_tail], tails[with_tail])
                self._keep(quick, ids, ends + np.cumsum(with_tail))
        if slow:
            for k in range(0, len(slow), ABREAST):
                some = slow[k : k + ABREAST]
                parts = [e.ids for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]
                self._keep(some, np.fromiter(itertools.chain.from_iterable(parts), np.uint32), np.cumsum([len(x) for x in parts]))
        return quick + slow

    def _keep(self, words: list[str], ids: np.ndarray, ends: np.ndarray) -> None:
        first, at = len(self.starts) - 1, len(self.pool)
        self.index.update(zip(words, range(first, first + len(words)), strict=True))
        self.pool.frombytes(ids.astype(self.pool.typecode).tobytes())
        self.starts.frombytes((ends + at).astype(np.int64).tobytes())

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, the end id after each text, and their number by text."""
        if not self.by_word:
            return self._encode_whole(texts)
        lowered = pc.ascii_lower(pc.fill_null(texts, ""))
        if any(pc.any(pc.match_substring(lowered, m)).as_py() for m in self.marks):
            return self._encode_whole(texts)  # lower-casing would forge an added token
        split = pc.ascii_split_whitespace(lowered)
        bounds = split.offsets.to_numpy()
        coded = split.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        had = len(self.starts)
        of = np.fromiter(map(self.index.get, words, itertools.repeat(-1)), dtype=np.int64, count=len(words))
        unknown = np.flatnonzero(of < 0)
        new = self._learn(coded.dictionary.take(pa.array(unknown)))
        of[unknown] = np.fromiter(map(self.index.__getitem__, map(words.__getitem__, unknown.tolist())), dtype=np.int64, count=len(unknown))
        entry = of[coded.indices.to_numpy()]
        ends = bounds[1:] - bounds[0]
        entry = np.insert(entry, ends, 0)
        pool, starts = np.array(self.pool), np.array(self.starts)
        lengths = np.diff(starts)[entry]
        after = np.cumsum(lengths)
        ids = pool[np.repeat(starts[entry] - (after - lengths), lengths) + np.arange(after[-1] if len(after) else 0)]
        text_ends = after[ends + np.arange(len(ends))]
        if len(self.index) > MEMORY_WORDS:  # forget what this slice added
            for w in new:
                del self.index[w]
            del self.pool[self.starts[had - 1] :], self.starts[had:]
        return ids, np.diff(text_ends, prepend=0)

    def _encode_whole(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        found = self.tokenizer.encode_batch_fast([x or "" for x in texts.to_pylist()], add_special_tokens=False)
        kind = np.uint16 if self.kind == "H" else np.uint32
        parts = [np.array([*e.ids, self.pool[0]], dtype=kind) for e in found]
        return np.concatenate(parts or [np.zeros(0, kind)]), np.array([len(p) for p in parts], dtype=np.int64)


_encoders: dict[tuple[str, int], TextEncoder] = {}


def encoder_of(path: str, end_id: int) -> TextEncoder:
    """The encoder of this process.  A task's function must come here for it: what it names itself is sent along, a new dictionary with each task."""
    if (path, end_id) not in _encoders:
        _encoders[path, end_id] = TextEncoder(path, end_id)
    return _encoders[path, end_id]


def text_slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Rows in order, cut so that a slice holds about ``most`` bytes of text, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    at, total = 0, 0
    for k, size in enumerate(sizes):
        if k > at and total + size > most:
            yield batch.slice(at, k - at)
            at, total = k, 0
        total += int(size)
    if at < batch.num_rows:
        yield batch.slice(at)


def write_token_files(docs: DataFrame, directory: str, tokenizer_path: str, end_id: int = END_ID, shards: int | None = None) -> DataFrame:
    """Write the files of ``docs`` (doc_id, text) and return the manifest: shard, name, n_docs, n_tokens."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    shards = shards or max(8, 2 * docs.rdd.getNumPartitions())

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        encoder = encoder_of(tokenizer_path, end_id)
        doc_ids, counts, parts, held, files = [], [], [], 0, 0

        def close() -> pa.RecordBatch:
            shard = (TaskContext.get().partitionId() << SHARD_BITS) + files
            name = f"{shard:016d}-{uuid.uuid4().hex}.tok"
            store, root = fs.FileSystem.from_uri(directory)
            store.create_dir(root, recursive=True)
            with store.open_output_stream(f"{root}/{name}") as out:
                for piece in shard_parts(doc_ids, np.concatenate(counts), parts):
                    out.write(piece)
            return pa.RecordBatch.from_pydict({"shard": [shard], "name": [name], "n_docs": [len(doc_ids)], "n_tokens": [held]})

        for batch in batches:
            for rows in text_slices(batch, "text"):
                ids, n = encoder.encode(rows.column("text"))
                parts.append(ids)
                counts.append(n)
                doc_ids += rows.column("doc_id").to_pylist()
                held += len(ids)
                give_back()
                if held >= FILE_IDS:
                    yield close()
                    doc_ids, counts, parts, held, files = [], [], [], 0, files + 1
        if doc_ids:
            yield close()
            doc_ids, counts, parts = [], [], []
            give_back()

    first = F.col("doc_id").asc_nulls_first()
    dealt = docs.repartitionByRange(shards, first, F.substring("text", 1, RANGE_CHARS).asc_nulls_first()).sortWithinPartitions(first, F.col("text").asc_nulls_first())
    with arrow_rows(docs.sparkSession, BATCH_ROWS):
        return stored(arrow_map(dealt, write, "shard long, name string, n_docs long, n_tokens long"), "token-manifest")


def read_token_files(spark: SparkSession, directory: str, manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids before the document in all files), n_tokens, ids (unsigned 32-bit, little-endian)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(directory)
        for batch in batches:
            for name in batch.column("name").to_pylist():
                with store.open_input_file(f"{root}/{name}") as file:
                    doc_ids, boundary, ids = unpack_shard(file.read_buffer())
                ends = boundary.decode().astype(np.int64)
                at = 0
                while at < len(ends):
                    base = int(ends[at - 1]) if at else 0
                    to = max(at + 1, int(np.searchsorted(ends, base + READ_IDS, side="right")))
                    own = ends[at:to]
                    starts = np.concatenate(([base], own[:-1]))
                    data = ids[base : own[-1]].astype("<u4")
                    offsets = np.concatenate(([0], own - base)).astype(np.int32) * 4
                    blob = pa.Array.from_buffers(pa.binary(), len(own), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(own)), pa.array(doc_ids[at:to], pa.int64()), pa.array(starts), pa.array(own - starts), blob],
                        ["name", "doc_id", "local_start", "n_tokens", "ids"],
                    )
                    at = to
                del doc_ids, boundary, ids
                give_back()

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tok").load(directory)
    named = files.select(F.substring_index("path", "/", -1).alias("name"))  # dealt to tasks by size; their content stays out of the JVM
    found = arrow_map(named, read, "name string, doc_id long, local_start long, n_tokens long, ids binary")
    # prefix sums over shards in two levels, so that no task holds more than a block of them
    block = Window.partitionBy("block").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = manifest.withColumn("block", F.floor(F.col("shard") / (512 << SHARD_BITS)))
    totals = shards.groupBy("block").agg(F.sum("n_tokens").alias("t")).withColumn("before", F.coalesce(F.sum("t").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    bases = shards.withColumn("inside", F.coalesce(F.sum("n_tokens").over(block), F.lit(0))).join(totals.select("block", "before"), "block").select("name", (F.col("inside") + F.col("before")).alias("base"))
    return found.join(bases, "name").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids")


def token_output(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """Write and read back; the result of the operator as rows."""
    spark = docs.sparkSession
    directory = fresh_path(spark, "tokens")
    manifest = write_token_files(docs, directory, tokenizer_path, end_id)
    if manifest.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids binary")
    return read_token_files(spark, directory, manifest)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_output(table(spark, sf_dir, "documents"), default_tokenizer())
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
