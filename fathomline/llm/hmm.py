"""Hidden Markov language model: Baum-Welch over the whole training corpus, exact forward scores.

Model.  ``STATES`` latent states emit words.  The most frequent words are *symbols* of their own, all
other words fall into classes by their last three bytes, and the end of a text is a symbol.  State s emits
word w of class k with

    p(k | s) * (c(w) + 0.1) / (C(k) + 0.1 * (n(k) + 1)) * q(s | w) / Z(s, k)
    q(s | w) = (E(s, w) + share(s, k)) / (c(w) + 1)

with c(w) its training count, C and n the class's tokens and distinct words (the last term keeps a share
for unseen words), E(s, w) the expected count of w in state s over all training texts, share(s, k) the
class's share of tokens in s, and Z what makes the class sum to one.  E is a table with a row for every
training word, so what is learnt grows with the corpus; the symbols only carry the passes before.

1. Counts of all training words: summed in the tasks, then by a shuffle.
2. The most frequent words, at most ``LOOKUP``, are handed to the tasks (a bound by construction); one
   pass writes each text as codes plus its remaining words.
3. Baum-Welch: ``SETTLING`` + ``PASSES`` passes, each over every training text from its first word to its end; tasks
   emit expected counts by symbol, a shuffle sums them.  The last pass also sums E by word.
4. E of the words that are not looked up is joined to the texts that have them; a scaled forward
   recursion over each whole text gives its exact probability, summed over state paths.

Texts of any length are walked in blocks: the forward vectors at the blocks' edges are kept and the block
is done again on the way back, so memory is bounded and nothing is cut.

Defined cases: a null text is empty (an end alone); a null doc_id counts as the empty string when texts
are dealt into training and held-out; repeated rows are scored row by row and count as often as they
occur; extra columns are dropped; an empty table gives an empty result, and without training texts all
tokens are unknown and the model is uniform over its symbols.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, arrow_rows, fresh_path, give_back, shuffles_dropped, stored, table
from .tokenout import BATCH_ROWS, text_slices
from .words import coded_words

STATES = 8
OWN_SYMBOLS = 16_384
CLASSES = 2_048
LOOKUP = 262_144
LOOKUP_BYTES = 64
#: Passes that settle the states from their random start, and passes after them; each reads every training text.
SETTLING = 4
PASSES = 3
#: Steps times sequences of a block, and tokens walked side by side.
BLOCK_TOKENS = 1 << 15
#: Steps times sequences whose vectors are kept for the way back, from the beginning on; those of all others are made again.
HELD_TOKENS = 1 << 15
#: Sequences walked side by side, and steps after which vectors are scaled.
ABREAST = 512
SCALED = 8
WAITING_TOKENS = 1 << 22
#: Looked-up words whose counts travel as one row.
LOOKED_ROWS = 1_024
#: Tasks of a pass over the corpus, at most: each emits up to SYMBOLS rows.
TASKS = 2_048
#: Rows of an encoding task, as a power of two.
PART_BITS = 40
#: Pseudo-counts of an emission row, shared out by the symbols' frequency.
PRIOR = 20.0
ADD = 0.1
#: Weight of a class's own share against a word's expected counts.
ALPHA = 1.0
END = OWN_SYMBOLS + CLASSES
SYMBOLS = END + 1


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(10)) == 0


def word_classes(words: pa.Array) -> np.ndarray:
    """Class of each word: a hash of its last three bytes."""
    n = len(words)
    if not n:
        return np.zeros(0, np.int64)
    words = words.cast(pa.large_string())
    _, offsets, data = words.buffers()
    ends = np.frombuffer(offsets, np.int64, count=n + 1, offset=words.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(1, np.uint8)
    code = np.zeros(n, np.uint64)
    for k in (3, 2, 1):
        at = ends[1:] - k
        code = code * np.uint64(257) + np.where(at >= ends[:-1], raw[np.clip(at, 0, len(raw) - 1)].astype(np.uint64) + np.uint64(1), np.uint64(0))
    return ((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % CLASSES


def count_words(train: DataFrame) -> DataFrame:
    """word, c over all rows of train (text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in text_slices(batch, "text", 8 << 20):
                codes, words, _ = coded_words(rows.column("text"))
                n = np.bincount(codes, minlength=len(words))
                seen = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([words.take(pa.array(seen)), pa.array(n[seen].astype(np.int64))], ["word", "c"])

    return arrow_map(train.select("text"), count, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    """What tasks need to know of words; bounded by LOOKUP and CLASSES."""

    words: pa.Array
    counts: np.ndarray
    class_tokens: np.ndarray
    class_words: np.ndarray
    tokens: int
    distinct: int

    def class_log(self, counts: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """log10 of a word's share of its class."""
        return np.log10((counts + ADD) / self.whole[classes])

    @property
    def whole(self) -> np.ndarray:
        return self.class_tokens + ADD * (self.class_words + 1)

    @property
    def own(self) -> int:
        return min(OWN_SYMBOLS, len(self.words))

    def symbol_of_code(self) -> np.ndarray:
        """The symbol of each looked-up word, and of the end, which comes after them."""
        rest = OWN_SYMBOLS + word_classes(self.words.slice(self.own))
        return np.concatenate([np.arange(self.own), rest, [END]]).astype(np.int64)


def vocabulary(counts: DataFrame, texts: int) -> Vocabulary:
    """From all counts: the looked-up words, most frequent first, and the totals by class."""
    grade = F.floor(F.log2(F.col("c").cast("double")) * 16).cast("int")
    short = F.octet_length("word") <= LOOKUP_BYTES
    graded = counts.select(grade.alias("grade"), "c", short.alias("short"))
    bins = graded.groupBy("grade").agg(F.count("*").alias("n"), F.sum("c").alias("c"), F.sum(F.col("short").cast("long")).alias("s")).orderBy(F.desc("grade")).collect()
    total, distinct = sum(r["c"] for r in bins), sum(r["n"] for r in bins)
    room, least = LOOKUP, 1 << 30
    for r in bins:  # whole grades from the top, as long as they fit
        if r["s"] > room:
            break
        room -= r["s"]
        least = r["grade"]
    top = counts.filter((grade >= least) & short).toArrow().sort_by([("c", "descending"), ("word", "ascending")])
    words = top["word"].combine_chunks().cast(pa.string()) if top.num_rows else pa.array([], pa.string())
    own = words.slice(0, OWN_SYMBOLS)
    cut = top["c"][OWN_SYMBOLS - 1].as_py() if len(words) >= OWN_SYMBOLS else 0

    def by_class(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            high = pc.greater_equal(batch.column("c"), cut)
            rest = batch.filter(pc.invert(pc.and_(high, pc.is_in(batch.column("word"), value_set=own))))
            classes = word_classes(rest.column("word"))
            n = np.bincount(classes, minlength=CLASSES)
            c = np.zeros(CLASSES, np.int64)
            np.add.at(c, classes, rest.column("c").to_numpy())
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict({"k": at.astype(np.int32), "n": n[at].astype(np.int64), "c": c[at]})

    class_tokens, class_words = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
    for r in arrow_map(counts, by_class, "k int, n long, c long").groupBy("k").agg(F.sum("n").alias("n"), F.sum("c").alias("c")).collect():
        class_tokens[r["k"]], class_words[r["k"]] = r["c"], r["n"]
    ends = 1 if texts else 0
    return Vocabulary(words, top["c"].to_numpy().astype(np.int64), class_tokens, class_words, total + texts, distinct + ends)


ENCODED = "row_id long, doc_id long, held_out boolean, n_tokens long, n_known long, base_log double, class_log double, codes binary, rare array<struct<word:string,n:int,k:int>>"


def encode(docs: DataFrame, v: Vocabulary) -> DataFrame:
    """Each text as codes, with what the looked-up words give and its other words.

    A code is the number of a looked-up word, ``len(v.words)`` for the end, or beyond it a place in ``rare``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << PART_BITS
        known_log = np.log10(v.counts + ADD)
        own, end = v.own, len(v.words)
        for batch in batches:
            for rows in text_slices(batch, "text", 4 << 20):
                codes, words, counts = coded_words(rows.column("text"))
                at = pc.index_in(words, value_set=v.words).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
                classes = word_classes(words)
                known = at >= 0
                base = np.where(known, known_log[np.maximum(at, 0)] if len(known_log) else 0.0, 0.0)
                within = np.zeros(len(words))
                mid = at >= own
                within[mid] = v.class_log(v.counts[at[mid]], classes[mid])
                ends = np.cumsum(counts)
                starts = ends - counts
                n = len(counts)

                def summed(x, starts=starts, ends=ends, codes=codes):
                    total = np.concatenate(([0.0], np.cumsum(x[codes])))
                    return total[ends] - total[starts]

                # the other words, counted and numbered by text
                rare = np.flatnonzero(~known[codes])
                of = np.searchsorted(ends, rare, side="right")
                pair, which, times = np.unique(of * len(words) + codes[rare], return_inverse=True, return_counts=True)
                text, word = pair // max(len(words), 1), pair % max(len(words), 1)
                first = np.searchsorted(text, np.arange(n + 1))
                flat = at[codes]
                flat[rare] = end + 1 + which - first[of]
                flat = np.insert(flat, ends, end).astype("<u4")
                bounds = (np.concatenate(([0], ends)) + np.arange(n + 1)).astype(np.int64)
                fields = [words.take(pa.array(word)), pa.array(times.astype(np.int32)), pa.array(classes[word].astype(np.int32))]
                lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.StructArray.from_arrays(fields, ["word", "n", "k"]))
                blob = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((bounds * 4).astype(np.int32)), pa.py_buffer(flat)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row + np.arange(n)), rows.column("doc_id"), rows.column("held_out"), pa.array(counts + 1), pa.array(summed(known.astype(float)).round().astype(np.int64)),
                     pa.array(summed(base)), pa.array(summed(within)), blob, lists],
                    ["row_id", "doc_id", "held_out", "n_tokens", "n_known", "base_log", "class_log", "codes", "rare"],
                )
                row += n

    return arrow_map(docs.select("doc_id", "text", "held_out"), run, ENCODED)


@dataclass
class Model:
    start: np.ndarray  # states
    move: np.ndarray  # states x states
    emit: np.ndarray  # states x symbols


class Expected:
    """Expected counts of one E-step; they add up over sequences, tasks and partitions."""

    def __init__(self, states: int):
        self.start, self.move, self.emit, self.log = np.zeros(states), np.zeros((states, states)), np.zeros((states, SYMBOLS)), 0.0

    def add(self, model: Model, sequences: list[np.ndarray], words: list[np.ndarray] | None = None, distinct: int = 0, looked: np.ndarray | None = None) -> np.ndarray:
        """Forward-backward over sequences of symbols side by side, longest first.

        Returns expected counts (distinct, states) by the numbers in ``words``, where they are given; the lowest
        numbers, as many as ``looked`` has rows, are added to it instead and the others count from there; -1 is not counted.
        """
        by_word = np.zeros((distinct, len(model.start)))
        order = sorted((j for j in range(len(sequences)) if len(sequences[j])), key=lambda j: -len(sequences[j]))
        peak = model.emit.max(axis=0)
        table = np.ones((SYMBOLS + 1, len(model.start)))  # beyond a text's end everything fits: states move on and change nothing
        np.divide(model.emit.T, peak[:, None], out=table[:-1], where=peak[:, None] > 0)
        seen, counted = np.zeros(SYMBOLS + 1, np.int64), []
        for k in range(0, len(order), ABREAST):
            mine = order[k : k + ABREAST]
            self._add(model, table, [sequences[j] for j in mine], [words[j] for j in mine] if words else None, seen, counted)
        at = np.flatnonzero(seen[:-1])
        self.log += float(seen[at] @ np.log(peak[at]))
        if counted:
            numbers, first = np.concatenate([x for x, _ in counted]), 0 if looked is None else len(looked)
            low = numbers < first
            for k in range(len(model.start)):
                weights = np.concatenate([x[k] for _, x in counted])
                if first:
                    looked[:, k] += np.bincount(numbers[low], weights=weights[low], minlength=first)
                by_word[:, k] += np.bincount(numbers[~low] - first, weights=weights[~low], minlength=distinct)
        return by_word

    def _add(self, model: Model, table: np.ndarray, seqs: list[np.ndarray], words: list[np.ndarray] | None, seen: np.ndarray, counted: list) -> None:
        """Vectors are scaled every ``SCALED`` steps; in between no emission (1 at most) and no move can bring them near zero."""
        lengths = np.array([len(s) for s in seqs])
        steps, n, states = int(lengths[0]), len(seqs), len(model.start)
        live = n - np.searchsorted(lengths[::-1], np.arange(steps), side="right")
        move, back = np.ascontiguousarray(model.move.T), np.ascontiguousarray(model.move)
        size = max(1, BLOCK_TOKENS // n)
        begins = list(range(0, steps, size))

        def padded(arrays: list[np.ndarray], t0: int, t1: int, none: int) -> np.ndarray:
            out = np.full((live[t0], t1 - t0), none, np.int64)
            for j in range(live[t0]):
                part = arrays[j][t0:t1]
                out[j, : len(part)] = part
            return np.ascontiguousarray(out.T)

        def forward(t0: int, before: np.ndarray | None):
            t1 = min(t0 + size, steps)
            sym = padded(seqs, t0, t1, SYMBOLS)
            emitted = np.ascontiguousarray(table.take(sym, axis=0).transpose(0, 2, 1))
            alpha, log, a = np.empty_like(emitted), 0.0, before
            for t in range(t1 - t0):
                if a is None:
                    np.multiply(model.start[:, None], emitted[t], out=alpha[t])
                else:
                    np.matmul(move, a[:, : sym.shape[1]], out=alpha[t])
                    alpha[t] *= emitted[t]
                a = alpha[t]
                if (t0 + t) % SCALED == SCALED - 1 or t0 + t == steps - 1 or t == t1 - t0 - 1:
                    c = a.sum(axis=0)
                    a /= c
                    log += float(np.log(c).sum())
            return sym, emitted, alpha, log, a.copy()

        edges, held = [None], {}
        for b, t0 in enumerate(begins):
            last = forward(t0, edges[-1])
            self.log += last[3]
            edges.append(last[4])
            if (t0 + size) * n <= HELD_TOKENS:
                held[b] = last
        moved = np.zeros((states, states))
        after = None  # beta times emission of the first step beyond the block
        for b in range(len(begins) - 1, -1, -1):
            t0 = begins[b]
            sym, emitted, alpha, _, _ = last if b == len(begins) - 1 else held.pop(b, None) or forward(t0, edges[b])
            wide = sym.shape[1]
            beta = np.empty_like(alpha)
            follow = emitted  # becomes beta times emission in place
            for t in range(len(alpha) - 1, -1, -1):
                if after is None or after.shape[1] < wide:
                    beta[t] = 1.0
                if after is not None:
                    np.matmul(back, after, out=beta[t, :, : after.shape[1]])
                if (t0 + t) % SCALED == 0:
                    scaled = beta[t] / beta[t].sum(axis=0)
                    follow[t] *= scaled
                else:
                    follow[t] *= beta[t]
                if t == len(alpha) - 1:
                    beyond = after
                after = follow[t]
            beta *= alpha
            z = 1.0 / beta.sum(axis=1)
            beta *= z[:, None, :]  # the chance of each state
            z *= t0 + 1 + np.arange(len(alpha))[:, None] < lengths[None, :wide]  # a text's last step moves nowhere
            alpha *= z[:, None, :]
            moved += np.matmul(alpha[:-1], follow[1:].transpose(0, 2, 1)).sum(axis=0)
            if beyond is not None:
                moved += alpha[-1, :, : beyond.shape[1]] @ beyond.T
            if b == 0:
                self.start += beta[0].sum(axis=1)
            flat = sym.ravel()
            seen += np.bincount(flat, minlength=SYMBOLS + 1)
            for k in range(states):
                self.emit[k] += np.bincount(flat, weights=beta[:, k].ravel(), minlength=SYMBOLS + 1)[:-1]
            if words is not None:
                numbers = padded(words, t0, t0 + len(alpha), -1)
                kept = np.flatnonzero(numbers >= 0)
                at = kept + kept // wide * (wide * (states - 1))
                counted.append((numbers.ravel()[kept], [beta.ravel()[at + k * wide] for k in range(states)]))
            after = after.copy()
        self.move += model.move * moved

    def model(self, unigram: np.ndarray) -> Model:
        """The M-step."""
        emit = self.emit + PRIOR * unigram
        move = self.move + 0.1
        start = self.start + 0.1
        return Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=1, keepdims=True))


def _symbols(batch: pa.RecordBatch, symbol_of: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], pa.Array]:
    """Codes and symbols of a batch's texts, and its rare words or only their classes; the places of rare words count on through the batch."""
    lists = batch.column("rare")
    first = lists.offsets.to_numpy()
    rare = lists.values.slice(first[0], first[-1] - first[0])
    kinds = rare.field("k") if pa.types.is_struct(rare.type) else rare
    table = np.concatenate([symbol_of, OWN_SYMBOLS + kinds.to_numpy()]).astype(np.int32)
    codes, end = [], len(symbol_of) - 1
    for x, at in zip(batch.column("codes"), first - first[0], strict=False):
        c = np.frombuffer(x.as_buffer(), "<u4").astype(np.int32)
        c[c > end] += np.int32(at)
        codes.append(c)
    return codes, [table[c] for c in codes], rare


def _kind(e: bytes, states: int) -> str:
    return "<f8" if len(e) == 8 * states else "<f4"


def _packed(rows: np.ndarray) -> pa.Array:
    """Each row's numbers as bytes."""
    offsets = (np.arange(len(rows) + 1) * rows.shape[1] * rows.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])


def _unpacked(blobs: pa.Array, kind: str = "<f4") -> np.ndarray:
    """Rows of numbers from bytes of one length."""
    offsets = np.frombuffer(blobs.buffers()[1], np.int32)[blobs.offset : blobs.offset + len(blobs) + 1]
    flat = np.frombuffer(blobs.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(kind)
    return flat.reshape(len(blobs), -1)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums by word and name of rows that come sorted by them: symbols first, eight bytes a state, then looked-up words and others, four."""
    held = None
    for batch in batches:
        for few in (batch.filter(pc.equal(pc.binary_length(batch.column("e")), size)) for size in pc.unique(pc.binary_length(batch.column("e"))).to_pylist()):
            kind = "<f8" if pc.less(few.column("name"), SYMBOLS)[0].as_py() and not few.column("word")[0].is_valid else "<f4"
            word, name = few.column("word"), few.column("name").to_numpy()
            rows = _unpacked(few.column("e"), kind).astype(np.float64)
            same = pc.fill_null(pc.equal(word.slice(1), word.slice(0, len(word) - 1)), False).to_numpy(zero_copy_only=False)
            nulls = word.is_null().to_numpy(zero_copy_only=False)
            same = (same | (nulls[1:] & nulls[:-1])) & (name[1:] == name[:-1])
            at = np.concatenate([[0], 1 + np.flatnonzero(~same)])
            keys, sums = few.select(["name", "word", "k"]).take(pa.array(at)), np.add.reduceat(rows, at, axis=0)
            if held is not None and held[0].to_pylist()[0] == keys.slice(0, 1).to_pylist()[0]:
                sums[0] += held[1][0]
            elif held is not None:
                yield _sums_of(*held)
            if len(at) > 1:
                yield _sums_of(keys.slice(0, len(at) - 1), sums[:-1], kind)
            held = keys.slice(len(at) - 1), sums[-1:], kind
    if held is not None:
        yield _sums_of(*held)


def _sums_of(keys: pa.RecordBatch, sums: np.ndarray, kind: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*keys.columns, _packed(sums.astype(kind))], ["name", "word", "k", "e"])


def _merged(df: DataFrame) -> DataFrame:
    return df.coalesce(TASKS) if df.rdd.getNumPartitions() > TASKS else df


def _baum_welch_pass(encoded: DataFrame, model: Model, unigram: np.ndarray, v: Vocabulary, words: bool = False) -> tuple[Model, Expected, DataFrame]:
    """One pass over all training texts: expected counts in tasks, sums by symbol (and by word) in a shuffle."""
    states = len(model.start)
    symbol_of = v.symbol_of_code().astype(np.int32)
    counted = np.where(np.arange(len(symbol_of)) < v.own, -1, np.arange(len(symbol_of)))  # symbols of their own are counted as such
    counted[-1] = -1

    def made(names, texts, kinds, rows):
        return pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), texts, pa.array(kinds, pa.int32()), _packed(rows)], ["name", "word", "k", "e"])

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, looked, end = Expected(states), np.zeros((len(symbol_of), states)), len(symbol_of) - 1
        waiting, tokens, most = [], 0, WAITING_TOKENS // 2 if words else WAITING_TOKENS  # the rare words' counts take the other half

        def walk():
            batch = pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
            codes, symbols, rare = _symbols(batch, symbol_of)
            if not words:
                found.add(model, symbols)
                return None
            numbers = np.concatenate([counted, len(counted) + np.arange(len(rare))]).astype(np.int32)
            codes = [numbers[c] for c in codes]
            sums = found.add(model, symbols, codes, len(rare), looked)
            if not len(rare):
                return None
            coded = rare.field("word").dictionary_encode()
            at, n = coded.indices.to_numpy(), len(coded.dictionary)
            kinds = np.zeros(n, np.int32)
            kinds[at] = rare.field("k").to_numpy()
            rows = np.stack([np.bincount(at, weights=sums[:, k], minlength=n) for k in range(states)], axis=1)
            return made(np.zeros(n, np.int32), coded.dictionary, kinds, rows.astype(np.float32))

        for batch in batches:
            for k in range(0, batch.num_rows, 2_000):
                part = batch.slice(k, 2_000)
                waiting.append(part)
                tokens += pc.sum(pc.binary_length(part.column("codes"))).as_py() // 4
                if tokens >= most:
                    out = walk()
                    waiting, tokens = [], 0
                    give_back()
                    if out is not None:
                        yield out
        if waiting:
            out = walk()
            if out is not None:
                yield out
        rows = np.concatenate([found.emit.T, found.move, found.start[None, :]])
        names = np.concatenate([np.arange(SYMBOLS), -1 - np.arange(states), [-1 - states]]).astype(np.int32)
        seen = rows.any(axis=1)
        yield made(names[seen], pa.nulls(int(seen.sum()), pa.string()), np.zeros(int(seen.sum()), np.int32), rows[seen])
        if words and end > OWN_SYMBOLS:
            rows = np.zeros((-(-(end - OWN_SYMBOLS) // LOOKED_ROWS), LOOKED_ROWS * states), np.float32)
            rows.reshape(-1, states)[: end - OWN_SYMBOLS] = looked[OWN_SYMBOLS:end]
            seen = np.flatnonzero(rows.any(axis=1))
            yield made(SYMBOLS + seen, pa.nulls(len(seen), pa.string()), np.zeros(len(seen), np.int32), rows[seen])

    learnt = _merged(encoded.filter(~F.col("held_out")).select("codes", "rare" if words else F.col("rare.k").alias("rare")))
    sums = arrow_map(learnt, expect, "name int, word string, k int, e binary").repartition("name", "word").sortWithinPartitions("word", "name")
    with shuffles_dropped(encoded.sparkSession), arrow_rows(encoded.sparkSession, BATCH_ROWS):
        sums = stored(arrow_map(sums, _summed, "name int, word string, k int, e binary"), "lm-expected")
    total, looked = Expected(states), np.zeros((max(0, len(v.words) - OWN_SYMBOLS), states))
    top = sums.filter("word is null").toArrow()  # SYMBOLS + states + 1 + LOOKUP rows at most
    for name, e in zip(top["name"].to_pylist(), top["e"].to_pylist(), strict=True):
        row = np.frombuffer(e, _kind(e, states))
        if name >= SYMBOLS:
            at = (name - SYMBOLS) * LOOKED_ROWS
            looked[at : at + LOOKED_ROWS] = row.reshape(-1, states)[: len(looked) - at]
        elif name >= 0:
            total.emit[:, name] = row
        elif name >= -states:
            total.move[-1 - name] = row
        else:
            total.start = row
    total.looked = looked
    return total.model(unigram), total, sums.filter("word is not null").drop("name")


def train(encoded: DataFrame, v: Vocabulary, texts: int, states: int = STATES, passes: int = PASSES, seed: int = 7) -> tuple[Model, Expected, DataFrame]:
    """The model, the last pass's expected counts, and those of the words that are not looked up."""
    unigram = np.full(SYMBOLS, ADD)
    unigram[: v.own] += v.counts[:OWN_SYMBOLS]
    unigram[OWN_SYMBOLS:END] += v.class_tokens
    unigram[END] += texts
    unigram /= unigram.sum()
    rng = np.random.default_rng(seed)
    emit = unigram * rng.gamma(2.0, 0.5, (states, SYMBOLS))
    move = np.full((states, states), 0.2 / states) + 0.8 * np.eye(states)
    model = Model(np.full(states, 1 / states), move, emit / emit.sum(axis=1, keepdims=True))
    if not texts:
        model = Model(model.start, move, np.full((states, SYMBOLS), 1 / SYMBOLS))
    for k in range(SETTLING + passes):
        model, found, rare = _baum_welch_pass(encoded, model, unigram, v, words=k == SETTLING + passes - 1)
    if not texts:
        model = Model(np.full(states, 1 / states), move, np.full((states, SYMBOLS), 1 / SYMBOLS))
    return model, found, rare


class Emissions:
    """Emissions by code, without the factor that no state changes (a word's share of its class)."""

    def __init__(self, model: Model, found: Expected, v: Vocabulary, rare: DataFrame):
        states = len(model.start)
        by_class = found.emit[:, OWN_SYMBOLS:END].T
        self.share = (by_class + 1e-9) / (by_class + 1e-9).sum(axis=1, keepdims=True)
        classes = v.symbol_of_code()[v.own : -1] - OWN_SYMBOLS
        c = v.counts[v.own :].astype(float)
        weight = (c + ADD) / (c + ALPHA)
        got, plain = np.zeros((CLASSES, states)), np.zeros(CLASSES)
        np.add.at(got, classes, weight[:, None] * found.looked)
        np.add.at(plain, classes, weight)

        def by_class(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((CLASSES, 1 + states))
            for batch in batches:
                kinds, e = batch.column("k").to_numpy(), _unpacked(batch.column("e")).astype(np.float64)
                count = e.sum(axis=1).round()
                w = (count + ADD) / (count + ALPHA)
                for s, x in enumerate([w, *(w[:, None] * e).T]):
                    sums[:, s] += np.bincount(kinds, weights=x, minlength=CLASSES)
            at = np.flatnonzero(sums[:, 0])
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *[pa.array(sums[at, s]) for s in range(1 + states)]], ["k", "plain", *[f"s{k}" for k in range(states)]])

        columns = ["plain", *[f"s{k}" for k in range(states)]]
        by_k = arrow_map(rare.select("k", "e"), by_class, ", ".join(["k int", *[f"{c} double" for c in columns]]))
        for r in by_k.groupBy("k").agg(*[F.sum(c).alias(c) for c in columns]).collect():  # CLASSES rows at most
            got[r["k"]] += np.array(r[2:])
            plain[r["k"]] += r["plain"]
        z = (got + (ALPHA * plain[:, None] + ADD) * self.share) / v.whole[:, None]
        self.of_class = model.emit[:, OWN_SYMBOLS:END].T / z
        mid = self.of_class[classes] * (found.looked + ALPHA * self.share[classes]) / (c + ALPHA)[:, None]
        self.by_code = np.concatenate([model.emit[:, : v.own].T, mid, model.emit[:, END][None, :]]).astype(np.float32)

    def rare(self, classes: np.ndarray, expected: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return self.of_class[classes] * (expected + ALPHA * self.share[classes]) / (counts + ALPHA)[:, None]


def forward_log10(model: Model, texts: list[np.ndarray], by_code: np.ndarray | None = None) -> np.ndarray:
    """log10 probability of each whole sequence by the scaled forward recursion."""
    by_code = np.ascontiguousarray(model.emit.T) if by_code is None else by_code
    beyond = len(by_code)
    by_code = np.concatenate([by_code, np.ones((1, len(model.start)), by_code.dtype)])  # beyond a text's end nothing changes
    out = np.zeros(len(texts))
    order = sorted(range(len(texts)), key=lambda j: -len(texts[j]))
    at = 0
    while at < len(order):
        longest = max(1, len(texts[order[at]]))
        take = max(1, min(512, (1 << 20) // longest))
        mine = order[at : at + take]
        at += take
        lengths = np.array([len(texts[j]) for j in mine])
        live = len(mine) - np.searchsorted(lengths[::-1], np.arange(longest), side="right")
        a, move = None, np.ascontiguousarray(model.move.T)
        total = np.zeros(len(mine))
        for t0 in range(0, longest, 64):
            steps, wide = min(64, longest - t0), live[t0]
            block = np.full((wide, steps), beyond, np.int64)
            for j in range(wide):
                part = texts[mine[j]][t0 : t0 + 64]
                block[j, : len(part)] = part
            emitted = np.ascontiguousarray(by_code.take(block.T, axis=0).transpose(0, 2, 1), dtype=np.float64)
            for i in range(steps):
                a = model.start[:, None] * emitted[i] if a is None else (move @ a[:, :wide]) * emitted[i]
                if i % 4 == 3 or i == steps - 1:
                    c = a.sum(axis=0)
                    a /= c
                    total[:wide] += np.log10(c)
        out[mine] = total
    return out


def _forward_scores(encoded: DataFrame, model: Model, emissions: Emissions, v: Vocabulary, learnt: str) -> DataFrame:
    """encoded, and the folder of expected counts (row_id, place in rare, counts) by part -> the texts' parts of both scores."""
    states = len(model.start)
    symbol_of, whole = v.symbol_of_code(), v.whole

    def counts_of(part: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        import pyarrow.parquet as pq
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(learnt)
        files = sorted(x.path for x in store.get_file_info(fs.FileSelector(f"{root}/part={part}", allow_not_found=True)) if x.path.endswith(".parquet"))
        tables = [pq.ParquetFile(x, filesystem=store).read(columns=["row_id", "j", "e"]) for x in files]
        if not tables:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, states), np.float32)
        found = pa.concat_tables(tables).sort_by("row_id") if len(tables) > 1 else tables[0]
        e = np.concatenate([_unpacked(x.cast(pa.binary())) for x in found["e"].chunks])
        return found["row_id"].to_numpy(), found["j"].to_numpy(), e

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, part = None, -1
        for whole_batch in batches:
            give_back()
            parts = whole_batch.column("row_id").to_numpy() >> PART_BITS
            cuts = sorted({*range(0, len(parts), 2_000), *(1 + np.flatnonzero(np.diff(parts))).tolist(), len(parts)})
            for k, to in zip(cuts[:-1], cuts[1:], strict=True):
                batch = whole_batch.slice(k, to - k)
                if parts[k] != part:
                    held, part = counts_of(int(parts[k])), parts[k]
                codes, _, rare = _symbols(batch, symbol_of)
                lists, ids = batch.column("rare"), batch.column("row_id").to_numpy()
                first = lists.offsets.to_numpy() - lists.offsets.to_numpy()[0]
                lo, hi = np.searchsorted(held[0], ids[0]), np.searchsorted(held[0], ids[-1], side="right")
                place = first[np.searchsorted(ids, held[0][lo:hi])] + held[1][lo:hi]
                expected = np.zeros((len(rare), states))
                expected[place] = held[2][lo:hi]
                classes, times = rare.to_numpy(), batch.column("times").flatten().to_numpy()
                counts = expected.sum(axis=1).round()
                table = np.concatenate([emissions.by_code, emissions.rare(classes, expected, counts).astype(np.float32)])
                sums = [np.concatenate(([0.0], np.cumsum(times * x))) for x in (np.log10(counts + ADD), np.log10((counts + ADD) / whole[classes]), counts > 0)]
                base, within, seen = (x[first[1:]] - x[first[:-1]] for x in sums)
                column = lambda c: batch.column(c).to_numpy(zero_copy_only=False)
                path = forward_log10(model, codes, table) + column("class_log") + within
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in ("doc_id", "held_out", "n_tokens")), pa.array((column("n_known") + seen).round().astype(np.int64)), pa.array(column("base_log") + base), pa.array(path)],
                    ["doc_id", "held_out", "n_tokens", "n_known", "base_log", "score"],
                )

    encoded = encoded.withColumns({"rare": F.col("rare.k"), "times": F.col("rare.n")})
    return arrow_map(encoded, score, "doc_id long, held_out boolean, n_tokens long, n_known long, base_log double, score double")


def score_texts(docs: DataFrame, states: int = STATES, passes: int = PASSES) -> DataFrame:
    """docs (doc_id, text) -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out(F.col("doc_id")).alias("held_out"))
    learn = docs.filter(~F.col("held_out"))
    texts = learn.select("doc_id").count()
    with shuffles_dropped(docs.sparkSession):
        counts = stored(count_words(learn), "lm-counts")
    v = vocabulary(counts, texts)
    with arrow_rows(docs.sparkSession, BATCH_ROWS):
        encoded = stored(encode(docs, v), "lm-encoded")
    model, found, rare = train(encoded, v, texts, states, passes)
    # words beyond the looked-up ones: what was learnt of them by a join, nothing where training has none; by the task that encoded a text,
    # so that the texts themselves need no shuffle
    places = encoded.select("row_id", F.posexplode("rare").alias("j", "r")).select("row_id", "j", "r.word").join(rare.select("word", "e"), "word")
    part = F.shiftright("row_id", PART_BITS).cast("int").alias("part")
    learnt = fresh_path(docs.sparkSession, "lm-learnt")
    with shuffles_dropped(docs.sparkSession):
        places.select("row_id", "j", "e", part).repartition("part").sortWithinPartitions("part", "row_id").write.partitionBy("part").parquet(learnt)
    df = _forward_scores(encoded, model, Emissions(model, found, v, rare), v, learnt)
    share = math.log10(v.tokens + ADD * (v.distinct + 1))
    base = F.col("base_log") + math.log10(texts + ADD) - F.col("n_tokens") * share
    known = F.col("n_known") + (1 if texts else 0)
    return df.select("doc_id", "held_out", "n_tokens", known.cast("long").alias("n_known"), F.lit(v.tokens).cast("long").alias("train_tokens"), base.alias("base_score"), "score")


def op2_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))
