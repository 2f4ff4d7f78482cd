"""Words and shingles of Arrow text columns, in NumPy."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

_MUL = np.uint64(0x9E3779B97F4A7C15)


def coded_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Lower-cased words: codes in text order, the distinct words, and the words by text."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    bounds = split.offsets.to_numpy().astype(np.int64)
    coded = split.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
    codes = coded.indices.to_numpy().astype(np.int32)
    words = coded.dictionary
    empty = pc.index(words, "").as_py() if len(words) else -1  # white space at either end of a text
    counts = np.diff(bounds)
    if empty >= 0:
        real = codes != empty
        before = np.concatenate(([0], np.cumsum(real)))
        at = bounds - bounds[0]
        counts = before[at[1:]] - before[at[:-1]]
        codes = codes[real]
    return codes, words, counts


def word_hashes(words: pa.Array) -> np.ndarray:
    """64-bit hashes that depend on the word alone."""
    if not len(words):
        return np.zeros(0, np.uint64)
    return pd.util.hash_array(words.to_numpy(zero_copy_only=False).astype(object), categorize=False)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's ``width``-word shingles.

    A text of fewer words has its whole sequence as one shingle, a text without words none.
    """
    codes, words, counts = coded_words(texts)
    h = word_hashes(words)[codes]
    run = h.copy()
    for k in range(1, width):
        run = mixed(run[:-1] * _MUL + h[k:]) if len(run) > 1 else run[:0]
    out, at = [], 0
    for n in counts.tolist():
        if n >= width:
            out.append(np.unique(run[at : at + n - width + 1]))
        elif n:
            out.append(np.frombuffer(hashlib.blake2b(h[at : at + n].tobytes(), digest_size=8, person=b"short").digest(), np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out


def min_hashes(sets: list[np.ndarray], coordinates: int, minima: int = 1, seed: int = 1) -> np.ndarray:
    """Signatures, one row a set; a coordinate's value stands for ``minima`` minima.  Rows of empty sets are undefined."""
    rng = np.random.default_rng(seed)
    salts = rng.integers(0, 1 << 63, (coordinates, minima), dtype=np.uint64)
    out = np.zeros((len(sets), coordinates), np.int64)
    todo = [k for k, s in enumerate(sets) if len(s)]
    while todo:
        take, size = 0, 0
        while take < len(todo) and (not take or size + len(sets[todo[take]]) <= 1 << 15):
            size += len(sets[todo[take]])
            take += 1
        mine, todo = todo[:take], todo[take:]
        flat = np.concatenate([sets[k] for k in mine])
        starts = np.cumsum([0, *[len(sets[k]) for k in mine[:-1]]])
        for j in range(coordinates):
            value = np.zeros(len(mine), np.uint64)
            for salt in salts[j]:
                v = flat ^ salt
                v *= _MUL
                v ^= v >> np.uint64(29)
                v *= np.uint64(0xBF58476D1CE4E5B9)
                value = mixed((value << np.uint64(1)) ^ np.minimum.reduceat(v, starts))
            out[mine, j] = value.view(np.int64)
    return out
