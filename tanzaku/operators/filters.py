"""Bloom filters of strings, to drop what a dictionary cannot hold before it is shuffled.

The filter is put together on the executors and only its words reach the driver: 2 ** ``MOST_BITS`` bits at most,
whatever the dictionary's size. A full filter lets more pass, and never less.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_BITS, BITS_EACH, PROBES = 26, 24, 4
BASE = np.uint64(0x100000001B3)
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)


def window_hashes(codes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all windows of ``size`` code points, one for each start."""
    n = len(codes) - size + 1
    h = np.full(max(0, n), np.uint64(size))
    with np.errstate(over="ignore"):
        for j in range(size if n > 0 else 0):
            h = h * BASE + codes[j : j + n].astype(np.uint64)
        h ^= h >> np.uint64(29)
        return h * ODD[0]


def _probe(h: np.ndarray, j: int, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((h ^ (h >> np.uint64(7 + 6 * j))) * ODD[j]) >> np.uint64(64 - bits)


def bloom(strings: DataFrame, column: str) -> tuple[np.ndarray, int]:
    """(words of the filter of a column of strings, binary logarithm of its bits); nulls and empty strings are left out."""
    some = strings.select(column).where(F.length(column) > 0)
    bits = int(np.clip(np.ceil(np.log2(max(1, some.count()) * BITS_EACH)), 12, MOST_BITS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = np.array([window_hashes(c, len(c))[0] for c in map(codes_of, b.column(0).to_pylist())], np.uint64)
            at = np.concatenate([_probe(h, j, bits) for j in range(PROBES)])
            word, where = np.unique(at >> np.uint64(6), return_inverse=True)
            mask = np.zeros(len(word), np.uint64)
            np.bitwise_or.at(mask, where, np.uint64(1) << (at & np.uint64(63)))
            yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(mask.view(np.int64))], names=["word", "mask"])

    got = some.mapInArrow(run, "word long, mask long").groupBy("word").agg(F.expr("bit_or(mask)").alias("mask")).toArrow()
    out = np.zeros((1 << bits) >> 6, np.uint64)
    out[np.asarray(got.column(0).combine_chunks())] = np.asarray(got.column(1).combine_chunks()).view(np.uint64)
    return out, bits


def passing(h: np.ndarray, words: np.ndarray, bits: int) -> np.ndarray:
    """Places of the hashes that the filter may hold."""
    at = np.arange(len(h))
    for j in range(PROBES):
        p = _probe(h[at], j, bits)
        at = at[(words[p >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1) == 1]
    return at
