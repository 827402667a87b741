"""Evaluation passages in training text, by winnowed fingerprints.

Texts are reduced to their letters and digits in one case and width, without markup. Of the hashes of all
``K``-grams the least of every window of ``WINDOW`` neighbours is kept; two texts that share a stretch of
``K + WINDOW - 1`` = 15 characters then share a fingerprint for certain. A hit is extended along its
diagonal, and the stretches that are long enough add up to the share of the passage that a document repeats.

The corpus is read once, whatever the size of the test set: a task keeps those fingerprints of its documents
that a Bloom filter of the test fingerprints (at most ``FILTER_BITS`` bits) lets pass, and the letters of
the documents that have any. Those are written, joined with the test fingerprints by hash in ``SALTS`` parts, so
that a hash of very many documents is no single task's, and counted by diagonal; what is left is extended.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tanzaku.checkpoints import stored

K, WINDOW = 10, 6
SHORTEST = K + WINDOW - 1
WORDS = 8  #: in languages with words, a stretch has at least so many
BY_WORD = ("en", "fr", "de", "es")
FILTER_BITS = 28  #: binary logarithm of the most bits of the filter: 32 MB, enough for test sets of about 100 million characters
PROBES, BITS_EACH = 6, 32
SALTS = 8  #: parts of the join of each hash
BATCH_CHARS = 1 << 20

COMMENT = re.compile(r"<!--.*?-->", re.S)
#: Tags with attributes of any length, tags that are not well formed up to a line end or sentence end, entities, heads of templates and links.
MARKUP = re.compile(
    r"</?[A-Za-z][A-Za-z0-9:_-]*+(?:\s++[A-Za-z0-9:@_.-]++(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s\"'<>=]++))?+)*+\s*+/?>|</?[A-Za-z][^<>。！？\n]*+>"
    r"|&(?:[A-Za-z]{2,8}|#\d{1,6}|#x[0-9A-Fa-f]{1,5});|\{\{[^{}|]*+\||\[\[(?:[^\[\]|]*+\|)?+"
)
INVISIBLE = re.compile("[­​-‏⁠﻿︎️]+")
MARK = re.compile(r"[\W_]+")
LETTER = np.array([chr(c).isalnum() for c in range(65536)])
HASH_BASE = 0x100000001B3


def without_markup(text: str) -> str:
    if "<!--" in text and "-->" in text:
        head, mark, rest = text.rpartition("-->")  # what opens behind the last end is no comment
        text = COMMENT.sub(" ", head + mark) + rest
    return MARKUP.sub(" ", text) if "<" in text or "&" in text or "{{" in text or "[[" in text else text


def dressed_down(text: str) -> str:
    """``text`` in one case and width, without markup and invisible characters."""
    return unicodedata.normalize("NFKC", INVISIBLE.sub("", without_markup(text))).casefold()


def letters(text: str) -> str:
    return MARK.sub("", dressed_down(text))


def _codes(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("utf-32-le", "replace"), np.uint32)


def letters_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of the letters of all texts, one behind the other; the number of the text of each)"""
    joined = INVISIBLE.sub("", "\0".join(without_markup(t).replace("\0", " ") for t in texts))
    codes = _codes(unicodedata.normalize("NFKC", joined).casefold())
    keep = LETTER[np.minimum(codes, 65535)]
    far = np.flatnonzero(codes > 65535)
    if len(far):
        keep = keep.copy()
        keep[far] = [chr(c).isalnum() for c in codes[far].tolist()]
    return codes[keep], np.cumsum(codes == 0)[keep]


def _winnow(codes: np.ndarray, of: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(hash, position) that winnowing keeps; ``of`` numbers the texts if there are several."""
    n = len(codes) - K + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    most = np.uint64(0xFFFFFFFFFFFFFFFF)
    power = [np.uint64(pow(HASH_BASE, e, 1 << 64)) for e in (1, 2, 4)]
    with np.errstate(over="ignore"):
        x = codes.astype(np.uint64) + np.uint64(1)
        two = x[:-1] * power[0] + x[1:]
        four = two[:-2] * power[1] + two[2:]
        h = (four[: n + 2] * power[2] + four[4 : n + 6])[:n] * power[1] + two[8 : n + 8]  # K = 4 + 4 + 2
        h ^= h >> np.uint64(31)
        h *= np.uint64(0x9E3779B97F4A7C15)
    inside = np.ones(n, bool) if of is None else of[:n] == of[K - 1 :]
    h[~inside] = most
    pad = np.full(WINDOW - 1, most)
    low = np.concatenate([pad, h, pad])
    low = np.minimum(low[:-1], low[1:])
    low = np.minimum(np.minimum(low[:-4], low[2:-2]), low[4:])  # least of each window of six
    high = np.where(low == most, np.uint64(0), low)
    high = np.maximum(high[:-1], high[1:])
    high = np.maximum(np.maximum(high[:-4], high[2:-2]), high[4:])  # greatest of those: is it the hash itself, it is some window's least
    at = np.flatnonzero(inside & (h == high))
    return h[at], at


def fingerprints(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, position) that winnowing keeps of a text."""
    return _winnow(codes)


@dataclass(frozen=True)
class Passage:
    codes: np.ndarray
    word_start: np.ndarray | None  #: of languages with words: where each begins and ends among the letters
    word_end: np.ndarray | None

    @cached_property
    def least(self) -> int:
        """Letters of the shortest stretch that counts."""
        if self.word_start is None:
            return SHORTEST
        if len(self.word_start) < WORDS:
            return len(self.codes) + 1
        return int((self.word_end[WORDS - 1 :] - self.word_start[: len(self.word_start) - WORDS + 1]).min())

    @property
    def need(self) -> int:
        """Fingerprints that winnowing is sure to keep of any stretch that counts."""
        return max(1, (self.least - K + 1) // WINDOW)

    def need_in_all(self, least_share: float) -> int:
        """Fingerprints that stretches of together ``least_share`` of the passage are sure to keep.

        A stretch of n letters keeps (n - K + 1) // WINDOW or more; the least of them a letter is found among
        the ``WINDOW`` shortest lengths that count.
        """
        rate = min(((n - K + 1) // WINDOW) / n for n in range(self.least, self.least + WINDOW))
        return max(1, int(np.ceil(least_share * len(self.codes) * rate - 1e-6)))

    def repeated(self, codes: np.ndarray, shifts: list[int]) -> int:
        """How many of the passage's letters lie in stretches that ``codes`` repeats on the diagonals ``shifts``."""
        hit, least = np.zeros(len(self.codes), bool), self.least
        for shift in shifts:
            a, b = max(0, -shift), min(len(self.codes), len(codes) - shift)
            if b - a < least:
                continue
            same = np.concatenate([[False], self.codes[a:b] == codes[a + shift : b + shift], [False]])
            edge = np.flatnonzero(same[1:] != same[:-1])
            begin, end = edge[::2] + a, edge[1::2] + a
            long = end - begin >= least
            for s, e in zip(begin[long], end[long]):
                if self.word_start is None:
                    hit[s:e] = True
                else:
                    i, j = np.searchsorted(self.word_start, s, "left"), np.searchsorted(self.word_end, e, "right")
                    if j - i >= WORDS:
                        hit[self.word_start[i] : self.word_end[j - 1]] = True
        return int(hit.sum())


@lru_cache(1024)
def passage(text: str, by_word: bool) -> Passage:
    if not by_word:
        return Passage(_codes(letters(text)), None, None)
    words = [w for w in (MARK.sub("", x) for x in dressed_down(text).split()) if w]
    ends = np.cumsum([len(w) for w in words])
    return Passage(_codes("".join(words)), ends - [len(w) for w in words], ends)


# ---------------------------------------------------------------- filter of the test fingerprints


ODD = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53]


def _probe(h: np.ndarray, j: int, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((h ^ (h >> np.uint64(7 + 5 * j))) * np.uint64(ODD[j])) >> np.uint64(64 - bits)


def bloom(prints: DataFrame, h: str, n: int) -> tuple[np.ndarray, int]:
    """(words of the filter of the hashes, binary logarithm of its bits); the driver sees the filter alone, 2 ** ``FILTER_BITS`` bits at most."""
    bits = int(np.clip(np.ceil(np.log2(max(1, n) * BITS_EACH)), 12, FILTER_BITS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.concatenate([_probe(np.asarray(b.column(0)).view(np.uint64), j, bits) for j in range(PROBES)])
            word, where = np.unique(at >> np.uint64(6), return_inverse=True)
            mask = np.zeros(len(word), np.uint64)
            np.bitwise_or.at(mask, where, np.uint64(1) << (at & np.uint64(63)))
            yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(mask.view(np.int64))], names=["word", "mask"])

    got = prints.select(h).mapInArrow(run, "word long, mask long").groupBy("word").agg(F.expr("bit_or(mask)").alias("mask")).toArrow()
    out = np.zeros(max(1, (1 << bits) >> 6), np.uint64)
    out[np.asarray(got.column(0).combine_chunks())] = np.asarray(got.column(1).combine_chunks()).view(np.uint64)
    return out, bits


def passing(h: np.ndarray, words: np.ndarray, bits: int) -> np.ndarray:
    """Places of the hashes that the filter may hold."""
    at = np.arange(len(h))
    for probe in range(PROBES):
        if not len(at):
            break
        p = _probe(h[at], probe, bits)
        at = at[(words[p >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1) == 1]
    return at


# ---------------------------------------------------------------- the operator


def _test_prints(passages: DataFrame, least_share: float) -> DataFrame:
    """(pid, need, total, h, at) of (pid, by_word, passage): ``need`` fingerprints on one diagonal and ``total`` on those together are the fewest of a leak."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pid, need, total, hs, at = [], [], [], [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
            for p, by_word, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                one = passage(text, by_word)
                h, pos = fingerprints(one.codes)
                pid += [p] * len(h)
                need += [one.need] * len(h)
                total += [one.need_in_all(least_share)] * len(h)
                hs.append(h)
                at.append(pos)
            yield pa.RecordBatch.from_arrays([pa.array(pid, pa.int64()), pa.array(need, pa.int32()), pa.array(total, pa.int32()), pa.array(np.concatenate(hs).view(np.int64)), pa.array(np.concatenate(at).astype(np.int32))], names=["pid", "need", "total", "h", "at"])

    return passages.select("pid", "by_word", "passage").mapInArrow(run, "pid long, need int, total int, h long, at int")


def _suspects(documents: DataFrame, doc: str, text: str, words: np.ndarray, bits: int) -> DataFrame:
    """(doc, letters, h, at): documents some of whose fingerprints pass the filter, with those and their letters; one scan."""
    shared = documents.sparkSession.sparkContext.broadcast((words, bits))
    kind = documents.schema[doc].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, bits = shared.value
        for b in batches:
            size = np.asarray(pc.utf8_length(b.column(1)), np.int64)
            cut = np.searchsorted(np.cumsum(size), np.arange(BATCH_CHARS, size.sum() + BATCH_CHARS, BATCH_CHARS), "left") + 1
            lo = 0
            for hi in sorted({min(int(c), b.num_rows) for c in cut} | {b.num_rows}):
                codes, of = letters_of(b.column(1).slice(lo, hi - lo).to_pylist())
                h, at = _winnow(codes, of)
                hit = passing(h, words, bits)
                h, at = h[hit], at[hit]
                who, first, count = np.unique(of[at], return_index=True, return_counts=True)
                begin, end = np.searchsorted(of, who, "left"), np.searchsorted(of, who, "right")
                rel = at - np.repeat(begin, count)
                ends = pa.array(np.append(0, np.cumsum(count)), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo).take(pa.array(who)), pa.array([codes[s:e].tobytes().decode("utf-32-le") for s, e in zip(begin, end)], pa.string()),
                     pa.ListArray.from_arrays(ends, pa.array(h.view(np.int64))), pa.ListArray.from_arrays(ends, pa.array(rel.astype(np.int32)))],
                    names=["_doc", "letters", "h", "at"],
                )
                lo = hi

    return documents.select(doc, text).where(F.col(doc).isNotNull() & F.col(text).isNotNull()).mapInArrow(run, f"_doc {kind}, letters string, h array<long>, at array<int>")


def leaks(documents: DataFrame, doc: str, text: str, items: DataFrame, item: str, lang: str, passage_text: str, least_share: float = 1 / 3) -> DataFrame:
    """(item, doc, letters, share) for every document that repeats at least ``least_share`` of an item's passage.

    Items whose passages are the same letters leak together. Null keys, null texts, empty passages and
    passages shorter than a stretch give nothing. Rows of equal document key are compared one by one.
    """
    items = items.select(F.col(item).alias("item"), F.coalesce(F.col(lang).isin(*BY_WORD), F.lit(False)).alias("by_word"), F.col(passage_text).alias("passage")).where("item is not null and passage is not null").distinct()
    passages = stored(items.select("by_word", "passage").distinct().withColumn("pid", F.monotonically_increasing_id()), "leak-passages")
    prints = stored(_test_prints(passages, least_share), "leak-prints")
    suspects = stored(_suspects(documents, doc, text, *bloom(prints, "h", prints.count())).withColumn("rid", F.monotonically_increasing_id()), "leak-suspects")

    salt = F.pmod(F.xxhash64("rid"), F.lit(SALTS)).alias("salt")
    hits = suspects.select("rid", salt, F.inline(F.arrays_zip("h", "at"))).withColumnRenamed("at", "pos")
    test = prints.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    lines = hits.join(test, ["h", "salt"]).groupBy("rid", "pid", (F.col("pos") - F.col("at")).alias("shift")).agg(F.count("*").alias("n"), F.max("need").alias("need"), F.max("total").alias("total"))
    pairs = lines.where("n >= need").groupBy("rid", "pid").agg(F.collect_list("shift").alias("shifts"), F.sum("n").alias("n"), F.max("total").alias("total")).where("n >= total")  # diagonals of one document and passage
    kind = documents.schema[doc].dataType.simpleString()

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, share = [], []
            for text_, p, by_word, shifts in zip(*(b.column(i).to_pylist() for i in (2, 3, 4, 5))):
                one = passage(p, by_word)
                size.append(one.repeated(_codes(text_), shifts))
                share.append(size[-1] / len(one.codes))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(size, pa.int32()), pa.array(share, pa.float64())], names=["_doc", "pid", "letters", "share"])

    both = pairs.join(suspects.select("rid", "_doc", F.col("letters").alias("_letters")), "rid").join(passages, "pid")
    found = both.select("_doc", "pid", "_letters", "passage", "by_word", "shifts").mapInArrow(extend, f"_doc {kind}, pid long, letters int, share double").where(F.col("share") >= least_share - 1e-9)
    owners = items.join(passages, ["by_word", "passage"]).select("item", "pid")
    return found.join(owners, "pid").select(F.col("item").alias(item), F.col("_doc").alias(doc), "letters", "share")
