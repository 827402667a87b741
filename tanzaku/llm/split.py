"""Splitting of oversized items at natural boundaries, by dynamic programming.

An item is a text that is shown behind a label, ``【section】text``. Its pieces, each with the label before
it, stay within ``limit`` characters; every piece but the first repeats the last ``overlap`` characters of
the text before its cut. Among all ways to cut, the dynamic program takes the one with the least sum of
cut penalties (line end, sentence end, clause end, any place) and of squared unused shares of the pieces,
which keeps sizes even. The work is one pass over each text: rows are independent, nothing is shuffled.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CLOSERS = "\"'”’」』】）)］\\]｝}》〉〕〗〙»›＂＇"
LINE_END = re.compile(r"\r\n|[\n\r\x0b\x0c\x85\u2028\u2029]")
SENTENCE_END = re.compile(rf"[。！？!?…]+[{CLOSERS}]*|\.(?=\s)")
CLAUSE_END = re.compile(r"[，、；：,;:](?=.)|\s+(?=\S)", re.S)
PENALTY = {"line": 0.0, "sentence": 0.15, "clause": 4.0, "any": 30.0}  #: of a cut, in units of a piece's squared unused share


def natural_cuts(text: str) -> dict[int, float]:
    """Inner natural boundaries of ``text`` with their penalties."""
    cuts = {m.end(): PENALTY["sentence"] for m in SENTENCE_END.finditer(text)}
    cuts |= {m.end(): PENALTY["line"] for m in LINE_END.finditer(text)}
    cuts.pop(len(text), None)
    cuts.pop(0, None)
    return cuts


def _safe(text: str, at: int) -> bool:
    """Whether a cut before ``text[at]`` leaves marks, joiners and selectors with what they belong to."""
    c = text[at]
    return not (unicodedata.combining(c) or c in "\u200d\ufe0e\ufe0f\uff9e\uff9f" or text[at - 1] == "\u200d")


def cut(text: str, room: int, first_room: int) -> tuple[list[int], bool]:
    """Positions to cut ``text`` at, both ends included, and whether every natural stretch fits ``room``.

    The first part may have ``first_room`` characters, the others ``room``.
    """
    n = len(text)
    cuts = natural_cuts(text)
    ends = [0, *sorted(cuts), n]
    natural = True
    for a, b in zip(ends, ends[1:]):
        if b - a <= room:
            continue
        natural = False
        inner = [m.end() for m in CLAUSE_END.finditer(text, a, b) if a < m.end() < b]
        cuts |= {x: PENALTY["clause"] for x in inner if x not in cuts}
        step = max(1, room // 12)
        for c, e in zip([a, *inner], [*inner, b]):
            if e - c > room:
                for x in range(c + step, e, step):
                    while x > c + 1 and not _safe(text, x):
                        x -= 1
                    cuts.setdefault(x, PENALTY["any"])
    at = [0, *sorted(cuts), n]
    cost, back, lo = [0.0] + [float("inf")] * (len(at) - 1), [0] * len(at), 0
    pen = [0.0, *(cuts[x] for x in at[1:-1]), 0.0]
    for j in range(1, len(at)):
        here, best, who = at[j], float("inf"), j - 1
        while lo < j - 1 and here - at[lo] > (room if lo else first_room):
            lo += 1
        for i in range(lo, j):
            size, most = here - at[i], room if i else first_room
            if size > most:
                continue
            spare = 1.0 - size / most
            value = cost[i] + spare * spare
            if value < best:
                best, who = value, i
        cost[j], back[j] = best + pen[j], who
    path, j = [n], len(at) - 1
    while j:
        j = back[j]
        path.append(at[j])
    return path[::-1], natural


def fits_beside(label_len: int, limit: int) -> bool:
    """Whether a label leaves room for a piece that moves on."""
    return limit - label_len >= 2


def pieces(text: str, label_len: int, limit: int, overlap: int) -> tuple[list[tuple[int, int]], bool]:
    """(start, end) of each piece of ``text``, and whether all cuts could be natural.

    A label that leaves no room for the overlap and one more character makes its item forced: the overlap shrinks
    to half of what is left. One that leaves fewer than two characters, ``fits_beside``, is not counted. A text that fits is one piece.
    """
    most, natural = limit - label_len, True
    if most <= overlap:
        natural = False
        most, overlap = (most, most // 2) if fits_beside(label_len, limit) else (limit, overlap)
    elif len(text) <= most:
        return [(0, len(text))], True
    path, ends = cut(text, most - overlap, most)
    return [(max(0, a - overlap) if a else 0, b) for a, b in zip(path, path[1:])], natural and ends


def oversized(text: Column, section: Column, limit: int = 600) -> Column:
    """Whether ``【section】text`` has more than ``limit`` code points; a null section has no label."""
    return F.length(text) + F.coalesce(F.length(section) + 2, F.lit(0)) > limit


def split_items(df: DataFrame, key: str, text: str, section: str, limit: int = 600, overlap: int = 50, with_text: bool = True) -> DataFrame:
    """(key, piece_no, start, end, cut_kind, fits[, piece]) for every row of ``df`` that is over ``limit``.

    Rows with a null key or text, and rows that fit, give nothing; an empty section is a label of two
    characters, a null one none. Repeated rows give repeated pieces. ``start`` counts from 0; without
    their overlaps the pieces join to the text. ``cut_kind`` is ``natural`` or ``forced``; ``fits`` is false where
    the label alone fills the limit.
    """
    kind = df.schema[key].dataType.simpleString()
    fields = f"{key} {kind}, piece_no int, start int, end int, cut_kind string, fits boolean" + (", piece string" if with_text else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, no, start, end, how, fit, part = [], [], [], [], [], [], []
            for k, t, s in zip(*(b.column(i).to_pylist() for i in range(3))):
                label = len(s) + 2 if s is not None else 0
                spans, natural = pieces(t, label, limit, overlap)
                keys += [k] * len(spans)
                no += range(1, len(spans) + 1)
                start += [a for a, _ in spans]
                end += [e for _, e in spans]
                how += ["natural" if natural else "forced"] * len(spans)
                fit += [fits_beside(label, limit)] * len(spans)
                if with_text:
                    part += [t[a:e] for a, e in spans]
            cols = [pa.array(keys, b.column(0).type), pa.array(no, pa.int32()), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(how, pa.string()), pa.array(fit, pa.bool_())]
            yield pa.RecordBatch.from_arrays(cols + ([pa.array(part, pa.string())] if with_text else []), names=[x.split()[0] for x in fields.split(", ")])

    over = df.select(key, text, section).where(F.col(key).isNotNull() & oversized(F.col(text), F.col(section), limit))
    return over.mapInArrow(run, fields)
