from __future__ import annotations

import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

import pytest

from tanzaku.llm import split


def _check(text: str, label: int, limit: int = 600, overlap: int = 50):
    spans, natural = split.pieces(text, label, limit, overlap)
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    for (a, b), (c, d) in zip(spans, spans[1:]):
        assert d > b and c == max(0, b - overlap)
    if limit - label > overlap:
        assert all(b - a <= limit - label for a, b in spans)
    joined = text[: spans[0][1]] + "".join(text[p[1] : q[1]] for p, q in zip(spans, spans[1:]))
    assert joined == text
    return spans, natural


def test_pieces_cover_and_fit():
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choice(["句", "a", " ", "。", "！」", "\n", ". ", "…", "，"] + ["字"] * 40) for _ in range(rng.randint(550, 4000)))
        _check(text, rng.choice([0, 5, 30]))


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab 。\n.，é́漢", min_size=0, max_size=400), st.integers(0, 12))
def test_any_text(text, label):
    _check(text, label, limit=40, overlap=7)


def test_cuts_are_natural_where_they_can_be():
    text = ("这是一句话，有一些字。" * 80)[:870] + "\n" + "第二段也有句子！" * 40
    spans, natural = _check(text, 6)
    assert natural and all(text[b - 1] in "。！\n" for _, b in spans)


def test_kind_by_stretches():
    ok = "字" * 543 + "。"
    assert split.pieces(ok * 3, 6, 600, 50)[1]
    assert not split.pieces("字" * 545 + "。" + ok, 6, 600, 50)[1]
    assert not split.pieces("字" * 2000, 0, 600, 50)[1]


def _least_cost(text: str, room: int, first: int) -> float:
    """The dynamic program by brute force over natural cuts."""
    cuts = split.natural_cuts(text)
    at = [0, *sorted(cuts), len(text)]
    best = {0: 0.0}
    for j in range(1, len(at)):
        options = [best[i] + (1 - (at[j] - at[i]) / (room if i else first)) ** 2 for i in range(j) if i in best and at[j] - at[i] <= (room if i else first)]
        if options:
            best[j] = min(options) + cuts.get(at[j], 0.0)
    return best[len(at) - 1]


def test_optimal():
    rng = random.Random(4)
    for _ in range(30):
        text = "".join(rng.choice(["字"] * 9 + ["。", "\n"]) for _ in range(260))
        path, natural = split.cut(text, 60, 70)
        if not natural:
            continue
        cuts = split.natural_cuts(text)
        cost = sum(cuts.get(b, 0.0) + (1 - (b - a) / (60 if a else 70)) ** 2 for a, b in zip(path, path[1:]))
        assert abs(cost - _least_cost(text, 60, 70)) < 1e-9


def test_frames(spark):
    long = "句子。" * 300
    rows = [(1, long, None), (1, long, None), (2, None, "x"), (3, "", None), (4, "短", "节"), (5, "字" * 599, ""), (None, long, None), (6, long, "长" * 700)]
    df = spark.createDataFrame(rows, "chunk_id long, text string, section string").selectExpr("*", "0 as piece", "1 as start")
    got = split.split_items(df, "chunk_id", "text", "section").distinct().collect()
    assert {r.chunk_id for r in got} == {1, 5, 6}
    assert {r.cut_kind for r in got if r.chunk_id == 1} == {"natural"} and {r.cut_kind for r in got if r.chunk_id == 6} == {"forced"}
    assert all(r.piece == (long if r.chunk_id != 5 else "字" * 599)[r.start : r.end] for r in got)
    assert split.split_items(df.where("false"), "chunk_id", "text", "section").count() == 0


def test_marks_stay_with_their_letters():
    text = ("ｶﾞ" * 800)
    spans, _ = split.pieces(text, 0, 600, 50)
    assert not any(re.match("[ﾞ゙]", text[b : b + 1]) for _, b in spans)


@pytest.mark.parametrize("label", [540, 551, 560, 597, 598])
def test_long_labels_keep_the_limit(label):
    text = "字" * 900
    spans, natural = split.pieces(text, label, 600, 50)
    assert all(b - a + label <= 600 for a, b in spans) and spans[0][0] == 0 and spans[-1][1] == 900
    assert all(a2 <= b1 < b2 for (_, b1), (a2, b2) in zip(spans, spans[1:])) and not natural


def test_labels_that_fill_the_limit_are_told(spark):
    df = spark.createDataFrame([(1, "字" * 900, "标" * 598), (2, "字" * 900, "标" * 560)], "k long, t string, s string")
    got = {r.k: r.fits for r in split.split_items(df, "k", "t", "s").collect()}
    assert got == {1: False, 2: True}
