from __future__ import annotations

import random

import pytest

from tanzaku.llm import quality as Q

COMMON = frozenset({"the", "a", "of", "and", "to", "in", "is", "that", "的", "了", "在"})
PROSE = "To win back the red scarf, she sets out alone for the station above the clouds. Nobody believed what he said, and only Rimin was willing to come along."
ZH = "为了找回被夺走的长剑，她决定独自前往白塔学院。这部作品的画面轻快，配乐也恰到好处，唯独后半段的节奏略显拖沓。"
rng = random.Random(3)
NOISE = " ".join("".join(rng.choice("bcdfghjklmnpqrstvwxz" * 2 + "aeiou") for _ in range(rng.randint(2, 9))) for _ in range(40))


def wrap(text: str, n: int) -> str:
    return "\n".join(text[i : i + n] for i in range(0, len(text), n))


CASES = [
    (PROSE, "prose"), (ZH * 3, "prose"), (wrap(ZH * 4, 17), "prose"), ("\n".join("> " + x for x in wrap(ZH * 3, 20).split("\n")), "prose"), ("甲：他们约定明年再见。\n乙：没有人相信她的话。\n甲：钟声响起时，她说出了真相。\n丙：故事从一间小店开始。", "prose"),
    (PROSE + "\n- a bell\n- a map\n- a sword\n" + PROSE, "prose"), ("\n".join(f"- item {i}" for i in range(9)), "list"), ("\n".join(f"{i}. 银色怀表" for i in range(9)), "list"),
    ("美术: 米尔娅\n监督: 菲莎\n原作: 诺迪亚\n脚本: 艾莎\n音乐: 莉迪亚", "list"), ("the last cogwheel\nthe red scarf\na glass bell\nhalf of a map\na paper boat", "list"),
    ("\n".join(f"{i}\tpier seven\tRimin\t4.{i}\t31{i}" for i in range(6)), "table"), ("\n".join(f"| {i} | 白塔学院 | 莉莎 | 4.{i} |" for i in range(6)), "table"),
    ("{|\n|-\n" + "|-\n".join(f"| {i} || pier seven || Rimin || 8.{i}\n" for i in range(6)) + "|}", "table"), ("\n".join(f"{i},名もない谷,ミレミ,6.2,55{i}" for i in range(6)), "table"),
    ("no   title        score\n" + "\n".join(f"{i}    pier seven     4.{i}" for i in range(6)), "table"),
    ("复制成功 " * 30, "junk"), ("哈" * 14, "junk"), ("loading please wait " * 20, "junk"), ("★★★★ !!!!!!&&&&&^????? ^^^^^^★★★...====", "junk"), (ZH.encode().decode("latin-1"), "junk"),
    (NOISE, "junk"), ("2f7c b5f2 b8ab 8f1a d422 a55e 8c8b c1ad\n" * 3 + "6e1c 83ce dbec 5442", "junk"), ("原�汕塽?□��□□傹□�?�?筛覭詌��□□?□??倮�□" * 3, "junk"),
    ("", "prose"), (None, "prose"), (" \n ", "prose"),
]


@pytest.mark.parametrize("text,kind", CASES)
def test_kinds(text, kind):
    assert Q.measure(text, COMMON)[-1] == kind


SENTENCE_50 = "".join(chr(i) for i in range(0x4E00, 0x9FA6) if Q.CLASS[i] == 7)[::130][:49] + "。"
LONG_EN = "To win back the red scarf that was taken from her, she sets out alone for the old station high above the clouds."
VARIED = " ".join(f"On day {i} the {a} of the {b} was lost, and {c} went to look for it." for i, (a, b, c) in enumerate(zip("bell map scarf sword door lamp".split(), "town tower river school harbour valley".split(), "Rimin Noel Mirea Fisha Aisha Lydia".split())))


@pytest.mark.parametrize("sep", ["", "\n", "\n\n"])
@pytest.mark.parametrize("text", [SENTENCE_50, LONG_EN])
def test_long_phrases_over_and_over(text, sep):
    assert Q.measure((text + (sep or " ")) * 20, COMMON)[-1] == "junk"


def test_most_of_a_document_repeats():
    line = "Loading the next page, please wait a moment."
    rest = VARIED[: int(len("".join(line.split())) * 12 * 0.75)]
    assert Q.measure("\n".join([line] * 12) + "\n" + rest, COMMON)[-1] == "junk"
    assert Q.measure((line + " ") * 12 + rest, COMMON)[-1] == "junk"
    halves = rest.split(". ")
    assert Q.measure("\n".join(f"{line}\n{halves[i % len(halves)] if i % 3 == 0 else line}" for i in range(12)), COMMON)[-1] == "junk"
    assert Q.measure(VARIED + "\n" + line + "\n" + VARIED[::-1][:10] + "\n" + line, COMMON)[-1] == "prose"


def test_statistics():
    names = [n for n, _ in Q.STATS]
    got = dict(zip(names, Q.measure("The bell is in the map.\nThe bell is in the map.\n- a map", COMMON)))
    assert got["n_chars"] == 55 and got["n_words"] == 14 and got["n_lines"] == 3
    assert abs(got["line_end_share"] - 2 / 3) < 1e-9 and abs(got["dup_line_share"] - 1 / 3) < 1e-9 and abs(got["bullet_share"] - 1 / 3) < 1e-9
    assert abs(got["mean_word_len"] - sum(map(len, "the bell is in the map the bell is in the map a map".split())) / 14) < 1e-9
    assert got["common_share"] > 0.4 and 0 < got["symbol_ratio"] < 0.1


def test_dominant_ngram():
    share = Q.measure("abcdefgh" * 50, COMMON)[[n for n, _ in Q.STATS].index("top_ngram_share")]
    assert share > 0.95


def test_frame(spark):
    rows = [(i, t) for i, (t, _) in enumerate(CASES)] + [(0, CASES[0][0]), (None, "x"), (99, (PROSE + " ") * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n_chars")
    got = {r.doc_id: r.doc_kind for r in Q.document_statistics(df, "doc_id", "text", ["the", None, ""]).collect()}
    assert got == {i: k for i, (_, k) in enumerate(CASES)} | {99: "prose"}
    assert Q.document_statistics(df.where("false"), "doc_id", "text", []).count() == 0


@pytest.mark.parametrize("n", [3, 7, 69, 118, 700])
def test_repetition_at_any_period(n):
    r = random.Random(n)
    phrase = "".join(chr(0x4E00 + r.randrange(3000)) for _ in range(n))
    top, again = Q.repetition(Q._codes(phrase * 30))
    assert top > 0.6 and again == 30 * n
    once = "".join(chr(0x4E00 + r.randrange(3000)) for _ in range(30 * n))
    assert Q.repetition(Q._codes(once))[1] == 0
    mixed = once + phrase * 8
    assert 0.9 * 8 * n <= Q.repetition(Q._codes(mixed))[1] <= 8 * n + 8 or n < 16


def test_common_words_against_brute_force():
    r = random.Random(1)
    words = ["的", "他们", "という", "はなし", "的人"]
    for _ in range(200):
        text = "".join(r.choice("的他们人とういはなしxy ") for _ in range(r.randrange(1, 60)))
        on = [False] * len(text)
        for w in words:
            for i in range(len(text) - len(w) + 1):
                if text[i : i + len(w)] == w:
                    on[i : i + len(w)] = [True] * len(w)
        assert Q.Common([*words, "the"]).cover(Q._codes(text)) == sum(on)


def test_letter_model():
    names = "Halrow Serabel Noerick Mirena Casdan Lurick Tomin Risia".lower().split()
    assert Q.LETTERS.odds("the story begins in a small shop".split()) > 0 > Q.LETTERS.chance / 2
    assert Q.LETTERS.odds(names) > Q.LETTERS.chance / 2 > Q.LETTERS.odds(NOISE.split())
