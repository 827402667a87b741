from __future__ import annotations

import random

import numpy as np
import pytest

from tanzaku.llm import leakage as L

ZH = "染血的手套证明塔妮思依照遗嘱才改姓隐居，而红色围巾早已拆散在第七码头。米珂背上叛徒的罪名，米露希则替亡者还债交出第三封电报。"
EN = "Torow was struck from the register; Haldan, half drunk, left the blue seed with the backstreet detectives while the guards of the old harbour changed."


def test_winnowing_guarantee():
    rng = random.Random(1)
    for _ in range(300):
        shared = "".join(rng.choice("abcdefgh") for _ in range(L.SHORTEST))
        a, b = ("".join(rng.choice("xyz") for _ in range(rng.randint(0, 40))) + shared + "".join(rng.choice("uvw") for _ in range(rng.randint(0, 40))) for _ in range(2))
        assert np.intersect1d(L.fingerprints(L._codes(a))[0], L.fingerprints(L._codes(b))[0]).size


def _share(passage: str, lang: str, doc: str) -> float:
    p, codes = L.passage(passage, lang in L.BY_WORD), L._codes(L.letters(doc))
    (h, at), (g, pos) = L.fingerprints(p.codes), L.fingerprints(codes)
    same = h[:, None] == g[None, :]
    shift, times = np.unique((pos[None, :] - at[:, None])[same], return_counts=True)
    return p.repeated(codes, shift[times >= p.need].tolist()) / max(1, len(p.codes))


def test_dress_does_not_matter():
    dressed = "前言。" + ZH.replace("，", " <b>,</b>\n").replace("第三", "第​三") + "后记"
    assert _share(ZH, "zh", dressed) == 1.0
    assert _share(EN, "en", "x " + EN.upper().replace(" ", "  ").replace(";", " &nbsp;") + " y") == 1.0


def test_short_stretches_do_not_count():
    assert _share(ZH, "zh", ZH[:14]) == 0.0
    words = EN.split()
    assert _share(EN, "en", " ".join(words[:7])) == 0.0
    assert 0.2 < _share(EN, "en", "we saw that " + " ".join(words[:9]) + " again") < 0.6


def _brute(passage: str, doc: str) -> float:
    p, d = L.letters(passage), L.letters(doc)
    hit = [False] * len(p)
    for i in range(len(p) - 14):
        if p[i : i + 15] in d:
            hit[i : i + 15] = [True] * 15
    return sum(hit) / len(p)


def test_against_brute_force():
    rng = random.Random(7)
    for _ in range(100):
        doc = list(ZH)
        for _ in range(rng.randint(0, 5)):
            doc[rng.randrange(len(doc))] = "某"
        doc = "".join(doc)[rng.randint(0, 20) :]
        assert abs(_share(ZH, "zh", doc) - _brute(ZH, doc)) < 1e-9


def test_frame(spark):
    items = [(1, "zh", ZH), (2, "zh", ZH), (3, "en", EN), (4, "zh", None), (5, "zh", "短"), (None, "zh", ZH), (1, "zh", ZH)]
    docs = [(10, "前" + ZH), (10, "前" + ZH), (11, EN), (12, None), (13, ""), (14, "无关的文字。" * 50), (15, ZH[:20]), (16, ("文" * 50 + EN) * 200)]
    i = spark.createDataFrame(items, "item_id long, lang string, passage string").selectExpr("*", "1 as doc_id")
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as item_id", "2 as share")
    got = {(r.item_id, r.doc_id) for r in L.leaks(d, "doc_id", "text", i, "item_id", "lang", "passage").collect()}
    assert got == {(1, 10), (2, 10), (3, 11), (3, 16), *(((1, 15), (2, 15)) if _share(ZH, "zh", ZH[:20]) >= 1 / 3 else ())}
    assert L.leaks(d.where("false"), "doc_id", "text", i, "item_id", "lang", "passage").count() == 0
    assert L.leaks(d, "doc_id", "text", i.where("false"), "item_id", "lang", "passage").count() == 0


@pytest.mark.parametrize("bits,salts,chars", [(12, 1, 50), (28, 3, 1 << 20)])
def test_any_filter_and_salting_give_the_same(spark, monkeypatch, bits, salts, chars):
    i = spark.createDataFrame([(k, "zh", ZH + "其他内容" * k) for k in range(6)], "item_id long, lang string, passage string")
    d = spark.createDataFrame([(1, ZH), (2, "x"), (3, ""), (4, ZH[:30] * 3)], "doc_id long, text string")
    run = lambda: {(r.item_id, r.doc_id) for r in L.leaks(d, "doc_id", "text", i, "item_id", "lang", "passage").collect()}
    whole = run()
    for name, value in (("FILTER_BITS", bits), ("SALTS", salts), ("BATCH_CHARS", chars)):
        monkeypatch.setattr(L, name, value)
    assert run() == whole and whole


def test_markup_of_any_length():
    words = EN.split()
    style = f'<span style="{"color:red;" * 100}">'
    assert _share(EN, "en", " ".join(w + (style if k % 7 == 6 else "") for k, w in enumerate(words))) == 1.0
    assert _share(ZH, "zh", ZH[:20] + "<!-- " + "说明" * 500 + " -->" + ZH[20:40] + "[[" + "长" * 400 + "|" + ZH[40:] + "]]") == 1.0
    assert _share(ZH, "zh", ZH[:30] + "<!-- 没有结尾 " + ZH[30:]) > 0.9
    assert _share(EN, "en", "if a <b and c are less than d; " + EN) == 1.0


def test_letters_of_many_texts():
    rng = random.Random(5)
    texts = ["", "a", ZH, "Ｆｕｌｌ　Ｗｉｄｔｈ", "e\u0301t\u200be", "x\0y", "\u0301start", EN, "𠀀𠀁 𝐀", "㌔㍻" * 4] + ["".join(rng.choice("ab字ｶﾞ _<>&;") for _ in range(30)) for _ in range(50)]
    codes, of = L.letters_of(texts)
    for k, t in enumerate(texts):
        assert codes[of == k].tobytes().decode("utf-32-le") == L.letters(t)
    h, at = L._winnow(codes, of)
    for k, t in enumerate(texts):
        want = L.fingerprints(L._codes(L.letters(t)))
        mine = of[at] == k
        assert h[mine].tolist() == want[0].tolist() and (at[mine] - (np.searchsorted(of, k))).tolist() == want[1].tolist()


def test_share_of_letters_that_expand(spark):
    d = spark.createDataFrame([(1, "㌔" * 8 + "㍻" * 6)], "doc_id long, text string")  # fewer characters than a stretch, more letters
    i = spark.createDataFrame([(1, "ja", "キロ" * 8 + "平成" * 6)], "item_id long, lang string, passage string")
    assert [r.share for r in L.leaks(d, "doc_id", "text", i, "item_id", "lang", "passage").collect()] == [1.0]


def test_fewest_fingerprints_of_a_leak():
    rng = random.Random(11)
    for _ in range(300):
        p = "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(40, 200)))
        one, doc, got = L.passage(p, False), "", 0
        while got < len(p) / 3:
            i = rng.randrange(len(p) - 15)
            cut = p[i : i + rng.randrange(15, 40)]
            doc, got = doc + cut + "#%", got + len(cut)
        h, g = L.fingerprints(one.codes), L.fingerprints(L._codes(doc.replace("#%", "z" * rng.randrange(1, 9))))
        shift, times = np.unique((g[1][None, :] - h[1][:, None])[h[0][:, None] == g[0][None, :]], return_counts=True)
        if _share(p, "zh", doc) >= 1 / 3:
            assert times[times >= one.need].sum() >= one.need_in_all(1 / 3)
