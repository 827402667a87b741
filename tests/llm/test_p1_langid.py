from __future__ import annotations

import pytest

from tanzaku.llm import langid as L

TEXTS = {
    "zh": "他们约定，等到初雪的早晨再一起回到白塔学院。与其说这是一个关于勇气的故事，不如说它写的是她的成长。",
    "ja": "ふたりは初雪の朝にもう一度ガラスの温室で会おうと約束した。本作は明るい映像と音楽が魅力である。",
    "ko": "두 사람은 첫눈이 오는 날 지하 도서관에서 다시 만나자고 약속했다. 아무도 그 말을 믿지 않았다.",
    "en": "They promised to meet again in the underground library when the first snow falls. Nobody believed what she said.",
    "fr": "Ils se sont promis de se revoir dans la bibliothèque le jour de la première neige. Personne ne la croyait.",
    "de": "Sie versprachen einander, sich beim ersten Schnee in der Bibliothek wiederzusehen. Niemand glaubte ihr.",
    "es": "Se prometieron volver a verse en la biblioteca el día de la primera nieve. Nadie creía lo que ella decía.",
}


@pytest.fixture(scope="module")
def model():
    return L.fit([])


@pytest.mark.parametrize("lang", TEXTS)
def test_one_language(model, lang):
    got = L.stretches(TEXTS[lang], model)
    assert [g[2] for g in got] == [lang] and got[0][3] > 0.5 and got[0][:2] == (0, len(TEXTS[lang]))


@pytest.mark.parametrize("a,b", [("zh", "en"), ("ja", "de"), ("fr", "zh"), ("en", "fr"), ("ko", "ja"), ("es", "de")])
def test_two_languages(model, a, b):
    for sep in ("\n", "\n\n***\n", " "):
        text = TEXTS[a] + sep + TEXTS[b]
        got = L.stretches(text, model)
        assert [g[2] for g in got] == [a, b]
        assert got[0][1] == got[1][0] and got[1][1] == len(text)


def test_names_and_separators_make_no_stretch(model):
    text = "《夜桥》的原名是「夜橋のガラベル 極代」，英文名为Frostfield!! Alonoa Hollow Hour。" + TEXTS["zh"] + "\n----\n" + TEXTS["zh"]
    assert [g[2] for g in L.stretches(text, model)] == ["zh"]


def test_nothing_to_read(model):
    for text in ("", "   ", "***", "12345 !!", "\n\n"):
        assert L.stretches(text, model) == []


def test_wrong_labels_do_not_spoil_the_fit():
    labelled = [(lang, t) for lang, t in TEXTS.items()] * 30 + [("zh", TEXTS["en"])] * 10 + [("en", TEXTS["ja"])] * 10
    model = L.fit(labelled)
    assert all([g[2] for g in L.stretches(t, model)] == [lang] for lang, t in TEXTS.items())


def test_filter_returns_all_languages_of_an_ngram(model):
    shared = L.grams(L._codes("de la"))[0]
    found = model.found(shared).any(0)
    assert found[L.LANGS.index("fr")] and found[L.LANGS.index("es")] and not found[L.LANGS.index("zh")]
    assert (model.chance < 0.01).all()


def test_labels(spark):
    rows = ["zh_Hans", "CHI", "ja-JP", "eng", "und", "", None, "Unknown", "mul", "GER", " fr "]
    df = spark.createDataFrame([(r,) for r in rows], "label string")
    got = [r[0] for r in df.select(L.label_language(df.label)).collect()]
    assert got == ["zh", "zh", "ja", "en", None, None, None, None, "?", "de", "fr"]


def test_frame(spark, model):
    rows = [("a", TEXTS["zh"] + "\n" + TEXTS["en"], 1), ("a", TEXTS["zh"] + "\n" + TEXTS["en"], 1), ("b", None, 1), ("c", "", 1), ("d", TEXTS["ko"] * 400, 1)]
    df = spark.createDataFrame(rows, "k string, text string, seg_no int")
    got = L.language_stretches(df, ["k"], "text", model).distinct().collect()
    assert sorted((r.k, r.seg_no, r.n_seg, r.lang) for r in got) == [("a", 1, 2, "zh"), ("a", 2, 2, "en"), ("d", 1, 1, "ko")]
    assert L.language_stretches(df.where("false"), ["k"], "text", model).count() == 0
