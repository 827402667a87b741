from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tanzaku.functions import text as T
from tanzaku.operators import titles as N


@pytest.mark.parametrize(
    "title,same,behind",
    [
        ("剧场版 魔法少女小圆 [前篇] 起始的物语", set(), {"魔法少女小圆"}), ("Re：从零开始的异世界生活 雪之回忆", {"Re:从零开始的异世界生活 雪之回忆"}, set()), ("幸运星 OVA", set(), {"幸运星"}),
        ("IS〈无限斯特拉托斯〉", set(), {"无限斯特拉托斯"}), ("双☆星!", {"双星!", "双星！", "双☆星！"}, set()), ("轻音少女", set(), set()), ("", set(), set()),
    ],
)
def test_variants(title, same, behind):
    got = N.variants(title)
    assert {v for v, c in got.items() if c == "A"} >= same and {v for v, c in got.items() if c == "B"} >= behind
    assert "Re" not in got and "前篇" not in got and title not in got
    assert got or not (same | behind)


def test_owners_and_best_match(spark):
    names = spark.createDataFrame([(1, "幸运星 OVA"), (1, "幸运星OVA"), (2, "幸运星：前"), (2, None), (3, "甲：乙丙丁戊己庚辛"), (1, "幸运星 OVA")], "root int, name string").withColumn("variant", F.lit(0))
    got = {r.variant: (r.cls, r.owners) for r in N.title_variants(names, "root", "name").collect()}
    assert got["幸运星"] == ("B", [1, 2]) and got["幸运星:前"] == ("A", [2]) and "甲" not in got
    found = spark.createDataFrame([("幸运星", 7), ("幸运星:前", 8)], "variant string, target int")
    best = {r.owner: (r.variant, r.target) for r in N.best_match(N.title_variants(names, "root", "name"), found).collect()}
    assert best == {1: ("幸运星", 7), 2: ("幸运星:前", 8)}


@pytest.mark.parametrize(
    "question,titles,left",
    [
        ("《一人之下》讲了什么故事？", ["一人之下"], "讲了什么故事？"), ("《紫罗兰永恒花园》", ["紫罗兰永恒花园"], "《紫罗兰永恒花园》"), ("Ｆａｔｅ／Zero 的结局是什么样", ["fatezero"], " 的结局是什么样"),
        ("没有名字的问题", ["别的"], "没有名字的问题"), ("没有名字的问题", [], "没有名字的问题"), ("「ガールズ」のｶﾞイド", ["ガールズ"], "「ガールズ」のｶﾞイド"),
    ],
)
def test_scope_titles(spark, question, titles, left):
    assert N.without_scope_title(question, titles) == left
    df = spark.createDataFrame([(question, titles), (None, titles)], "q string, t array<string>")
    assert [r[0] for r in df.select(N.scope_stripped("q", "t")).collect()] == [left, None]


def test_tails(spark):
    jp = "これは日本語の文章です。とても長い文章なので、原文と呼ばれます。"
    zh = "这是一段足够长的中文简介，讲述了主角的旅途与归来的故事。"
    rows = [(f"{zh}\n[简介原文]\n{jp}", zh), (f"{zh}【 原文 】{jp}", zh), (f"{zh}\n\n{jp}", zh), (f"[原文]{jp}", f"[原文]{jp}"), (zh, zh), (jp, jp), ("", ""), (None, None)]
    df = spark.createDataFrame([r[:1] for r in rows], "s string")
    assert [r[0] for r in df.select(T.without_tail(F.col("s"))).collect()] == [r[1] for r in rows]


def test_candidate_titles(spark):
    rows = [(1, 1, "原名", "中文名"), (2, 1, "原名 第二季", None), (3, None, " ", "独立"), (4, 1, "中文名", "乙")]
    got = [(r.root, r.title, r.position) for r in N.candidate_titles(spark.createDataFrame(rows, "subject_id int, series_root int, name string, name_cn string")).orderBy("root", "position").collect()]
    assert got == [(1, "中文名", 1), (1, "原名", 2), (1, "乙", 3), (1, "原名 第二季", 4), (3, "独立", 1)]
