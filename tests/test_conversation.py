from __future__ import annotations

from pyspark.sql import functions as F

from tanzaku.operators import conversation as V
from tanzaku.operators import translation as N


def test_turns(spark):
    df = spark.createDataFrame([(1, [("q" * 999, "a" * 999)] + [(str(i), None) for i in range(4)]), (2, [("x", "y")]), (3, [])], "k int, h array<struct<q:string,a:string>>")
    got = {r.k: r.t for r in df.select("k", V.last_turns(F.col("h")).alias("t")).collect()}
    assert [(t.q, t.a) for t in got[1]] == [("1", ""), ("2", ""), ("3", "")] and len(got[2]) == 1 and got[3] == []
    one = df.where("k = 1").select(V.last_turns(F.col("h"), 5).alias("t")).first().t[0]
    assert len(one.q) == len(one.a) == 300


def test_scopes(spark):
    schema = "qid int, pinned_scope int, own_state string, own_root int, own_roots array<int>, own_subjects boolean, own_characters map<int,array<int>>, previous_root int, previous_characters array<int>"
    rows = [
        (1, 9, "OK", 5, [5], True, {9: [1]}, 7, [2]),
        (2, None, "OK", 5, [5], True, {5: [3]}, 7, [2]),
        (3, None, "UNKNOWN", None, [], False, {}, 7, [2]),
        (4, None, "AMBIGUOUS", None, [7, 8], True, {7: [4]}, 7, [2]),
        (5, None, "AMBIGUOUS", None, [8, 9], False, {}, 7, [2]),
        (6, None, "AMBIGUOUS", None, [8, 9], True, {}, 7, [2]),
        (7, None, "OK", 7, [7], True, {7: [4, 2]}, 7, [2, 1]),
        (8, None, "UNKNOWN", None, None, None, None, None, None),
    ]
    got = {r.qid: (r.state, r.root, r.characters, r.source) for r in V.scope_of(spark.createDataFrame(rows, schema)).collect()}
    assert got == {
        1: ("OK", 9, [1], "pinned"), 2: ("OK", 5, [3], "own"), 3: ("OK", 7, [2], "history"), 4: ("OK", 7, [2, 4], "history"), 5: ("OK", 7, [2], "history"),
        6: ("AMBIGUOUS", None, [], "own"), 7: ("OK", 7, [1, 2, 4], "own"), 8: ("UNKNOWN", None, [], "own"),
    }
    df = spark.createDataFrame([("AMBIGUOUS", ["a", "b"]), ("UNKNOWN", None), ("OK", None)], "s string, l array<string>")
    assert [r[0] for r in df.select(V.reply(F.col("s"), F.col("l"))).collect()] == ["你是指哪一部？a / b", "没认出你问的是哪部作品或哪个角色。", None]


def test_rerank_falls_back(spark):
    pool = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 101)], "qid int, chunk_id int, position int")
    assert [(r.chunk_id, r.score) for r in V.reranked(pool, None).orderBy("position").collect()] == [(10, 1.0), (11, 0.5)]
    scores = spark.createDataFrame([(1, 11, 0.9)], "qid int, chunk_id int, score double")
    assert {(r.chunk_id, r.score) for r in V.reranked(pool, scores).collect()} == {(10, None), (11, 0.9)}


def test_chase(spark):
    r = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("x", "y"), ("y", "x")], "source string, target string")
    t = spark.createDataFrame([(c,) for c in "acexz"], "title string")
    got = {x.title: x.target for x in V.chase(t, r).collect()}
    assert got == {"a": "d", "c": "e", "e": "e", "x": "y", "z": "z"}


def test_echo(spark):
    ja, zh = "ふたりは初雪の朝にもう一度ガラスの温室で会おうと約束した。本作は明るい映像と音楽が魅力である。", "他们约定，等到初雪的早晨再一起回到玻璃温室。"
    rows = [(ja, ja, True), (ja, zh, False), (ja, "", True), (ja, None, True), (zh, zh, False), (zh * 3, zh * 3, True), ("レム", "レム", True), ("レム", "雷姆", False)]
    got = spark.createDataFrame(rows, "s string, d string, w boolean").select(N.untranslated(F.col("s"), F.col("d")).alias("g"), "w").collect()
    assert [r.g for r in got] == [r.w for r in got]


def test_variants_and_models(spark):
    df = spark.createDataFrame([('{"disabled":{"t":"<b>White &amp; Black</b> [[A|想風]]"}}',), ("{}",), ("broken",)], "a string")
    assert [r[0] for r in df.select(N.variant_text(F.col("a"))).collect()] == ["White & Black 想風", "", ""]
    rows = [("k", "m2", "v1", "two"), ("k", "m1", "v1", "old"), ("k", "m1", "v2", "new"), ("j", "m9", "v1", "nine"), ("i", "m1", "v1", None)]
    t = spark.createDataFrame(rows, "src_sha string, model string, prompt_version string, dst string")
    assert {(r.src_sha, r.dst) for r in N.best_translation(t, ["m1", "m2"]).collect()} == {("k", "new"), ("j", "nine")}
    s = spark.createDataFrame([("剧情/第一章",), ("注释/来源",), ("",)], "p string")
    assert [r[0] for r in s.select(N.skipped(F.col("p"))).collect()] == [False, True, False]


def test_from_question_to_context(spark):
    from tanzaku.operators.conversation import answer_context

    v = lambda x: [float(x), 1.0]
    q = spark.createDataFrame([(1, "甲作的主题曲是什么", "甲作的主题曲是什么", v(1)), (2, "小红在甲作", "小红在甲作", v(1)), (3, "什么都没有", "什么都没有", v(1)), (4, "乙作", "乙作", None), (5, None, None, v(1))], "qid int, question string, key string, qvec array<double>")
    names = spark.createDataFrame([("甲作", "subject", 10, None), ("小红", "character", 10, 7), ("乙作", "subject", 20, None)], "name string, entity_type string, root int, character_id int")
    rows = [(100 + i, 10, "series", 0, v(i), None, i) for i in range(12)] + [(200, 10, "songs", 0, v(-9), None, 0), (300, 10, "char", 0, v(-5), 7, 0), (301, 10, "char", 1, v(50), 7, 1), (400, 20, "series", 0, v(1), None, 0)]
    chunks = spark.createDataFrame(rows, "chunk_id int, root int, layer string, spoiler_level int, vec array<double>, character_id int, chunk_no int").withColumn("qid", F.lit(0))
    got = answer_context(q, names, chunks).collect()
    of = lambda i: [(r.state, r.chunk_id) for r in sorted((r for r in got if r.qid == i), key=lambda r: r.position or 0)]
    assert len(of(1)) == 8 and {c for _, c in of(1)} >= {200, 111} and 301 not in {c for _, c in of(1)}
    assert 300 in {c for _, c in of(2)} and 200 not in {c for _, c in of(2)}
    assert of(3) == [("UNKNOWN", None)] and of(4) == [("OK", None)] and of(5) == [("UNKNOWN", None)]
