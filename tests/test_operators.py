"""Golden cases and brute force for operators that SQL cannot state."""

from __future__ import annotations

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tanzaku.functions import text as T
from tanzaku.operators import chunking as C
from tanzaku.operators import features as X
from tanzaku.operators import merging as M
from tanzaku.operators import pages as G
from tanzaku.operators import metrics as E
from tanzaku.operators import recommend as R
from tanzaku.operators import retrieval as V
from tanzaku.operators import routing as Q
from tanzaku.operators import selecting as S


def _items(spark, n=30, d=6, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(i, i % 7, [float(x) for x in rng.normal(size=d)] if i % 5 else None, float(3 + i % 6), int(i * 13 % 400), i % 11 == 0, 1990 + i, datetime.date(1990 + i, 5, 1)) for i in range(n)]
    return spark.createDataFrame(rows, "item_id long, root long, vec array<double>, score double, votes long, nsfw boolean, air_year int, air_date date")


def _ratings(spark, rows):
    return spark.createDataFrame([(1, *r) for r in rows], "user_id long, item_id long, score double, confidence double, exclude boolean")


@pytest.mark.parametrize("score,mu", [(10.0, 8.05), (3.0, 5.71)])
def test_shrinkage(spark, score, mu):
    r = R.weighted(_ratings(spark, [(1, score, 1.0, True)])).collect()[0]
    assert abs(r.mu - (score + 2 * 7.07) / 3) < 1e-12 and abs(r.mu - mu) < 0.01


def test_last_answer_counts(spark):
    a = spark.createDataFrame([(1, 5, "seen", 9.0, 1), (1, 5, "wish", None, 2), (1, 6, "skip", None, 3), (1, None, "seen", 1.0, 4), (1, 7, "pass", None, 5)], "user_id long, item_id long, choice string, score double, seq int")
    got = {(r.item_id, r.score, r.confidence, r.exclude) for r in R.ratings_from_answers(a).collect()}
    assert got == {(5, 8.0, 0.5, False), (7, 3.0, 0.3, True)}


def test_recommend_against_numpy(spark):
    items = _items(spark)
    rated = [(3, 9.0, 1.0, True), (8, 4.0, 1.0, True), (5, 8.0, 0.5, False), (999, 10.0, 1.0, True)]
    got = R.recommend(items, _ratings(spark, rated), R.Options(rank_by="match", fold=False, top_k=50)).collect()
    rows = {r.item_id: r for r in items.collect()}
    mu = (sum(s * c for _, s, c, _ in rated) + 2 * 7.07) / (sum(c for _, _, c, _ in rated) + 2)
    pref = sum(c * (s - mu) * np.array(rows[i].vec) for i, s, c, _ in rated if i in rows and rows[i].vec)
    want = []
    for i, r in rows.items():
        if r.vec and i not in (3, 8) and not r.nsfw and r.score >= 3.5:
            v = np.array(r.vec)
            want.append((i, round(float(pref @ v / np.linalg.norm(pref) / np.linalg.norm(v)), 9)))
    want.sort(key=lambda x: (-x[1], x[0]))
    assert [(r.item_id, round(r.match, 8)) for r in got] == [(i, round(m, 8)) for i, m in want]


def test_recommend_edges(spark):
    items = _items(spark)
    for rated in ([], [(999, 8.0, 1.0, True)], [(5, 8.0, 1.0, True)]):
        assert R.recommend(items, _ratings(spark, rated)).count() == 0
    folded = R.recommend(items, _ratings(spark, [(3, 9.0, 1.0, True)]), R.Options(top_k=20)).collect()
    assert len({r.root for r in folded}) == len(folded) and all(0 <= r.quality <= 10 and -1 <= r.match <= 1 for r in folded)
    assert [r.rank_score for r in folded] == sorted((r.rank_score for r in folded), reverse=True)
    assert R.recommend(items.where("false"), _ratings(spark, [(3, 9.0, 1.0, True)])).count() == 0


def _mmr(x, pop, weight):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    picked: list[int] = []
    while len(picked) < len(x):
        best = max((i for i in range(len(x)) if i not in picked), key=lambda i: (round(weight * pop[i] - (1 - weight) * max((x[i] @ x[j] for j in picked), default=0), 9) if picked else pop[i], -i))
        picked.append(best)
    return picked


def test_mmr_against_its_definition(spark):
    rng = np.random.default_rng(5)
    x, done = rng.normal(size=(25, 4)), [int(v) for v in rng.integers(0, 50, 25)]
    df = spark.createDataFrame([(0, i, done[i], [float(v) for v in x[i]]) for i in range(25)] + [(0, 99, 5, None), (1, 7, None, [1.0, 0.0, 0.0, 0.0])], "g int, i int, done int, v array<double>")
    got = S.mmr_order(df, "g", "i", "done", "v").collect()
    p = np.log1p(done)
    want = _mmr(x, (p - p.min()) / (p.max() - p.min()), 0.5)
    assert [r.i for r in sorted((r for r in got if r.g == 0), key=lambda r: r.rank)] == want and [r.i for r in got if r.g == 1] == [7]


def test_greedy_spans_against_brute_force(spark):
    texts = ["蕾姆和拉姆是谁", "看eva的结局", "evangelion的eva", "海贼王路飞海贼", "", "aab"]
    names = ["蕾姆", "拉姆", "eva", "海贼王", "海贼", "路飞", "贼王路飞", "ab", "aa"]
    q = spark.createDataFrame(list(enumerate(texts)), "qid int, key string")
    got = sorted((r.qid, r.start, r.name) for r in V.mentions(q, spark.createDataFrame([(n,) for n in names], "name string")).collect())
    want = []
    for i, t in enumerate(texts):
        spans = [(-len(n), s, n) for n in names for s in range(len(t)) if t.startswith(n, s)]
        spans = [x for x in spans if not x[2].isascii() or not ((x[1] > 0 and t[x[1] - 1].isascii() and t[x[1] - 1].isalnum()) or (x[1] - x[0] < len(t) and t[x[1] - x[0]].isascii() and t[x[1] - x[0]].isalnum()))]
        used: list[tuple[int, int]] = []
        for n, s, name in sorted(spans):
            if all(s >= b or s - n <= a for a, b in used):
                used.append((s, s - n))
                want.append((i, s + 1, name))
    assert got == sorted(want)


def test_resolution_states(spark):
    q = spark.createDataFrame([(i,) for i in range(1, 9)], "qid int")
    f = [(1, "a", "subject", 10), (2, "a", "subject", 10), (2, "b", "subject", 11), (3, "x", "character", 10), (3, "y", "character", 10), (3, "z", "character", 11), (4, "x", "character", 10), (4, "z", "character", 11), (5, "a", "subject", 12), (6, "女主角", "character", 11), (6, "x", "character", 10), (7, "女主角", "character", 11)]
    found = spark.createDataFrame(f, "qid int, name string, entity_type string, root int")
    scopes = spark.createDataFrame([(10,), (11,)], "root int")
    got = {r.qid: (r.state, r.root) for r in V.resolve(q, found, scopes).collect()}
    assert got == {1: ("OK", 10), 2: ("AMBIGUOUS", None), 3: ("OK", 10), 4: ("AMBIGUOUS", None), 5: ("NO_CORPUS", 12), 6: ("OK", 10), 7: ("OK", 11), 8: ("UNKNOWN", None)}


CHOICES = [
    ([0.873, 0.671, 0.06, 0.032, 0.031, 0.03, 0.025, 0.023], {}, {1, 2, 3}),
    ([0.9 - 0.05 * i for i in range(8)], {}, set(range(1, 9))),
    ([0.001] * 6, {}, {1, 2}),
    ([0.9 - 0.1 * i for i in range(7)] + [0.0089], {"pinned": {8}}, set(range(1, 9))),
    ([0.001] * 10 + [0.9] * 5, {"pinned": set(range(1, 11))}, {1, 2, 3, 4, 11, 12, 13, 14}),
    ([0.543, 0.4, 0.3, 0.2, 0.1, 0.09, 0.08, 0.07, 0.0032], {"seat": 9}, {1, 2, 3, 4, 5, 6, 7, 9}),
    ([0.543, 0.4, 0.3, 0.2, 0.1, 0.09, 0.08, 0.07, 0.0032], {}, set(range(1, 9))),
    ([0.9] * 4 + [0.001] * 5, {"pinned": {5, 6, 7, 8}, "seat": 9}, {1, 2, 3, 5, 6, 7, 8, 9}),
]


def test_context_choice(spark):
    rows = [(g, i + 1, s, i + 1 in k.get("pinned", ()), i + 1 == k.get("seat")) for g, (scores, k, _) in enumerate(CHOICES) for i, s in enumerate(scores)]
    got = V.choose(spark.createDataFrame(rows, "g int, chunk_id int, score double, pinned boolean, seat boolean"), ["g"]).collect()
    for g, (_, _, want) in enumerate(CHOICES):
        mine = sorted((r for r in got if r.g == g), key=lambda r: r.position)
        assert {r.chunk_id for r in mine} == want
        assert [r.score for r in mine] == sorted((r.score for r in mine), reverse=True)


def test_songs_and_intents(spark):
    yes, no = ["片头曲是什么", "OP 是谁唱的", " op ", "ED曲", "主题曲"], ["Unlimited", "SPEED", "TOP", "pop", "FLOPS"]
    df = spark.createDataFrame([(x,) for x in yes + no], "q string")
    assert [r[0] for r in df.select(df.q.rlike(V.SONGS_QUERY)).collect()] == [True] * 5 + [False] * 5
    qs = [("作者还画过什么", "原作", False), ("导演还做过什么", "导演", False), ("制作公司是哪家", "", True), ("结局是什么", "", False), ("还有什么作品", "原作,导演", True)]
    df = spark.createDataFrame([(x,) for x, _, _ in qs], "q string")
    roles, studio = Q.relation_intent(F.col("q"))
    assert [(r[0], r[1]) for r in df.select(roles, studio).collect()] == [(b, c) for _, b, c in qs]
    voice = [("花泽香菜配过哪些角色？", "person"), ("钉宫理惠配了什么角色", "person"), ("樱井孝宏的配音作品有哪些", "person"), ("银魂里神乐是谁配的", "character"), ("这个角色的声优是谁", "character"), ("路飞的cv是谁", "character")]
    voice += [("推荐几部科幻番", None), ("《进击的巨人》的结局是什么", None), ("十年前的这个季度在播什么", None), ("银魂里神乐是谁配的角色", "character"), ("《进击的巨人》里有哪些角色", None), ("宫崎骏的代表作是什么", None), ("声优的代表作", "person")]
    voice += [("配过哪些角色", "person"), ("是谁配的", "character"), ("CV是谁", "character"), ("配了什么角色 是谁配的", "character"), ("结局", None)]
    df = spark.createDataFrame([(x,) for x, _ in voice], "q string")
    assert [r[0] for r in df.select(Q.voice_intent(F.col("q"))).collect()] == [v for _, v in voice]
    nums = [("十", 10), ("十二", 12), ("二十", 20), ("二十三", 23), ("两", 2), ("7", 7), ("百", None), ("", None)]
    df = spark.createDataFrame([(x,) for x, _ in nums], "q string")
    assert [r[0] for r in df.select(Q.chinese_int(F.col("q"))).collect()] == [v for _, v in nums]


def test_name_key_and_trigrams(spark):
    df = spark.createDataFrame([("Ｒｅ：ゼロ!",), ("ﾚﾑ ",), (None,), ("Straße",)], "n string")
    assert [r[0] for r in df.select(T.name_key("n")).collect()] == ["reゼロ", "レム", None, "strasse"]
    t = df.select(F.array_sort(T.trigrams(F.lit("ab cd"))).alias("t")).first().t
    assert t == sorted(["  a", " ab", "ab ", "  c", " cd", "cd "])


def test_chunks(spark):
    texts = ["短句。" * 300, "没有句号" * 400, "甲。\n" * 500, "短", "  ", "a" * 599 + "。" + "b。" * 30]
    for t in texts:
        c = C.pack_sentences([t])
        assert "".join("".join(c).split()) == "".join(t.split())
        assert all(len(x) <= C.MOST + C.LEAST for x in c)
    df = spark.createDataFrame([(1, texts[0]), (2, None), (3, "")], "k int, t string")
    assert {r.k for r in C.chunk_texts(df, "k", "t").collect()} == {1}


def test_html(spark):
    html = "<h2>剧情</h2><p>第一段文字，足够长的一段文字。<span class='heimu'>剧透</span></p><script>x()</script><h3>第一章</h3><ul><li>列表里的一项，足够长的内容在这里。</li></ul><h2>歌曲</h2><p>短</p>"
    got = G.html_sections(spark.createDataFrame([(1, html), (2, None)], "k int, h string"), "k", "h").collect()
    assert [(r.section, r.hidden) for r in got] == [("剧情", 2), ("剧情/第一章", 0)]


def test_roots(spark):
    n = 200
    items = spark.createDataFrame([(i, 1990 + i // 10) for i in range(n)] + [(900, 2000), (901, 2000), (902, 1980)], "item long, year int")
    edges = spark.createDataFrame([(i, i - 1) for i in range(1, n)] + [(900, 901), (901, 900), (900, 902), (902, 900), (5, 5)], "item long, prequel long")
    got = {r.item: r.root for r in X.series_roots(items, edges).collect()}
    assert all(got[i] == 0 for i in range(n)) and got[901] == got[900] == 902 and got[902] == 902


def test_merge_and_scope(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (None, "n", 3)], "k int, v string, w int")
    new = spark.createDataFrame([(1, None, 9), (3, "c", 9), (None, "m", 9)], "k int, v string, w int")
    got = {tuple(r) for r in M.upsert(old, new, ["k"], ["v"], preserve=True).collect()}
    assert got == {(1, "a", 1), (2, "b", 2), (3, "c", 9), (None, "m", 3)}
    assert {tuple(r) for r in M.upsert(M.upsert(old, new, ["k"], ["v"], True), new, ["k"], ["v"], True).collect()} == got
    scoped = {tuple(r) for r in M.replace_scope(old, new, ["k"], ["k", "v"]).collect()}
    assert scoped == {(2, "b", 2), (1, None, 9), (3, "c", 9), (None, "m", 9)}


def test_batches(spark):
    df = spark.createDataFrame([(0, i, 250) for i in range(5)] + [(1, 0, 900), (1, 1, 1)] + [(2, i, 1) for i in range(41)], "lane int, i int, n int")
    got = {(r.lane, r.i): r.batch for r in M.pack_batches(df, "lane", "i", "n").collect()}
    assert [got[0, i] for i in range(5)] == [0, 0, 1, 1, 2] and got[1, 0] == 0 and got[1, 1] == 1 and got[2, 19] == 0 and got[2, 20] == 1 and got[2, 40] == 2


def test_quantiles_and_metrics(spark):
    df = spark.createDataFrame([(x,) for x in [5, 1, 1, 3, 9, 7, 7]] + [(None,)], "v int")
    s = sorted([5, 1, 1, 3, 9, 7, 7])
    assert {(r.share, r.v) for r in E.quantile_by_index(df, "v", [0.0, 0.5, 0.9, 1.0]).collect()} == {(p, s[min(int(7 * p), 6)]) for p in (0.0, 0.5, 0.9, 1.0)}
    ranked = spark.createDataFrame([(1, i + 1, r) for i, r in enumerate([1, 0, 1])] + [(2, 1, 0)], "q int, rk int, rel int")
    got = {r.q: r for r in E.precision_ndcg(ranked, "q", "rk", "rel", 2).collect()}
    assert got[1].precision == 0.5 and abs(got[1].ndcg - 1 / (1 + 1 / np.log2(3))) < 1e-12 and got[2].ndcg == 0


def test_two_stage_prefers_the_first(spark):
    from tanzaku.operators import searching as H

    docs = spark.createDataFrame([(1, "red scarf", "a talking compass"), (2, "compass", "red"), (3, "x", None)], "k int, a string, b string")
    index = H.inverted(docs, "k", {"a": "A", "b": "B"})
    names = docs.select("k", F.col("a").alias("n"))
    assert [r.k for r in H.two_stage(index, names, "k", "n", "red", ["red"]).collect()] == [1, 2]
    assert [(r.k, r.stage) for r in H.two_stage(index, names, "k", "n", "compas", ["compas"]).collect()] == [(2, 2)]


def test_stored_tables_are_cleared(spark):
    from pathlib import Path

    from tanzaku import checkpoints

    df = checkpoints.stored(spark.range(5), "some")
    folder = Path(checkpoints._folder(spark).removeprefix("file://"))
    assert df.count() == 5 and list(folder.iterdir())
    checkpoints.clear(spark)
    assert not folder.exists()
    assert checkpoints.stored(spark.range(3), "more").count() == 3


def test_routes(spark):
    want = {"花泽香菜配过哪些角色": "voice", "2016年7月番有哪些": "season", "十年前的这个季度在播什么": "season", "《进击的巨人》的结局是什么": "ask", "2016年的作画怎么样": "ask", "给我推荐点像命运石之门的": "ask", "花泽香菜今年有哪些新番": "season"}
    df = spark.createDataFrame([(x,) for x in want], "q string")
    assert {r.q: r.r for r in df.select("q", Q.route(F.col("q"), F.lit(datetime.date(2026, 8, 21))).alias("r")).collect()} == want


def test_years_of_date_fields(spark):
    from tanzaku.sources import dumps as D

    rows = [("2001-02-03", None, 2001), ("", "{{Infobox\n|放送开始日= 1999年4月\n}}", 1999), (None, "|上映日期= 昭和，1986", 1986), (None, "|首播=2003", 2003), (None, "|公开日= 1975-01-01", 1975), (None, "|发售日=1990", 1990), (None, "|播放开始=1991", None), (None, "|结束=1992", None)]
    df = spark.createDataFrame([r[:2] for r in rows], "d string, i string")
    assert [r[0] for r in df.select(D.year_of(F.col("d"), F.col("i"))).collect()] == [r[2] for r in rows]
