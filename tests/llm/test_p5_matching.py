from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tanzaku.llm import matching as M


@pytest.mark.parametrize(
    "title,lead,want",
    [
        ("TV动画 夜桥之寻师：极代 Ⅱ", None, ("夜桥之寻师极代", 2, None, False)),
        ("夜橋のガラベル 極代（2015年版）", None, (M.core("夜橋のガラベル 極代"), 0, 2015, False)),
        ("夜桥之寻师：极代(漫画)", None, ("夜桥之寻师极代", 0, None, True)),
        ("夜桥 第二二季", "《夜桥》是由Studio Lanta制作、于二〇一七年播出的动画作品。", ("夜桥", 2, 2017, False)),
        ("夜​桥 Season 3", "96年春季首播的TV动画，原名夜橋，动画制作为不明。", ("夜桥", 3, 1996, False)),
    ],
)
def test_titles(title, lead, want):
    p = M.parse_page(title, lead)
    assert (p["title"], p["season"], p["year"], p["skip"]) == want


@pytest.mark.parametrize("chunks", [7, 5, 14])
def test_multi_index_search_is_exact(spark, chunks):
    rng = random.Random(5)
    chars = "夜桥之寻师极代霜原守者双声晨灯忆影与帆空时旅人的歌"
    names = ["".join(rng.choice(chars) for _ in range(rng.randint(3, 9))) for _ in range(400)]
    other = [n[:i] + rng.choice(chars) + n[i + 1 :] for n in names[:200] for i in [rng.randrange(len(n))]]
    vec = {n: M.bit_vector(n) for n in {*names, *other}}
    of = {v: n for n, v in vec.items()}
    assert len(of) == len(vec)
    left, right = (spark.createDataFrame([vec[x] for x in set(v)], "v0 long, v1 long") for v in (other, names))
    got = {(of[r.a0, r.a1], of[r.b0, r.b1]) for r in M.close_vectors(left, right, chunks=chunks).collect()}
    ones = lambda x: bin(x & (2**64 - 1)).count("1")
    want = {(a, b) for a in set(other) for b in set(names) if ones(vec[a][0] ^ vec[b][0]) + ones(vec[a][1] ^ vec[b][1]) <= M.RADIUS}
    assert got == want and len(want) > 50


def _data(spark):
    works = [
        (1, "夜橋のガラベル 極代", "夜桥之寻师：极代", 2015, ["Studio Lanta"], "2020-01-01"),
        (2, "夜橋のガラベル 極代 Ⅱ", "夜桥之寻师：极代 第2期", 2017, None, "2020-01-01"),
        (3, "霜原ロゼニカ×幻頁", None, 1999, ["Works Orrery"], "2020-01-01"),
        (4, "双声！晨灯忆师", "双声！晨灯忆师", 1990, None, "2020-01-01"),
        (5, "双声！晨灯忆师", "双声！晨灯忆师", 2012, None, "2020-01-01"),
        (4, "双声！晨灯忆师", "双声！晨灯忆师", 1990, None, "2021-01-01"),
        (6, None, None, None, None, None), (None, "x", "y", 1, None, None),
    ]
    pages = [
        (10, "series", "夜桥之寻师：极代（动画）", "《夜橋のガラベル 極代》是由Studio Lanta制作、于2015年播出的动画作品。", 1),
        (11, "series", "夜橋のガラベル 極代 2nd", None, 1),
        (12, "series", "霜霜原ロゼニカ×幻頁", "原作改编动画，Works Orrery负责制作，1999年开播。原题「霜原ロゼニカ×幻頁」。", 1),
        (13, "series", "双声！晨灯忆师（2012年版）", None, 1),
        (14, "series", "双声！晨灯忆师", None, 1),
        (15, "series", "双声！晨灯忆师（原声集）", None, 1),
        (16, "character", "双声！晨灯忆师", None, 1),
        (17, "series", "完全不同的名字", None, 1), (18, "series", None, None, None), (None, "series", "双声！晨灯忆师", None, 1),
        (10, "series", "夜桥之寻师：极代（动画）", "《夜橋のガラベル 極代》是由Studio Lanta制作、于2015年播出的动画作品。", 2),
    ]
    w = spark.createDataFrame(works, "subject_id int, name string, name_cn string, air_year short, studios array<string>, updated_at string").withColumn("pageid", F.lit(0))
    p = spark.createDataFrame(pages, "pageid int, kind string, title string, lead_text string, lastrevid int").withColumn("subject_id", F.lit(0))
    return w, p


def test_matches(spark):
    w, p = _data(spark)
    got = {(r.subject_id, r.pageid): r.confidence for r in M.matches(w, p).collect()}
    assert set(got) == {(1, 10), (2, 11), (3, 12), (5, 13), (4, 14)}
    assert all(0.5 <= c <= 1 for c in got.values())


def test_near_works_of_other_seasons_are_seen(spark):
    works = [(1, None, "星海港之歌", 2001, None, "2020"), (2, None, "星海港的之歌 第二季", 2003, None, "2020")]
    w = spark.createDataFrame(works, "subject_id int, name string, name_cn string, air_year short, studios array<string>, updated_at string")
    p = spark.createDataFrame([(9, "series", "星海港之歌 第二季", None, 1)], "pageid int, kind string, title string, lead_text string, lastrevid int")
    assert [(r.pageid, r.subject_id) for r in M.scored_pairs(w, p).collect()] == [(9, 2)]


def test_confidence_is_calibrated(spark):
    """On planted matches with noise, the mean confidence of a band of reported pairs is about the share of true matches in it."""
    rng = random.Random(9)
    chars = "夜桥之寻师极代霜原守者双声晨灯忆影与帆空时旅人的歌山川湖海云雨雪风花月鸟虫鱼石木竹"
    works, pages, true = [], [], {}
    for i in range(1500):
        name = "".join(rng.choice(chars) for _ in range(rng.randint(3, 6)))
        works.append((i, None, name, 1985 + rng.randrange(40), ["Studio " + rng.choice("ABCDEFGH") * 3], "2020"))
        if rng.random() < 0.3:  # another work of nearly the same name
            j = rng.randrange(len(name))
            works.append((10_000 + i, None, name[:j] + rng.choice(chars) + name[j + 1 :], 1985 + rng.randrange(40), None, "2020"))
    for k in range(1500):
        sid, _, name, year, studios, _ = rng.choice(works)
        title, said = name, year if rng.random() < 0.9 else 1985 + rng.randrange(40)
        if rng.random() < 0.5:
            j = rng.randrange(len(name))
            title = name[:j] + rng.choice(chars) + name[j + 1 :]
        if rng.random() < 0.15:
            title, sid = "".join(rng.choice(chars) for _ in range(4)), None
        made = studios[0] if studios and rng.random() < 0.8 else "不明"
        pages.append((k, "series", title, f"{said}年播出的动画，由{made}制作。" if rng.random() < 0.6 else None, 1))
        true[k] = sid
    w = spark.createDataFrame(works, "subject_id int, name string, name_cn string, air_year short, studios array<string>, updated_at string")
    p = spark.createDataFrame(pages, "pageid int, kind string, title string, lead_text string, lastrevid int")
    got = [(r.confidence, true[r.pageid] == r.subject_id) for r in M.matches(w, p, first_bonus=1.0).collect()]
    for lo, hi in ((0.5, 0.8), (0.8, 0.95), (0.95, 1.01)):
        band = [(c, t) for c, t in got if lo <= c < hi]
        if len(band) >= 30:
            assert abs(sum(c for c, _ in band) / len(band) - sum(t for _, t in band) / len(band)) < 0.12, (lo, hi, len(band))
    sure = [t for _, t in got]
    assert sum(sure) / len(sure) > 0.93 and len(sure) > 900


def test_empty(spark):
    w, p = _data(spark)
    assert M.matches(w.where("false"), p).count() == 0
    assert M.matches(w, p.where("false")).count() == 0
