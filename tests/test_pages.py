"""Golden cases of the page rules, on the least HTML that triggers each."""

from __future__ import annotations

import pytest

from tanzaku.operators import pages as G

SONG_A = "<p>花になって（第1~12话） 歌：绿黄色社会 作词：长屋晴子，作曲：穴见真吾，编曲：川口圭太</p>"
SONG_B = "<p>アイコトバ（第1~12话） 歌：アイナ・ジ・エンド 作词、作曲：石崎ひゅーい，编曲：トオミヨウ</p>"
STORY = "少女在旧城的图书馆里找到了一本没有名字的书，从此每个夜晚都会听见远处传来的钟声，她决定独自去寻找。"


def sec(n: int, title: str, body: str) -> str:
    return f'<section data-mw-section-id="{n}">{f"<h2>{title}</h2>" if title else ""}{body}</section>'


def texts(*parts: str) -> list[str]:
    return [c[3] for c in G.chunks_of("<html><body>" + "".join(parts) + "</body></html>")]


def test_labels_stand_before_songs():
    got = " ".join(texts(sec(1, "相关音乐", f"<p>片头曲（OP）</p>{SONG_A}<p>片尾曲（ED）</p>{SONG_B}")))
    assert "片头曲（OP）：花になって" in got and "片尾曲（ED）：アイコトバ" in got
    assert got.count("片头曲（OP）") == 1


def test_stages_reset_kinds():
    got = " ".join(texts(sec(1, "相关音乐", f"<p>第1期</p><p>片尾曲（ED）</p>{SONG_A}<p>第2期</p>{SONG_B}")))
    assert "第1期 片尾曲（ED）：花になって" in got and "第2期：アイコトバ" in got


def test_details_join_their_song():
    got = " ".join(texts(sec(1, "主题曲", "<p>片头曲(OP)</p><p>曲名：偶尔也说说昔日吧，动画第一季每话开头播放的曲子</p><p>作词：加藤登纪子</p><p>作曲：加藤登纪子，编曲：菅野洋子，演奏时间三分钟</p>")))
    assert got.count("片头曲(OP)：") == 1 and "曲子 作词：加藤登纪子 作曲：" in got


def test_labels_only_in_song_sections():
    got = texts(sec(1, "剧情", f"<p>插曲</p><p>{STORY}</p>"))
    assert got == [STORY]


@pytest.mark.parametrize("cells,each,kept", [(6, 100, True), (18, 80, True), (10, 6, False), (41, 80, False), (1, 39, False), (1, 60, True)])
def test_tables(cells, each, kept):
    row = "".join(f"<td><p>{'剧情' * (each // 2)}{'事' * (each % 2)}</p></td>" for _ in range(cells))
    assert bool(texts(sec(1, "经历", f"<table><tbody><tr>{row}</tr></tbody></table>"))) == kept


def test_sections_nest_and_blocks_come_once():
    inner = sec(3, "第一章", f"<p>{STORY}一</p>")
    got = G.chunks_of(sec(2, "剧情", f"<p>{STORY}二</p>{inner}"))
    assert [(c[0], c[1], c[3]) for c in got] == [(2, "剧情", STORY + "二"), (3, "剧情 > 第一章", STORY + "一")]


def test_dropped_kinds_sections_and_classes():
    assert texts(sec(1, "外部链接", f"<p>{STORY}</p>"), sec(2, "舞台剧CAST", f"<p>{STORY}</p>" + sec(3, "中配版", f"<p>{STORY}</p>")), sec(4, "各话标题", f"<p>{STORY}</p>")) == []
    assert texts(sec(1, "剧情", f'<div class="navbox"><p>{STORY}</p></div><p class="menu-item">{STORY}</p><p>{STORY}<sup>[1]</sup></p>')) == [STORY]
    assert texts(sec(1, "人物", "<p>" + "甲•乙•丙•丁，" * 8 + "</p>")) == [] and texts(sec(1, "人物", "<p>" + "CV：甲，作词乙，作曲丙，" * 8 + "</p>")) == []


def test_floors():
    assert texts(sec(1, "剧情", f"<p>{STORY[:39]}</p>")) == [] and texts(sec(1, "剧情", f"<p>{STORY[:40]}</p>")) == [STORY[:40]]


def test_spoilers():
    box = f"<table><tr><td><p>以下内容含有剧透成分，可能影响观赏</p><p>。{STORY * 2}</p></td></tr></table>"
    got = G.chunks_of(sec(1, "剧情", box))
    assert got[0][5] and "剧透成分" not in got[0][3]
    hidden = G.chunks_of(sec(1, "剧情", f'<p>{STORY * 8}<span class="heimu">{STORY * 8}</span></p>'))
    assert len(hidden) == 1 + len(STORY) * 16 // 600 or len(hidden) >= 2
    total = sum(c[4] for c in hidden)
    assert len(STORY) * 8 - 2 * 16 <= total <= len(STORY) * 8 and all(c[4] > 0 for c in hidden)


def test_hidden_variants_and_widgets():
    span = """<span data-mw-variant='{"disabled":{"t":"<b>[[紅蓮|紅蓮の弓矢]]</b> &amp;amp; 心"}}'></span>"""
    got = texts(sec(1, "主题曲", f"<p>片头曲</p><p>{span}（歌：Linked Horizon，START_WIDGETxEND_WIDGET作词、作曲：Revo，动画的第一首曲子）</p>"))
    assert got and got[0].startswith("片头曲：紅蓮の弓矢 & 心（歌") and "WIDGET" not in got[0]


def test_broken_pages():
    assert G.chunks_of("") == [] and G.chunks_of("<p>") == [] and G.chunks_of("</div></p>x") == []
    assert [c[3] for c in G.chunks_of(f"<h2>剧情</h2><ul><li>{STORY}<li>{STORY}</ul>")] == [STORY * 2]


def test_frame(spark):
    df = spark.createDataFrame([(1, sec(7, "剧情", f"<p>{STORY}</p>")), (2, None), (3, "")], "k int, h string").selectExpr("*", "1 as chunk_no", "'x' as text")
    assert [(r.k, r.chunk_no, r.section_id, r.kind, r.spoiler_level) for r in G.page_chunks(df, "k", "h").collect()] == [(1, 0, 7, "prose", 0)]
    assert G.page_chunks(df.where("false"), "k", "h").count() == 0
