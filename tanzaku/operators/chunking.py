"""Kinds of sections, sentence packing, links."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values.
TARGET, MOST, LEAST, BLOCK_LEAST, ONLY_LEAST = 400, 600, 80, 12, 40
KINDS = [
    ("songs", r"(?i)主题曲|主題曲|片头曲|片尾曲|片頭曲|插曲|OP$|ED$|歌曲|曲目|音乐|音樂|BGM|角色歌"),
    ("credits", r"(?i)CAST|STAFF|声优|聲優|配音|演员|演職員|職員|制作人员|製作人員|工作人员"),
    ("episodes", r"各话|各話|各集|话数|話數|分集|集数|集數|剧集|劇集|集标题|集標題|标题列表|標題列表"),
    ("goods", r"单行本|單行本|发售|發售|商品|周边|BD|DVD|蓝光"),
    ("guide", r"攻略|流程图|流程圖|路线图|路線圖|存档点|存檔點"),
]
DROPPED = ("episodes", "goods", "credits", "info", "guide")
CREDIT = r"CV[.:：]|作词|作曲|编曲|演唱[:：]|作詞|編曲"
TABLE_CJK, TABLE_CELLS, TABLE_PER_CELL = 40, 40, 60


def kind_of(title: Column, text: Column) -> Column:
    """Kind of a section by its title, else credits for a text with three credit marks or more, else prose."""
    out = None
    for kind, pattern in KINDS:
        hit = F.coalesce(title, F.lit("")).rlike(pattern)
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.when(F.regexp_count(text, F.lit(CREDIT)) >= 3, "credits").otherwise("prose")


def keeps_table(cjk: Column, cells: Column) -> Column:
    """Whether a table reads as prose: enough ideographs, few cells, long ones."""
    return (cjk >= TABLE_CJK) & (cells <= TABLE_CELLS) & (cjk / F.greatest(cells, F.lit(1)) >= TABLE_PER_CELL)


SENTENCE = re.compile(r"[^。！？!?…\n]*[。！？!?…\n]|[^。！？!?…\n]+$")


@lru_cache
def _overlong(most: int) -> re.Pattern[str]:
    """The longest start of a text that ends at a secondary mark in the second half of ``most`` characters, else one more than ``most``."""
    return re.compile(rf"(?s).{{{most // 2},{most - 1}}}[，、；)）】」』 ]|.{{{most + 1}}}")


def sentences(text: str, most: int = MOST) -> list[str]:
    """Pieces of a text behind sentence ends and line ends, overlong ones cut once more; blank ones are left out."""
    out: list[str] = []
    for found in SENTENCE.finditer(text):
        at, end = found.span()
        while end - at > most:
            head = _overlong(most).match(text, at, end)
            out.append(head.group())
            at = head.end()
        out.append(text[at:end])
    return [s for s in out if not s.isspace()]


def pack_blocks(blocks: list[tuple[str, int, bool]], target: int = TARGET, most: int = MOST, least: int = LEAST) -> list[tuple[str, int, bool]]:
    """Greedy chunks of about ``target`` characters of (text, hidden characters, flag).

    Hidden characters of a block are dealt out to its sentences in proportion to their length, rounded down; a flag holds for every
    chunk that has a sentence of its block. A short tail joins the chunk before it, which may then exceed
    ``most`` by less than ``least``.
    """
    groups: list[list[tuple[str, int, bool]]] = []
    size = target  # as if full, so that the first sentence opens a group
    for text, hidden, flag in blocks:
        share = hidden / len(text) if text else 0.0
        for s in sentences(text, most):
            if size >= target or size >= least and size + len(s) > most:
                groups.append([])
                size = 0
            groups[-1].append((s, int(len(s) * share), flag))
            size += len(s)
    made = [("".join(s for s, _, _ in g).strip(), sum(h for _, h, _ in g), any(f for _, _, f in g)) for g in groups]
    chunks = [c for c in made if c[0]]
    if len(chunks) > 1 and len(chunks[-1][0]) < least:
        (a, m, f), (b, n, g) = chunks[-2:]
        chunks[-2:] = [(a + b, m + n, f or g)]
    return chunks


def pack_sentences(blocks: list[str], target: int = TARGET, most: int = MOST, least: int = LEAST) -> list[str]:
    """``pack_blocks`` of texts alone."""
    return [c[0] for c in pack_blocks([(b, 0, False) for b in blocks], target, most, least)]


def chunk_texts(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, chunk_no, chunk): packed chunks of each text, numbered from 0; null texts give none."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, i, c) for k, t in zip(b[key], b[text]) for i, c in enumerate(pack_sentences(t.split("\n\n")))]
            yield pd.DataFrame(rows, columns=[key, "chunk_no", "chunk"])

    return df.select(key, text).where(F.col(text).isNotNull()).mapInPandas(run, f"{key} {kind}, chunk_no int, chunk string")


def links(html: Column) -> Column:
    """Distinct internal link targets of a page, without other namespaces."""
    return F.filter(F.array_distinct(F.regexp_extract_all(html, F.lit(r'href="/([^"#?]+)'), F.lit(1))), lambda x: ~x.contains(":"))


def spoiler_level(hidden: Column, box: Column) -> Column:
    return F.when((hidden > 0) | box, 1).otherwise(0)
