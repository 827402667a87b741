"""Encyclopaedia pages to chunks: a tree of the HTML, its sections, and rules on what is kept.

A page is read into a tree, hidden texts are put back, tables are kept as paragraphs or dropped by their content,
and what is no text (notes, navigation, figures) goes. Blocks of text belong to the innermost section around them;
its path of titles tells the kind. Song titles take the labels above them, and blocks are packed into chunks to which
their hidden characters are dealt out in proportion. Pages without marked sections are cut at their headings.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tanzaku.operators.chunking import BLOCK_LEAST, CREDIT, DROPPED, KINDS, LEAST, ONLY_LEAST, TABLE_CELLS, TABLE_CJK, TABLE_PER_CELL, pack_blocks
from tanzaku.operators.translation import SKIPPED

#: Fixed values.
TEXT_TAGS = ("p", "li", "dd", "dt", "blockquote")
DROP_TAGS = ("style", "script", "figure", "sup", "audio", "video", "img", "rt", "rp")
DROP_CLASSES = (
    "thumb", r"gallery\w*", "navbar", "navbox", r"infoBox\w*", r"noteTA\w*", "toc", r"reference\w*", "mw-editsection", "noprint", "hlist", r"Tab(?:Label|Content)?\w*", "magnify",
    "mw-empty-elt", "template-ruby-hidden", "menu-(?:item|content|popout|title)", "six divs",
)
SPOILER_BOX = re.compile(r"以下内容含有剧透成分[^。]*")
WIDGET = re.compile("[￼​]|START_WIDGET.*?END_WIDGET")
SONG_STAGE = re.compile(r"^第[0-9一二三四五六七八九十]+[期季部]$")
SONG_LABEL = re.compile(
    r"^(?:(?:片头曲|片頭曲|片尾曲|片尾|片头|主题曲|主題曲|插曲|插入曲|插入歌|印象曲|印象歌|角色歌|character\s*song)(?:\s*[（(][^）)]{0,8}[）)])?\s*\d*|(?:OP|ED|IN|IM)\s*\d*)$", re.I
)
SONG_MORE = re.compile(r"^(?:作词|作曲|编曲|作詞|編曲|演唱|歌|CV)[、，,]?[^:：]{0,6}[:：]")
BULLETS_LEAST, CREDITS_LEAST, MARK, FRONT = 3, 3, "heimu", "(前言)"

_DROP_CLASS = re.compile(rf"\b(?:{'|'.join(DROP_CLASSES)})\b")
_KINDS = [(kind, re.compile(pattern)) for kind, pattern in KINDS]
_CREDIT, _SKIPPED, _CJK, _BLANK = re.compile(CREDIT), re.compile(SKIPPED), re.compile("[一-鿿]"), re.compile(r"\s+")
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
HEADS = ("h1", "h2", "h3", "h4", "h5", "h6")
#: What an opening tag ends, and within what it looks for it.
ENDS = {"p": ({"p"}, {"table", "section", "div"}), "li": ({"li", "p"}, {"ul", "ol"}), "dd": ({"dd", "dt", "p"}, {"dl"}), "dt": ({"dd", "dt", "p"}, {"dl"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr", "td", "th"}, {"table"})}

Block = tuple[str, int, bool]  #: text, hidden characters, whether it stood in a spoiler box


@dataclass(eq=False)
class Node:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    kids: list[Node | str] = field(default_factory=list)
    boxed: bool = False

    def nodes(self) -> Iterator[Node]:
        """All nodes below, in the order of the page."""
        todo = [k for k in reversed(self.kids) if isinstance(k, Node)]
        while todo:
            node = todo.pop()
            yield node
            todo += [k for k in reversed(node.kids) if isinstance(k, Node)]

    def text(self) -> str:
        out, todo = [], list(reversed(self.kids))
        while todo:
            k = todo.pop()
            if isinstance(k, str):
                out.append(k)
            else:
                todo += reversed(k.kids)
        return _BLANK.sub(" ", "".join(out)).strip()


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open = [Node("page")]

    def handle_starttag(self, tag, attrs):
        if tag in ENDS:
            ends, within = ENDS[tag]
            for i in range(len(self.open) - 1, 0, -1):
                if self.open[i].tag in within:
                    break
                if self.open[i].tag in ends:
                    del self.open[i:]
                    break
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].kids.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].kids.append(Node(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                break

    def handle_data(self, data):
        self.open[-1].kids.append(data)


def tree(page: str) -> Node:
    parser = _Tree()
    parser.feed(page)
    parser.close()
    return parser.open[0]


def variant(attribute: str) -> str:
    """The text that a language variant keeps in its JSON attribute: tags off, entities read, links by their display names."""
    try:
        kept = (json.loads(attribute).get("disabled") or {}).get("t") or ""
    except (ValueError, AttributeError):
        return ""
    plain = entities.unescape(re.sub(r"<[^>]+>", "", kept))
    return re.sub(r"\[\[(?:[^\[\]|]*\|)?([^\[\]|]*)\]\]", r"\1", plain).replace("[[", "").replace("]]", "").strip()


def table_is_prose(text: str, cells: int) -> bool:
    """Whether a table reads as prose: enough ideographs, few cells, long ones."""
    n = len(_CJK.findall(text))
    return n >= TABLE_CJK and cells <= TABLE_CELLS and n >= TABLE_PER_CELL * max(cells, 1)


def _settle(node: Node) -> None:
    """Puts texts of variants back, turns tables into paragraphs or drops them, and drops what is no text."""
    kept: list[Node | str] = []
    for k in node.kids:
        if isinstance(k, Node):
            if k.tag == "table":
                said = k.text()
                if not table_is_prose(said, sum(x.tag in ("td", "th") for x in k.nodes())):
                    continue
                k.tag, k.boxed = "p", SPOILER_BOX.search(said) is not None
            if k.tag in DROP_TAGS or _DROP_CLASS.search(k.attrs.get("class", "")):
                continue
            _settle(k)
        kept.append(k)
    node.kids = kept


@dataclass(eq=False)
class Section:
    id: int
    path: tuple[str, ...]
    blocks: list[Node] = field(default_factory=list)


def sections(page: str) -> list[Section]:
    """The sections of a page with the path of their titles and the blocks that are theirs and no inner section's."""
    root = tree(page)
    for x in root.nodes():
        if "data-mw-variant" in x.attrs and not x.text():
            x.kids = [variant(x.attrs["data-mw-variant"])]
    _settle(root)
    out = [Section(0, ())]
    levels: list[tuple[int, str]] = []

    def read(node: Node, into: Section) -> Section:
        for k in node.kids:
            if not isinstance(k, Node):
                continue
            if k.tag == "section" and k.attrs.get("data-mw-section-id", "").lstrip("-").isdigit():
                title = next((t for h in k.kids if isinstance(h, Node) and h.tag in HEADS[1:5] and (t := h.text())), "")
                out.append(Section(int(k.attrs["data-mw-section-id"]), into.path + ((title,) if title else ())))
                read(k, out[-1])
            elif k.tag in HEADS and not marked:
                level = int(k.tag[1])
                levels[:] = [x for x in levels if x[0] < level] + [(level, k.text())]
                into = Section(len(out), tuple(t for _, t in levels))
                out.append(into)
            elif k.tag in TEXT_TAGS:
                into.blocks.append(k)
            else:
                into = read(k, into) if not marked else (read(k, into), into)[1]
        return into

    marked = any(x.tag == "section" and "data-mw-section-id" in x.attrs for x in root.nodes())
    read(root, out[0])
    return [s for s in out if s.blocks]


def block_of(node: Node, mark: str = MARK) -> Block:
    text = WIDGET.sub("", node.text()).strip()
    hidden = sum(len(x.text()) for x in node.nodes() if mark in x.attrs.get("class", ""))
    return text, min(hidden, len(text)), node.boxed


def song_labels(blocks: list[Block]) -> list[Block]:
    """Blocks of a song section, each behind the stage and kind above it; labels do not come out alone, details join the song before them."""
    stage = kind = ""
    out: list[Block] = []
    for text, hidden, boxed in blocks:
        if SONG_STAGE.match(text):
            stage, kind = text, ""
        elif SONG_LABEL.match(text):
            kind = text
        elif out and SONG_MORE.match(text):
            out[-1] = (f"{out[-1][0]} {text}", out[-1][1] + hidden, out[-1][2] or boxed)
        else:
            label = " ".join(x for x in (stage, kind) if x)
            out.append((f"{label}：{text}" if label else text, hidden, boxed))
    return out


def kind_of_path(path: str, text: str) -> str:
    found = next((kind for kind, pattern in _KINDS if pattern.search(path)), None)
    return found or ("credits" if len(_CREDIT.findall(text)) >= CREDITS_LEAST else "prose")


def is_credits(text: str) -> bool:
    return len(_CREDIT.findall(text)) >= CREDITS_LEAST or text.count("•") + text.count("・") >= BULLETS_LEAST


def chunks_of(page: str) -> list[tuple[int, str, str, str, int, bool]]:
    """(section id, section, kind, text, hidden characters, spoiler box) of the chunks of a page."""
    out = []
    for s in sections(page):
        if any(_SKIPPED.match(t) for t in s.path):
            continue
        path = " ".join(s.path)
        blocks = [block_of(b) for b in s.blocks]
        if _KINDS[0][1].search(path):
            blocks = song_labels(blocks)
        blocks = [b for b in blocks if len(b[0]) >= BLOCK_LEAST]
        kind = kind_of_path(path, " ".join(b[0] for b in blocks))
        if not blocks or kind in DROPPED:
            continue
        made = pack_blocks(blocks)
        for text, hidden, boxed in made:
            boxed = boxed or SPOILER_BOX.search(text) is not None
            text = SPOILER_BOX.sub("", text).strip()
            if len(text) >= (ONLY_LEAST if len(made) == 1 else LEAST) and not (kind == "prose" and is_credits(text)):
                out.append((s.id, " > ".join(s.path) or FRONT, kind, text, hidden, boxed))
    return out


def page_chunks(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, chunk_no, section_id, section, kind, text, heimu_chars, spoiler_box, spoiler_level) of HTML pages.

    Chunks count from 0 in the order of the page. Null pages, and pages of which nothing is kept, give none.
    """
    kind = pages.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, i, *c, int(c[4] > 0 or c[5])) for k, h in zip(b[key], b[html]) for i, c in enumerate(chunks_of(h))]
            yield pd.DataFrame(rows, columns=[key, "chunk_no", "section_id", "section", "kind", "text", "heimu_chars", "spoiler_box", "spoiler_level"])

    return pages.select(key, html).where(F.col(html).isNotNull()).mapInPandas(run, f"{key} {kind}, chunk_no int, section_id int, section string, kind string, text string, heimu_chars int, spoiler_box boolean, spoiler_level int")


def html_sections(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, block_no, section, text, hidden): blocks of ``BLOCK_LEAST`` characters or more with the path of their titles."""
    kind = pages.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, h in zip(b[key], b[html]):
                got = [("/".join(s.path), text, hidden) for s in sections(h) for text, hidden, _ in map(block_of, s.blocks) if len(text) >= BLOCK_LEAST]
                rows += [(k, i, *x) for i, x in enumerate(got)]
            yield pd.DataFrame(rows, columns=[key, "block_no", "section", "text", "hidden"])

    return pages.select(key, html).where(F.col(html).isNotNull()).mapInPandas(run, f"{key} {kind}, block_no int, section string, text string, hidden int")
