"""Per-document text statistics and the kind of text: prose, list, table or junk.

Lines are grouped into blocks and each block is judged by combined rules: field counts for tables, bullets
and entry lengths for lists, sentence ends for prose and hard-wrapped prose, repetition and character
statistics for junk. A document is what most of its characters are. One pass over each text, no shuffle;
the list of common words is a parameter whose size is checked.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tanzaku.llm.langid import SEEDS

REPEATS = 4  #: a line of prose that comes so many times is one phrase over and over
MAX_COMMON = 100_000  #: most common words that are handed to the tasks

TERMINAL = re.compile(r"[.。！？!?…～~♪][\"'”’」』】）)\]〉》]*(\s*[(（][^()（）]{1,8}[)）])?\s*$|[\"”」』]\s*$")
ENDS = re.compile(r"[。！？!?…]+|\.(?=\s|$|[\"”')\]])")
BULLET = re.compile(r"^\s*(?:[-*+・•●○■□◆◇‣▪※★☆–—]\s*|\(?\d{1,4}[.)．、:：]\s*|（\d{1,4}）\s*|[①-⑳]\s*|#\d+\s+|\[\d+\]\s*)(?=\S)")
RULE_LINE = re.compile(r"^\s*(?:\{\||\|\}|\|-+|\|\+.*|!.*!!.*|[|+:\-\s=]{3,})\s*$")
COMMA = re.compile(r"[，、,;；]")
PAIRED = re.compile(r"[:：]\s*\S|[「『][^」』]+[」』]")
QUOTE = re.compile(r"^\s*>+ ?")
END_CODES = np.array([ord(c) for c in ".。！？!?…"], np.uint32)
CJK = re.compile("[぀-ヿ㐀-鿿豈-﫿가-힯]")
LATIN = re.compile(r"[^\W\d_぀-ヿ㐀-鿿豈-﫿가-힯]+")
HEX = re.compile(r"^(?=.*\d)[0-9a-f]{4,}$", re.I)

STATS = (
    ("n_chars", "long"), ("n_words", "long"), ("mean_word_len", "double"), ("symbol_ratio", "double"), ("digit_ratio", "double"),
    ("n_lines", "long"), ("line_end_share", "double"), ("bullet_share", "double"), ("common_share", "double"), ("dup_line_share", "double"),
    ("dup_paragraph_share", "double"), ("top_ngram_share", "double"), ("list_share", "double"), ("table_share", "double"), ("junk_share", "double"),
)


def _classes() -> np.ndarray:
    """Class of every code point below 65 536; see ``NAMES``."""
    out = np.zeros(65536, np.uint8)
    for i in range(65536):
        c = chr(i)
        kind = unicodedata.category(c)
        if c.isspace():
            out[i] = 0
        elif c in "\ufffd□" or 0xE000 <= i <= 0xF8FF or kind in ("Cn", "Cc", "Cs"):
            out[i] = 5
        elif 0x4E00 <= i <= 0x9FFF or 0x3400 <= i <= 0x4DBF:
            try:
                out[i] = 7 if len(c.encode("gb2312")) == 2 else 8
            except UnicodeEncodeError:
                out[i] = 8
        elif 0x3040 <= i <= 0x30FF and kind[0] == "L":
            out[i] = 9
        elif 0xAC00 <= i <= 0xD7A3 or 0xF900 <= i <= 0xFAFF:
            out[i] = 11
        elif i < 128 and c.isalpha():
            out[i] = 2
        elif kind[0] == "N":
            out[i] = 3
        elif kind[0] in "LM":
            out[i] = 6 if 0xA1 <= i <= 0xFF or c in "ƒŠŒšœŸžŽˆ" else 1
        else:
            out[i] = 10 if 0xA1 <= i <= 0xFF or c in "€‚„…†‡‰‹‘’“”•–—˜™›" else 4
    return out


CLASS = _classes()
NAMES = ("space", "letter", "ascii letter", "number", "sign", "broken", "latin-1 letter", "common ideograph", "rare ideograph", "kana", "latin-1 sign", "other CJK")


def _codes(text: str) -> np.ndarray:
    return np.minimum(np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32), 65535)


def _weight(s: str) -> int:
    return len("".join(s.split()))


def _edges(on: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the runs of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], on.astype(np.int8), [0]))))
    return edge[::2], edge[1::2]


def _double(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the ``2 * size``-grams from those of the ``size``-grams."""
    with np.errstate(over="ignore"):
        return h[:-size] * np.uint64(0x9E3779B97F4A7C15) + (h[size:] ^ (h[size:] >> np.uint64(17)))


def repetition(chars: np.ndarray) -> tuple[float, int]:
    """(largest share of the characters that one n-gram covers, characters in stretches that say one phrase four times or more).

    n-grams of 4 characters, or 8 in texts of 64 or more, and then twice as long as long as one comes three
    times, without overlaps. Phrases may be of any length: their periods are read off the distances between
    equal n-grams. A phrase has one sentence end at most, so a passage of several sentences that comes again is
    a copy, not a phrase.
    """
    n, size = len(chars), 4
    if n >= 3 and (chars == chars[0]).all():
        return 1.0, n if n >= 6 else 0
    if n < 12:
        return 0.0, 0
    h = _double(_double(chars.astype(np.uint64) + np.uint64(1), 1), 2)
    if n >= 64:
        h, size = _double(h, 4), 8
    order = np.argsort(h, kind="stable")
    first = h[order]
    same = first[1:] == first[:-1]
    if not same.any():
        return 0.0, 0
    top, times, width, g = 0.0, int(np.diff(np.flatnonzero(np.concatenate(([True], ~same, [True])))).max()), size, h
    while times >= 3:
        top = max(top, min(times, n // width) * width / n)
        if n < 6 * width:
            break
        g = _double(g, width)
        width *= 2
        times = int(np.unique(g, return_counts=True)[1].max())
    gaps = np.diff(order)[same]
    votes = np.bincount(gaps[gaps <= n // 4]) if len(gaps) >= n // 8 else np.empty(0, np.int64)
    if n < 16 or not len(votes):
        return top, 0
    stop = np.isin(chars, END_CODES) & ~((chars == ord(".")) & np.append((CLASS[chars[1:]] == 3), False))
    ends = np.append(0, np.cumsum(stop & ~np.append(stop[1:], False)))
    best = 0
    for p in np.argsort(-votes, kind="stable")[:3].tolist():
        if p == 0 or votes[p] < n // 16:
            continue
        again = chars[:-p] == chars[p:]
        if again.sum() >= 0.9 * (n - p) and (ends[-1] <= 1.25 * n / p or p <= 4):
            return top, n
        start, stop_ = _edges(again)
        long = stop_ - start >= 3 * p
        one = ends[start[long] + p] - ends[start[long]] <= 1
        best = max(best, int((stop_ - start + p)[long][one].sum()))
    return top, min(best, n)


class LetterModel:
    """Which letters follow which in words of Latin letters: smoothed trigrams over ``SEEDS``, as log odds against letters at random.

    Code points beyond a to z count as their base letter or as one further sign. ``odds`` is the mean per letter: above
    zero for words of the languages, about ``chance`` for letters at random, in between for names of other languages.
    """

    def __init__(self, texts: list[str]) -> None:
        tri, bi, uni = np.full((28, 28, 28), 0.0), np.full((28, 28), 0.0), np.full(28, 1.0)
        x, y, z = self._trigrams(re.findall(r"[^\W\d_]+", " ".join(texts).lower()))
        np.add.at(tri, (x, y, z), 1)
        np.add.at(bi, (y, z), 1)
        np.add.at(uni, z, 1)
        one = uni / uni.sum()
        two = (bi + 6 * one) / (bi.sum(1, keepdims=True) + 6)
        three = (tri + 3 * two) / (tri.sum(2, keepdims=True) + 3)
        self.table = (np.log(three) - np.log(1 / 28)).astype(np.float32)
        self.chance = float(self.table[1:27, 1:27, 1:27].mean())

    @staticmethod
    def _trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Letters of all trigrams of the words, each with two blanks before and one behind it."""
        text = "  " + "  ".join(words) + " "
        if not text.isascii():
            text = "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn")
        c = LETTER[np.minimum(_codes(text), 127)]
        inside = (c[1:-1] > 0) | (c[2:] > 0)
        return c[:-2][inside], c[1:-1][inside], c[2:][inside]

    def odds(self, words: list[str]) -> float:
        got = self.table[self._trigrams(words)]
        return float(got.mean()) if len(got) else 0.0


LETTER = np.full(128, 27, np.int64)  #: of every ASCII code: 1 to 26 for letters, 0 for a blank, 27 for all others
LETTER[[*range(97, 123)]], LETTER[32] = np.arange(1, 27), 0
LETTERS = LetterModel([SEEDS[x] for x in ("en", "fr", "de", "es")])


def _latin_noise(words: list[str]) -> bool:
    """Whether Latin words are letters at random."""
    long = [w.lower() for w in words if len(w) >= 3]
    return len(long) >= 5 and LETTERS.odds(long) < LETTERS.chance / 2


class Common:
    """Common words for lookups: those of alphabets as a set, those of CJK as hashes by length, found in one pass a length."""

    def __init__(self, words: Iterable[str]) -> None:
        self.words = frozenset(words)
        self.single = np.zeros(65536, bool)
        longer: dict[int, list[int]] = {}
        for w in self.words:
            if CJK.match(w):
                c = _codes(w)
                if len(c) == 1:
                    self.single[c[0]] = True
                else:
                    longer.setdefault(len(c), []).append(self._hash(c, len(c))[0])
        self.longer = {n: np.unique(np.array(x, np.uint64)) for n, x in longer.items()}

    @staticmethod
    def _hash(codes: np.ndarray, n: int) -> np.ndarray:
        x, h = codes.astype(np.uint64), np.zeros(len(codes) - n + 1, np.uint64)
        with np.errstate(over="ignore"):
            for j in range(n):
                h = h * np.uint64(0x100000001B3) + x[j : j + len(h)]
        return h

    def cover(self, codes: np.ndarray) -> int:
        """How many characters lie in common words of CJK."""
        on = self.single[codes]
        for n, hashes in self.longer.items():
            if len(codes) >= n:
                h = self._hash(codes, n)
                at = np.searchsorted(hashes, h)
                for p in np.flatnonzero(hashes[np.minimum(at, len(hashes) - 1)] == h).tolist():
                    on[p : p + n] = True
        return int(on.sum())


def _junk(text: str, common: Common, codes: np.ndarray | None = None, rows: bool = False, repeated: int | None = None) -> bool:
    """Whether there is nothing to read in ``text``: signs, broken coding, noise or, if it is no ``rows`` of a table, one phrase over and over."""
    codes = _codes(text) if codes is None else codes
    kinds = CLASS[codes]
    c = np.bincount(kinds, minlength=12)
    n = int(c[1:].sum())
    again = repetition(codes[kinds > 0])[1] if repeated is None else repeated
    if n < 12:
        return n - c[4] - c[10] > 0.5 * n and again > 0.5 * n
    if n - c[4] - c[5] - c[10] < 0.45 * n or c[5] > 0.04 * n:
        return True
    if c[6] + c[10] > 0.3 * n and c[6] + c[10] > 0.6 * c[2]:
        return True
    if c[3] > 0.1 * n and sum(len(w) for w in re.split(r"[\s,;:|-]+", text) if HEX.match(w)) > 0.5 * n:
        return True
    if not rows and again > 0.5 * n:
        return True
    if c[2] > 0.6 * n and _latin_noise(re.findall(r"[A-Za-z]+", text)):
        return True
    return c[8] >= 12 and c[8] > 0.45 * (c[7] + c[8]) and c[7] + c[8] > 0.4 * n and c[9] == 0 and not common.cover(codes)


def _width(s: str) -> int:
    return len(s) + len(CJK.findall(s))


def _fields(line: str) -> tuple[str, int]:
    """The separator that cuts a line into three fields or more, and their number."""
    s = line.strip()
    for sep, got in (("||", s.count("||")), ("\t", line.count("\t")), ("|", s.strip("|").count("|")), ("｜", s.strip("｜").count("｜"))):
        if got >= 2:
            return sep, got + 1
    got = len(re.findall(r"(?<=\S)(?: {2,}|　{2,})(?=\S)", s))
    if got >= 2:
        return "  ", got + 1
    for sep in (",", ";", "，", "；"):
        parts = s.split(sep)
        if len(parts) >= 3 and max(map(len, parts)) <= 40 and (sep in ",;" and " " not in {p[:1] for p in parts[1:]} or sep in "，；" and not TERMINAL.search(s) and any(p.strip().replace(".", "").isdigit() for p in parts)):
            return sep, len(parts)
    return "", 0


def line_kinds(lines: list[str]) -> list[str]:
    """prose, list, table, junk or blank for each line, judged in blocks of neighbouring lines of one look."""
    look: list[str] = []
    for raw in lines:
        line = QUOTE.sub("", raw)
        if not line.strip():
            look.append("blank")
        elif RULE_LINE.match(line) and len(set(line.strip())) <= 5:
            look.append("rule")
        elif (f := _fields(line))[1] >= 3:
            look.append(f"row{f[0]}{f[1] if f[0] in ',;，；' else ''}")
        elif BULLET.match(line):
            look.append("bullet")
        else:
            look.append("plain")
    tables = [i for i, x in enumerate(look) if x.startswith("row")]
    out = ["prose"] * len(lines)
    for i, x in enumerate(look):
        if x == "blank":
            out[i] = "blank"
        elif x == "rule":
            near = [look[j] for j in range(max(0, i - 2), min(len(look), i + 3)) if j != i]
            out[i] = "table" if any(y.startswith("row") for y in near) or tables and re.match(r"^\s*(\{\||\|)", lines[i]) else "blank"
        elif x.startswith("row"):
            near = sum(1 for j in range(max(0, i - 3), min(len(look), i + 4)) if j != i and look[j] == x)
            strong = x[3:4] in ("|", "\t", "｜")
            out[i] = "table" if near >= (1 if strong else 2) else ("table" if strong and len(tables) >= 2 else "prose")
        elif x == "bullet":
            body = BULLET.sub("", lines[i])
            sentence = TERMINAL.search(body) and len(ENDS.findall(body)) >= 1 and _weight(body) > 24
            out[i] = "prose" if sentence or _weight(body) > 160 else "list"
    i = 0
    while i < len(lines):  # unmarked lines: short entries, or prose that is cut into lines
        if look[i] not in ("plain",) and not (look[i].startswith("row") and out[i] == "prose"):
            i += 1
            continue
        j = i
        if _sentence(lines[i]):
            i += 1
            continue
        while j < len(lines) and (look[j] == "plain" or look[j].startswith("row") and out[j] == "prose") and not _sentence(lines[j]):
            j += 1
        block = [QUOTE.sub("", x) for x in lines[i:j]]
        sizes = [_weight(x) for x in block]
        ends = sum(len(ENDS.findall(x)) for x in block)
        wide = sum(map(_width, block)) / len(block)
        paired = sum(1 for x in block if PAIRED.search(x)) >= 0.8 * len(block) and not any(COMMA.search(x) for x in block)
        if len(block) >= 3 and ends <= 0.15 * len(block) and ends * 200 <= sum(sizes) + 100 and wide <= (120 if paired else 60) and (paired or not _wrapped(block)):
            out[i:j] = ["list"] * len(block)
        i = j
    return out


def _sentence(line: str) -> bool:
    """Whether a line ends like a sentence and is long enough for one."""
    return TERMINAL.search(line) is not None and _weight(line) > 12 and ENDS.search(line) is not None


def _wrapped(block: list[str]) -> bool:
    """Whether lines look like one text broken at a width: all but the last nearly as wide as the widest."""
    if len(block) < 3:
        return False
    width = [_width(x.strip()) for x in block]
    full = sum(1 for w in width[:-1] if w >= 0.8 * max(width))
    return full >= 0.85 * (len(block) - 1) and len(set(block)) == len(block) and any(re.search(r"[，、,；;：:]", x) for x in block)


def measure(text: str | None, common: Common | Iterable[str]) -> tuple:
    """Values of ``STATS`` and the document's kind; a null or blank text is prose with zero counts.

    Blocks of lines are lists, tables or prose by their look. Of what is not a list or a table the repetition
    statistics decide: paragraphs and lines that come ``REPEATS`` times or more (duplicate shares) and, where one
    n-gram dominates, the stretches that say one phrase over and over, are junk. A document is what most of its
    characters are.
    """
    if not text or text.isspace():
        return (len(text or ""), 0, 0.0, 0.0, 0.0, 0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, "prose")
    common = common if isinstance(common, Common) else Common(common)
    codes = _codes(text)
    kinds_at = CLASS[codes]
    counts = np.bincount(kinds_at, minlength=12)
    n = int(counts[1:].sum())
    lines = text.splitlines()
    full = [x.strip() for x in lines if not x.isspace() and x]
    latin = LATIN.findall(text.lower())
    cjk = int(counts[7] + counts[8] + counts[9] + counts[11])
    digit = kinds_at == 3
    words = len(latin) + cjk + int((digit[1:] & ~digit[:-1]).sum()) + int(digit[0])
    shared = sum(len(w) for w in latin if w in common.words) + (common.cover(codes) if cjk else 0)
    top, again = repetition(codes[kinds_at > 0])
    times = Counter(full)
    paragraphs = [p.strip() for p in re.split(r"\n\s*\n", text) if not p.isspace() and p] if "\n" in text else [text]
    blocks = Counter(paragraphs)
    dup_lines, dup_paragraphs = 1 - len(times) / max(1, len(full)), 1 - len(blocks) / max(1, len(paragraphs))
    share: Counter[str] = Counter()
    kinds = line_kinds(lines)
    rows = sum(k == "table" for k in kinds) > 0.5 * len(full)
    if _junk(text, common, codes, rows, again):
        share["junk"] = n if rows or again <= 0.5 * n else again
    else:
        repeated = {x for p, c in blocks.items() if c >= REPEATS for x in map(str.strip, p.splitlines())} if dup_paragraphs else set()
        if dup_lines:
            repeated |= {x for x, c in times.items() if c >= REPEATS}
        doubtful = counts[5] + counts[8] + counts[6] + counts[10] + counts[4] + counts[3] + (counts[2] if counts[2] < 0.9 * n else 0) > 0.25 * n or dup_lines > 0
        for line, kind in zip(lines, kinds):
            if kind == "prose" and (line.strip() in repeated or doubtful and _junk(line, common)):
                kind = "junk"
            if kind not in ("prose", "blank"):
                share[kind] += _weight(line)
    other = sum(share.values())
    kind = max(("list", "table", "junk"), key=lambda k: share[k]) if other > 0.5 * n else "prose"
    return (
        len(text), words, (sum(map(len, latin)) + cjk) / max(1, len(latin) + cjk), float(counts[4] + counts[10] + counts[5]) / n, float(counts[3]) / n,
        len(full), sum(1 for x in full if TERMINAL.search(x)) / max(1, len(full)), sum(1 for x in full if BULLET.match(x)) / max(1, len(full)), min(1.0, shared / n), dup_lines,
        dup_paragraphs, top, share["list"] / n, share["table"] / n, share["junk"] / n, kind,
    )


def document_statistics(df: DataFrame, key: str, text: str, common_words: list[str]) -> DataFrame:
    """(key, statistics, doc_kind) for every row of ``df`` with a key; see ``measure`` for empty texts.

    Repeated rows give repeated results; other columns of ``df`` are not read.
    """
    if len(common_words) > MAX_COMMON:
        raise ValueError(f"{len(common_words)} common words; at most {MAX_COMMON} are handed to the tasks")
    common = Common(w.lower() for w in common_words if w)
    kind = df.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, " + ", ".join(f"{n} {t}" for n, t in STATS) + ", doc_kind string"
    types = [pa.int64() if t == "long" else pa.float64() for _, t in STATS] + [pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [measure(t, common) for t in b.column(1).to_pylist()]
            cols = list(zip(*rows)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, types))], names=[key, *(n for n, _ in STATS), "doc_kind"])

    return df.select(key, text).where(f"`{key}` is not null").mapInArrow(run, schema)
