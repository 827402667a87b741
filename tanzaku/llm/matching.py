"""Works and their pages without a common key: bit vectors, multi-index Hamming search, calibrated confidences.

Names of both sides are reduced to a core (one width and case, common variant ideographs folded, season
marks, years and media set apart) whose q-grams are hashed into vectors of 128 bits. Pairs within ``RADIUS``
bits are found exactly: the vectors are cut into ``CHUNKS`` chunks, and by the pigeonhole principle a close pair
differs in some chunk by no more than ``RADIUS // CHUNKS`` bits, so every vector is looked up under that
few flips of each chunk. All names of all pages are searched, those that a work has letter for letter too.

Dice coefficients of title and lead names, weighted, give a name score. What a score, an agreement of years and
one of studios are worth is estimated from all pairs by expectation and maximisation over their joint counts
(252 cells), without labels; of the scores a better one is never worth less. The works that compete for a page,
and no work at all, share its odds. Works of one core, season, year and studios are merged before the join, so
that one stock name on a third of the rows makes no more pairs than there are different years and studios.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tanzaku.checkpoints import stored
from tanzaku.llm.lookalike import CJK_SHAPES, LATIN_SHAPES

BITS, RADIUS = 128, 13
CHUNKS = 7  #: of the search; fewer and longer ones suit hundreds of millions of names, at any number the same pairs come out
BINS, ROUNDS = 20, 200  #: bins of the score, rounds of the estimation
#: Where the estimation starts: shares of equal, neighbouring and other years, and of named and other studios, among matches and others.
START, LEAN = {3: ((0.9, 0.06, 0.04), (0.04, 0.08, 0.88)), 2: ((0.85, 0.15), (0.15, 0.85))}, 5

#: Variant ideographs (traditional or Japanese) and the simplified ones.
VARIANTS = dict(zip(
    "與燈圖謠聲尋約語錄繪靈夢雙師輕歸喚織憶聽時線遠緋終極橋霧嵐蒼紀詠軽帰謡双絵銀鐘灯頁廊齋開關閉門間問聞風飛馬鳥魚龍龜車軍連還邊話說讀書畫見視覺觀記訓請誰調談論證識護變讓貴買資進運過達違選遺鄉醫鏡長陽陰隊階際難電霊静順須頭題類顏願顯館駅驗體樂樹機權歐殘氣漢湯滿灣為無煙熱愛爺紅級純紙細組結給統絕經綠維網緊緒緣練縣總績繼續罪羅義習翼聖職肅腦臨與舊華萬葉蓋藍藝藥處號蟲親",
    "与灯图谣声寻约语录绘灵梦双师轻归唤织忆听时线远绯终极桥雾岚苍纪咏轻归谣双绘银钟灯页廊斋开关闭门间问闻风飞马鸟鱼龙龟车军连还边话说读书画见视觉观记训请谁调谈论证识护变让贵买资进运过达违选遗乡医镜长阳阴队阶际难电灵静顺须头题类颜愿显馆驿验体乐树机权欧残气汉汤满湾为无烟热爱爷红级纯纸细组结给统绝经绿维网紧绪缘练县总绩继续罪罗义习翼圣职肃脑临与旧华万叶盖蓝艺药处号虫亲",
))
_LATIN = {ord(x): y for many, one in LATIN_SHAPES.items() for x, y in zip(many, one)}
_CJK = {ord(x): y for many, one in CJK_SHAPES.items() for x, y in zip(many, one)}
_VARIANT = {ord(a): b for a, b in VARIANTS.items()}
_NUMBER = {c: i % 10 for i, c in enumerate("〇一二三四五六七八九")} | {"零": 0}

INVISIBLE = re.compile("[\xad​-‏⁠﻿︀-️]+")
SEASON = re.compile(r"[\s:・·-]*(?:第\s*([0-9一二三四五六七八九十]+)\s*[季期部]|([0-9]+)\s*[期季]|season\s*([0-9]+)|(?<![0-9])([0-9])(?:st|nd|rd|th)(?:\s*season)?|(?<![a-z])(ii|iii|iv|vi?)|(?<=\s)([2-9]))\s*$", re.I)
ROMAN = {"ii": 2, "iii": 3, "iv": 4, "v": 5, "vi": 6}
BEFORE = re.compile(r"^\s*(?:(?:tv|电视|電視|ova|web|剧场版)?\s*(?:动画|動畫|アニメ))\s*[:：]?\s*", re.I)
MEDIA = re.compile(r"漫画|漫畫|小说|小說|原声|原聲|专辑|專輯|游戏|遊戲|画集|畫集|广播剧|舞台剧|音乐|音樂")
ANIMATED = re.compile(r"^\s*(?:(?:tv|电视|電視|ova|web|剧场版)?\s*(?:动画|動畫|アニメ)(?:版)?)\s*$", re.I)
YEAR_MARK = re.compile(r"^\s*((?:19|20)\d\d)\s*年?\s*(?:版|动画|動畫|tv动画)?\s*$", re.I)
TAIL = re.compile(r"\s*[(（\[【]([^()（）\[\]【】]*)[)）\]】]\s*$")
QUOTED_NAME = re.compile(r"[《「『]([^》」』]+)[》」』]")
#: Labels behind which an encyclopaedia gives another name of its subject.
NAME_LABEL = re.compile(r"(?:原名|原题|原題|又名|别名|別名|日文名|英文名|中文名|译名)[为為是:：]?\s*([^，。；、,;:：「『《（(]+)")
LEAD_YEAR = re.compile(r"(?<!\d)(\d{4}|\d{2}|[〇零一二三四五六七八九]{4})年")
DENIED = re.compile(r"(?:不涉及|不包括|不是|并非|非|无|没有)[^，。,；]{0,4}(?:动画|動畫|アニメ)")
ANIME = re.compile(r"动画|動畫|アニメ|anime", re.I)
PRODUCED, UNNAMED = re.compile(r"制作|製作|produc|animat", re.I), re.compile(r"不明|未知|不详|未公开|未公開")


def plain(text: str) -> str:
    return unicodedata.normalize("NFKC", INVISIBLE.sub("", text).translate(_LATIN))


def season_of(name: str) -> tuple[str, int]:
    """A name without its season mark, and the season (0 if there is no mark)."""
    m = SEASON.search(name)
    if not m or not name[: m.start()].strip():
        return name, 0
    got = next(g for g in m.groups() if g)
    if got.lower() in ROMAN:
        n = ROMAN[got.lower()]
    elif got.isdigit():
        n = int(got)
    else:
        n = 10 if got == "十" else _NUMBER.get(got[-1], 1)  # a doubled numeral is a slip
    return name[: m.start()], n


def core(name: str) -> str:
    """Letters and digits of a name in one form."""
    return "".join(c for c in name.casefold().translate(_VARIANT) if c.isalnum()).translate(_CJK)


def named(name: str | None) -> tuple[str, int]:
    """(core, season) of a work's name; ("", 0) of none."""
    if not name:
        return "", 0
    rest, season = season_of(plain(name))
    return core(rest), season


def parse_page(title: str | None, lead: str | None) -> dict:
    """Names (title, others of the title, those the lead quotes or labels), season, year, what is said where a producer is named, and whether the page is on something else."""
    out = {"title": "", "other": "", "leads": [], "season": 0, "year": None, "said": None, "skip": False}
    t = plain(title or "")
    while m := TAIL.search(t):
        inner = m.group(1)
        if y := YEAR_MARK.match(inner):
            out["year"] = int(y.group(1))
        elif MEDIA.search(inner):
            out["skip"] = True
        elif not ANIMATED.match(inner) and not out["other"]:
            out["other"], s = named(inner)
            out["season"] = out["season"] or s
        t = t[: m.start()]
        if not t:
            break
    if m := re.search(r"\s((?:19|20)\d\d)\s*$", t):
        out["year"], t = out["year"] or int(m.group(1)), t[: m.start()]
    t = BEFORE.sub("", t)
    first, _, romaji = t.partition(" / ")
    rest, season = season_of(first)
    out["title"], out["season"] = core(rest), season or season_of(romaji)[1] or out["season"]
    if lead:
        said = plain(lead)
        head = said.split("。")[0]
        about = DENIED.sub("", head)
        out["skip"] |= bool(MEDIA.search(head)) and not ANIME.search(about)
        for name in dict.fromkeys(QUOTED_NAME.findall(said) + NAME_LABEL.findall(said)):
            got, s = named(name)
            if got:
                out["leads"].append(got)
                out["season"] = out["season"] or s
        if m := LEAD_YEAR.search(head):
            y = m.group(1)
            n = int(y) if y.isdigit() and y.isascii() else int("".join(str(_NUMBER[c]) for c in y))
            n = n if n > 99 else n + (2000 if n <= 30 else 1900)
            out["year"] = out["year"] or n
        if PRODUCED.search(said) and not UNNAMED.search(head):
            out["said"] = core(said)
    return out


@lru_cache(1 << 16)
def _gram_bits(gram: str, times: int) -> int:
    h, bits = 1469598103934665603, 0
    for c in gram:
        h = ((h ^ ord(c)) * 1099511628211) & 0xFFFFFFFFFFFFFFFF
    for _ in range(times):
        h = (h * 6364136223846793005 + 1442695040888963407) & 0xFFFFFFFFFFFFFFFF
        bits |= 1 << (h >> 57)
    return bits


def bit_vector(name: str) -> tuple[int, int]:
    """The q-grams of a core as 128 bits in two signed halves: six bits for each character, one for each pair."""
    bits = 0
    for c in set(name):
        bits |= _gram_bits(c, 6)
    for a, b in zip(name, name[1:]):
        bits |= _gram_bits(a + b, 1)
    sign = lambda v: v - (1 << 64) if v >= 1 << 63 else v
    return sign(bits & 0xFFFFFFFFFFFFFFFF), sign(bits >> 64)


def _chunk(i: int, chunks: int) -> Column:
    """Bits [i * BITS / chunks, (i + 1) * BITS / chunks) of (v0, v1)."""
    lo, hi = i * BITS // chunks, (i + 1) * BITS // chunks
    parts = []
    for half, col in enumerate(("v0", "v1")):
        a, b = max(lo, 64 * half) - 64 * half, min(hi, 64 * half + 64) - 64 * half
        if b > a:
            piece = F.shiftrightunsigned(col, a).bitwiseAND(F.lit((1 << (b - a)) - 1 if b - a < 64 else -1))
            parts.append(F.shiftleft(piece, a + 64 * half - lo))
    return parts[0] if len(parts) == 1 else parts[0].bitwiseOR(parts[1])


def close_vectors(left: DataFrame, right: DataFrame, radius: int = RADIUS, chunks: int = CHUNKS) -> DataFrame:
    """(a0, a1, b0, b1, dice) for all pairs of distinct vectors of ``left`` and ``right`` (v0, v1) within ``radius`` bits."""
    flips = radius // chunks
    masks = []
    for i in range(chunks):
        width = (i + 1) * BITS // chunks - i * BITS // chunks
        # a pair with ``flips`` + 1 or more flips in each of the first chunks has none left for those behind them
        most = flips if i <= radius - flips * chunks else flips - 1
        masks.append([0] * (most >= 0) + [sum(1 << p for p in c) for n in range(1, most + 1) for c in combinations(range(width), n)])

    def place(i: int, mask: Column | None = None) -> Column:
        c = _chunk(i, chunks)
        return (c if mask is None else c.bitwiseXOR(mask.cast("long"))).bitwiseOR(F.lit(i << 56).cast("long"))  # one number: chunk and its bits

    def near(i: int) -> Column:
        return F.transform(F.array(*map(F.lit, masks[i])), lambda x: place(i, x))

    probe = F.concat(*[near(i) for i in range(chunks) if masks[i]])
    own = F.array(*[place(i) for i in range(chunks) if masks[i]])
    a = _spread(left.select("v0", "v1"), "v0", "v1").distinct().select(F.col("v0").alias("a0"), F.col("v1").alias("a1"), F.explode(probe).alias("c"))
    b = _spread(right.select("v0", "v1"), "v0", "v1").distinct().select(F.col("v0").alias("b0"), F.col("v1").alias("b1"), F.explode(own).alias("c"))
    apart = F.bit_count(F.col("a0").bitwiseXOR(F.col("b0"))) + F.bit_count(F.col("a1").bitwiseXOR(F.col("b1")))
    both = F.bit_count(F.col("a0").bitwiseAND(F.col("b0"))) + F.bit_count(F.col("a1").bitwiseAND(F.col("b1")))
    sizes = F.bit_count("a0") + F.bit_count("a1") + F.bit_count("b0") + F.bit_count("b1")
    # the planner takes exploded probes for as small as their vectors and would broadcast them: both sides are shuffled instead
    return a.join(b.hint("shuffle_hash"), "c").where(apart <= radius).select("a0", "a1", "b0", "b1", (2.0 * both / sizes).alias("dice")).distinct()


def _spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` by ``keys`` over all shuffle partitions, ahead of functions that cost more than the bytes tell."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _latest(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return _spread(df.where(F.col(key).isNotNull()), key).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def work_names(works: DataFrame) -> DataFrame:
    """(subject_id, core, season, year, studios, v0, v1): the names of every work, each core once, with their vectors."""

    def run(batches):
        for b in batches:
            rows = []
            for sid, names, year, studios in zip(b["subject_id"], zip(b["name"], b["name_cn"]), b["air_year"], b["studios"]):
                got = [named(n) for n in names]
                season = max((s for _, s in got), default=0) or 1
                made = sorted({c for x in (studios if studios is not None else ()) if x and len(c := core(plain(x))) > 1})
                rows += [(sid, c, season, year, made, *bit_vector(c)) for c in {c for c, _ in got if c}]
            yield pd.DataFrame(rows, columns=["subject_id", "core", "season", "year", "studios", "v0", "v1"]).astype({"year": "Int64"})

    one = _latest(works, "subject_id", ["updated_at"]).select("subject_id", "name", "name_cn", F.col("air_year").cast("int"), "studios")
    return one.mapInPandas(run, "subject_id int, core string, season int, year int, studios array<string>, v0 long, v1 long")


def page_names(pages: DataFrame) -> DataFrame:
    """(pageid, role, season, year, said, v0, v1): the names of the pages that may describe an animated work, as vectors."""

    def run(batches):
        for b in batches:
            rows = []
            for pid, title, lead in zip(b["pageid"], b["title"], b["lead_text"]):
                p = parse_page(title, lead)
                if p["skip"]:
                    continue
                for role, name in (("title", p["title"]), ("other", p["other"]), *(("lead", x) for x in p["leads"])):
                    if name:
                        rows.append((pid, role, p["season"] or 1, p["year"], p["said"], *bit_vector(name)))
            yield pd.DataFrame(rows, columns=["pageid", "role", "season", "year", "said", "v0", "v1"]).astype({"year": "Int64"})

    one = _latest(pages.where("kind = 'series'"), "pageid", ["lastrevid"]).select("pageid", "title", "lead_text")
    return one.mapInPandas(run, "pageid int, role string, season int, year int, said string, v0 long, v1 long")


def scored_pairs(works: DataFrame, pages: DataFrame) -> DataFrame:
    """(pageid, subject_id, score, bin, year_b, years, made): pairs of close names and one season.

    ``years``: 0 equal, 1 neighbours, 2 apart; ``made``: 0 a studio of the work is named, 1 others are. Null where a side is silent.
    """
    a = stored(page_names(pages), "match-pages")
    b = stored(work_names(works).groupBy("core", "season", "year", "studios", "v0", "v1").agg(F.min("subject_id").alias("subject_id")), "match-works")
    w = b.select(F.col("v0").alias("b0"), F.col("v1").alias("b1"), "season", F.col("year").alias("year_b"), "studios", "subject_id")
    mine = a.select("pageid", "role", F.col("v0").alias("a0"), F.col("v1").alias("a1"), "season", F.col("year").alias("year_a"))
    pairs = mine.join(close_vectors(a, b), ["a0", "a1"]).join(w, ["b0", "b1", "season"])
    best = lambda lead: F.max(F.when((F.col("role") == "lead") == lead, F.col("dice")))
    got = pairs.groupBy("pageid", "subject_id").agg(best(False).alias("title_dice"), best(True).alias("lead_dice"), *[F.max(c).alias(c) for c in ("year_a", "year_b", "studios")])
    of = a.groupBy("pageid").agg(F.max(F.col("role") == "lead").alias("has_lead"), F.max("said").alias("said"))
    floor = F.lit(0.55)  # a name that is not close at all counts as that alike
    t, lead = F.coalesce("title_dice", floor), F.coalesce("lead_dice", floor)
    score = F.when(F.col("has_lead"), 0.5 * t + 0.5 * lead).otherwise(t)
    gap = F.abs(F.col("year_a") - F.col("year_b"))
    years = F.when(gap.isNotNull(), F.least(gap, F.lit(2)))
    made = F.when(F.col("said").isNotNull() & (F.size("studios") > 0), F.when(F.exists("studios", lambda x: F.contains(F.col("said"), x)), 0).otherwise(1))
    bin_ = F.least(F.floor(score * BINS), F.lit(BINS)).cast("int")
    return got.join(of, "pageid").select("pageid", "subject_id", score.alias("score"), bin_.alias("bin"), "year_b", years.alias("years"), made.alias("made"))


def _rising(value: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The closest rising sequence (pool adjacent violators)."""
    blocks: list[list[float]] = []
    for v, w in zip(value, np.maximum(weight, 1e-9)):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] > blocks[-1][0]:
            (v1, w1, n1), (v2, w2, n2) = blocks[-2:]
            blocks[-2:] = [[(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2]]
    return np.concatenate([np.full(n, v) for v, _, n in blocks]) if blocks else value


def estimate(cells: list[tuple[int, int | None, int | None, int]], rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log odds of a match by score bin, and what years and studios add to them, from counts of (bin, years, made).

    Expectation and maximisation of a mixture of matches and others in which the three are independent; a
    null counts for neither. The start, ``START``, tells the two classes apart and counts for ``LEAN`` pairs, so that
    it decides where there are hardly any and nothing where there are many.
    """
    n = np.array([c[3] for c in cells], float)
    bin_, year, made = (np.array([-1 if c[i] is None else c[i] for c in cells], int) for i in range(3))
    rise = 1 / (1 + np.exp(-(np.arange(BINS + 1) / BINS - 0.85) * 20))
    odds = np.log(rise / (1 - rise))
    start = {size: (np.array(m), np.array(u)) for size, (m, u) in START.items()} | {BINS + 1: (rise / rise.sum(), (1 - rise) / (1 - rise).sum())}
    by_year, by_made = (np.log(start[size][0] / start[size][1]) for size in (3, 2))
    for _ in range(rounds if len(cells) else 0):
        x = odds[bin_] + np.where(year < 0, 0, by_year[year]) + np.where(made < 0, 0, by_made[made])
        p = 1 / (1 + np.exp(-np.clip(x, -30, 30)))
        m, u = n * p, n * (1 - p)
        prior = (m.sum() + 1) / (u.sum() + 1)
        count = lambda at, w, size, i: np.bincount(at[at >= 0], w[at >= 0], size) + LEAN * start[size][i]
        share = lambda at, w, size, i: count(at, w, size, i) / count(at, w, size, i).sum()
        ratio = lambda at, size: np.log(share(at, m, size, 0) / share(at, u, size, 1))
        new = np.log(prior) + ratio(bin_, BINS + 1)
        odds = _rising(new, np.bincount(bin_, n, BINS + 1))
        by_year, by_made = ratio(year, 3), ratio(made, 2)
    return odds, by_year, by_made


def none_weight(sums: list[tuple[float, int]], expected: float) -> float:
    """The weight of "no work" beside the odds of a page's works, so that pages expect as many matches as pairs do.

    ``sums``: (sum of odds, pages with it). Works that compete for a page make each other's odds as pairs small; at
    weight 1 that would count twice.
    """
    s, n = np.array([x for x, _ in sums] or [1.0]), np.array([x for _, x in sums] or [0.0])
    lo, hi = -12.0, 0.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if (n * s / (np.exp(mid) + s)).sum() > expected else (lo, mid)
    return float(np.exp(hi))


def matches(works: DataFrame, pages: DataFrame, least: float = 0.5, first_bonus: float = 1.5) -> DataFrame:
    """(subject_id, pageid, confidence): for every page at most one work, confidence of at least ``least``.

    Works: subject_id, name, name_cn, air_year, studios, updated_at; pages: pageid, kind, title, lead_text,
    lastrevid. Of repeated keys the newest row counts; null keys and pages without a name take no part. Among
    works that are alike in all attributes the smallest subject_id stands for all. ``first_bonus``: odds by
    which the earliest of several works goes before its remakes where nothing else decides.
    """
    pairs = stored(scored_pairs(works, pages), "match-pairs")
    cells = pairs.groupBy("bin", "years", "made").agg(F.count("*").alias("n")).collect()  # 252 rows at most
    odds, by_year, by_made = estimate(sorted(((r["bin"], r["years"], r["made"], r["n"]) for r in cells), key=repr))
    at = lambda col, values: F.coalesce(*[F.when(F.col(col) == i, float(v)) for i, v in enumerate(values)], F.lit(0.0))
    x = at("bin", odds) + at("years", by_year) + at("made", by_made)
    w = Window.partitionBy("pageid")
    first = F.min(F.when(F.col("score") >= 0.999, F.coalesce("year_b", F.lit(9999)))).over(w)
    bonus = F.when((F.col("score") >= 0.999) & (F.coalesce("year_b", F.lit(9999)) == first), first_bonus).otherwise(1.0)
    plain_odds = F.exp(F.greatest(F.least(x, F.lit(30.0)), F.lit(-30.0)))
    per_page = pairs.withColumn("odds", plain_odds).groupBy("pageid").agg(F.sum("odds").alias("s"), F.sum(F.col("odds") / (1 + F.col("odds"))).alias("e"))
    sums = per_page.groupBy(F.round(F.ln("s"), 1).alias("l")).agg(F.count("*").alias("n"), F.sum("e").alias("e")).collect()  # 700 rows at most
    none = none_weight([(float(np.exp(r["l"])), r["n"]) for r in sorted(sums)], sum(r["e"] for r in sorted(sums)))
    weighed = pairs.withColumn("odds", plain_odds * bonus)
    best = weighed.withColumn("confidence", F.round(F.col("odds") / (none + F.sum("odds").over(w)), 6)).withColumn("r", F.row_number().over(w.orderBy(F.col("odds").desc(), "subject_id")))
    return best.where((F.col("r") == 1) & (F.col("confidence") >= least)).select("subject_id", "pageid", "confidence")
