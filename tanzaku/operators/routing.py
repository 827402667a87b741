"""Reading questions: quarters in words, intents, routes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that the rules listen for.
SEASON_TRIGGERS = ("番", "季度", "季番", "播出", "开播", "上映", "这一季", "当季", "新番", "在播", "有哪些", "有什么")
SEASON_MONTHS = {"春": 4, "夏": 7, "秋": 10, "冬": 1}
RELATIVE_YEARS = {"今年": 0, "本年": 0, "去年": -1, "前年": -2, "明年": 1}
RELATIVE_QUARTERS = {"下下季": 2, "下一季": 1, "下个季度": 1, "下一个季度": 1, "下季": 1, "上一季": -1, "上个季度": -1, "上一个季度": -1, "上季": -1}
THIS_QUARTER = ("这个季度", "本季", "当季", "这一季")
PERSON_TRIGGERS = ("配过", "配了", "演过", "出演", "配音作品", "参演", "代表作", "有哪些角色", "哪些角色", "什么角色")
PERSON_ALONE = ("配过", "配了", "配音作品")  # of those, the ones that need no word on voices beside them
VOICE_WORDS = ("声优", "配音", "cv", "seiyu")
CHARACTER_TRIGGERS = ("谁配", "声优是", "声优谁", "cv是", "cv谁", "谁的声优", "配音是", "哪位声优", "什么声优")
ROLE_TRIGGERS = {"原作": ("原作", "作者", "漫画家", "画过", "写过", "原著"), "导演": ("导演", "监督", "执导"), "脚本": ("脚本", "编剧", "剧本"), "音乐": ("音乐", "配乐", "作曲", "劇伴"), "人物设定": ("人设", "人物设定", "角色设计", "作画监督")}
STUDIO_TRIGGERS = ("制作公司", "制作方", "动画公司", "工作室", "哪家公司", "哪个公司")
GENERIC_TRIGGERS = ("其他作品", "还做过", "还画过", "还有什么作品", "别的作品", "同一个人")
DIGITS = "零一二三四五六七八九"
YEAR_MONTH, YEAR_SEASON, YEAR = r"(\d{4})\s*年\s*(\d{1,2})\s*月", r"(\d{4})\s*年\s*(?:的\s*)?([春夏秋冬])", r"(\d{4})\s*年"
YEARS_AGO = "([0-9零一二两三四五六七八九十百]+)\\s*年前"


def any_of(q: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(q, F.lit(w)) for w in words])


def _first(q: Column, table: dict[str, int], value) -> Column:
    """``value`` of the first word of ``table`` that ``q`` holds; null if none."""
    return F.coalesce(*[F.when(F.contains(q, F.lit(w)), value(v)) for w, v in table.items()])


def chinese_int(s: Column) -> Column:
    """A numeral below 100 in digits or Chinese; null otherwise."""
    t = F.translate(F.replace(s, F.lit("两"), F.lit("二")), DIGITS, "0123456789")
    ten = F.regexp_extract(t, "^([0-9]?)十([0-9]?)$", 1), F.regexp_extract(t, "^([0-9]?)十([0-9]?)$", 2)
    part = lambda x, default: F.coalesce(F.nullif(x, F.lit("")).cast("int"), F.lit(default))
    plain = F.when(s.rlike("^[0-9]{1,6}$"), s.try_cast("int")).when(t.rlike("^[0-9]$"), t.try_cast("int"))
    return F.when(t.rlike("^[0-9]?十[0-9]?$"), part(ten[0], 1) * 10 + part(ten[1], 0)).otherwise(plain)


def parse_quarter(q: Column, today: Column) -> Column:
    """year * 100 + first month of the quarter that a question speaks of; null if it speaks of none.

    Only questions with a trigger word count. In order: year and month, year and season, years ago or relative
    years (with a season, else this quarter), a bare year, relative quarters, this quarter. A month that is
    none falls through to the later rules.
    """
    this = F.quarter(today) * 3 - 2
    rx = lambda p, i: F.regexp_extract(q, p, i).try_cast("int")
    month = rx(YEAR_MONTH, 2)
    by_month = F.when(month.between(1, 12), rx(YEAR_MONTH, 1) * 100 + F.floor((month - 1) / 3).cast("int") * 3 + 1)
    word = F.regexp_extract(q, YEAR_SEASON, 2)
    by_season = F.when(word != "", rx(YEAR_SEASON, 1) * 100 + F.coalesce(*[F.when(word == w, m) for w, m in SEASON_MONTHS.items()]))
    ago = chinese_int(F.regexp_extract(q, YEARS_AGO, 1))
    year = F.coalesce(F.year(today) - ago, _first(q, RELATIVE_YEARS, lambda n: F.year(today) + n))
    by_year = year * 100 + F.coalesce(_first(q, SEASON_MONTHS, F.lit), this)
    bare = rx(YEAR, 1) * 100 + this

    def shifted(n: int) -> Column:
        at = F.add_months(F.trunc(today, "quarter"), 3 * n)
        return F.year(at) * 100 + F.month(at)

    relative = _first(q, RELATIVE_QUARTERS, shifted)
    return F.when(any_of(q, SEASON_TRIGGERS), F.coalesce(by_month, by_season, by_year, bare, relative, F.when(any_of(q, THIS_QUARTER), F.year(today) * 100 + this)))


def voice_intent(q: Column) -> Column:
    """character goes before person; null for neither.

    Most words on a person's roles are as common about works, and count only beside a word on voices.
    """
    low = F.lower(q)
    person = any_of(low, PERSON_ALONE) | (any_of(low, PERSON_TRIGGERS) & any_of(low, VOICE_WORDS))
    return F.when(any_of(low, CHARACTER_TRIGGERS), "character").when(person, "person")


def relation_intent(q: Column) -> tuple[Column, Column]:
    """(roles asked for, joined by a comma; whether studios are asked for)"""
    roles = F.array_compact(F.array(*[F.when(any_of(q, words), F.lit(role)) for role, words in ROLE_TRIGGERS.items()]))
    studio = any_of(q, STUDIO_TRIGGERS)
    generic = (F.size(roles) == 0) & ~studio & any_of(q, GENERIC_TRIGGERS)
    return F.when(generic, "原作,导演").otherwise(F.array_join(roles, ",")), studio | generic


def route(q: Column, today: Column) -> Column:
    """voice, season or ask, in this order."""
    return F.when(voice_intent(q) == "person", "voice").when(parse_quarter(q, today).isNotNull(), "season").otherwise("ask")
