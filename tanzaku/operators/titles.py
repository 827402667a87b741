"""Titles: other ways to write them, their owners and best matches, candidates of a series, scope names in questions."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Fixed values.
SYMBOLS = re.compile(r"[☆★✩✧✦♪♫♬✿❀◆◇※♡❤∞＆〜～]")
PREFIXES = ("剧场总集篇", "劇場総集編", "剧场版 ", "劇場版 ", "剧场版", "劇場版", "TV动画 ", "OVA ")
SUFFIXES = (
    " OVA", " OAD", " SP", " Extra Edition", " Special", " 剧场版", " 总集篇", " 特别篇", " 番外篇", " 完结篇", " 前篇", " 后篇", " 第一季", " 第二季", " 第三季", " 第四季",
    " 第1季", " 第2季", " 第3季", " 第一期", " 第二期", " 第三期", " 第四期",
)
CUTS = ("：", ":", " - ", " — ", "〈", "【", "[", "（", "(")
WIDE, NARROW = "：！？（）；，～", ":!?();,~"
BRACKETED = re.compile(r"[〈【（(［\[]([^〉】）)］\]]{2,})[〉】）)］\]]")
LEAST_LENGTH, LEAST_SHARE, ROUNDS, LEFT_LEAST = 2, 0.3, 2, 4
EMPTY_BRACKETS = re.compile(r"[《〈「『\[(（【]\s*[》〉」』\])）】]")

_BLANKS = re.compile(r"\s+")


def _squashed(t: str) -> str:
    return _BLANKS.sub(" ", t).strip()


def _long_enough(part: str, whole: str) -> bool:
    return len(part) >= LEAST_LENGTH and len(part) >= LEAST_SHARE * len(whole)


def widths(t: str) -> set[str]:
    """The title with all its punctuation narrow, and with all of it wide."""
    return {t.translate(str.maketrans(a, b)) for a, b in ((WIDE, NARROW), (NARROW, WIDE))} - {t}


def _shorter(t: str) -> Iterator[str]:
    """The title without a prefix, without a suffix, and up to each mark, where enough of it is left."""
    yield from (t[len(p) :] for p in PREFIXES if t.startswith(p))
    yield from (t[: -len(s)] for s in SUFFIXES if t.endswith(s))
    yield from (left for c in CUTS if (i := t.find(c)) > 1 and _long_enough(left := t[:i].strip(), t))


def shortened(t: str) -> set[str]:
    """What ``ROUNDS`` rounds of shortening make of a title."""
    out, last = set(), {t}
    for _ in range(ROUNDS):
        last = {y for x in last for y in map(_squashed, _shorter(x)) if len(y) >= LEAST_LENGTH} - out - {t}
        out |= last
    return out


def variants(t: str) -> dict[str, str]:
    """Other ways to write a title: A for the same work otherwise written, B for what may be the work behind it."""
    bare = _squashed(SYMBOLS.sub("", t))
    same = {bare} | widths(t) | widths(bare)
    inner = {m.strip() for m in BRACKETED.findall(t) if _long_enough(m.strip(), t)}
    behind = inner.union(*map(shortened, {t, bare} | widths(t)))
    return {v: "A" if v in same else "B" for v in same | behind if v and v != t}


def title_variants(names: DataFrame, owner: str, name: str) -> DataFrame:
    """(variant, cls, owners): every other way to write the names of each owner that is none of its names.

    A variant that is of class A for one name stays so; ``owners`` are sorted and distinct. Null names give nothing.
    """
    kind = names.schema[owner].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(o, v, c) for o, n in zip(b["owner"], b["name"]) for v, c in variants(n).items()], columns=["owner", "variant", "cls"])

    n = names.select(F.col(owner).alias("owner"), F.col(name).alias("name")).where("owner is not null and name is not null").distinct()
    made = n.mapInPandas(run, f"owner {kind}, variant string, cls string").join(n.withColumnRenamed("name", "variant"), ["owner", "variant"], "left_anti")
    return made.groupBy("variant").agg(F.min("cls").alias("cls"), F.array_sort(F.collect_set("owner")).alias("owners"))  # works of one name


def best_match(candidates: DataFrame, found: DataFrame) -> DataFrame:
    """(owner, variant, cls, target): of each owner's variants that lead to a target, the first by class, then by text.

    ``candidates``: variant, cls, owners; ``found``: variant, target.
    """
    hit = candidates.join(found, "variant").select(F.explode("owners").alias("owner"), "variant", "cls", "target")
    return hit.groupBy("owner").agg(F.min(F.struct("cls", "variant", "target")).alias("m")).select("owner", "m.variant", "m.cls", "m.target")


def candidate_titles(works: DataFrame) -> DataFrame:
    """(root, title, position): distinct titles of each series: the root's own names, the local one first, then the other members' in order of text.

    ``works``: subject_id, series_root, name, name_cn. Blank titles are none.
    """
    x = works.select(F.coalesce("series_root", "subject_id").alias("root"), "subject_id", F.posexplode(F.array("name_cn", "name")).alias("at", "title"))
    x = x.withColumn("title", F.trim("title")).where("title != ''")
    rank = F.when(F.col("subject_id") == F.col("root"), F.col("at")).otherwise(2)
    first = x.groupBy("root", "title").agg(F.min(rank).alias("rank"))
    return first.select("root", "title", F.row_number().over(Window.partitionBy("root").orderBy("rank", "title")).cast("long").alias("position"))


def _key(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKC", text).casefold() if unicodedata.category(c)[0] not in "PSZC")


def without_scope_title(question: str, titles: list[str]) -> str:
    """``question`` without the names of the work it is about; as it was where too little is left.

    Names are keys, found in the key of the question whose characters remember where they came from; a question
    whose key is another when made character by character stays whole.
    """
    parts = [_key(c) for c in question]
    key, at = "".join(parts), [i for i, p in enumerate(parts) for _ in p]
    if key != _key(question):
        return question
    gone = {k for t in titles if t for m in re.finditer(f"(?={re.escape(t)})", key) for k in range(at[m.start()], at[m.start() + len(t) - 1] + 1)}
    left = EMPTY_BRACKETS.sub("", "".join(c for i, c in enumerate(question) if i not in gone))
    return left if gone and len(_key(left)) >= LEFT_LEAST else question


@F.pandas_udf(StringType())
def scope_stripped(question: pd.Series, titles: pd.Series) -> pd.Series:
    """``without_scope_title`` of a column of questions and one of arrays of keys; nulls stay null."""
    return pd.Series([None if q is None else without_scope_title(q, [] if t is None else list(t)) for q, t in zip(question, titles)], dtype=object)


def related_line(name: Column, year: Column, role: Column, shared: Column) -> Column:
    """A related work as a line of context; an unknown year leaves no bracket."""
    return F.concat(name, F.coalesce(F.concat(F.lit("（"), year.cast("string"), F.lit("）")), F.lit("")), F.lit(" —— 与本作共享 "), role, F.lit("："), shared)


def role_line(character: Column, title: Column, year: Column, role_type: Column) -> Column:
    """A role as a line of context; a missing name is told."""
    part = F.when(role_type == 1, "　主角").when(role_type == 2, "　配角").when(role_type == 3, "　客串").otherwise("")
    return F.concat(F.coalesce(character, F.lit("（角色名缺失）")), F.lit(" —— 《"), title, F.lit("》"), F.coalesce(F.concat(F.lit("（"), year.cast("string"), F.lit("）")), F.lit("")), part)
