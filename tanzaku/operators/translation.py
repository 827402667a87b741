"""Translations: echo detection, choice of a model, restoration of texts in attributes."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tanzaku.functions.text import class_share

#: Fixed values.
ECHO, LONG, HIRAGANA_LEAST, KANA_LEAST = 0.8, 40, 0.20, 0.20


@F.pandas_udf(DoubleType())
def matching_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of matching blocks of two texts (difflib); an edit distance would be another measure."""
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b)], dtype="float64")


def untranslated(src: Column, dst: Column) -> Column:
    """Whether a translation is none: missing, still full of hiragana, or nearly the source itself.

    The costly comparison runs only where the cheap tests leave it open.
    """
    echo = (F.length(src) > LONG) | (class_share(dst, "[぀-ヿ]") > KANA_LEAST)
    cheap = F.coalesce(F.length(dst) == 0, F.lit(True)) | (class_share(dst, "[぀-ゟ]") > HIRAGANA_LEAST)
    return F.when(F.coalesce(cheap, F.lit(True)), True).when(echo, matching_ratio(src, dst) > ECHO).otherwise(False)


def best_translation(df: DataFrame, models: list[str]) -> DataFrame:
    """(src_sha, dst): of each source the translation of the first model of ``models`` that has one, of the newest prompt."""
    place = F.array_position(F.array(*map(F.lit, models)), F.col("model"))
    rank = F.struct(F.when(place > 0, place).otherwise(len(models) + 1).alias("p"), F.col("model"))
    good = df.where("dst is not null").withColumn("_rank", rank)
    newest = good.groupBy("src_sha", "_rank").agg(F.max(F.struct("prompt_version", "dst"))["dst"].alias("dst"))
    return newest.groupBy("src_sha").agg(F.min_by("dst", "_rank").alias("dst"))


def variant_text(attribute: Column) -> Column:
    """The text that a language variant keeps in its JSON attribute: tags off, entities read, links by their display names."""
    t = F.regexp_replace(F.coalesce(F.get_json_object(attribute, "$.disabled.t"), F.lit("")), "<[^>]+>", "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    t = F.regexp_replace(t, r"\[\[(?:[^\[\]|]*\|)?([^\[\]]*)\]\]", "$1")
    return F.trim(F.regexp_replace(t, r"\[\[|\]\]", ""))


SKIPPED = "^(外部链接|外部連結|注释|註釋|注释与外部链接|参考资料|參考資料|参考|参见|參見|相关条目|相關條目|相关链接|注解|脚注|備註|备注|導航|导航|注釋)$"  # fixed values


def skipped(path: Column) -> Column:
    """Whether any title of a section's path is one of the sections without content."""
    return F.exists(F.split(path, "/"), lambda t: t.rlike(SKIPPED))
