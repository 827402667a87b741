"""Text search in two stages: all terms in an inverted index, else trigram similarity of names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tanzaku.functions import text as T

TRIGRAM_FLOOR, LIMIT = 0.3, 50
WEIGHTS = {"A": 1.0, "B": 0.4}
RUNS = (r"\x{30A1}-\x{30FA}\x{30FC}-\x{30FF}", r"\x{3041}-\x{309F}", r"\x{AC00}-\x{D7AF}")  # katakana without the middle dot, hiragana, Hangul


def terms(c: Column) -> Column:
    """Lower-case terms of a text: runs of katakana, of hiragana, of Hangul and of letters and digits of alphabets, single ideographs."""
    return F.regexp_extract_all(F.lower(c), F.lit(rf"(\p{{IsHan}}|{'|'.join(f'[{x}]+' for x in RUNS)}|[\p{{L}}\p{{N}}&&[^\p{{IsHan}}{''.join(RUNS)}]]+)"), F.lit(1))


def inverted(docs: DataFrame, key: str, fields: dict[str, str]) -> DataFrame:
    """(term, key, tf_A, tf_B): postings of the given fields, each of weight class A or B."""
    parts = [docs.select(F.col(key), F.lit(cls).alias("cls"), F.explode(terms(F.col(col))).alias("term")) for col, cls in fields.items()]
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    return u.groupBy("term", key).agg(*[F.count_if(F.col("cls") == c).alias(f"tf_{c}") for c in WEIGHTS])


def match_all(index: DataFrame, key: str, wanted: list[str]) -> DataFrame:
    """(key, score): documents that hold every wanted term; score = sum of weight * (1 + ln tf) over terms and classes."""
    hits = index.where(F.col("term").isin(*wanted))
    part = sum((F.when(F.col(f"tf_{c}") > 0, F.lit(w) * (1 + F.ln(f"tf_{c}"))).otherwise(0.0) for c, w in WEIGHTS.items()), F.lit(0.0))
    return hits.groupBy(key).agg(F.count("*").alias("n"), F.sum(part).alias("score")).where(F.col("n") == len(set(wanted))).drop("n")


def similar(names: DataFrame, key: str, name: str, wanted: str, floor: float = TRIGRAM_FLOOR) -> DataFrame:
    """(key, score): best trigram similarity of each key's names, above ``floor``; keys are ranked before any limit."""
    q = T.trigrams(F.lit(wanted))
    s = names.select(key, T.trigram_similarity(T.trigrams(F.col(name)), q).alias("score")).where(F.col("score") > floor)
    return s.groupBy(key).agg(F.max("score").alias("score"))


def two_stage(index: DataFrame, names: DataFrame, key: str, name: str, wanted: str, tokens: list[str], limit: int = LIMIT) -> DataFrame:
    """(key, score, stage): the first stage's hits, or the second's if the first has none; at most ``limit``."""
    first = match_all(index, key, tokens).withColumn("stage", F.lit(1))
    found = first.agg((F.count("*") > 0).alias("found"))
    second = similar(names, key, name, wanted).crossJoin(F.broadcast(found)).where("not found").drop("found").withColumn("stage", F.lit(2))
    return first.unionByName(second).withColumn("score", F.round("score", 9)).orderBy("stage", F.col("score").desc(), key).limit(limit)


def fused_ranks(ranked: DataFrame, key: str, rank: str, k: int = 60) -> DataFrame:
    """(key, rrf): reciprocal rank fusion over lists; ``rank`` counts from 1."""
    return ranked.groupBy(key).agg(F.sum(1.0 / (k + F.col(rank))).alias("rrf"))
