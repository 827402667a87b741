from __future__ import annotations

import itertools
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from tanzaku.llm import lookalike

SAME = [
    ("カガニ", "ｶｶﾞﾆ"), ("がく", "がく"), ("Roma", "Rоmа"), ("TAKE", "ＴＡＫＥ"), ("a b", "a　b"), ("a b", "a b"), ("ab", "a​b"), ("ab", "a️b⁠"), ("頁", "⾴"),
    ("零", "零"), ("ロカ", "口力"), ("ヘや", "へや"), ("ē", "ē"), ("A!", "A！"), ("ヴ", "ｳﾞ"), ("Ⅱ", "II"),
]
APART = [("abc", "ABC"), ("e", "é"), ("か", "が"), ("つ", "っ"), ("ア", "ァ"), ("国", "國"), ("a,b", "a.b"), ("a b", "ab"), ("あ", "ア"), ("ō", "o"), ("i", "l"), ("0", "O"), ("「a」", "『a』")]


def _frame(spark, values):
    return spark.createDataFrame([("f", i, v) for i, v in enumerate(values)], "field string, key long, value string")


def test_equal_looks(spark):
    values = [v for p in SAME for v in p]
    got = {(r.key_a, r.key_b) for r in lookalike.lookalike_pairs(_frame(spark, values), "field", "key", "value").collect()}
    assert {(2 * i, 2 * i + 1) for i in range(len(SAME))} <= got


@pytest.mark.parametrize("pair", APART)
def test_others_stay_apart(spark, pair):
    assert lookalike.lookalike_pairs(_frame(spark, pair), "field", "key", "value").count() == 0


def test_canonical_member(spark):
    values = ["ｶｶﾞ", "カガ", "カガ", "カガ", "カ​ガ", None, "", "​", "x"]
    got = {r.key: r.canonical for r in lookalike.canonical_values(_frame(spark, values), "field", "key", "value").collect()}
    assert {got[i] for i in range(5)} == {"カガ"} and got[5] is None and got[6] == got[7] == "" and got[8] == "x"


def test_all_pairs_of_rows_with_different_values(spark):
    values = ["ab"] * 5 + ["ab​"] * 3 + ["ａb"]
    rows = _frame(spark, values)
    got = {(r.key_a, r.key_b) for r in lookalike.lookalike_pairs(rows.unionByName(rows), "field", "key", "value").collect()}
    assert got == {(i, j) for i, j in itertools.combinations(range(9), 2) if values[i] != values[j]}


def test_fields_do_not_meet_and_empty_input(spark):
    df = spark.createDataFrame([("f", 1, "ａ", 0), ("g", 2, "a", 0)], "field string, key long, value string, canonical int")
    assert lookalike.lookalike_pairs(df, "field", "key", "value").count() == 0
    assert lookalike.lookalike_pairs(df.where("false"), "field", "key", "value").count() == 0


#: Letters of other alphabets that are drawn like a Latin letter: rho, palochka, izhitsa, vo, tli, komi sje.
@pytest.mark.parametrize("a,b", [("ρ", "p"), ("ӏ", "l"), ("ѵ", "v"), ("ո", "n"), ("Ꮯ", "C"), ("Ԍ", "G")])
def test_shapes_of_other_alphabets(spark, a, b):
    assert lookalike.lookalike_pairs(_frame(spark, [f"x{a}y", f"x{b}y"]), "field", "key", "value").count() == 1


def test_base_is_coarser_than_the_collation(spark):
    rng = random.Random(2)
    chars = "aeéがが́ÅÅΩΩ각각가 "
    values = sorted({"".join(rng.choice(chars) for _ in range(rng.randrange(1, 4))) for _ in range(400)})
    df = _frame(spark, values).selectExpr("value as v")
    df = df.withColumn("look", lookalike.skeleton(F.col("v"))).withColumn("base", lookalike.base(F.col("look")))
    a = df.select(F.collate("look", "UNICODE").alias("look"), F.col("base").alias("base_a"))
    assert a.join(df.select(F.collate("look", "UNICODE").alias("look"), F.col("base").alias("base_b")), "look").where("base_a != base_b").count() == 0
    want = {(i, j) for i, j in itertools.combinations(range(len(values)), 2) if unicodedata.normalize("NFC", values[i]) == unicodedata.normalize("NFC", values[j])}
    got = {(r.key_a, r.key_b) for r in lookalike.lookalike_pairs(_frame(spark, values), "field", "key", "value").collect()}
    assert want and want <= got
