"""Queries of the training-data operators, by name; each reads whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tanzaku.llm import knn, langid, leakage, lookalike, matching, packing, quality, split
from tanzaku.tables import load, spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


# ---------------------------------------------------------------- 2: most similar vectors


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return knn.all_vectors(spread(load(spark, d, "plot_chunk", ["chunk_id", "vec"])), load(spark, d, "vectors", ["k", "dim", "vec"]))


@query
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return knn.mutual_pairs(_vectors(spark, d), 0.90)


# ---------------------------------------------------------------- 3: splitting oversized items


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return spread(load(spark, d, "plot_chunk", ["chunk_id", "text", "section"]))


@query
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    cut = split.split_items(_chunks(spark, d), "chunk_id", "text", "section", with_text=False)
    return cut.where("piece_no = 1").select("chunk_id", "cut_kind").distinct()


@query
def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    cut = split.split_items(_chunks(spark, d), "chunk_id", "text", "section")
    return cut.select("chunk_id", "piece_no", "start", "end", "cut_kind", "fits", "piece").distinct()


# ---------------------------------------------------------------- 8: text quality


def _common(spark: SparkSession, d: str) -> list[str]:
    return [r["word"] for r in load(spark, d, "common_word", ["word"]).where("word is not null").limit(quality.MAX_COMMON + 1).collect()]


def _statistics(spark: SparkSession, d: str) -> DataFrame:
    return quality.document_statistics(spread(load(spark, d, "documents", ["doc_id", "text"])), "doc_id", "text", _common(spark, d))


@query
def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _statistics(spark, d).where("doc_kind != 'prose'").select("doc_id", "doc_kind").distinct()


@query
def p8_statistics(spark: SparkSession, d: str) -> DataFrame:
    return _statistics(spark, d).distinct()


# ---------------------------------------------------------------- 1: languages


def _texts(spark: SparkSession, d: str) -> DataFrame:
    """(rec_table, rec_key, text, label) of all rows with a key and a text."""
    a = load(spark, d, "anime_profile", ["subject_id", "summary", "summary_lang"]).toDF("rec_key", "text", "label").withColumn("rec_table", F.lit("anime_profile"))
    b = load(spark, d, "translation", ["src_sha", "src", "src_lang"]).toDF("rec_key", "text", "label").withColumn("rec_table", F.lit("translation"))
    return a.withColumn("rec_key", F.col("rec_key").cast("string")).unionByName(b).where("text is not null and rec_key is not null")


def _stretches(spark: SparkSession, d: str) -> DataFrame:
    """Each key once, with the least text and label of its rows; they are combined before the shuffle, so copies of one key never meet."""
    texts = _texts(spark, d)
    once = texts.groupBy("rec_table", "rec_key").agg(F.min(F.struct("text", "label")).alias("m")).select("rec_table", "rec_key", "m.text", langid.label_language(F.col("m.label")).alias("named"))
    return langid.language_stretches(once, ["rec_table", "rec_key", "named"], "text", langid.fit_on(texts, "text", "label"))


@query
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _stretches(spark, d).where("named is null or named != lang or n_seg > 1").select("rec_table", "rec_key", "seg_no", "lang")


@query
def p1_stretches(spark: SparkSession, d: str) -> DataFrame:
    return _stretches(spark, d).drop("named")


# ---------------------------------------------------------------- 4: visually identical text


def _names(spark: SparkSession, d: str) -> DataFrame:
    """(field_name, key, value)"""
    alias = load(spark, d, "alias", ["id", "name", "norm_name"])
    pages = load(spark, d, "moegirl_page", ["pageid", "title"])
    one = lambda df, field, key, value: df.select(F.lit(field).alias("field_name"), F.col(key).cast("long").alias("key"), F.col(value).alias("value"))
    return one(alias, "alias.name", "id", "name").unionByName(one(alias, "alias.norm_name", "id", "norm_name")).unionByName(one(pages, "moegirl_page.title", "pageid", "title"))


@query
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.lookalike_pairs(_names(spark, d), "field_name", "key", "value")


@query
def p4_canonical(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.canonical_values(_names(spark, d), "field_name", "key", "value").distinct()


# ---------------------------------------------------------------- 6: filling containers


def _packed(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents", ["doc_id", "text"]).select("doc_id", packing.byte_tokens(F.col("text")).alias("tokens"))
    return packing.pack(docs.where("tokens is not null").distinct(), "doc_id", "tokens", 4096)


@query
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d).where("n_pieces > 1").select("doc_id").distinct()


@query
def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d)


# ---------------------------------------------------------------- 7: leaked evaluation texts


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    items = load(spark, d, "eval_item", ["item_id", "lang", "passage"])
    return leakage.leaks(spread(load(spark, d, "documents", ["doc_id", "text"])), "doc_id", "text", items, "item_id", "lang", "passage")


@query
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).select("item_id", "doc_id").distinct()


@query
def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).groupBy("item_id", "doc_id").agg(F.max("letters").alias("letters"), F.max("share").alias("share"))


# ---------------------------------------------------------------- 5: works and their pages


def _matches(spark: SparkSession, d: str) -> DataFrame:
    works = load(spark, d, "anime_profile", ["subject_id", "name", "name_cn", "air_year", "studios", "updated_at"])
    pages = load(spark, d, "moegirl_page", ["pageid", "kind", "title", "lead_text", "lastrevid"])
    return matching.matches(works, pages)


@query
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _matches(spark, d).select("subject_id", "pageid")


@query
def p5_confidence(spark: SparkSession, d: str) -> DataFrame:
    return _matches(spark, d)


# ---------------------------------------------------------------- SQL of an independent engine, where it can say the same

_CLOSERS = "\"\\'”’」』】）)］\\]｝}》〉〕〗〙»›＂＇".replace("\\'", "''")
ORACLES["p3_found"] = f"""with c as (select distinct chunk_id, text, coalesce(length(section) + 2, 0) label from plot_chunk where length(text) + coalesce(length(section) + 2, 0) > 600),
m as (select chunk_id, label, regexp_replace(regexp_replace(regexp_replace(text, '\\.(\\s)', '.' || chr(1) || '\\1', 'g'), '([。！？!?…]+[{_CLOSERS}]*)', '\\1' || chr(1), 'g'), '(\\r\\n|[\\n\\r\\x0b\\x0c])', '\\1' || chr(1), 'g') t from c)
select chunk_id, case when list_max(list_transform(string_split(t, chr(1)), lambda x: length(x))) <= 600 - label - 50 then 'natural' else 'forced' end cut_kind from m"""
ORACLES["p6_found"] = "select distinct doc_id from documents where strlen(text) + 1 > 4096"


# ---------------------------------------------------------------- 2: lists for a stated set of queries


#: The stated queries: chunks whose id is divisible by 50, and texts whose digest's first 8 hex digits, read as a number, are.
ASKED = "case coll when 'vectors' then try_cast(conv(left(key, 8), 16, 10) as bigint) % 50 = 0 else try_cast(key as bigint) % 50 = 0 end"


@query
def p2_neighbors(spark: SparkSession, d: str) -> DataFrame:
    """The 10 nearest keys of every key of ``ASKED`` among all rows of its collection, with many more leaves visited than for all pairs."""
    return knn.nearest_keys(_vectors(spark, d), ASKED, knn.Params(stages=16, beam=2, probes=64, rerank=160))


def _look_sql(value: str) -> str:
    """The skeleton of a value with composed marks, for an engine without collations of the same rules."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    out = f"regexp_replace(regexp_replace({value}, {quoted(lookalike.INVISIBLE)}, '', 'g'), {quoted(lookalike.BLANK)}, ' ', 'g')"
    for sign, letters in lookalike.SEVERAL.items():
        out = f"replace({out}, {quoted(sign)}, {quoted(letters)})"
    return f"nfc_normalize(translate({out}, {quoted(lookalike.FROM)}, {quoted(lookalike.TO)}))"


_FIELDS = "select distinct 'alias.name' field_name, id as key, name as v from alias where name is not null union all select distinct 'alias.norm_name', id, norm_name from alias where norm_name is not null union all select distinct 'moegirl_page.title', pageid, title from moegirl_page where title is not null"
ORACLES["p4_found"] = f"with f as ({_FIELDS}), l as (select *, {_look_sql('v')} look from f) select distinct a.field_name, a.key key_a, b.key key_b from l a join l b on a.field_name = b.field_name and a.look = b.look and a.key < b.key and a.v <> b.v"
