"""Evaluation over ``embeddings`` (labels as relevance) and ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tanzaku.functions import vectors as V
from tanzaku.operators import metrics as E
from tanzaku.plans.registry import query
from tanzaku.tables import load

RANKED = "q as (select vec_id qid, label qlabel, embedding::double[] v from embeddings where vec_id < 20), ranked as (select qid, vec_id, case when label = qlabel then 1 else 0 end rel, row_number() over (partition by qid order by round(list_cosine_similarity(v, embedding::double[]), 9) desc, vec_id) rk from embeddings cross join q where vec_id <> qid)"


def _ranked(spark: SparkSession, d: str, cut: int | None = None) -> DataFrame:
    e = load(spark, d, "embeddings", ["vec_id", "embedding", "label"])
    v = F.slice("embedding", 1, cut) if cut else F.col("embedding")
    e = e.select("vec_id", "label", v.alias("v"))
    q = e.where("vec_id < 20").select(F.col("vec_id").alias("qid"), F.col("label").alias("qlabel"), F.col("v").alias("q"))
    s = e.crossJoin(F.broadcast(q)).where("vec_id != qid").select("qid", "vec_id", (F.col("label") == F.col("qlabel")).cast("int").alias("rel"), F.round(V.cosine(F.col("q"), F.col("v")), 9).alias("cos"))  # twenty queries
    return s.withColumn("rk", F.row_number().over(Window.partitionBy("qid").orderBy(F.col("cos").desc(), "vec_id")))


@query(f"with {RANKED}, g as (select qid, sum(case when rk <= 10 then rel end) hits, sum(case when rk <= 10 then rel / log2(rk + 1) end) dcg, sum(rel) al from ranked group by 1) select qid, round(hits / 10.0::double, 6) as precision, round(case when al > 0 then dcg / list_sum(list_transform(range(1, least(al, 10)::bigint + 1), lambda i: 1 / log2(i + 1))) else 0 end, 6) ndcg from g")
def precision_ndcg_at_k(spark, d):
    return E.precision_ndcg(_ranked(spark, d), "qid", "rk", "rel").select("qid", F.round("precision", 6).alias("precision"), F.round("ndcg", 6).alias("ndcg"))


@query(f"with {RANKED}, b as (select qid, vec_id, case when label = qlabel then 1 else 0 end rel, row_number() over (partition by qid order by round(list_cosine_similarity(v[1:16], embedding[1:16]::double[]), 9) desc, vec_id) rk from embeddings cross join q where vec_id <> qid) select a.qid, round(a.s, 6) share_a, round(b.s, 6) share_b from (select qid, avg(rel::double) s from ranked where rk <= 20 group by 1) a join (select qid, avg(rel::double) s from b where rk <= 20 group by 1) b using (qid)")
def share_at_k_ab(spark, d):
    a = E.share_at_k(_ranked(spark, d), "qid", "rk", "rel", 20).select("qid", F.round("share", 6).alias("share_a"))
    return a.join(E.share_at_k(_ranked(spark, d, 16), "qid", "rk", "rel", 20).select("qid", F.round("share", 6).alias("share_b")), "qid")


@query("select source, count(*) n, round(avg((n_chars > 300)::int::double), 6) hit, round(avg(case when n_chars > 300 then (lang = 'zh')::int::double end), 6) answered_if_hit, round(avg(case when not n_chars > 300 then (lang = 'zh')::int::double end), 6) answered_if_miss from documents where n_chars is not null and lang is not null group by 1")
def confusion_rates(spark, d):
    x = load(spark, d, "documents", ["source", "n_chars", "lang"]).where("n_chars is not null and lang is not null")
    c = E.confusion(x, "source", F.col("n_chars") > 300, F.col("lang") == "zh")
    return c.select("source", "n", *[F.round(k, 6).alias(k) for k in ("hit", "answered_if_hit", "answered_if_miss")])


@query("select source, doc_id from (select source, doc_id, row_number() over (partition by source order by md5('s' || doc_id), doc_id) r from documents) where r <= 7")
def stratified_sample(spark, d):
    return E.stratified(load(spark, d, "documents", ["source", "doc_id"]), "source", "doc_id", 7, "s").select("source", "doc_id")


@query("with s as (select l, row_number() over (order by l) - 1 i, count(*) over () n from (select length(text) l from documents where text is not null)) select p.share, s.l::bigint len from s join (values (0.0::double), (0.25), (0.5), (0.9), (1.0)) p(share) on s.i = least(floor(s.n * p.share), s.n - 1)")
def quantile_by_index(spark, d):
    x = load(spark, d, "documents", ["text"]).select(F.length("text").cast("long").alias("len"))
    return E.quantile_by_index(x, "len", [0.0, 0.25, 0.5, 0.9, 1.0])


@query("with g as (select subject_id, max(source) source, count(distinct lang) langs, count(*) n from documents where subject_id is not null group by 1 having count(*) >= 2) select subject_id, source, langs, n from (select *, row_number() over (order by md5('q' || subject_id), subject_id) r from g) where r <= 30")
def named_question_sample(spark, d):
    g = load(spark, d, "documents", ["subject_id", "source", "lang"]).where("subject_id is not null").groupBy("subject_id").agg(F.max("source").alias("source"), F.count_distinct("lang").alias("langs"), F.count("*").alias("n")).where("n >= 2")
    return g.orderBy(F.md5(F.concat(F.lit("q"), F.col("subject_id").cast("string"))), "subject_id").limit(30)


@query("with c as (select distinct chunk_id, section, text from plot_chunk where section is not null) select section, sum(length(text))::bigint chars, count(*) n from c group by 1 order by chars desc, section limit 8")
def top_sections_by_length(spark, d):
    c = load(spark, d, "plot_chunk", ["chunk_id", "section", "text"]).where("section is not null").distinct()
    return c.groupBy("section").agg(F.sum(F.length("text")).alias("chars"), F.count("*").alias("n")).orderBy(F.col("chars").desc(), "section").limit(8)
