"""Selection for questionnaires over ``anime_profile``, and diversity over ``embeddings``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tanzaku.operators import selecting as S
from tanzaku.plans.registry import query
from tanzaku.tables import load

PROFILE = "select distinct on (subject_id) * from anime_profile order by subject_id, updated_at desc, fav_done desc nulls last"


def works(spark: SparkSession, d: str, columns: list[str]) -> DataFrame:
    """``anime_profile`` with each key once, the newest delivery."""
    df = load(spark, d, "anime_profile", list(dict.fromkeys(["subject_id", *columns, "updated_at", "fav_done"])))
    w = Window.partitionBy("subject_id").orderBy(F.col("updated_at").desc(), F.col("fav_done").desc_nulls_last())
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def asked(spark: SparkSession, d: str) -> DataFrame:
    w = works(spark, d, ["series_root", "form", "nsfw", "air_year"])
    rank = F.when(F.col("subject_id") % 3 == 0, F.col("subject_id") % 1009)
    return w.select(F.col("subject_id").alias("item_id"), F.col("series_root").alias("root"), "form", "nsfw", F.col("air_year").cast("int").alias("air_year"), F.col("fav_done").alias("done"), rank.alias("mmr_rank"))


def _questionnaire_sql(n: int, floor: int, exclude: str = "") -> str:
    return f"""with p as ({PROFILE}), x as (select p.subject_id item_id, coalesce(p.series_root, p.subject_id) root, p.fav_done done, case when p.subject_id % 3 = 0 then p.subject_id % 1009 end mmr_rank
  from p join p r on r.subject_id = coalesce(p.series_root, p.subject_id) where p.form in ('TV', 'WEB') and not coalesce(r.nsfw, false) and r.air_year >= {floor}),
lead as (select distinct on (root) * from x {exclude} order by root, done desc nulls last, item_id)
select item_id, root, row_number() over (order by mmr_rank is null, mmr_rank, done desc, item_id) as position from lead order by position limit {n}"""


@query(_questionnaire_sql(30, 2000))
def questionnaire_select(spark, d):
    return S.questionnaire(asked(spark, d), 30, ["TV", "WEB"], year_floor=2000)


@query(_questionnaire_sql(30, 2000, "where root % 2 = 0"))
def questionnaire_second_round(spark, d):
    items = asked(spark, d)
    done = items.where("root % 2 = 1").select("root")
    return S.questionnaire(items, 30, ["TV", "WEB"], year_floor=2000, exclude=done)


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "embeddings", ["vec_id", "embedding", "label"]).withColumn("done", (F.col("vec_id") * 37) % 211)


@query()
def mmr_order(spark, d):
    return S.mmr_order(_vectors(spark, d), "label", "vec_id", "done", "embedding")


@query("with u as (select label, vec_id, embedding::double[] v from embeddings) select a.label, round(avg(list_cosine_similarity(a.v, b.v)), 6) redundancy from u a join u b on a.label = b.label and a.vec_id < b.vec_id group by 1")
def redundancy_pairs(spark, d):
    return S.redundancy(_vectors(spark, d), "label", "vec_id", "embedding").select("label", F.round("redundancy", 6).alias("redundancy"))


@query()
def kmeans_representatives(spark, d):
    return S.kmeans_representatives(_vectors(spark, d), "vec_id", "embedding", "done", k=10)


@query("select distinct on (label) label, vec_id, round(embedding[1]::double, 6) score from embeddings order by label, embedding[1] desc, vec_id")
def distinct_on_best(spark, d):
    e = load(spark, d, "embeddings", ["vec_id", "embedding", "label"]).withColumn("x", F.col("embedding")[0])
    best = e.groupBy("label").agg(F.max_by(F.struct("vec_id", "x"), F.struct("x", -F.col("vec_id"))).alias("m"))
    return best.select("label", "m.vec_id", F.round(F.col("m.x").cast("double"), 6).alias("score"))


@query(f"with p as ({PROFILE}) select distinct on (series_root) series_root, subject_id, air_year::bigint air_year from p order by series_root, air_year nulls last, fav_done desc nulls last, subject_id")
def distinct_on_entry(spark, d):
    w = works(spark, d, ["series_root", "air_year"])
    order = F.struct(F.coalesce(F.col("air_year").cast("int"), F.lit(1 << 30)), -F.coalesce("fav_done", F.lit(-1)), F.col("subject_id"))
    return w.groupBy("series_root").agg(F.min_by(F.struct("subject_id", "air_year"), order).alias("m")).select("series_root", "m.subject_id", F.col("m.air_year").cast("long").alias("air_year"))


@query(f"with p as ({PROFILE}) select form, subject_id, fav_done::bigint fav_done, row_number() over (partition by form order by fav_done desc nulls last, subject_id) as position from p qualify position <= 5")
def top_per_form(spark, d):
    w = works(spark, d, ["form"]).select("form", "subject_id", F.col("fav_done").cast("long").alias("fav_done"))
    return S.top_by(w, ["form"], [F.col("fav_done").desc_nulls_last(), F.col("subject_id")], 5)
