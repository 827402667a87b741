"""Search over ``anime_profile`` titles and tags, ``documents`` and names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tanzaku.functions import text as T
from tanzaku.functions import vectors as V
from tanzaku.operators import searching as S
from tanzaku.plans.keys import name_key_sql
from tanzaku.plans.registry import query
from tanzaku.plans.selecting import PROFILE, works
from tanzaku.tables import load

SPLIT = "|".join(["\\p{Han}", *(f"[{x}]+" for x in S.RUNS)])
TERMS = f"regexp_extract_all(regexp_replace(lower({{}}), '({SPLIT.replace('{', '{{').replace('}', '}}')})', ' \\1 ', 'g'), '[\\p{{{{L}}}}\\p{{{{N}}}}{''.join(S.RUNS).replace('{', '{{').replace('}', '}}')}]+')"
TRI = "list_distinct(flatten(list_transform(list_filter(string_split(regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


def _index(spark: SparkSession, d: str) -> DataFrame:
    return S.inverted(load(spark, d, "documents", ["doc_id", "text", "source"]), "doc_id", {"source": "A", "text": "B"})


INDEX = f"post as (select doc_id, 'A' cls, unnest({TERMS.format('source')}) term from documents union all select doc_id, 'B', unnest({TERMS.format('text')}) from documents), idx as (select term, doc_id, count(*) filter (cls = 'A') a, count(*) filter (cls = 'B') b from post group by 1, 2)"


def _match(words: list[str]) -> str:
    return f"hits as (select doc_id, count(*) n, sum(case when a > 0 then 1 + ln(a) else 0 end + case when b > 0 then 0.4::double * (1 + ln(b)) else 0 end) score from idx where term in ({', '.join(repr(w) for w in words)}) group by 1 having n = {len(words)})"


@query(f"with {INDEX}, {_match(['compass', 'talking', 'valley'])} select doc_id, round(score, 6) score from hits")
def fulltext_and_match(spark, d):
    return S.match_all(_index(spark, d), "doc_id", ["compass", "talking", "valley"]).select("doc_id", F.round("score", 6).alias("score"))


@query(f"with {INDEX}, {_match(['钟', '声', '响', '起'])} select doc_id, round(score, 6) score from hits")
def fulltext_ideographs(spark, d):
    return S.match_all(_index(spark, d), "doc_id", ["钟", "声", "响", "起"]).select("doc_id", F.round("score", 6).alias("score"))


@query(f"with p as ({PROFILE}), n as (select subject_id, name_en from p where name_en is not null), s as (select subject_id, {TRI.format('name_en')} t, {TRI.format(chr(39) + 'Nightmoor Ballad' + chr(39))} q from n), r as (select subject_id, len(list_intersect(t, q)) / greatest(len(t) + len(q) - len(list_intersect(t, q)), 1) sim from s) select subject_id, round(sim, 6) sim from r where sim > 0.3")
def trigram_similarity(spark, d):
    n = works(spark, d, ["name_en"]).where("name_en is not null")
    return S.similar(n, "subject_id", "name_en", "Nightmoor Ballad").select("subject_id", F.round("score", 6).alias("sim"))


def _two_stage_sql(words: list[str], text: str) -> str:
    return f"""with {INDEX}, {_match(words)}, names as (select distinct subject_id doc_id, name_en from anime_profile where name_en is not null), s as (select doc_id, {TRI.format('name_en')} t, {TRI.format(chr(39) + text + chr(39))} q from names),
second as (select doc_id, max(len(list_intersect(t, q)) / greatest(len(t) + len(q) - len(list_intersect(t, q)), 1)) score from s group by 1 having score > 0.3),
u as (select doc_id, round(score, 9) score, 1 stage from hits union all select doc_id, round(score, 9), 2 from second where not exists (select 1 from hits))
select doc_id, round(score, 6) score, stage from (select * from u order by stage, score desc, doc_id limit 20)"""


def _two_stage(spark: SparkSession, d: str, words: list[str], text: str) -> DataFrame:
    names = load(spark, d, "anime_profile", ["subject_id", "name_en"]).where("name_en is not null").select(F.col("subject_id").cast("long").alias("doc_id"), "name_en").distinct()
    return S.two_stage(_index(spark, d), names, "doc_id", "name_en", text, words, 20).select("doc_id", F.round("score", 6).alias("score"), "stage")


@query(_two_stage_sql(["silver", "watch"], "silver watch"))
def search_two_stage(spark, d):
    return _two_stage(spark, d, ["silver", "watch"], "silver watch")


@query(_two_stage_sql(["nightmor", "ballade"], "nightmor ballade"))
def search_second_stage(spark, d):
    return _two_stage(spark, d, ["nightmor", "ballade"], "nightmor ballade")


@query("with q as (select embedding::double[] v, vec_id qid from embeddings where vec_id < 3), l as (select vec_id, qid, row_number() over (partition by qid order by round(list_cosine_similarity(v, embedding::double[]), 9) desc, vec_id) rn from embeddings cross join q qualify rn <= 20) select vec_id, round(sum(1.0::double / (60 + rn)), 6) rrf from l group by 1")
def rrf_fusion(spark, d):
    e = load(spark, d, "embeddings", ["vec_id", "embedding"])
    q = e.where("vec_id < 3").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))
    s = e.crossJoin(F.broadcast(q)).select("vec_id", "qid", F.round(V.cosine(F.col("q"), F.col("embedding")), 9).alias("cos"))  # three queries
    w = Window.partitionBy("qid").orderBy(F.col("cos").desc(), "vec_id")
    top = s.withColumn("rn", F.row_number().over(w)).where("rn <= 20")
    return S.fused_ranks(top, "vec_id", "rn").select("vec_id", F.round("rrf", 6).alias("rrf"))


@query(r"select id, regexp_replace(lower(name), '[\p{P}\p{S}\p{Z}\p{C}]', '', 'g') as key from (select distinct id, name from alias)")
def norm_name_key(spark, d):
    return load(spark, d, "alias", ["id", "name"]).distinct().select("id", T.stripped_key(F.col("name")).alias("key"))


@query(f"select id, {name_key_sql('name')} as key from (select distinct id, name from alias)")
def norm_name_full(spark, d):
    return load(spark, d, "alias", ["id", "name"]).distinct().select("id", T.name_key("name").alias("key"))


@query(f"select subject_id, array_to_string({TERMS.format('name')}, ' ') tokens from (select distinct subject_id, name from anime_profile)")
def script_runs(spark, d):
    p = load(spark, d, "anime_profile", ["subject_id", "name"]).distinct()
    return p.select("subject_id", F.array_join(S.terms(F.col("name")), " ").alias("tokens"))
