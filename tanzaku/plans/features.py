"""Tags, credits and sequels of ``anime_profile``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tanzaku.operators import features as X
from tanzaku.plans.registry import query
from tanzaku.plans.selecting import PROFILE, works
from tanzaku.tables import load

TAGS = f"p as ({PROFILE}), tags as (select subject_id item, t.name as name, sum(t.count) n from (select subject_id, unnest(tags) t from p) group by 1, 2), meta as (select distinct subject_id item, unnest(meta_tags) as name from p)"
SYNONYMS = (("战斗", "动作"), ("群像", "群像剧"), ("恋爱", "爱情"))
SYN = "syn as (select * from (values " + ", ".join(f"('{a}', '{b}')" for a, b in SYNONYMS) + ") t(name, canonical))"


def tags(spark: SparkSession, d: str) -> DataFrame:
    t = works(spark, d, ["tags"]).select(F.col("subject_id").alias("item"), F.explode("tags").alias("t"))
    return t.groupBy("item", F.col("t.name").alias("name")).agg(F.sum("t.count").alias("n"))


def meta(spark: SparkSession, d: str) -> DataFrame:
    return works(spark, d, ["meta_tags"]).select(F.col("subject_id").alias("item"), F.explode("meta_tags").alias("name")).distinct()


@query(f"with {TAGS} select name, count(distinct item) df from tags group by 1 having count(distinct item) >= 8")
def tag_vocab_df(spark, d):
    return X.document_frequency(tags(spark, d), "item", "name")


@query(f"with {TAGS}, c as (select *, case when regexp_matches(name, '^(19|20)\\d\\d(年(\\d{{1,2}}月)?)?$') then 'YEAR' when regexp_matches(name, '^(TV|OVA|OAD|WEB|剧场版|短片|电影)$') then 'FORM' when regexp_matches(name, '^(日本|中国|国产|欧美|美国|韩国|法国)$') then 'REGION' when regexp_matches(name, '^([ -~]{{3,}}|[ァ-ヶー]{{3,}})$') then 'STUDIO' else 'KEEP' end cls from (select item, name from tags union all select item, name from meta)) select cls, count(*) n, count(distinct name) names from c group by 1")
def tag_class_partition(spark, d):
    t = tags(spark, d).select("item", "name").unionByName(meta(spark, d))
    return t.groupBy(X.classify(F.col("name"), X.TAG_RULES).alias("cls")).agg(F.count("*").alias("n"), F.count_distinct("name").alias("names"))


@query(f"with {TAGS}, {SYN} select item, coalesce(canonical, name) as name, sum(n)::bigint n from tags left join syn using (name) group by 1, 2")
def tag_synonym_merge(spark, d):
    return X.merged_counts(tags(spark, d), spark.createDataFrame(list(SYNONYMS), "name string, canonical string"))


ALL_TAGS = f"{TAGS}, mid as (select item, median(n) mid from tags group by 1), allt as (select item, name, n::double n from tags union all select m.item, m.name, coalesce(mid, 1.0) from meta m left join mid using (item) where not exists (select 1 from tags t where t.item = m.item and t.name = m.name)), df as (select name, count(distinct item) df from allt group by 1), tot as (select count(distinct item) n_items from allt)"


def _weights_sql(w: str) -> str:
    return f"{ALL_TAGS}, w0 as (select item, name, {w} * ln((n_items + 1.0::double) / (df + 1)) w from allt join df using (name) cross join tot), weights as (select item, name, w / sqrt(sum(w * w) over (partition by item)) w from w0 qualify sum(w * w) over (partition by item) > 0)"


def _all(spark: SparkSession, d: str) -> DataFrame:
    return X.with_meta(tags(spark, d), meta(spark, d))


@query(f"with {_weights_sql('ln(1 + n)')} select item, name, round(w, 6) w from weights")
def tag_weights_log_idf(spark, d):
    return X.tag_weights(_all(spark, d)).withColumn("w", F.round("w", 6))


@query(f"with {_weights_sql('1.0')} select item, name, round(w, 6) w from weights")
def tag_weights_binary(spark, d):
    return X.tag_weights(_all(spark, d), binary=True).withColumn("w", F.round("w", 6))


@query(f"with {_weights_sql('ln(1 + n)')}, q as (select name, w qw from weights where item = (select min(item) from weights)), s as (select item, round(sum(w * qw), 9) cos from weights join q using (name) group by 1) select item, round(cos, 6) cos from (select * from s order by cos desc, item limit 15)")
def sparse_cosine(spark, d):
    w = X.tag_weights(_all(spark, d))
    q = w.join(F.broadcast(w.agg(F.min("item").alias("item"))), "item")
    s = X.sparse_cosine(w, q).withColumn("cos", F.round("cos", 9))
    return s.orderBy(F.col("cos").desc(), "item").limit(15).select("item", F.round("cos", 6).alias("cos"))


FEATS = f"p as ({PROFILE}), f as (select distinct subject_id item, 'S|' || s as name from (select subject_id, unnest(studios) s from p) union select distinct subject_id, 'M|' || m from (select subject_id, unnest(meta_tags) m from p)), df as (select name, count(*) df from f where name is not null group by 1 having count(*) >= 8), tot as (select count(distinct item) n from f where name is not null), w0 as (select item, name, ln(n::double / df) w from f join df using (name) cross join tot)"


@query(f"with {FEATS} select item, name, round(w / sqrt(sum(w * w) over (partition by item)), 6) w from w0 qualify sum(w * w) over (partition by item) > 0")
def feature_idf_l2(spark, d):
    w = works(spark, d, ["studios", "meta_tags"])
    f = w.select(F.col("subject_id").alias("item"), F.explode("studios").alias("x")).select("item", F.concat(F.lit("S|"), "x").alias("name"))
    f = f.unionByName(w.select(F.col("subject_id").alias("item"), F.explode("meta_tags").alias("x")).select("item", F.concat(F.lit("M|"), "x").alias("name")))
    return X.feature_weights(f).withColumn("w", F.round("w", 6))


CHAIN = "n as (select o_orderkey item, o_custkey c, year(o_orderdate) as year, o_orderdate, lag(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey) prequel from orders)"


def _chain(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    o = load(spark, d, "orders", ["o_orderkey", "o_custkey", "o_orderdate"])
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return o.select(F.col("o_orderkey").alias("item"), F.year("o_orderdate").alias("year"), F.lag("o_orderkey").over(w).alias("prequel"))


def _roots(c: DataFrame) -> DataFrame:
    return X.series_roots(c.select("item", "year"), c.where("prequel is not null and item % 7 != 0").select("item", "prequel"))


@query(f"with recursive {CHAIN}, e as (select a.item, a.prequel from n a join n b on b.item = a.prequel where a.prequel is not null and b.year <= a.year and a.item % 7 <> 0), up as (select item, item root from n where item not in (select item from e) union all select e.item, up.root from up join e on e.prequel = up.item) select item, root from up")
def series_root_closure(spark, d):
    return _roots(_chain(spark, d))


@query(f"with {TAGS}, x as (select item, name, n, row_number() over (partition by item order by n desc, name) r from tags) select item, string_agg(name, '/' order by r) as names from x where r <= 3 group by 1")
def ordered_distinct_cap(spark, d):
    t = tags(spark, d).groupBy("item").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "name"))).alias("l"))  # the tags of one work
    return t.select("item", F.array_join(F.transform(F.slice("l", 1, 3), lambda x: x["name"]), "/").alias("names"))


@query(f"with p as ({PROFILE}) select subject_id, case when list_contains(meta_tags, 'TV') then 'TV' when list_contains(meta_tags, 'WEB') then 'WEB' when list_contains(meta_tags, '剧场版') then '剧场版' when list_contains(meta_tags, 'OVA') then 'OVA' end form, coalesce(case when len(studios) > 0 then studios[1] end, '不明') studio from p")
def array_priority_pick(spark, d):
    w = works(spark, d, ["meta_tags", "studios"])
    first = F.array_intersect(F.array(*map(F.lit, ("TV", "WEB", "剧场版", "OVA"))), "meta_tags")
    return w.select("subject_id", F.try_element_at(first, F.lit(1)).alias("form"), F.coalesce(F.try_element_at("studios", F.lit(1)), F.lit("不明")).alias("studio"))
