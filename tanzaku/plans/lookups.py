"""Related works, people and seasons; ``lineitem`` stands for credits (supplier = person, part = character, order = work)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tanzaku.functions import dates as D
from tanzaku.operators import lookups as L
from tanzaku.plans.registry import query
from tanzaku.plans.selecting import PROFILE, works
from tanzaku.tables import load


def _members(spark: SparkSession, d: str, arrays: dict[str, str]) -> DataFrame:
    w = works(spark, d, ["series_root", "studios", "meta_tags"]).withColumn("root", F.coalesce("series_root", "subject_id"))
    f = L.features(w, "subject_id", arrays)
    return f.join(w.select("subject_id", "root", F.col("fav_done").alias("done")), "subject_id").withColumnRenamed("subject_id", "item_id")


def _related_sql(facets: str) -> str:
    return f"""with p as ({PROFILE}), f as (select distinct subject_id item_id, coalesce(series_root, subject_id) root, fav_done done, kind, name from ({facets}) where name is not null),
seed as (select min(root) root from f), facets as (select distinct kind, name from f where root in (select root from seed)),
hits as (select f.*, row_number() over (partition by kind, name order by done desc nulls last, item_id) r from f join facets using (kind, name) where root not in (select root from seed)),
h as (select * from hits where r <= 20), best as (select distinct on (root) root, item_id, done from h order by root, item_id = root desc, coalesce(done, -1) desc, item_id),
n as (select root, count(distinct kind || name) shared from h group by 1) select root, item_id, done, shared from best join n using (root)"""


STUDIO = "select subject_id, series_root, fav_done, 'studio' kind, unnest(studios) as name from p"
META = "select subject_id, series_root, fav_done, 'meta' kind, unnest(meta_tags) as name from p"


def _related(spark: SparkSession, d: str, arrays: dict[str, str]) -> DataFrame:
    m = _members(spark, d, arrays)
    return L.related(m.agg(F.min("root").alias("root")), m)


@query(_related_sql(STUDIO))
def related_same_feature(spark, d):
    return _related(spark, d, {"studio": "studios"})


@query(_related_sql(f"{STUDIO} union all {META}"))
def related_union_new_roots(spark, d):
    return _related(spark, d, {"studio": "studios", "meta": "meta_tags"})


@query(f"with p as ({PROFILE}), q as (select studios s from p where studios is not null and len(studios) > 0 order by subject_id limit 1) select subject_id, fav_done from p cross join q where list_has_any(studios, s)")
def related_overlap(spark, d):
    w = works(spark, d, ["studios"])
    q = w.where("size(studios) > 0").orderBy("subject_id").limit(1).select(F.col("studios").alias("s"))
    return w.crossJoin(F.broadcast(q)).where(F.arrays_overlap("studios", "s")).select("subject_id", "fav_done")  # one row


@query(f"with p as ({PROFILE}) select subject_id, series_root from p where len(list_filter(tags, lambda t: t.name = '战斗' and t.count >= 5)) > 0")
def struct_containment(spark, d):
    w = works(spark, d, ["series_root", "tags"])
    return w.where(F.exists("tags", lambda t: (t["name"] == "战斗") & (t["count"] >= 5))).select("subject_id", "series_root")


def _roles(spark: SparkSession, d: str) -> DataFrame:
    li = load(spark, d, "lineitem", ["l_suppkey", "l_partkey", "l_orderkey", "l_linenumber"])
    return li.select(F.col("l_suppkey").alias("person"), F.col("l_partkey").alias("character"), F.col("l_orderkey").alias("work"), F.when(F.col("l_linenumber") <= 3, F.col("l_linenumber")).alias("role_type"))


NAMES = "select p_partkey as character, p_brand as name, 1 rank from part where p_partkey % 2 = 0 union all select p_partkey, p_type, 2 from part"


def _roles_of(spark: SparkSession, d: str) -> DataFrame:
    w = load(spark, d, "orders", ["o_orderkey", "o_totalprice"]).toDF("work", "popularity")
    p = load(spark, d, "part", ["p_partkey", "p_brand", "p_type"])
    names = p.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("character"), F.col("p_brand").alias("name"), F.lit(1).alias("rank")).unionByName(p.select(F.col("p_partkey").alias("character"), F.col("p_type").alias("name"), F.lit(2).alias("rank")))
    return L.roles_of(_roles(spark, d), w, names).withColumn("popularity", F.round("popularity", 2))


@query(f"""with r as (select l_suppkey person, l_partkey as character, l_orderkey as work, case when l_linenumber <= 3 then l_linenumber end role_type, o_totalprice popularity from lineitem join orders on o_orderkey = l_orderkey),
best as (select distinct on (person, character) * from r order by person, character, coalesce(role_type = 1, false) desc, popularity desc nulls last, work),
names as (select distinct on (character) character, name from ({NAMES}) order by character, rank, name)
select person, character, name, work, role_type, round(popularity, 2) popularity from best left join names using (character)""")
def roles_of(spark, d):
    return _roles_of(spark, d)


@query("with n as (select character_id, name, case source when 'name_cn' then 1 when 'name' then 2 else 3 end rank from alias where entity_type = 'character' and name is not null) select distinct on (character_id) character_id, name from n order by character_id, rank, name")
def name_pick_priority(spark, d):
    a = load(spark, d, "alias", ["character_id", "name", "entity_type", "source"]).where("entity_type = 'character' and name is not null")
    rank = F.when(F.col("source") == "name_cn", 1).when(F.col("source") == "name", 2).otherwise(3)
    return a.groupBy("character_id").agg(F.min_by("name", F.struct(rank, F.col("name"))).alias("name"))


@query("select s_suppkey, s_name, count(distinct l_partkey) as n_roles from supplier left join lineitem on l_suppkey = s_suppkey and l_returnflag = 'R' where s_nationkey < 12 group by 1, 2 having count(l_partkey) >= 10")
def find_person_left_join_having(spark, d):
    s = load(spark, d, "supplier", ["s_suppkey", "s_name", "s_nationkey"]).where("s_nationkey < 12")
    li = load(spark, d, "lineitem", ["l_suppkey", "l_partkey", "l_returnflag"]).where("l_returnflag = 'R'")
    g = s.join(li, F.col("l_suppkey") == F.col("s_suppkey"), "left").groupBy("s_suppkey", "s_name").agg(F.count_distinct("l_partkey").alias("n_roles"), F.count("l_partkey").alias("n"))
    return g.where("n >= 10").drop("n")


def _voices_three_way(spark: SparkSession, d: str) -> DataFrame:
    li = load(spark, d, "lineitem", ["l_partkey", "l_suppkey", "l_orderkey"])
    s, o = load(spark, d, "supplier", ["s_suppkey", "s_name"]), load(spark, d, "orders", ["o_orderkey", "o_orderdate"])
    j = li.join(s, F.col("s_suppkey") == F.col("l_suppkey")).join(o, F.col("o_orderkey") == F.col("l_orderkey"))
    return j.groupBy("l_partkey", "s_name", F.col("o_orderdate").cast("date").alias("first_date")).agg(F.count("*").alias("n"))


@query("select l_partkey, s_name, o_orderdate::date first_date, count(*) n from lineitem join supplier on s_suppkey = l_suppkey join orders on o_orderkey = l_orderkey group by 1, 2, 3")
def voices_three_way(spark, d):
    return _voices_three_way(spark, d)


@query(f"with p as ({PROFILE}), s as (select subject_id, air_date, fav_done from p where air_date >= date '2016-06-24' and air_date < date '2016-10-01') select subject_id, air_date, (select count(*) from s) total from s order by fav_done desc nulls last, subject_id limit 5")
def season_window_total(spark, d):
    w = works(spark, d, ["air_date"])
    return L.season(w, 2016, 8, 5, order=[F.col("fav_done").desc_nulls_last(), F.col("subject_id")]).select("subject_id", "air_date", "total")


def _quarter_functions(spark: SparkSession, d: str) -> DataFrame:
    o = load(spark, d, "orders", ["o_orderkey", "o_orderdate"]).withColumn("day", F.col("o_orderdate").cast("date"))
    q, (lo, hi) = D.quarter_start(F.col("day")), D.season_window(F.col("day"))
    return o.select("o_orderkey", q.alias("q_start"), D.shift_quarters(q, 1).alias("next_quarter"), lo.alias("window_from"), hi.alias("window_to"), (F.year("day") * 100 + F.month("day")).cast("long").alias("ym"))


@query("""select o_orderkey, date_trunc('quarter', o_orderdate)::date q_start, (date_trunc('quarter', o_orderdate) + interval 3 month)::date next_quarter, (date_trunc('quarter', o_orderdate) - interval 3 month - interval 7 day)::date window_from,
(date_trunc('quarter', o_orderdate) + interval 6 month - interval 1 day)::date window_to, year(o_orderdate) * 100 + month(o_orderdate) as ym from orders""")
def quarter_functions(spark, d):
    return _quarter_functions(spark, d)


def _detail_projection(spark: SparkSession, d: str) -> DataFrame:
    w = works(spark, d, ["name", "name_cn", "air_year", "tags"])
    tags = F.array_sort(F.transform("tags", lambda t: F.struct((-t["count"]).alias("c"), t["name"].alias("n"))))
    text = F.array_join(F.transform(tags, lambda t: F.concat(t["n"], F.lit(":"), (-t["c"]).cast("string"))), ",")
    return w.select("subject_id", F.coalesce("name_cn", "name").alias("title"), F.col("air_year").cast("long").alias("air_year"), F.size("tags").cast("long").alias("n_tags"), F.nullif(text, F.lit("")).alias("tag_list"))


@query(f"with p as ({PROFILE}) select subject_id, coalesce(name_cn, name) title, air_year::bigint air_year, len(tags) n_tags, (select string_agg(t.name || ':' || t.count, ',' order by t.count desc, t.name) from unnest(tags) u(t)) tag_list from p")
def detail_projection(spark, d):
    return _detail_projection(spark, d)


@query(f"with p as ({PROFILE}), l as (select coalesce(name_cn, name) t, subject_id, air_year, fav_done, count(*) over (partition by coalesce(name_cn, name)) c from p) select subject_id, case when c > 1 and air_year is not null then t || '（' || air_year || '）' else t end as shown from l")
def candidate_labels(spark, d):
    from pyspark.sql import Window

    w = works(spark, d, ["name", "name_cn", "air_year"]).withColumn("t", F.coalesce("name_cn", "name"))
    c = F.count("*").over(Window.partitionBy("t"))
    return w.select("subject_id", F.when((c > 1) & F.col("air_year").isNotNull(), F.concat("t", F.lit("（"), F.col("air_year").cast("string"), F.lit("）"))).otherwise(F.col("t")).alias("shown"))
