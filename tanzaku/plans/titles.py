"""Titles of works and pages, lines of context, and gates over the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from tanzaku.functions import dates as D
from tanzaku.functions import text as T
from tanzaku.operators import merging as M
from tanzaku.operators import metrics as E
from tanzaku.operators import titles as N
from tanzaku.plans.keys import name_key_sql
from tanzaku.plans.registry import query
from tanzaku.plans.selecting import PROFILE, works
from tanzaku.tables import load


def _names(spark, d):
    w = works(spark, d, ["series_root", "name", "name_cn"])
    return w.select(F.coalesce("series_root", "subject_id").alias("root"), F.explode(F.array("name", "name_cn")).alias("name"))


@query()
def title_variant_classes(spark, d):
    v = N.title_variants(_names(spark, d), "root", "name")
    return v.select("variant", "cls", F.array_join(F.transform("owners", lambda o: o.cast("string")), ",").alias("owners"))


@query()
def title_best_match(spark, d):
    pages = load(spark, d, "moegirl_page", ["pageid", "title"]).groupBy(F.col("title").alias("variant")).agg(F.min("pageid").alias("target")).where("variant is not null")
    return N.best_match(N.title_variants(_names(spark, d), "root", "name"), pages)


@query(f"with p as ({PROFILE}), x as (select coalesce(series_root, subject_id) root, subject_id, 0 as idx, trim(name_cn, ' ') title from p union all select coalesce(series_root, subject_id), subject_id, 1, trim(name, ' ') from p), f as (select root, title, min(case when subject_id = root then idx else 2 end) rank from x where title <> '' group by 1, 2) select root, title, row_number() over (partition by root order by rank, encode(title)) as position from f")
def candidate_title_list(spark, d):
    return N.candidate_titles(works(spark, d, ["series_root", "name", "name_cn"]))


@query()
def scope_title_strip(spark, d):
    """Questions without the quoted title of the work they are about."""
    q = load(spark, d, "eval_item", ["item_id", "question"])
    title = F.regexp_extract("question", "[《『]([^》』]+)[》』]", 1)
    return q.select("item_id", N.scope_stripped("question", F.when(title != "", F.array(T.name_key(title)))).alias("stripped"))


@query(f"with p as ({PROFILE}) select a.subject_id, a.series_root from p a join p b on b.subject_id = a.series_root where a.series_root <> a.subject_id and abs(a.air_year - b.air_year) <= 1")
def year_gate(spark, d):
    w = works(spark, d, ["series_root", "air_year"])
    root = w.select(F.col("subject_id").alias("series_root"), F.col("air_year").alias("root_year"))
    return w.where("series_root != subject_id").join(root, "series_root").where(D.years_close(F.col("air_year"), F.col("root_year"))).select("subject_id", "series_root")


@query(f"with p as ({PROFILE}) select subject_id, nullif(trim(name_en, ' '), '') name_en, list_sum(map_values(favorite))::bigint readers from p")
def profile_normalised(spark, d):
    w = works(spark, d, ["name_en", "favorite"])
    return w.select("subject_id", T.blank_to_null(F.col("name_en")).alias("name_en"), M.map_total(F.col("favorite")).alias("readers"))


@query("with s as (select count(*) n, round(avg((name = norm_name)::int::double), 6) share from (select distinct id, name, norm_name from alias) where name is not null and norm_name is not null) select n, share, share > 0.95 suspicious from s")
def equality_gate(spark, d):
    return E.equality(load(spark, d, "alias", ["id", "name", "norm_name"]).distinct(), "name", "norm_name")


@query("with g as (select coalesce(lang, '') as lang, source, count(*) n from documents group by 1, 2) select lang, source, n, round(100.0::double * n / sum(n) over (), 4) pct, row_number() over (order by n desc, lang, source) as position from g qualify position <= 20")
def distribution_top20(spark, d):
    x = load(spark, d, "documents", ["lang", "source"]).withColumn("lang", F.coalesce("lang", F.lit("")))
    return E.distribution(x, ["lang", "source"], 20)


@query(f"with p as ({PROFILE}), new as (select subject_id, fav_done * 2 as done2 from p where subject_id % 3 = 0) select p.subject_id, new.done2 fav_done from p left join new using (subject_id)")
def column_backfill(spark, d):
    w = works(spark, d, []).select("subject_id", "fav_done")
    return M.backfill(w, w.where("subject_id % 3 = 0").select("subject_id", (F.col("fav_done") * 2).alias("fav_done")), "subject_id", ["fav_done"])


@query("with g as (select pageid, max(section) section, list_sort(list_distinct(list(kind))) kinds, list_sort(list_distinct(list(spoiler_level))) levels, count(distinct chunk_id) n from plot_chunk where pageid is not null group by 1 having count(distinct chunk_id) >= 2) select pageid, section, array_to_string(kinds, ',') kinds, array_to_string(levels, ',') levels, n from g")
def page_profile_arrays(spark, d):
    c = load(spark, d, "plot_chunk", ["pageid", "section", "kind", "spoiler_level", "chunk_id"]).where("pageid is not null")
    text = lambda c_: F.array_join(F.array_sort(F.collect_set(c_)), ",")  # noqa: E731  # three kinds, two levels
    return c.groupBy("pageid").agg(F.max("section").alias("section"), text("kind").alias("kinds"), text(F.col("spoiler_level").cast("string")).alias("levels"), F.count_distinct("chunk_id").alias("n")).where("n >= 2")


@query(f"with p as ({PROFILE}), r as (select *, row_number() over (order by fav_done desc nulls last, subject_id) top from p), rest as (select *, case when air_date is null then 'undated' when coalesce(nsfw, false) then 'nsfw' else 'other' end stratum from r where top > 30), d as (select subject_id, stratum, row_number() over (partition by stratum order by md5('s' || subject_id), subject_id) k from rest) select subject_id, 'top' as stratum from r where top <= 30 union all select subject_id, stratum from d where k <= case stratum when 'other' then 10 else 5 end")
def sample_with_head(spark, d):
    w = works(spark, d, ["air_date", "nsfw"])
    stratum = F.when(F.col("air_date").isNull(), "undated").when(F.coalesce("nsfw", F.lit(False)), "nsfw").otherwise("other")
    return E.sample_with_head(w, "subject_id", [F.col("fav_done").desc_nulls_last(), F.col("subject_id")], stratum, {"undated": 5, "nsfw": 5, "other": 10}, 30, "s")


@query(f"with p as ({PROFILE}) select subject_id, coalesce(name_cn, name) || case when air_year is null then '' else '（' || air_year || '）' end || ' —— 与本作共享 制作：' || studios[1] line from p where len(studios) > 0 and coalesce(name_cn, name) is not null")
def related_lines(spark, d):
    w = works(spark, d, ["name", "name_cn", "air_year", "studios"]).where("size(studios) > 0")
    line = N.related_line(F.coalesce("name_cn", "name"), F.col("air_year"), F.lit("制作"), F.col("studios")[0])
    return w.select("subject_id", line.alias("line")).where("line is not null")


@query("select l_orderkey, l_linenumber, case when p_partkey % 3 = 0 then '（角色名缺失）' else p_brand end || ' —— 《' || l_returnflag || '》' || '（' || year(l_shipdate) || '）' || case l_linenumber when 1 then '　主角' when 2 then '　配角' when 3 then '　客串' else '' end line from lineitem join part on p_partkey = l_partkey")
def role_lines(spark, d):
    li = load(spark, d, "lineitem", ["l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_shipdate"])
    p = load(spark, d, "part", ["p_partkey", "p_brand"])
    j = li.join(p, F.col("p_partkey") == F.col("l_partkey"))
    return j.select("l_orderkey", "l_linenumber", N.role_line(F.when(F.col("p_partkey") % 3 != 0, F.col("p_brand")), F.col("l_returnflag"), F.year("l_shipdate"), F.col("l_linenumber")).alias("line"))


@query(f"select id, {name_key_sql('name')} = {name_key_sql('norm_name')} as same from (select distinct id, name, norm_name from alias)")
def key_agreement(spark, d):
    """Whether the stored normal form of a name is the one that the full key gives."""
    a = load(spark, d, "alias", ["id", "name", "norm_name"]).distinct()
    return a.select("id", (T.name_key("name") == T.name_key("norm_name")).alias("same"))
