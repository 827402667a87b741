"""Loads, merges and profiles over the catalogue tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tanzaku.functions import text as T
from tanzaku.operators import merging as M
from tanzaku.plans.keys import name_key_sql
from tanzaku.plans.registry import query
from tanzaku.plans.selecting import PROFILE, works
from tanzaku.tables import load


@query(f"with a as (select entity_type, coalesce(subject_id, -1) s, coalesce(character_id, -1) c, {name_key_sql('name')} k, case source when 'name' then 1 when 'name_cn' then 2 when 'infobox_alias' then 3 else 4 end pr, id from alias where name is not null) select distinct on (entity_type, s, c, k) entity_type, s, c, k, id from a order by entity_type, s, c, k, pr, id")
def alias_dedupe(spark, d):
    a = load(spark, d, "alias", ["id", "name", "entity_type", "subject_id", "character_id", "source"]).where("name is not null")
    pr = F.when(F.col("source") == "name", 1).when(F.col("source") == "name_cn", 2).when(F.col("source") == "infobox_alias", 3).otherwise(4)
    k = a.select("entity_type", F.coalesce("subject_id", F.lit(-1)).alias("s"), F.coalesce("character_id", F.lit(-1)).alias("c"), T.name_key("name").alias("k"), pr.alias("pr"), "id")
    return k.groupBy("entity_type", "s", "c", "k").agg(F.min_by("id", F.struct("pr", "id")).alias("id"))


UP = "old as (select o_orderkey, o_custkey, o_orderstatus, o_orderpriority from orders where o_orderkey % 3 <> 0), new as (select o_orderkey, o_custkey + 1 o_custkey, 'X' o_orderstatus, case when o_orderkey % 2 = 0 then o_orderpriority end o_orderpriority from orders where o_orderkey % 5 = 0)"


def _old_new(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    o = load(spark, d, "orders", ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"])
    new = o.where("o_orderkey % 5 = 0").select("o_orderkey", (F.col("o_custkey") + 1).alias("o_custkey"), F.lit("X").alias("o_orderstatus"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).alias("o_orderpriority"))
    return o.where("o_orderkey % 3 != 0"), new


@query(f"with {UP} select coalesce(n.o_orderkey, o.o_orderkey) o_orderkey, case when o.o_orderkey is null then n.o_custkey else o.o_custkey end o_custkey, coalesce(n.o_orderstatus, o.o_orderstatus) o_orderstatus, case when n.o_orderkey is not null then coalesce(n.o_orderpriority, o.o_orderpriority) else o.o_orderpriority end o_orderpriority from old o full join new n on o.o_orderkey = n.o_orderkey")
def upsert_merge(spark, d):
    old, new = _old_new(spark, d)
    return M.upsert(old, new, ["o_orderkey"], ["o_orderstatus", "o_orderpriority"], preserve=True)


@query(f"with {UP}, kept as (select * from old where o_custkey not in (select o_custkey from new)) select * from kept union all select * from new where o_orderkey not in (select o_orderkey from kept)")
def replace_scope(spark, d):
    old, new = _old_new(spark, d)
    return M.replace_scope(old, new, ["o_custkey"], ["o_orderkey"])


@query("with o as (select doc_id, case when doc_id % 4 = 0 then text || '!' else text end as text from documents where doc_id % 7 <> 0), n as (select doc_id, text from documents) select n.doc_id from n left join o on o.doc_id = n.doc_id and md5(o.text) = md5(n.text) where o.doc_id is null")
def digest_diff(spark, d):
    n = load(spark, d, "documents", ["doc_id", "text"])
    o = n.where("doc_id % 7 != 0").withColumn("text", F.when(F.col("doc_id") % 4 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return M.changed(o, n, "doc_id", "text").select("doc_id")


@query("select distinct on (pageid) pageid, title, lastrevid from moegirl_page order by pageid, lastrevid desc, title")
def latest_manifest(spark, d):
    p = load(spark, d, "moegirl_page", ["pageid", "title", "lastrevid"])
    return M.latest(p, ["pageid"], [F.col("lastrevid").desc(), F.col("title")])


@query(f"with p as ({PROFILE}) select distinct p.series_root, doc_id from documents join p using (subject_id)")
def scope_bridge_build(spark, d):
    docs = load(spark, d, "documents", ["doc_id", "subject_id"]).where("subject_id is not null")
    return M.bridge(docs, works(spark, d, ["series_root"]).select("subject_id", "series_root"), "subject_id", ["series_root", "doc_id"])


@query(f"with p as ({PROFILE}), r as (select series_root, sum(fav_done)::bigint heat, string_agg(distinct name, '|' order by name) names from p group by 1) select * from r where series_root not in (select subject_id from documents where subject_id is not null)")
def gap_roots_antijoin(spark, d):
    r = works(spark, d, ["series_root", "name"]).groupBy("series_root").agg(F.sum("fav_done").alias("heat"), F.array_join(F.array_sort(F.collect_set("name")), "|").alias("names"))  # names of one series
    have = load(spark, d, "documents", ["subject_id"]).where("subject_id is not null").select(F.col("subject_id").alias("series_root")).distinct()
    return r.join(have, "series_root", "left_anti")


@query(f"with p as ({PROFILE}), x as (select subject_id, favorite['wish'] wish, favorite['done'] done, subject_id % 2 flip from p) select subject_id, coalesce(case when flip = 0 then 1 end, wish)::bigint wish, done::bigint done, case when flip = 0 then 7 end::bigint extra from x")
def jsonb_merge(spark, d):
    w = works(spark, d, ["favorite"])
    add = F.when(F.col("subject_id") % 2 == 0, F.create_map(F.lit("wish"), F.lit(1), F.lit("extra"), F.lit(7)))
    m = w.select("subject_id", M.merged_maps(F.col("favorite"), add).alias("m"))
    return m.select("subject_id", *[F.try_element_at("m", F.lit(k)).cast("long").alias(k) for k in ("wish", "done", "extra")])


@query("select count(*) n, count(text) with_text, count(subject_id) with_subject, count(*) filter (lang = 'zh') zh, count(distinct source) sources, round(avg(length(text)), 6) mean_len, median(length(text))::double median_len from documents")
def coverage_profile(spark, d):
    x = load(spark, d, "documents", ["text", "subject_id", "lang", "source"])
    n = F.length("text")
    return x.agg(F.count("*").alias("n"), F.count("text").alias("with_text"), F.count("subject_id").alias("with_subject"), F.count_if(F.col("lang") == "zh").alias("zh"), F.count_distinct("source").alias("sources"), F.round(F.avg(n), 6).alias("mean_len"), F.median(n).alias("median_len"))


@query("with v as (select distinct sha256(name) d from alias where name is not null), s as (select count(*) n, " + ", ".join(f"coalesce(sum(('0x' || substr(d, {15 * i + 1}, 15))::bigint), 0)::varchar s{i}" for i in range(4)) + " from v) select n, sha256(concat_ws('|', n::varchar, s0, s1, s2, s3)) digest from s")
def provenance_fingerprint(spark, d):
    return M.fingerprint(load(spark, d, "alias", ["name"]), "name")


@query(f"with p as ({PROFILE}), t as (select *, favorite['done'] f from p), c as (select count(*) total, count(*) filter (air_year is not null) dated, count(*) filter (air_year is not null and list_has_any(meta_tags, ['TV', 'WEB', '剧场版', 'OVA'])) shaped, count(*) filter (air_year is not null and list_has_any(meta_tags, ['TV', 'WEB', '剧场版', 'OVA']) and f >= 50) candidates from t) select * from c")
def candidate_predicate(spark, d):
    w = works(spark, d, ["air_year", "meta_tags", "favorite"])
    dated = F.col("air_year").isNotNull()
    shaped = dated & F.arrays_overlap("meta_tags", F.array(*map(F.lit, ("TV", "WEB", "剧场版", "OVA"))))
    done = F.try_element_at("favorite", F.lit("done")) >= 50
    return w.agg(F.count("*").alias("total"), F.count_if(dated).alias("dated"), F.count_if(shaped).alias("shaped"), F.count_if(shaped & done).alias("candidates"))


def _props(e: DataFrame) -> DataFrame:
    p = F.from_json("props", "k bigint, none string")
    return e.select("event_id", p["k"].alias("k"), p["none"].isNull().alias("no_none"))


@query("select event_id, cast(json_extract_string(props, '$.k') as bigint) k, json_extract_string(props, '$.none') is null no_none from events")
def json_nested_scan(spark, d):
    return _props(load(spark, d, "events", ["event_id", "props"]))


@query("select l_partkey, count(*) n, count(distinct o_orderpriority) kinds from lineitem left join (select * from orders where o_orderstatus = 'F') o on o_orderkey = l_orderkey where l_suppkey in (select s_suppkey from supplier where s_nationkey < 5) group by 1")
def semi_and_default_join(spark, d):
    li = load(spark, d, "lineitem", ["l_partkey", "l_suppkey", "l_orderkey"])
    s = load(spark, d, "supplier", ["s_suppkey", "s_nationkey"]).where("s_nationkey < 5")
    o = load(spark, d, "orders", ["o_orderkey", "o_orderstatus", "o_orderpriority"]).where("o_orderstatus = 'F'")
    j = li.join(s, F.col("l_suppkey") == F.col("s_suppkey"), "left_semi").join(o, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return j.groupBy("l_partkey").agg(F.count("*").alias("n"), F.count_distinct("o_orderpriority").alias("kinds"))


CREDITS = "select distinct l_partkey item, l_suppkey % 5 pos, s_name as name from lineitem join supplier on s_suppkey = l_suppkey"


def _credits(spark: SparkSession, d: str) -> DataFrame:
    li = load(spark, d, "lineitem", ["l_partkey", "l_suppkey"])
    s = load(spark, d, "supplier", ["s_suppkey", "s_name"])
    c = li.join(s, F.col("s_suppkey") == F.col("l_suppkey")).select(F.col("l_partkey").alias("item"), (F.col("l_suppkey") % 5).alias("pos"), "s_name")
    lists = c.groupBy("item", "pos").agg(F.array_join(F.slice(F.array_sort(F.collect_set("s_name")), 1, 3), "/").alias("names"))  # suppliers of one part
    at = lambda p: F.max(F.when(F.col("pos") == p, F.col("names")))
    return lists.groupBy("item").agg(F.coalesce(at(4), at(3), at(2)).alias("studio"), at(1).alias("director"))


@query(f"with c as ({CREDITS}), r as (select *, row_number() over (partition by item, pos order by name) r from c), l as (select item, pos, string_agg(name, '/' order by r) filter (r <= 3) as names from r group by 1, 2) select item, coalesce(max(names) filter (pos = 4), max(names) filter (pos = 3), max(names) filter (pos = 2)) studio, max(names) filter (pos = 1) director from l group by 1")
def credits_aggregate(spark, d):
    return _credits(spark, d)


@query("with t as (select src_sha, model, dst, row_number() over (partition by src_sha order by prompt_version desc, model, dst) r from translation where dst is not null), d as (select doc_id, sha256(text) h, text from documents) select doc_id, md5(coalesce(t.dst, d.text)) shown from d left join t on t.src_sha = d.h and t.r = 1")
def lookup_or_self(spark, d):
    t = load(spark, d, "translation", ["src_sha", "model", "prompt_version", "dst"]).where("dst is not null")
    best = M.latest(t, ["src_sha"], [F.col("prompt_version").desc(), F.col("model"), F.col("dst")]).select(F.col("src_sha").alias("h"), "dst")
    x = load(spark, d, "documents", ["doc_id", "text"]).withColumn("h", F.sha2("text", 256))
    return x.join(best, "h", "left").select("doc_id", F.md5(F.coalesce("dst", "text")).alias("shown"))


@query("select count(distinct trim(src, ' ')) n, count(distinct src_sha) keys from translation where len(regexp_extract_all(src, '[ぁ-んァ-ヶ]')) / greatest(length(src), 1) > 0.2")
def worklist_distinct(spark, d):
    t = load(spark, d, "translation", ["src", "src_sha"]).where(T.is_japanese(F.col("src")))
    return t.agg(F.count_distinct(F.trim("src")).alias("n"), F.count_distinct("src_sha").alias("keys"))


BATCHES = "x as (select doc_id // 1000 lane, doc_id, coalesce(length(text), 0) n, row_number() over (partition by doc_id // 1000 order by doc_id) i from documents), r as (select lane, doc_id, i, n used, 1 items, 0 batch from x where i = 1 union all select x.lane, x.doc_id, x.i, case when used + n > 600 or items >= 20 then n else used + n end, case when used + n > 600 or items >= 20 then 1 else items + 1 end, batch + case when used + n > 600 or items >= 20 then 1 else 0 end from r join x on x.lane = r.lane and x.i = r.i + 1)"


@query(f"with recursive {BATCHES} select lane, doc_id, batch from r")
def batch_packing(spark, d):
    """Lanes are blocks of a thousand consecutive numbers."""
    x = load(spark, d, "documents", ["doc_id", "text"]).select(F.floor(F.col("doc_id") / 1000).alias("lane"), "doc_id", F.length("text").alias("n"))
    return M.pack_batches(x, "lane", "doc_id", "n")


@query("select vec_id, case when vec_id % 5 <> 0 then round(embedding[1]::double, 6) end as first_value from embeddings")
def empty_text_repair(spark, d):
    e = load(spark, d, "embeddings", ["vec_id", "embedding"]).withColumn("text", F.when(F.col("vec_id") % 5 != 0, "x").otherwise(""))
    fixed = e.withColumn("embedding", F.when(F.length("text") > 0, F.col("embedding")))
    return fixed.select("vec_id", F.round(fixed["embedding"][0].cast("double"), 6).alias("first_value"))


@query("select o_custkey, max(year(o_orderdate)) last_year, count(*) n from (select distinct o_custkey, o_orderdate from orders) group by 1")
def latest_and_distinct(spark, d):
    o = load(spark, d, "orders", ["o_custkey", "o_orderdate"]).distinct()
    return o.groupBy("o_custkey").agg(F.max(F.year("o_orderdate")).cast("long").alias("last_year"), F.count("*").alias("n"))


@query(f"with p as ({PROFILE}), heat as (select series_root, sum(fav_done) h, max(air_year) y from p group by 1), t as (select series_root from (select * from heat order by h desc nulls last, series_root limit 20) union select series_root from heat where y >= 2020) select series_root from t where series_root not in (select subject_id from documents where source = 'moegirl' and subject_id is not null)")
def page_targets(spark, d):
    heat = works(spark, d, ["series_root", "air_year"]).groupBy("series_root").agg(F.sum("fav_done").alias("h"), F.max("air_year").alias("y"))
    t = heat.orderBy(F.col("h").desc_nulls_last(), "series_root").limit(20).select("series_root").unionByName(heat.where("y >= 2020").select("series_root")).distinct()
    have = load(spark, d, "documents", ["subject_id", "source"]).where("source = 'moegirl' and subject_id is not null").select(F.col("subject_id").alias("series_root"))
    return t.join(have, "series_root", "left_anti")


@query(f"with p as ({PROFILE}) select source, count(*) n, count(*) filter (subject_id is null) unknown, count(*) filter (subject_id is not null and subject_id not in (select subject_id from p)) rejected from documents group by 1")
def corpus_reject_unknown(spark, d):
    x = load(spark, d, "documents", ["subject_id", "source"])
    known = works(spark, d, []).select("subject_id").withColumn("known", F.lit(True))
    j = x.join(known, "subject_id", "left")
    return j.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("subject_id").isNull()).alias("unknown"), F.count_if(F.col("subject_id").isNotNull() & F.col("known").isNull()).alias("rejected"))


@query("with t as (select distinct on (pageid) pageid, title from moegirl_page order by pageid, title), b as (select pageid, regexp_replace(title, '（[^（）]*）$', '') n from t where not regexp_matches(title, '^(Template|Category|File|User):')), a as (select distinct name n, subject_id from alias where subject_id is not null) select distinct pageid, subject_id from b join a using (n)")
def link_scope_intersection(spark, d):
    t = load(spark, d, "moegirl_page", ["pageid", "title"]).groupBy("pageid").agg(F.min("title").alias("title"))
    b = t.where(~F.col("title").rlike("^(Template|Category|File|User):")).select("pageid", F.regexp_replace("title", "（[^（）]*）$", "").alias("n"))
    a = load(spark, d, "alias", ["name", "subject_id"]).where("subject_id is not null").select(F.col("name").alias("n"), "subject_id")
    return M.bridge(b, a, "n", ["pageid", "subject_id"])


@query("select (select count(*) from documents) documents, (select count(*) from embeddings) embeddings, (select count(distinct chunk_id) from plot_chunk) chunks, (select strftime(max(updated_at) at time zone 'UTC', '%Y-%m-%d %H:%M:%S') from anime_profile) as newest")
def health_report(spark, d):
    n = lambda t, c, e, a: load(spark, d, t, [c]).agg(e.alias(a))
    a = n("documents", "doc_id", F.count("*"), "documents").crossJoin(n("embeddings", "vec_id", F.count("*"), "embeddings"))
    b = n("plot_chunk", "chunk_id", F.count_distinct("chunk_id"), "chunks").crossJoin(n("anime_profile", "updated_at", F.date_format(F.max("updated_at"), "yyyy-MM-dd HH:mm:ss"), "newest"))
    return a.crossJoin(b)  # one row each
