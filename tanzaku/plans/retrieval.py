"""Entity linking, recall and context choice; questions are the leads of ``moegirl_page``, names ``alias``, chunks ``plot_chunk``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tanzaku.functions import text as T
from tanzaku.operators import retrieval as R
from tanzaku.operators.conversation import answer_context
from tanzaku.plans.keys import name_key_sql
from tanzaku.plans.registry import query
from tanzaku.plans.selecting import PROFILE, works
from tanzaku.plans.texts import ASKED, asked
from tanzaku.tables import load


def questions(spark: SparkSession, d: str) -> DataFrame:
    q = load(spark, d, "moegirl_page", ["pageid", "lead_text"]).where("lead_text is not null").groupBy(F.col("pageid").alias("qid")).agg(F.min("lead_text").alias("question"))
    return q.select("qid", "question", T.name_key("question").alias("key"))


def names(spark: SparkSession, d: str) -> DataFrame:
    """name (key), entity_type, root"""
    a = load(spark, d, "alias", ["name", "entity_type", "subject_id", "parent_subject_id"])
    w = works(spark, d, ["series_root"]).select("subject_id", F.coalesce("series_root", "subject_id").alias("root"))
    k = a.select(T.name_key("name").alias("name"), "entity_type", F.coalesce("parent_subject_id", "subject_id").alias("subject_id"))
    return k.join(w, "subject_id").select("name", "entity_type", "root").distinct()


NAMES = f"""p as ({PROFILE}), names as (select distinct {name_key_sql('a.name')} as name, a.entity_type, coalesce(p.series_root, p.subject_id) root from alias a join p on p.subject_id = coalesce(a.parent_subject_id, a.subject_id)),
q as (select pageid qid, min(lead_text) question, {name_key_sql('min(lead_text)')} as key from moegirl_page where lead_text is not null group by 1),
subs as (select distinct qid, substr(key, i, n) as name from (select qid, key, unnest(range(1, length(key) + 1)) i from q), range(2, 17) t(n) where i + n - 1 <= length(key))"""


@query("select distinct n_name as name, substr(lower(n_name), i, n) as sub from (select n_name, unnest(range(1, length(n_name) + 1)) i from nation) cross join range(2, 17) t(n) where i + n - 1 <= length(n_name)")
def substring_enumeration(spark, d):
    n = load(spark, d, "nation", ["n_name"])
    return n.select(F.col("n_name").alias("name"), F.explode(T.substrings(F.lower("n_name"))).alias("sub")).distinct()


@query(f"with {NAMES} select distinct qid, name from subs join (select distinct name from names) using (name)")
def entity_link_candidates(spark, d):
    return R.candidate_mentions(questions(spark, d), names(spark, d)).select("qid", "name").distinct()


@query()
def entity_link_longest(spark, d):
    return R.mentions(questions(spark, d), names(spark, d))


@query()
def resolve_states(spark, d):
    q, n = questions(spark, d), names(spark, d)
    chunks = load(spark, d, "documents", ["subject_id"]).select(F.col("subject_id").alias("root"))
    return R.resolve(q, R.mentions(q, n).select("qid", "name").join(n, "name"), chunks)


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    """chunk_id, root, layer, spoiler_level, vec: each chunk once, vectors of the right length only"""
    c = load(spark, d, "plot_chunk", ["chunk_id", "pageid", "character_id", "kind", "spoiler_level", "vec"]).dropDuplicates(["chunk_id"])
    layer = F.when(F.col("kind") == "songs", "songs").when(F.col("character_id").isNotNull(), "char").otherwise("series")
    return c.where("size(vec) = 96 and not exists(vec, x -> isnan(x))").select("chunk_id", (F.coalesce("pageid", "character_id") % 5).alias("root"), layer.alias("layer"), "spoiler_level", "vec")


CHUNKS = "c as (select distinct on (chunk_id) chunk_id, coalesce(pageid, character_id) % 5 root, case when kind = 'songs' then 'songs' when character_id is not null then 'char' else 'series' end layer, spoiler_level, vec from plot_chunk where len(vec) = 96 and len(list_filter(vec, lambda x: isnan(x))) = 0)"
RECALL = f"""{CHUNKS}, q as (select chunk_id qid, root, vec qvec from c where chunk_id % 50 = 0),
s as (select qid, chunk_id, layer, round(list_inner_product(qvec::double[], vec::double[]), 9) score from c join q using (root) where spoiler_level = 0),
r as (select *, row_number() over (partition by qid, layer order by score desc, chunk_id) rn from s), recalled as (select * from r where rn <= case layer when 'char' then 40 when 'series' then 10 else 3 end)"""


def _recalled(spark: SparkSession, d: str) -> DataFrame:
    c = _chunks(spark, d)
    q = c.where("chunk_id % 50 = 0").select(F.col("chunk_id").alias("qid"), "root", F.col("vec").alias("qvec"))
    return R.recall_many(q, c)


@query(f"with {RECALL} select qid, chunk_id, layer, rn, round(score, 6) score from recalled")
def recall_quota(spark, d):
    return _recalled(spark, d).select("qid", "chunk_id", "layer", F.col("rn").cast("long").alias("rn"), F.round("score", 6).alias("score"))


PINNED = "w as (select distinct character_id % 7 qid, character_id from plot_chunk where character_id is not null and character_id % 3 = 0), pc as (select distinct chunk_id, character_id, chunk_no from plot_chunk), pinned as (select qid, chunk_id, row_number() over (partition by qid order by character_id, chunk_no, chunk_id) as position from pc join w using (character_id) qualify position <= 40)"


def _pinned(spark: SparkSession, d: str) -> DataFrame:
    c = load(spark, d, "plot_chunk", ["chunk_id", "character_id", "chunk_no"]).distinct()
    w = c.where("character_id % 3 = 0").select((F.col("character_id") % 7).alias("qid"), "character_id").distinct()
    return R.pinned(w, c)


@query(f"with {PINNED} select * from pinned")
def pinned_topn(spark, d):
    return _pinned(spark, d)


@query(f"with {PINNED}, a as (select qid, chunk_id, 0 src, position from pinned), b as (select chunk_id % 3 qid, chunk_id, 1 src, chunk_id as position from pc), u as (select qid, chunk_id, min((src, position)) as pos from (select * from a union all select * from b) group by 1, 2) select qid, chunk_id, row_number() over (partition by qid order by pos, chunk_id) as position from u")
def merge_keep_first(spark, d):
    b = load(spark, d, "plot_chunk", ["chunk_id"]).distinct()
    b = b.select((F.col("chunk_id") % 3).cast("int").alias("qid"), "chunk_id", F.col("chunk_id").alias("position"))
    return R.keep_first([_pinned(spark, d), b], "qid", "chunk_id", "position")


POOL = "pool as (select label, vec_id chunk_id, round(abs(embedding[1])::double * case when vec_id % 2 = 0 then 1.0::double else 0.2::double end, 9) score, vec_id % 6 = 0 pinned, vec_id % 11 = 5 seat from embeddings)"


def _pool(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "embeddings", ["vec_id", "embedding", "label"])
    score = F.round(F.abs(F.col("embedding")[0].cast("double")) * F.when(F.col("vec_id") % 2 == 0, F.lit(1.0)).otherwise(F.lit(0.2)), 9)
    return e.select("label", F.col("vec_id").alias("chunk_id"), score.alias("score"), (F.col("vec_id") % 6 == 0).alias("pinned"), (F.col("vec_id") % 11 == 5).alias("seat"))


def _choose_sql(group: str, pool: str, final: str = "8", floor: str = "0.05", reserve: str = "4") -> str:
    k = "coalesce(score, 0) desc, chunk_id"
    return f"""a as (select *, pinned and row_number() over (partition by {group}, pinned order by {k}) <= {reserve} pin from {pool}),
b as (select *, seat and not pin s from a), c as (select *, pin or (s and row_number() over (partition by {group}, s order by {k}) <= 1) held from b),
e as (select *, row_number() over (partition by {group}, held order by {k}) rn, greatest(0, {final} - count(*) filter (held) over (partition by {group})) room, count(*) filter (not held and score >= {floor}) over (partition by {group}) above from c),
f as (select * from e where held or rn <= case when least(above, room) < 2 then least(2, room) else least(above, room) end),
chosen as (select *, row_number() over (partition by {group} order by {k}) as position from f qualify position <= {final})"""


@query(f"with {POOL}, {_choose_sql('label', 'pool')} select label, chunk_id, round(score, 6) score, position from chosen")
def context_select(spark, d):
    return R.choose(_pool(spark, d), ["label"]).select("label", "chunk_id", F.round("score", 6).alias("score"), "position")


SWEEP = ((0.0, 4, 8), (0.05, 0, 8), (0.1, 4, 6), (0.3, 2, 5))


@query(f"with {POOL}, params as (select * from (values {', '.join(f'({f}::double, {r}, {n})' for f, r, n in SWEEP)}) t(floor, reserve, final)), grid as (select * from pool cross join params), {_choose_sql('label, floor, reserve, final', 'grid', 'final', 'floor', 'reserve')} select floor, reserve, final, count(*) n, count(*) filter (pinned) n_pinned, round(avg(score), 6) mean_score from chosen group by 1, 2, 3")
def context_select_sweep(spark, d):
    params = spark.createDataFrame(list(SWEEP), "floor double, reserve int, final int")
    grid = _pool(spark, d).crossJoin(F.broadcast(params))  # a fixed handful of settings
    got = R.choose(grid, ["label", "floor", "reserve", "final"], F.col("final"), F.col("floor"), reserve=F.col("reserve"))
    return got.groupBy("floor", "reserve", "final").agg(F.count("*").alias("n"), F.count_if("pinned").alias("n_pinned"), F.round(F.avg("score"), 6).alias("mean_score"))


@query(f"""with {POOL}, {_choose_sql('label', 'pool')}, wide as (select chunk_id from chosen), x as (select chunk_id from pool where pinned), y as (select chunk_id from pool where score >= 0.05)
select 'pinned and above' as sets, (select count(*) from (select chunk_id from x intersect select chunk_id from y)) both_sets, (select count(*) from (select chunk_id from x except select chunk_id from y)) first_only, (select count(*) from (select chunk_id from x except select chunk_id from y)) = 0 is_subset
union all select 'chosen and above', (select count(*) from (select chunk_id from wide intersect select chunk_id from y)), (select count(*) from (select chunk_id from wide except select chunk_id from y)), (select count(*) from (select chunk_id from wide except select chunk_id from y)) = 0
union all select 'chosen and pool', (select count(*) from (select chunk_id from wide intersect select chunk_id from pool)), (select count(*) from (select chunk_id from wide except select chunk_id from pool)), (select count(*) from (select chunk_id from wide except select chunk_id from pool)) = 0""")
def selection_set_checks(spark, d):
    p = _pool(spark, d)
    chosen, above = R.choose(p, ["label"]).select("chunk_id"), p.where("score >= 0.05").select("chunk_id")
    pairs = {"pinned and above": (p.where("pinned").select("chunk_id"), above), "chosen and above": (chosen, above), "chosen and pool": (chosen, p.select("chunk_id"))}
    return reduce(DataFrame.unionByName, [R.compared(a, b, "chunk_id").select(F.lit(name).alias("sets"), "both_sets", "first_only", "is_subset") for name, (a, b) in pairs.items()])


@query(f"with {ASKED} select item_id as qid, regexp_matches(question, '片头|片尾|主题曲|插曲|(^|[^A-Za-z])(OP|ED|op|ed|Op|Ed|oP|eD)([^A-Za-z]|$)') songs, contains(question, '导演') or contains(question, '监督') director, contains(question, '最后') ending from asked")
def keyword_triggers(spark, d):
    any_of = lambda words: reduce(lambda a, b: a | b, [F.col("question").contains(w) for w in words])
    return asked(spark, d).select(F.col("item_id").alias("qid"), F.col("question").rlike(R.SONGS_QUERY).alias("songs"), any_of(("导演", "监督")).alias("director"), any_of(("最后",)).alias("ending"))


def linked_pages(spark: SparkSession, d: str) -> DataFrame:
    """pageid, root: pages whose title, without what stands in brackets behind it, is a name of a work."""
    t = load(spark, d, "moegirl_page", ["pageid", "title"]).where("title is not null").groupBy("pageid").agg(F.min("title").alias("title"))
    t = t.select("pageid", T.name_key(F.regexp_replace("title", "[（(][^（()）]*[)）]$", "")).alias("name"))
    return t.join(names(spark, d).where("entity_type = 'subject'"), "name").groupBy("pageid").agg(F.min("root").alias("root"))


@query()
def ask_context(spark, d):
    """From the first lines of pages, as questions with the vector of a chunk of theirs, to the chunks an answer would rest on."""
    c = load(spark, d, "plot_chunk", ["chunk_id", "pageid", "character_id", "kind", "chunk_no", "spoiler_level", "vec"]).dropDuplicates(["chunk_id"])
    layer = F.when(F.col("kind") == "songs", "songs").when(F.col("character_id").isNotNull(), "char").otherwise("series")
    usable = c.where("size(vec) = 96 and not exists(vec, x -> isnan(x))")
    chunks = usable.join(linked_pages(spark, d), "pageid").select("chunk_id", "root", layer.alias("layer"), "spoiler_level", "vec", "character_id", "chunk_no")
    qvec = usable.where("pageid is not null").groupBy(F.col("pageid").alias("qid")).agg(F.min_by("vec", "chunk_id").alias("qvec"))
    a = load(spark, d, "alias", ["name", "character_id", "entity_type", "subject_id", "parent_subject_id"])
    w = works(spark, d, ["series_root"]).select("subject_id", F.coalesce("series_root", "subject_id").alias("root"))
    named = a.select(T.name_key("name").alias("name"), "entity_type", "character_id", F.coalesce("parent_subject_id", "subject_id").alias("subject_id")).join(w, "subject_id").select("name", "entity_type", "root", "character_id").distinct()
    got = answer_context(questions(spark, d).join(qvec, "qid", "left"), named, chunks)
    return got.select("qid", "state", "root", "position", "chunk_id", F.round("score", 6).alias("score"), "pinned")
