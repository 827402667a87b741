"""Preference ranking over ``embeddings`` as items, ``events`` as answers and ``lineitem`` as votes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tanzaku.functions import vectors as V
from tanzaku.operators import recommend as R
from tanzaku.plans.registry import query
from tanzaku.tables import load

USER = 7
TODAY = "1997-05-20"


def answers(spark: SparkSession, d: str) -> DataFrame:
    """purchase = seen with a score of 1 to 10, click = wish, error = pass; other events are no answer."""
    e = load(spark, d, "events", ["event_id", "ts", "user_id", "event_type", "value", "props"])
    choice = F.when(F.col("event_type") == "purchase", "seen").when(F.col("event_type") == "click", "wish").when(F.col("event_type") == "error", "pass").otherwise("skip")
    item = F.get_json_object("props", "$.k").cast("long")
    return e.select("user_id", item.alias("item_id"), choice.alias("choice"), (1 + 9 * F.least(F.col("value"), F.lit(500.0)) / 500).alias("score"), F.struct("ts", "event_id").alias("seq"))


def ratings(spark: SparkSession, d: str, user: int | None = None) -> DataFrame:
    a = answers(spark, d)
    return R.ratings_from_answers(a.where(F.col("user_id") == user) if user is not None else a)


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "embeddings", ["vec_id", "embedding"]).toDF("item_id", "vec")


def items(spark: SparkSession, d: str) -> DataFrame:
    """item_id, root, vec, score, votes, nsfw, air_year, air_date"""
    e = load(spark, d, "embeddings", ["vec_id", "embedding"]).select(F.col("vec_id").alias("item_id"), (F.col("vec_id") % 97).alias("root"), F.col("embedding").alias("vec"))
    keys = e.select(F.col("item_id").alias("l_partkey"))  # the facts of other parts are dropped before they are added up
    votes = load(spark, d, "lineitem", ["l_partkey", "l_quantity"]).join(keys, "l_partkey", "left_semi").groupBy(F.col("l_partkey").alias("item_id")).agg(F.count("*").alias("votes"), F.round(F.avg("l_quantity") / 5, 6).alias("score"))
    dates = load(spark, d, "orders", ["o_orderkey", "o_orderdate"]).select(F.col("o_orderkey").alias("item_id"), F.col("o_orderdate").cast("date").alias("air_date"))
    flags = load(spark, d, "part", ["p_partkey", "p_size"]).select(F.col("p_partkey").alias("item_id"), (F.col("p_size") % 10 == 0).alias("nsfw"))
    return e.join(votes, "item_id", "left").join(dates, "item_id", "left").join(flags, "item_id", "left").withColumn("air_year", F.year("air_date"))


RATED = """
answers as (
  select user_id, cast(json_extract_string(props, '$.k') as bigint) item_id,
    case event_type when 'purchase' then 'seen' when 'click' then 'wish' else 'pass' end choice, 1 + 9 * least(value, 500.0) / 500 raw,
    row_number() over (partition by user_id, cast(json_extract_string(props, '$.k') as bigint) order by ts desc, event_id desc) rn
  from events where event_type in ('purchase', 'click', 'error')),
ratings as (
  select user_id, item_id, case choice when 'seen' then raw when 'wish' then 8.0::double else 3.0::double end score,
    case choice when 'seen' then 1.0::double when 'wish' then 0.5::double else 0.3::double end confidence, choice <> 'wish' excl
  from answers where rn = 1 and item_id is not null),
means as (select user_id, (sum(confidence * score) + 2.0 * 7.07::double) / (sum(confidence) + 2.0) mu from ratings group by 1),
weights as (select r.*, confidence * (score - mu) w from ratings r join means using (user_id))"""
ITEMS = """
votes as (select l_partkey item_id, count(*) votes, round(avg(l_quantity) / 5, 6) score from lineitem group by 1),
items as (
  select e.vec_id item_id, e.vec_id % 97 root, e.embedding vec, v.votes, v.score, o.o_orderdate::date air_date, year(o.o_orderdate) air_year, p.p_size % 10 = 0 nsfw
  from embeddings e left join votes v on v.item_id = e.vec_id left join orders o on o.o_orderkey = e.vec_id left join part p on p.p_partkey = e.vec_id)"""
PREF = f"""
dims as (
  select user_id, pos, sum(w * x) v from (
    select user_id, w, unnest(vec)::double x, generate_subscripts(vec, 1) pos from weights join items using (item_id)) group by 1, 2),
pref as (select list(v order by pos) pv from dims where user_id = {USER}),
scored as (
  select i.item_id, i.root, i.air_year, i.air_date, i.nsfw, i.score, i.votes, round(list_cosine_similarity(pv, vec::double[]), 9) match,
    case when score > 0 then votes / (votes + 300.0::double) * score + (1 - votes / (votes + 300.0::double)) * 7.07::double else 7.07::double end quality
  from items i cross join pref)"""


def ranked_sql(where: str = "not coalesce(nsfw, false) and (score is null or score <= 0 or score >= 3.5)", fold: bool = True, rank: str = "blend", alpha: float = 0.5, k: int = 10) -> str:
    want = k if rank == "match" else max(10 * k, 100)
    pool = "best as (select distinct on (root) root, match, item_id best_id from cand order by root, match desc, item_id), entry as (select distinct on (root) root, item_id, quality from cand order by root, air_year nulls last, votes desc, item_id), pool0 as (select root, entry.item_id, best.match, entry.quality, best_id from best join entry using (root))" if fold else "pool0 as (select root, item_id, match, quality, item_id best_id from cand)"
    unit = lambda c: f"case when max({c}) over () - min({c}) over () < 1e-9 then 0.5::double else ({c} - min({c}) over ()) / (max({c}) over () - min({c}) over ()) end"
    score = {"match": "match", "quality": "quality", "blend": f"{alpha}::double * ({unit('match')}) + {1 - alpha}::double * ({unit('quality')})"}[rank]
    return f"""with {RATED}, {ITEMS}, {PREF},
cand as (select * from scored where item_id not in (select item_id from ratings where user_id = {USER} and excl) and match is not null and {where}),
{pool}, pool as (select * from pool0 order by match desc, best_id limit {want}),
ranked as (select *, round({score}, 9) rank_score from pool), top as (select * from ranked order by rank_score desc, match desc, best_id limit {k})
select item_id, root, round(match, 6) match, round(quality, 6) quality, round(rank_score, 6) rank_score, row_number() over (order by rank_score desc, match desc, best_id) as position from top"""


def shown(df: DataFrame) -> DataFrame:
    return df.select("item_id", "root", *[F.round(c, 6).alias(c) for c in ("match", "quality", "rank_score")], "position")


def run(spark: SparkSession, d: str, **o) -> DataFrame:
    return shown(R.recommend(items(spark, d), ratings(spark, d, USER), R.Options(**o), vectors(spark, d)))


@query(f"with {RATED} select user_id, item_id, round(score, 6) score, confidence, excl as exclude from ratings")
def rating_from_answers(spark, d):
    return ratings(spark, d).select("user_id", "item_id", F.round("score", 6).alias("score"), "confidence", "exclude")


@query(f"with {RATED} select user_id, round(mu, 6) mu from means")
def shrunk_mean_by_user(spark, d):
    return R.shrunk_means(ratings(spark, d)).select("user_id", F.round("mu", 6).alias("mu"))


@query(f"with {RATED} select user_id, item_id, round(w, 6) w from weights")
def rating_weights(spark, d):
    return R.weighted(ratings(spark, d)).select("user_id", "item_id", F.round("w", 6).alias("w"))


@query(f"with {RATED}, {ITEMS}, dims as (select user_id, pos, sum(w * x) v from (select user_id, w, unnest(vec)::double x, generate_subscripts(vec, 1) pos from weights join items using (item_id)) group by 1, 2) select user_id, pos - 1 as pos, round(v, 6) value from dims")
def preference_vector_dims(spark, d):
    return R.preference_dims(ratings(spark, d), vectors(spark, d)).select("user_id", F.col("pos").cast("long").alias("pos"), F.round("value", 6).alias("value"))


@query("with q as (select embedding::double[] v from embeddings where vec_id = 3), s as (select vec_id, round(list_cosine_similarity(v, embedding::double[]), 9) cos from embeddings cross join q where vec_id <> 3) select vec_id, round(cos, 6) cos from s order by s.cos desc, vec_id limit 10")
def cosine_topk(spark, d):
    e = load(spark, d, "embeddings", ["vec_id", "embedding"])
    q = e.where("vec_id = 3").select(F.col("embedding").alias("q"))
    s = e.where("vec_id != 3").crossJoin(F.broadcast(q)).select("vec_id", F.round(V.cosine(F.col("q"), F.col("embedding")), 9).alias("cos"))
    return s.orderBy(F.col("cos").desc(), "vec_id").limit(10).select("vec_id", F.round("cos", 6).alias("cos"))


@query("with q as (select embedding::double[] v from embeddings where vec_id = 5), s as (select vec_id, round(list_inner_product(v, embedding::double[]), 9) ip from embeddings cross join q) select vec_id, round(ip, 6) ip from s order by s.ip desc, vec_id limit 10")
def inner_product_topk(spark, d):
    e = load(spark, d, "embeddings", ["vec_id", "embedding"])
    q = e.where("vec_id = 5").select(F.col("embedding").alias("q"))
    s = e.crossJoin(F.broadcast(q)).select("vec_id", F.round(V.dot(F.col("q"), F.col("embedding")), 9).alias("ip"))
    return s.orderBy(F.col("ip").desc(), "vec_id").limit(10).select("vec_id", F.round("ip", 6).alias("ip"))


@query("select vec_id, round(sqrt(list_inner_product(embedding::double[], embedding::double[])), 6) n, sqrt(list_inner_product(embedding::double[], embedding::double[])) between 0.999 and 1.001 as is_unit from embeddings")
def vector_norm_audit(spark, d):
    n = V.norm(F.col("embedding"))
    return load(spark, d, "embeddings", ["vec_id", "embedding"]).select("vec_id", F.round(n, 6).alias("n"), n.between(0.999, 1.001).alias("is_unit"))


@query("with q as (select embedding[1:16]::double[] v from embeddings where vec_id = 3), s as (select vec_id, round(list_cosine_similarity(v, embedding[1:16]::double[]), 9) cos from embeddings cross join q where vec_id <> 3) select vec_id, round(cos, 6) cos from s order by s.cos desc, vec_id limit 10")
def truncate_renorm_cosine(spark, d):
    e = load(spark, d, "embeddings", ["vec_id", "embedding"]).select("vec_id", V.truncated(F.col("embedding"), 16).alias("v"))
    q = e.where("vec_id = 3").select(F.col("v").alias("q"))
    s = e.where("vec_id != 3").crossJoin(F.broadcast(q)).select("vec_id", F.round(V.dot(F.col("q"), F.col("v")), 9).alias("cos"))
    return s.orderBy(F.col("cos").desc(), "vec_id").limit(10).select("vec_id", F.round("cos", 6).alias("cos"))


def _spaces(e: str, q: str) -> str:
    return ", ".join(f"list_cosine_similarity({q}[{a}:{b}], {e}[{a}:{b}]::double[]) as c{i}" for i, (a, b) in enumerate(((1, 16), (17, 48), (49, 64))))


def _fused_sql(weights: tuple[float, ...]) -> str:
    total = sum(weights)
    mix = " + ".join(f"{w / total}::double * coalesce(c{i}, 0)" for i, w in enumerate(weights) if w > 0)
    return f"with q as (select embedding::double[] v from embeddings where vec_id = 3), c as (select vec_id, {_spaces('embedding', 'v')} from embeddings cross join q where vec_id <> 3), s as (select vec_id, round({mix}, 9) fused from c) select vec_id, round(fused, 6) fused from s order by s.fused desc, vec_id limit 20"


def _fused(spark: SparkSession, d: str, weights: tuple[float, ...]) -> DataFrame:
    e = load(spark, d, "embeddings", ["vec_id", "embedding"])
    q = e.where("vec_id = 3").select(F.col("embedding").alias("q"))
    parts = [(V.cosine(F.slice("q", a, n), F.slice("embedding", a, n)), w) for (a, n), w in zip(((1, 16), (17, 32), (49, 16)), weights)]
    s = e.where("vec_id != 3").crossJoin(F.broadcast(q)).select("vec_id", F.round(V.fused(parts), 9).alias("fused"))
    return s.orderBy(F.col("fused").desc(), "vec_id").limit(20).select("vec_id", F.round("fused", 6).alias("fused"))


@query(_fused_sql((0.3, 0.6, 0.1)))
def fused_match(spark, d):
    return _fused(spark, d, (0.3, 0.6, 0.1))


@query(_fused_sql((0.3, 0.6, 0.0)))
def fused_match_inactive_space(spark, d):
    return _fused(spark, d, (0.3, 0.6, 0.0))


@query(ranked_sql())
def recommend_fold(spark, d):
    return run(spark, d)


@query(ranked_sql(fold=False))
def recommend_flat(spark, d):
    return run(spark, d, fold=False)


@query(ranked_sql(rank="match"))
def recommend_rank_match(spark, d):
    return run(spark, d, rank_by="match")


@query(ranked_sql(rank="quality"))
def recommend_rank_quality(spark, d):
    return run(spark, d, rank_by="quality")


@query(ranked_sql(alpha=0.8, k=25))
def recommend_rank_blend(spark, d):
    return run(spark, d, alpha=0.8, top_k=25)


SPACES = (("vec_tag", 1, 16), ("vec_emb", 17, 32), ("vec_staff", 49, 16))  # column, first number, how many


def _in_spaces(df: DataFrame) -> DataFrame:
    """The three spaces of an item; every seventh item has no staff, every eleventh no tags."""
    lacks = {"vec_staff": F.col("item_id") % 7 == 0, "vec_tag": F.col("item_id") % 11 == 0}
    return df.select("*", *[F.when(~lacks.get(c, F.lit(False)), F.slice("vec", a, n)).alias(c) for c, a, n in SPACES])


def _spaces_sql(weights: dict[str, float]) -> str:
    """``ranked_sql`` with the match of the spaces in ``weights`` fused."""
    lacks = {"vec_staff": "item_id % 7 = 0", "vec_tag": "item_id % 11 = 0"}
    total = sum(weights.values())
    used = [(c, a, n) for c, a, n in SPACES if weights.get(c, 0) > 0]
    vec = lambda c, a, n: f"case when not ({lacks.get(c, 'false')}) then vec[{a}:{a + n - 1}] end {c}"
    dims = ", ".join(f"d_{c} as (select pos, sum(w * x) v from (select w, unnest({c})::double x, generate_subscripts({c}, 1) pos from weights join spaced using (item_id) where user_id = {USER}) group by 1), p_{c} as (select list(v order by pos) pv_{c} from d_{c})" for c, _, _ in used)
    mix = " + ".join(f"{weights[c] / total}::double * coalesce(list_cosine_similarity(pv_{c}, {c}::double[]), 0)" for c, _, _ in used)
    some = " or ".join(f"{c} is not null" for c, _, _ in used)
    whole = ranked_sql()
    a, b = whole.index("dims as ("), whole.index("scored as (")
    pref = f"spaced as (select *, {', '.join(vec(*s) for s in SPACES)} from items), {dims}, "
    return whole[:a] + pref + whole[b:].replace("round(list_cosine_similarity(pv, vec::double[]), 9) match", f"case when {some} then round({mix}, 9) end match").replace("from items i cross join pref", "from spaced i " + " ".join(f"cross join p_{c}" for c, _, _ in used))


def _recommend_spaces(spark: SparkSession, d: str, weights: dict[str, float]) -> DataFrame:
    i = _in_spaces(items(spark, d))
    return shown(R.recommend(i, ratings(spark, d, USER), R.Options(weights=tuple(weights.items())), _in_spaces(vectors(spark, d))))


@query(_spaces_sql({"vec_tag": 0.3, "vec_emb": 0.6, "vec_staff": 0.1}))
def recommend_three_spaces(spark, d):
    return _recommend_spaces(spark, d, {"vec_tag": 0.3, "vec_emb": 0.6, "vec_staff": 0.1})


@query(_spaces_sql({"vec_tag": 0.5, "vec_staff": 0.5}))
def recommend_two_spaces(spark, d):
    return _recommend_spaces(spark, d, {"vec_tag": 0.5, "vec_emb": 0.0, "vec_staff": 0.5})


BASE = "not coalesce(nsfw, false) and (score is null or score <= 0 or score >= 3.5)"


@query(ranked_sql(BASE + " and air_year >= 1996 and air_year <= 1998"))
def recommend_flags_year(spark, d):
    return run(spark, d, year_min=1996, year_max=1998)


@query(ranked_sql(BASE + " and air_year < 2011"))
def recommend_mode_classic(spark, d):
    return run(spark, d, mode="classic")


@query(ranked_sql(BASE + " and air_date between date '1996-12-25' and date '1997-09-30'"))
def recommend_mode_season(spark, d):
    return run(spark, d, mode="season", today=TODAY)


@query(ranked_sql(BASE + f" and air_date between date '1996-12-25' and date '1997-09-30' and air_date > date '{TODAY}'"))
def recommend_mode_upcoming(spark, d):
    return run(spark, d, mode="upcoming", today=TODAY)


@query(ranked_sql("(score is null or score <= 0 or score >= 5.2)"))
def recommend_min_score_floor(spark, d):
    return run(spark, d, min_score=5.2, include_nsfw=True)


def _explain_reasons(spark: SparkSession, d: str) -> DataFrame:
    i = items(spark, d)
    pref = R.preference_vectors(ratings(spark, d, USER), i).select("pref")
    got = R.reasons(pref, i.select("item_id", "vec"))
    return got.select("item_id", F.col("pos").cast("long").alias("pos"), F.round("part", 6).alias("part"), "position")


@query(f"""with {RATED}, {ITEMS}, {PREF}, parts as (select item_id, unnest(list_zip(pv, vec::double[])) z, generate_subscripts(pv, 1) - 1 pos from items cross join pref),
p as (select item_id, pos, z[1] * z[2] part from parts), r as (select *, row_number() over (partition by item_id order by part desc, pos) as position from p where part > 0)
select item_id, pos, round(part, 6) part, position from r where position <= 4""")
def explain_reasons(spark, d):
    return _explain_reasons(spark, d)


@query(f"with {ITEMS} select item_id, round(case when score > 0 then votes / (votes + 300.0::double) * score + (1 - votes / (votes + 300.0::double)) * 7.07::double else 7.07::double end, 6) quality from items")
def bayes_rating(spark, d):
    return items(spark, d).select("item_id", F.round(R.bayes_quality(F.col("score"), F.coalesce("votes", F.lit(0))), 6).alias("quality"))


@query("select l_linestatus, l_linenumber as n, round(case when max(x) over (partition by l_linestatus) - min(x) over (partition by l_linestatus) < 1e-9 then 0.5 else (x - min(x) over (partition by l_linestatus)) / (max(x) over (partition by l_linestatus) - min(x) over (partition by l_linestatus)) end, 6) as scaled from (select l_linestatus, l_linenumber::bigint l_linenumber, case when l_linestatus = 'F' then 1.0::double else avg(l_quantity) end x from lineitem group by 1, 2)")
def minmax_blend_constant_pool(spark, d):
    x = F.when(F.col("l_linestatus") == "F", F.lit(1.0)).otherwise(F.avg("l_quantity"))
    g = load(spark, d, "lineitem", ["l_linestatus", "l_linenumber", "l_quantity"]).groupBy("l_linestatus", F.col("l_linenumber").cast("long").alias("n")).agg(x.alias("x"))
    ends = g.groupBy("l_linestatus").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    return g.join(ends, "l_linestatus").select("l_linestatus", "n", F.round(V.min_max(F.col("x"), F.col("lo"), F.col("hi")), 6).alias("scaled"))
