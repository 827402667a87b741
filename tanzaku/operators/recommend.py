"""Preference-driven ranking: ratings, preference vectors, cosine fusion, folding by group, quality blending.

A profile is one small row, so scoring is a map over the items with that row broadcast; folding aggregates
by group with ``max_by``/``min_by`` (combined before the shuffle) and the pool is a bounded top-n.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tanzaku.functions import vectors as V
from tanzaku.functions.dates import season_window

#: Fixed values.
PRIOR_MEAN, PRIOR_WEIGHT, VOTE_PRIOR, CLASSIC_BEFORE = 7.07, 2.0, 300, 2011
WISH, PASS, SEEN_CONFIDENCE = (8.0, 0.5), (3.0, 0.3), 1.0


def ratings_from_answers(answers: DataFrame) -> DataFrame:
    """(user_id, item_id, score, confidence, exclude) from (user_id, item_id, choice, score, seq).

    ``seen`` keeps its score and excludes, ``wish`` and ``pass`` have fixed ones, other choices are dropped;
    of several answers on one item the last by ``seq`` counts. Null items are left out.
    """
    w = Window.partitionBy("user_id", "item_id").orderBy(F.col("seq").desc())
    last = answers.where(F.col("choice").isin("seen", "wish", "pass") & F.col("item_id").isNotNull()).withColumn("_r", F.row_number().over(w)).where("_r = 1")
    pick = lambda seen, wish, pas: F.when(F.col("choice") == "seen", seen).when(F.col("choice") == "wish", F.lit(wish)).otherwise(F.lit(pas))
    return last.select("user_id", "item_id", pick(F.col("score"), WISH[0], PASS[0]).alias("score"), pick(F.lit(SEEN_CONFIDENCE), WISH[1], PASS[1]).alias("confidence"), (F.col("choice") != "wish").alias("exclude"))


def shrunk_means(ratings: DataFrame) -> DataFrame:
    """(user_id, mu): confidence-weighted mean of each user, shrunk towards the prior."""
    c, r = F.col("confidence"), F.col("score")
    return ratings.groupBy("user_id").agg(((F.sum(c * r) + PRIOR_WEIGHT * PRIOR_MEAN) / (F.sum(c) + PRIOR_WEIGHT)).alias("mu"))


def weighted(ratings: DataFrame) -> DataFrame:
    """``ratings`` with ``w`` = confidence * (score - mu); mu counts rated items without a vector too."""
    return ratings.join(shrunk_means(ratings), "user_id").withColumn("w", F.col("confidence") * (F.col("score") - F.col("mu")))


def preference_dims(ratings: DataFrame, items: DataFrame, vec: str = "vec") -> DataFrame:
    """(user_id, pos, value): preference vectors in long form, summed per dimension before the shuffle."""
    v = weighted(ratings).join(items.select("item_id", vec), "item_id").where(F.col(vec).isNotNull())
    return v.select("user_id", "w", F.posexplode(vec).alias("pos", "x")).groupBy("user_id", "pos").agg(F.sum(F.col("w") * F.col("x").cast("double")).alias("value"))


def preference_vectors(ratings: DataFrame, items: DataFrame, vec: str = "vec") -> DataFrame:
    """(user_id, pref): one array for each user; as many entries as dimensions."""
    dims = preference_dims(ratings, items, vec).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("d"))
    return dims.select("user_id", F.col("d.value").alias("pref"))


def bayes_quality(score: Column, votes: Column) -> Column:
    """Weighted rating; an item without a score has the prior mean."""
    share = votes / (votes + VOTE_PRIOR)
    return F.when(score > 0, share * score + (1 - share) * PRIOR_MEAN).otherwise(F.lit(PRIOR_MEAN))


@dataclass(frozen=True)
class Options:
    mode: str = "all"  #: all, classic, season, aired, upcoming, recent
    today: str | None = None
    year_min: int | None = None
    year_max: int | None = None
    include_nsfw: bool = False
    min_score: float | None = 3.5
    fold: bool = True
    rank_by: str = "blend"  #: match, quality, blend
    alpha: float = 0.5
    top_k: int = 10
    weights: tuple[tuple[str, float], ...] = (("vec", 1.0),)  #: vector columns of the spaces and what each counts for

    @property
    def want(self) -> int:
        return self.top_k if self.rank_by == "match" else max(10 * self.top_k, 100)

    @property
    def spaces(self) -> list[tuple[str, float]]:
        return [(c, w) for c, w in self.weights if w > 0]


def allowed(o: Options) -> Column:
    """Predicate over (score, nsfw, air_year, air_date): ratings below the floor, years, windows; unrated items pass the floor."""
    ok = F.lit(True)
    if not o.include_nsfw:
        ok &= ~F.coalesce("nsfw", F.lit(False))
    if o.min_score is not None:
        ok &= F.col("score").isNull() | (F.col("score") <= 0) | (F.col("score") >= o.min_score)
    if o.year_min is not None or o.year_max is not None:  # an explicit range replaces the mode's
        if o.year_min is not None:
            ok &= F.col("air_year") >= o.year_min
        if o.year_max is not None:
            ok &= F.col("air_year") <= o.year_max
    elif o.mode == "classic":
        ok &= F.col("air_year") < CLASSIC_BEFORE
    elif o.mode != "all":
        today = F.lit(o.today).cast("date")
        lo, hi = season_window(today)
        ok &= F.col("air_date").between(lo, hi)
        if o.mode == "aired":
            ok &= F.col("air_date") <= today
        if o.mode == "upcoming":
            ok &= F.col("air_date") > today
    return ok


def recommend(items: DataFrame, ratings: DataFrame, o: Options = Options(), vectors: DataFrame | None = None) -> DataFrame:
    """(item_id, root, match, quality, rank_score, position) for the one user in ``ratings``.

    ``items``: item_id, root, vec, score, votes, nsfw, air_year, air_date. Folded, a group has the match of its
    best member and the identity and quality of its entry (earliest year, most votes, least id). Matches of
    several spaces (``Options.weights``) are fused, a space in which the item or the user has no vector counts 0. Items
    without any vector, and rated ones that exclude, take no part; no ratings give no rows. ``vectors`` (item_id,
    vectors) spares the joins behind the other columns of ``items`` when the preference is computed.
    """
    of = items if vectors is None else vectors
    prefs = [preference_vectors(ratings, of, c).withColumnRenamed("pref", f"pref_{c}") for c, _ in o.spaces]
    pref = reduce(lambda a, b: a.join(b, "user_id", "full"), prefs).drop("user_id")
    seen = ratings.where("exclude").select("item_id").distinct()
    present = reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c, _ in o.spaces])
    cand = items.where(present & allowed(o)).withColumn("root", F.coalesce("root", "item_id")).join(seen, "item_id", "left_anti")
    cand = cand.crossJoin(F.broadcast(pref))  # one row
    cosines = [(V.cosine(F.col(f"pref_{c}"), F.col(c)), w) for c, w in o.spaces]
    match = F.when(F.coalesce(*[c for c, _ in cosines]).isNotNull(), V.fused(cosines))
    cand = cand.select("item_id", "root", "air_year", "votes", F.round(match, 9).alias("match"), bayes_quality(F.col("score"), F.coalesce("votes", F.lit(0))).alias("quality")).where("match is not null")
    if o.fold:
        best = F.max_by(F.struct("match", "item_id"), F.struct(F.col("match"), -F.col("item_id")))
        entry = F.min_by(F.struct("item_id", "quality"), F.struct(F.coalesce("air_year", F.lit(1 << 30)), -F.coalesce("votes", F.lit(0)), F.col("item_id")))
        pool = cand.groupBy("root").agg(best.alias("b"), entry.alias("e")).select("root", F.col("e.item_id").alias("item_id"), F.col("b.match").alias("match"), F.col("e.quality").alias("quality"), F.col("b.item_id").alias("best_id"))
    else:
        pool = cand.select("root", "item_id", "match", "quality", F.col("item_id").alias("best_id"))
    pool = pool.orderBy(F.col("match").desc(), "best_id").limit(o.want)
    if o.rank_by == "match":
        ranked = pool.withColumn("rank_score", F.col("match"))
    elif o.rank_by == "quality":
        ranked = pool.withColumn("rank_score", F.col("quality"))
    else:
        whole = Window.partitionBy(F.lit(0))  # the pool has ``want`` rows at most
        scaled = lambda c: V.min_max(F.col(c), F.min(c).over(whole), F.max(c).over(whole))
        ranked = pool.withColumn("rank_score", o.alpha * scaled("match") + (1 - o.alpha) * scaled("quality"))
    ranked = ranked.withColumn("rank_score", F.round("rank_score", 9))
    top = ranked.orderBy(F.col("rank_score").desc(), F.col("match").desc(), "best_id").limit(o.top_k)  # bounded by top_k from here
    w = Window.orderBy(F.col("rank_score").desc(), F.col("match").desc(), "best_id")
    return top.select("item_id", "root", "match", "quality", "rank_score", F.row_number().over(w).cast("long").alias("position"))


def reasons(pref: DataFrame, items: DataFrame, most: int = 4) -> DataFrame:
    """(item_id, pos, part): the ``most`` largest positive contributions of single dimensions to each item's match."""
    v = items.crossJoin(F.broadcast(pref)).select("item_id", F.posexplode(F.zip_with("pref", "vec", lambda p, x: p * x.cast("double"))).alias("pos", "part"))
    w = Window.partitionBy("item_id").orderBy(F.col("part").desc(), "pos")
    return v.where("part > 0").withColumn("r", F.row_number().over(w)).where(F.col("r") <= most).select("item_id", "pos", "part", F.col("r").cast("long").alias("position"))
