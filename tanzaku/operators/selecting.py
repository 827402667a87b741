"""Diverse item selection: questionnaire order, greedy maximal marginal relevance, redundancy, clusters."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tanzaku.functions import vectors as V

MMR_LAMBDA, MMR_POOL = 0.5, 5000  #: pool: a group of more items is refused, as its order is inherently sequential


def mmr_order(items: DataFrame, group: str, item: str, done: str, vec: str, weight: float = MMR_LAMBDA) -> DataFrame:
    """(group, item, rank): full greedy order of each group, popularity against the greatest similarity to what is chosen.

    Popularity is log1p(done) scaled to [0, 1] in the group. O(n d) for each pick, so a group may hold at most
    ``MMR_POOL`` items with a vector; ties go to the smaller item.
    """
    pool = items.where(F.col(vec).isNotNull() & F.col(item).isNotNull())

    def order(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) > MMR_POOL:
            raise ValueError(f"{len(pdf)} items in one group; select at most {MMR_POOL} first")
        pdf = pdf.sort_values(item)
        x = np.stack(pdf[vec].to_numpy()).astype(np.float64)
        n = np.linalg.norm(x, axis=1, keepdims=True)
        x = x / np.where(n > 0, n, 1)
        pop = np.log1p(pdf[done].fillna(0).to_numpy(np.float64))
        span = pop.max() - pop.min()
        pop = (pop - pop.min()) / span if span > 0 else np.full(len(pop), 0.5)
        near, free, picked = np.zeros(len(x)), np.ones(len(x), bool), []
        for i in range(len(x)):
            score = np.round(weight * pop - (1 - weight) * near, 9) if i else pop
            j = int(np.argmax(np.where(free, score, -np.inf)))
            picked.append(j)
            free[j] = False
            near = np.maximum(near, x @ x[j]) if i else x @ x[j]
        return pd.DataFrame({group: pdf[group].iloc[0], item: pdf[item].to_numpy()[picked], "rank": np.arange(1, len(x) + 1)})

    kinds = {c: items.schema[c].dataType.simpleString() for c in (group, item)}
    return pool.select(group, item, done, vec).groupBy(group).applyInPandas(order, f"{group} {kinds[group]}, {item} {kinds[item]}, rank long")


def redundancy(items: DataFrame, group: str, item: str, vec: str) -> DataFrame:
    """(group, redundancy): mean cosine over the pairs of each group, from the sum of its unit vectors.

    The pairs themselves are never made: |sum|^2 = n + 2 * (sum over pairs). Vectors without length count as none.
    """
    u = items.select(group, V.unit(F.col(vec)).alias("u")).where("u is not null")
    dims = u.select(group, F.posexplode("u").alias("pos", "x")).groupBy(group, "pos").agg(F.sum("x").alias("s"), F.count("*").alias("n"))
    return dims.groupBy(group).agg(((F.sum(F.col("s") * F.col("s")) - F.max("n")) / F.nullif(F.max("n") * (F.max("n") - 1), F.lit(0))).alias("redundancy"))


def kmeans_representatives(items: DataFrame, item: str, vec: str, done: str, k: int = 30, seed: int = 0) -> DataFrame:
    """(cluster, item, size): the most popular item of each cluster of the vectors (MLlib k-means)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    x = items.where(F.col(vec).isNotNull()).select(item, done, array_to_vector(F.col(vec).cast("array<double>")).alias("features"))
    at = KMeans(k=k, seed=seed, maxIter=20).fit(x).transform(x)
    return at.groupBy(F.col("prediction").alias("cluster")).agg(F.min_by(item, F.struct(-F.coalesce(done, F.lit(0)), F.col(item))).alias(item), F.count("*").alias("size"))


def questionnaire(items: DataFrame, n: int, forms: list[str], include_nsfw: bool = False, fold: bool = True, year_floor: int | None = None, exclude: DataFrame | None = None) -> DataFrame:
    """(item_id, root, position): the first ``n`` items to ask about.

    ``items``: item_id, root, form, nsfw, air_year, done, mmr_rank. Folded, a group shows its most popular
    member; an nsfw root drops its group, the year floor is the root's, and ``exclude`` (root) drops whole
    groups. Ranked groups come first by ``mmr_rank``, the others by popularity.
    """
    root_of = items.select(F.col("item_id").alias("root"), F.col("nsfw").alias("root_nsfw"), F.col("air_year").alias("root_year"))
    x = items.where(F.col("form").isin(*forms)).withColumn("root", F.coalesce("root", "item_id") if fold else F.col("item_id")).join(root_of, "root")
    if not include_nsfw:
        x = x.where(~F.coalesce("root_nsfw", F.lit(False)))
    if year_floor is not None:
        x = x.where(F.col("root_year") >= year_floor)
    if exclude is not None:
        x = x.join(exclude.select("root").distinct(), "root", "left_anti")
    lead = x.groupBy("root").agg(F.min_by(F.struct("item_id", "done", "mmr_rank"), F.struct(-F.coalesce("done", F.lit(0)), F.col("item_id"))).alias("m")).select("root", "m.*")
    order = [F.col("mmr_rank").isNull(), F.col("mmr_rank"), F.col("done").desc(), F.col("item_id")]
    return lead.orderBy(*order).limit(n).select("item_id", "root", F.row_number().over(Window.orderBy(*order)).cast("long").alias("position"))


def top_by(df: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group with ``position``; the limit acts before the shuffle."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("position", F.row_number().over(w)).where(F.col("position") <= n).withColumn("position", F.col("position").cast("long"))
