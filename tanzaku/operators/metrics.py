"""Ranking metrics and evaluation samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tanzaku.checkpoints import stored


def precision_ndcg(ranked: DataFrame, query: str, rank: str, relevant: str, k: int = 10) -> DataFrame:
    """(query, precision, ndcg) at ``k``; ``ranked`` has a row per query and candidate, rank from 1, relevance 0 or 1.

    The ideal order puts all relevant candidates first; without any, NDCG is 0.
    """
    gain = F.col(relevant) / F.log2(F.col(rank) + 1)
    g = ranked.groupBy(query).agg(F.sum(F.when(F.col(rank) <= k, F.col(relevant))).alias("hits"), F.sum(F.when(F.col(rank) <= k, gain)).alias("dcg"), F.sum(relevant).alias("all"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(F.col("all").cast("int"), F.lit(k)), F.lit(1))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    return g.select(query, (F.col("hits") / k).alias("precision"), F.when(F.col("all") > 0, F.col("dcg") / ideal).otherwise(0.0).alias("ndcg"))


def share_at_k(ranked: DataFrame, query: str, rank: str, flag: str, k: int) -> DataFrame:
    """(query, share): share of the first ``k`` candidates that carry the flag."""
    return ranked.where(F.col(rank) <= k).groupBy(query).agg(F.avg(F.col(flag).cast("double")).alias("share"))


def confusion(df: DataFrame, group: str, found: Column, answered: Column) -> DataFrame:
    """(group, n, hit, answered_if_hit, answered_if_miss): rates with conditional denominators, null where there is none."""
    return df.groupBy(group).agg(
        F.count("*").alias("n"), F.avg(found.cast("double")).alias("hit"), F.avg(F.when(found, answered.cast("double"))).alias("answered_if_hit"), F.avg(F.when(~found, answered.cast("double"))).alias("answered_if_miss")
    )


def stratified(df: DataFrame, stratum: str, key: str, n: int, salt: str = "") -> DataFrame:
    """Up to ``n`` rows of each stratum in the order of a hash of the key: the same rows at every run."""
    w = Window.partitionBy(stratum).orderBy(F.md5(F.concat(F.lit(salt), F.col(key).cast("string"))), key)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def equality(df: DataFrame, a: str, b: str, most: float = 0.95) -> DataFrame:
    """(n, share, suspicious): how often two columns are equal where both are known; more than ``most`` hints at a copy of one as the other."""
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    return both.agg(F.count("*").alias("n"), F.round(F.avg((F.col(a) == F.col(b)).cast("double")), 6).alias("share")).withColumn("suspicious", F.col("share") > most)


def distribution(df: DataFrame, by: list[str], top: int) -> DataFrame:
    """(by, n, pct, position): the ``top`` most frequent values with their share of all rows in per cent."""
    g = df.groupBy(*by).agg(F.count("*").alias("n"))
    first = g.orderBy(F.col("n").desc(), *by).limit(top).crossJoin(F.broadcast(g.agg(F.sum("n").alias("_all"))))  # one row
    position = F.row_number().over(Window.orderBy(F.col("n").desc(), *by)).cast("long")  # of ``top`` rows
    return first.select(*by, "n", F.round(100.0 * F.col("n") / F.col("_all"), 4).alias("pct"), position.alias("position"))


def sample_with_head(df: DataFrame, key: str, order: list[Column], stratum: Column, quotas: dict[str, int], head: int, salt: str = "") -> DataFrame:
    """(key, stratum): the first ``head`` rows by ``order`` as stratum ``top``, and of the others so many of each stratum, picked by hash."""
    top = df.orderBy(*order).limit(head).select(key, F.lit("top").alias("stratum"))
    rest = df.withColumn("stratum", stratum).join(top.select(key), key, "left_anti")
    quota = F.create_map(*[F.lit(x) for kv in quotas.items() for x in kv])
    w = Window.partitionBy("stratum").orderBy(F.md5(F.concat(F.lit(salt), F.col(key).cast("string"))), key)
    picked = rest.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= max(quotas.values())).where(F.col("_r") <= F.try_element_at(quota, F.col("stratum")))
    return top.unionByName(picked.select(key, "stratum"))


def quantile_by_index(df: DataFrame, value: str, shares: list[float]) -> DataFrame:
    """(share, value): the element at position floor(n * share) of the sorted values, not interpolated.

    From counts of distinct values in ranges: only the ranges' totals are added up in one place.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("c"))
    ranged = stored(counts.repartitionByRange(value).withColumn("_p", F.spark_partition_id()), "quantiles")
    sums = ranged.groupBy("_p").agg(F.sum("c").alias("s"))
    before = sums.select("_p", (F.sum("s").over(Window.orderBy("_p")) - F.col("s")).alias("before"))  # a row per range
    upto = ranged.join(F.broadcast(before), "_p").withColumn("upto", F.col("before") + F.sum("c").over(Window.partitionBy("_p").orderBy(value)))
    total = sums.agg(F.sum("s").alias("n"))
    wanted = df.sparkSession.createDataFrame([(s,) for s in shares], "share double").crossJoin(F.broadcast(total)).withColumn("at", F.least(F.floor(F.col("n") * F.col("share")), F.col("n") - 1))
    return upto.join(F.broadcast(wanted), (F.col("upto") > F.col("at")) & (F.col("upto") - F.col("c") <= F.col("at"))).select("share", value)
