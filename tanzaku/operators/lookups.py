"""Structured lookups: related works by shared features, people and their roles, seasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tanzaku.functions.dates import quarter_window


def features(df: DataFrame, item: str, arrays: dict[str, str]) -> DataFrame:
    """(item, kind, name): the distinct members of array columns, by kind."""
    parts = [df.select(item, F.lit(kind).alias("kind"), F.explode(F.array_distinct(col)).alias("name")) for kind, col in arrays.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where("name is not null")


def related(seed: DataFrame, members: DataFrame, per_facet: int = 20) -> DataFrame:
    """(root, item_id, done, shared): groups that share a facet (kind, name) with the seed group, each shown by one work.

    ``members``: item_id, root, done, kind, name; ``seed``: root. Of each facet the ``per_facet`` most popular
    works count; a group is shown by its root itself if that is among them, else by its most popular work.
    """
    facets = members.join(seed.select("root").distinct(), "root", "left_semi").select("kind", "name").distinct()
    w = Window.partitionBy("kind", "name").orderBy(F.col("done").desc_nulls_last(), "item_id")
    hits = members.join(seed.select("root").distinct(), "root", "left_anti").join(facets, ["kind", "name"]).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= per_facet)
    key = F.struct((F.col("item_id") == F.col("root")).alias("own"), F.coalesce("done", F.lit(-1)).alias("pop"), (-F.col("item_id")).alias("neg"))
    return hits.groupBy("root").agg(F.max_by(F.struct("item_id", "done"), key).alias("m"), F.count_distinct("kind", "name").alias("shared")).select("root", "m.item_id", "m.done", "shared")


def roles_of(roles: DataFrame, works: DataFrame, names: DataFrame) -> DataFrame:
    """(person, character, name, work, role_type, popularity): one row for each character of each person.

    A leading role (type 1) goes before popularity, ties to the smaller work; ``names`` has (character, name, rank),
    of which the least rank and then the first name shows. A null role type never drops a role.
    """
    shown = names.groupBy("character").agg(F.min_by("name", F.struct("rank", "name")).alias("name"))
    w = Window.partitionBy("person", "character").orderBy(F.coalesce(F.col("role_type") == 1, F.lit(False)).desc(), F.col("popularity").desc_nulls_last(), "work")
    best = roles.join(works, "work").withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    return best.join(shown, "character", "left").select("person", "character", "name", "work", "role_type", "popularity")


def season(works: DataFrame, year: int, month: int, limit: int, date: str = "air_date", order: list[Column] | None = None) -> DataFrame:
    """The works of a quarter in the order given, at most ``limit`` of them, with ``total``, the count without the limit."""
    lo, hi = quarter_window(F.make_date(F.lit(year), F.lit(month), F.lit(1)))
    inside = works.where((F.col(date) >= lo) & (F.col(date) < hi))
    total = inside.agg(F.count("*").alias("total"))
    return inside.orderBy(*(order or [F.col(date)])).limit(limit).crossJoin(F.broadcast(total))  # one row
