"""Idempotent loads: merges that touch owned columns, scoped replacement, change detection, bridges, provenance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _same(keys: list[str], a: str, b: str) -> Column:
    return reduce(lambda x, y: x & y, [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys])


def upsert(old: DataFrame, new: DataFrame, keys: list[str], owned: list[str], preserve: bool = False) -> DataFrame:
    """``old`` with the rows of ``new`` merged in by ``keys``: only ``owned`` columns change, missing rows are added.

    ``preserve`` keeps an old value where the new one is null. Keys are compared as equal when null. ``new``
    has each key once.
    """
    rest = [c for c in old.columns if c not in keys]
    a, b = old.select(*keys, F.struct(*rest).alias("_o")).alias("a"), new.select(*keys, F.struct(*[c for c in rest if c in new.columns]).alias("_n")).alias("b")
    j = a.join(b, _same(keys, "a", "b"), "full_outer")
    have_new = F.col("_n").isNotNull()

    def value(c: str) -> Column:
        if c not in new.columns:
            return F.col(f"_o.{c}")
        got = F.coalesce(F.col(f"_n.{c}"), F.col(f"_o.{c}")) if preserve else F.col(f"_n.{c}")
        return F.when(have_new & (F.lit(c in owned) | F.col("_o").isNull()), got).otherwise(F.col(f"_o.{c}"))

    return j.select(*[F.coalesce(F.col(f"b.{k}"), F.col(f"a.{k}")).alias(k) for k in keys], *[value(c).alias(c) for c in rest]).select(*old.columns)


def replace_scope(old: DataFrame, new: DataFrame, scope: list[str], unique: list[str]) -> DataFrame:
    """``old`` without the rows whose ``scope`` occurs in ``new``, and those of ``new`` whose ``unique`` key is still free.

    Null keys are equal; of rows of ``new`` with one key the least in column order stays.
    """
    kept = old.alias("a").join(new.select(*scope).distinct().alias("b"), _same(scope, "a", "b"), "left_anti").select(*old.columns)
    rest = [c for c in old.columns if c not in unique]
    first = new.groupBy(*unique).agg(F.min(F.struct(*rest)).alias("_m")).select(*unique, "_m.*").select(*old.columns)
    free = first.alias("a").join(kept.select(*unique).alias("b"), _same(unique, "a", "b"), "left_anti").select(*old.columns)
    return kept.unionByName(free)


def changed(old: DataFrame, new: DataFrame, key: str, text: str) -> DataFrame:
    """Rows of ``new`` whose text is new or has another digest than in ``old``."""
    known = old.select(F.col(key).alias("_k"), F.md5(text).alias("_d"))
    return new.join(known, (F.col(key) == F.col("_k")) & F.md5(text).eqNullSafe(F.col("_d")), "left_anti")


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key by ``order`` (descending expressions)."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def bridge(a: DataFrame, b: DataFrame, on: str, cols: list[str]) -> DataFrame:
    """Distinct pairs of two sides that share ``on``; both sides are made distinct before they meet."""
    left = [c for c in cols if c in a.columns]
    right = [c for c in cols if c not in left]
    return a.select(on, *left).distinct().join(b.select(on, *right).distinct(), on).select(*cols).distinct()


def merged_maps(old: Column, new: Column) -> Column:
    """Union of two maps in which a value of ``new`` that is not null goes before."""
    empty = F.create_map().cast("map<string,int>")
    return F.map_zip_with(F.coalesce(old, empty), F.coalesce(new, empty), lambda k, o, n: F.coalesce(n, o))


def map_total(m: Column) -> Column:
    """Sum of a map's values; null for a null map."""
    return F.aggregate(F.map_values(m), F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x, F.lit(0)))


def backfill(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``old`` with ``columns`` cleared and filled from ``new`` (key, columns), which has each key once; rows without a match are null there."""
    rest = [c for c in old.columns if c not in columns]
    return old.select(*rest).join(new.select(key, *columns), key, "left").select(*old.columns)


def fingerprint(df: DataFrame, c: str) -> DataFrame:
    """(n, digest): a digest of the distinct values of a column, from sums over four parts of their digests.

    Sums do not depend on an order and are combined before the shuffle, so that no task holds more than its values.
    """
    per = df.where(F.col(c).isNotNull()).select(F.sha2(F.col(c).cast("string"), 256).alias("d")).distinct()
    part = lambda i: F.sum(F.conv(F.substring("d", 15 * i + 1, 15), 16, 10).cast("decimal(20,0)")).alias(f"s{i}")
    sums = per.agg(F.count("*").alias("n"), *map(part, range(4)))
    return sums.select("n", F.sha2(F.concat_ws("|", F.col("n").cast("string"), *[F.coalesce(F.col(f"s{i}"), F.lit(0)).cast("decimal(38,0)").cast("string") for i in range(4)]), 256).alias("digest"))


def pack_batches(df: DataFrame, lane: str, order: str, size: str, most_size: int = 600, most_items: int = 20) -> DataFrame:
    """(lane, order, batch): greedy batches of consecutive items of each lane within a size and a count.

    An item above the size has a batch of its own; a null size counts as 0. The scan is a fold over the items of
    a lane in order, so lanes must be bounded: cut long sequences into blocks of consecutive items.
    """
    import pandas as pd

    kinds = {c: df.schema[c].dataType.simpleString() for c in (lane, order)}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        batch, used, items, out = 0, 0, 0, []
        for n in pdf[size].fillna(0):
            if items and (used + n > most_size or items >= most_items):
                batch, used, items = batch + 1, 0, 0
            used, items = used + n, items + 1
            out.append(batch)
        return pd.DataFrame({lane: pdf[lane], order: pdf[order], "batch": out})

    return df.select(lane, order, size).groupBy(lane).applyInPandas(run, f"{lane} {kinds[lane]}, {order} {kinds[order]}, batch long")
