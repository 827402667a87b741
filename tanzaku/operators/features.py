"""Weighted sparse features of items: vocabularies, idf, unit length, sparse cosine, root closure of sequels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tanzaku.checkpoints import stored

MIN_DF = 8


def document_frequency(long: DataFrame, item: str, name: str, least: int = MIN_DF) -> DataFrame:
    """(name, df): in how many items a name occurs, from ``least`` on."""
    return long.where(F.col(name).isNotNull()).select(item, name).distinct().groupBy(name).agg(F.count("*").alias("df")).where(F.col("df") >= least)


def merged_counts(tags: DataFrame, synonyms: DataFrame, keep: DataFrame | None = None) -> DataFrame:
    """(item, name, n): tag counts under their canonical names; ``synonyms`` (name, canonical) is followed one hop."""
    m = tags.join(synonyms, "name", "left").select("item", F.coalesce("canonical", "name").alias("name"), "n")
    if keep is not None:
        m = m.join(keep, "name", "left_semi")
    return m.groupBy("item", "name").agg(F.sum("n").alias("n"))


def with_meta(tags: DataFrame, meta: DataFrame) -> DataFrame:
    """(item, name, n): user tags with counts, and meta tags at the item's median count (1.0 if it has no tags); a user tag wins."""
    mid = tags.groupBy("item").agg(F.median("n").alias("mid"))
    extra = meta.select("item", "name").distinct().join(tags.select("item", "name"), ["item", "name"], "left_anti").join(mid, "item", "left")
    return tags.select("item", "name", F.col("n").cast("double").alias("n")).unionByName(extra.select("item", "name", F.coalesce("mid", F.lit(1.0)).alias("n")))


def unit_rows(long: DataFrame, w: str = "w") -> DataFrame:
    """``long`` (item, name, w) with each item at length one; items without weight disappear."""
    n = F.sqrt(F.sum(F.col(w) * F.col(w)).over(Window.partitionBy("item")))
    return long.withColumn("_n", n).where("_n > 0").withColumn(w, F.col(w) / F.col("_n")).drop("_n")


def tag_weights(tags: DataFrame, items: int | None = None, binary: bool = False) -> DataFrame:
    """(item, name, w): ln(1 + n) * ln((N + 1) / (df + 1)), or the idf alone if ``binary``, at length one."""
    total = items if items is not None else tags.select("item").distinct().count()
    df = document_frequency(tags, "item", "name", 1)
    idf = F.ln((F.lit(float(total)) + 1) / (F.col("df") + 1))
    w = idf * (F.lit(1.0) if binary else F.log1p("n"))
    return unit_rows(tags.join(df, "name").select("item", "name", w.alias("w")))


def feature_weights(long: DataFrame, least: int = MIN_DF) -> DataFrame:
    """(item, name, w): ln(N / df) of each distinct feature with df of at least ``least``, at length one."""
    f = long.where("name is not null").select("item", "name").distinct()
    total = f.select("item").distinct().count()
    return unit_rows(f.join(document_frequency(f, "item", "name", least), "name").select("item", "name", F.ln(F.lit(float(total)) / F.col("df")).alias("w")))


def sparse_cosine(weights: DataFrame, query: DataFrame) -> DataFrame:
    """(item, cos): cosine of unit rows with one query (name, w); only items that share a feature appear."""
    q = query.select("name", F.col("w").alias("qw"))
    return weights.join(q, "name").groupBy("item").agg(F.sum(F.col("w") * F.col("qw")).alias("cos"))


def classify(name: Column, rules: list[tuple[str, str]], rest: str = "KEEP") -> Column:
    """Class of a tag by the first rule (class, pattern) that matches it."""
    out = None
    for cls, pattern in rules:
        hit = name.rlike(pattern)
        out = F.when(hit, cls) if out is None else out.when(hit, cls)
    return out.otherwise(rest)


#: Patterns of tag classes, in the order in which they are tried.
TAG_RULES = [
    ("YEAR", r"^(19|20)\d\d(年(\d{1,2}月)?)?$"),
    ("FORM", r"^(TV|OVA|OAD|WEB|剧场版|短片|电影)$"),
    ("REGION", r"^(日本|中国|国产|欧美|美国|韩国|法国)$"),
    ("STUDIO", r"^([ -~]{3,}|[ァ-ヶー]{3,})$"),
]


def series_roots(items: DataFrame, edges: DataFrame, hops: int = 8) -> DataFrame:
    """(item, root): the first work of each chain of prequels; an item without one is its own root.

    ``items``: item, year; ``edges``: item, prequel. Only prequels of no later year count, and of several the
    least (year, id). Pointers are doubled, so ``hops`` rounds reach 2 ** hops links; what is cyclic, or
    longer, ends at the least item that was reached.
    """
    y = items.select(F.col("item").alias("prequel"), F.col("year").alias("pyear"))
    parent = edges.join(items, "item").join(y, "prequel").where("prequel != item and pyear <= year")
    parent = parent.groupBy("item").agg(F.min_by("prequel", F.struct("pyear", "prequel")).alias("up"))
    at = stored(items.select("item").join(parent, "item", "left").select("item", F.coalesce("up", "item").alias("root")), "roots")
    for _ in range(hops):
        nxt = at.alias("a").join(at.alias("b"), F.col("a.root") == F.col("b.item")).select("a.item", F.col("b.root").alias("root"))
        nxt = stored(nxt, "roots")
        moved = nxt.join(at, ["item", "root"], "left_anti").limit(1).count()
        at = nxt
        if not moved:
            break
    return at
