"""Scoped retrieval: entity linking, resolution of the scope, quota-bounded recall, choice of the context.

All stages take many questions at once and partition by question; within a question the candidates are
bounded by quotas before they meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tanzaku.functions import vectors as V
from tanzaku.operators.filters import bloom, codes_of, passing, window_hashes

#: Fixed values.
QUOTAS = {"char": 40, "series": 10, "songs": 3}
FINAL, FLOOR, MIN_KEEP, PIN_RESERVE, SONGS_SEAT, MAX_PINNED = 8, 0.05, 2, 4, 1, 40
MENTION_MIN, MENTION_MAX = 2, 16
GENERIC_NAMES = ("主人公", "主角", "女主角", "男主角", "主人翁", "男主", "女主", "旁白", "叙述者", "玩家", "プレイヤー", "ナレーター", "ナレーション", "无名", "名前なし", "村民", "路人", "群众", "众人")
SONGS_QUERY = r"(?i)片头|片尾|主题曲|插曲|(?<![A-Za-z])(?:OP|ED)(?![A-Za-z])"


def candidate_mentions(questions: DataFrame, names: DataFrame) -> DataFrame:
    """(qid, name, start, free): where names of the dictionary occur in a question's key.

    ``questions``: qid, key; ``names``: name (keys of 2 to 16 characters). ``start`` counts from 1; ``free`` tells whether
    a name of ASCII letters and digits stands at word borders. Nulls match nothing. Of the parts of a question only
    those that a filter of the dictionary lets pass are shuffled; the join on the names themselves decides.
    """
    distinct = names.select("name").where(F.length("name").between(MENTION_MIN, MENTION_MAX)).distinct()
    shared = questions.sparkSession.sparkContext.broadcast(bloom(distinct, "name"))
    kind = questions.schema["qid"].dataType.simpleString()
    word = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, bits = shared.value
        for b in batches:
            keys = b.column(1).to_pylist()
            ends = np.cumsum([len(k) for k in keys])
            begins = np.concatenate([[0], ends[:-1]])
            joined = "".join(keys)
            codes, owner = codes_of(joined), np.repeat(np.arange(len(keys)), ends - begins)
            row, name, start, free = [], [], [], []
            for size in range(MENTION_MIN, min(MENTION_MAX, len(codes)) + 1):
                at = np.flatnonzero(owner[: len(codes) - size + 1] == owner[size - 1 :])
                at = at[passing(window_hashes(codes, size)[at], words, bits)]
                for i, k in zip(owner[at].tolist(), at.tolist()):
                    part, e = joined[k : k + size], k + size
                    row.append(i)
                    name.append(part)
                    start.append(k - int(begins[i]) + 1)
                    free.append(not word.issuperset(part) or not (k > begins[i] and joined[k - 1] in word or e < ends[i] and joined[e] in word))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), pa.array(name, pa.string()), pa.array(start, pa.int32()), pa.array(free, pa.bool_())], names=["qid", "name", "start", "free"])

    parts = questions.select("qid", "key").where("qid is not null and key is not null").mapInArrow(run, f"qid {kind}, name string, start int, free boolean")
    return parts.join(distinct, "name").select("qid", "name", "start", "free")


def longest_spans(spans: Column) -> Column:
    """Of array<struct<start, len, name>> those that a greedy choice keeps: longest first, then leftmost, without overlap."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct((-s["len"]).alias("n"), s["start"].alias("start"), s["name"].alias("name"))))
    kept = F.filter(ordered, lambda s: s["n"].isNull())  # empty, of the right type
    free = lambda acc, s: ~F.exists(acc, lambda t: (s["start"] < t["start"] - t["n"]) & (t["start"] < s["start"] - s["n"]))
    return F.aggregate(ordered, kept, lambda acc, s: F.when(free(acc, s), F.array_append(acc, s)).otherwise(acc))


def mentions(questions: DataFrame, names: DataFrame) -> DataFrame:
    """(qid, name, start): longest mentions that do not overlap; ASCII names only at word borders. ``start`` counts from 1."""
    hits = candidate_mentions(questions, names).where("free")
    spans = hits.groupBy("qid").agg(F.collect_list(F.struct("start", F.length("name").alias("len"), "name")).alias("spans"))  # bounded by the question's length
    return spans.select("qid", F.explode(longest_spans(F.col("spans"))).alias("s")).select("qid", F.col("s.name").alias("name"), F.col("s.start").alias("start"))


def resolve(questions: DataFrame, found: DataFrame, scopes: DataFrame) -> DataFrame:
    """(qid, state, root): the scope that a question's mentions point at.

    ``found``: qid, name, entity_type, root; ``scopes``: root, with chunks. One root of works is OK, several are
    AMBIGUOUS; without any, distinct names of characters vote (generic ones only if there is nothing else) and
    a tie is AMBIGUOUS; nothing is UNKNOWN; a root without chunks is NO_CORPUS.
    """
    generic = F.col("name").isin(*GENERIC_NAMES)
    f = found.where("root is not null").withColumn("subject", F.col("entity_type") == "subject").withColumn("generic", generic)
    direct = f.where("subject").groupBy("qid").agg(F.count_distinct("root").alias("n"), F.min("root").alias("root"))
    any_named = f.where("not subject").groupBy("qid").agg(F.max(~F.col("generic")).alias("named"))
    votes = f.where("not subject").join(any_named, "qid").where("not named or not generic").groupBy("qid", "root").agg(F.count_distinct("name").alias("v"))
    ranked = votes.groupBy("qid").agg(F.max("v").alias("top")).join(votes, "qid").where("v = top").groupBy("qid").agg(F.count("*").alias("vn"), F.min("root").alias("vroot"))
    joined = questions.select("qid").distinct().join(direct, "qid", "left").join(ranked, "qid", "left")
    one = F.when(F.col("n") == 1, F.col("root")).when(F.col("n").isNull() & (F.col("vn") == 1), F.col("vroot"))
    told = joined.select("qid", one.alias("root"), F.when((F.col("n") > 1) | (F.col("n").isNull() & (F.col("vn") > 1)), "AMBIGUOUS").when(one.isNull(), "UNKNOWN").alias("state"))
    have = scopes.select("root").distinct().withColumn("has", F.lit(True))
    return told.join(have, "root", "left").select("qid", F.coalesce("state", F.when(F.col("has"), "OK").otherwise("NO_CORPUS")).alias("state"), "root")


def recall(queries: DataFrame, chunks: DataFrame, quotas: dict[str, int] | None = None, spoiler: bool = False) -> DataFrame:
    """(qid, chunk_id, layer, rn, score): per question and layer the chunks of greatest inner product within the layer's quota.

    ``queries``: qid, root, qvec; ``chunks``: chunk_id, root, layer, spoiler_level, vec. The constant bound beside
    the quota lets the ranking stop early in every partition before the shuffle.
    """
    quotas = quotas or QUOTAS
    quota = F.create_map(*[F.lit(x) for kv in quotas.items() for x in kv])
    c = chunks if spoiler else chunks.where("spoiler_level = 0")
    s = c.where("vec is not null").join(queries, "root").select("qid", "chunk_id", "layer", F.round(V.dot(F.col("qvec"), F.col("vec")), 9).alias("score"))
    w = Window.partitionBy("qid", "layer").orderBy(F.col("score").desc_nulls_last(), "chunk_id")
    r = s.where(F.col("layer").isin(*quotas)).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= max(quotas.values()))
    return r.where(F.col("rn") <= F.element_at(quota, F.col("layer")))


def recall_many(queries: DataFrame, chunks: DataFrame, quotas: dict[str, int] | None = None, spoiler: bool = False, query_block: int = 4096, chunk_block: int = 40_000) -> DataFrame:
    """What ``recall`` gives, for very many questions: blocks of questions meet blocks of chunks as matrices.

    Both sides are cut by hash, so a task holds one block of each of one root; a block keeps no more than the
    quota of each question and layer. All questions meet all chunks of their root, whatever that costs.
    """
    quotas = quotas or QUOTAS
    c = chunks if spoiler else chunks.where("spoiler_level = 0")
    c = c.where("vec is not null").where(F.col("layer").isin(*quotas))
    nq, nc = 1 + queries.count() // query_block, 1 + c.count() // chunk_block
    cut = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select("root", "qid", "qvec", cut("qid", nq).alias("qb"), every(nc).alias("cb"))
    right = c.select("root", "chunk_id", "layer", "vec", cut("chunk_id", nc).alias("cb"), every(nq).alias("qb"))

    def matrix(x: pa.ChunkedArray, n: int) -> np.ndarray:
        return np.asarray(x.combine_chunks().flatten(), np.float64).reshape(n, -1)

    def best(q: pa.Table, t: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if q.num_rows and t.num_rows:
            t = t.sort_by("chunk_id")  # ties go to the smaller id
            qid, qv = np.asarray(q.column("qid")), matrix(q.column("qvec"), q.num_rows)
            cid, cv, layers = np.asarray(t.column("chunk_id")), matrix(t.column("vec"), t.num_rows), np.asarray(t.column("layer").to_pylist())
            for layer, quota in quotas.items():
                at = np.flatnonzero(layers == layer)
                for lo in range(0, len(qid) if len(at) else 0, 256):
                    score = np.round(qv[lo : lo + 256] @ cv[at].T, 9)
                    order = np.argsort(-score, axis=1, kind="stable")[:, :quota]
                    out.append((np.repeat(qid[lo : lo + 256], order.shape[1]), cid[at][order].ravel(), [layer] * order.size, np.take_along_axis(score, order, 1).ravel()))
        cols = [np.concatenate([o[i] for o in out]) if out else [] for i in range(4)]
        return pa.table([pa.array(x, kind) for x, kind in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.float64()))], names=["qid", "chunk_id", "layer", "score"])

    keys = ["root", "qb", "cb"]
    s = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(best, "qid long, chunk_id long, layer string, score double")
    w = Window.partitionBy("qid", "layer").orderBy(F.col("score").desc_nulls_last(), "chunk_id")
    quota = F.create_map(*[F.lit(x) for kv in quotas.items() for x in kv])
    r = s.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= max(quotas.values()))
    return r.where(F.col("rn") <= F.element_at(quota, F.col("layer")))


def pinned(wanted: DataFrame, chunks: DataFrame, limit: int = MAX_PINNED) -> DataFrame:
    """(qid, chunk_id, position): chunks of the named characters in order of character and chunk number.

    ``wanted``: qid, character_id; ``chunks``: chunk_id, character_id, chunk_no.
    """
    w = Window.partitionBy("qid").orderBy("character_id", "chunk_no", "chunk_id")
    got = chunks.join(wanted.distinct(), "character_id").withColumn("position", F.row_number().over(w)).where(F.col("position") <= limit)
    return got.select("qid", "chunk_id", F.col("position").cast("long").alias("position"))


def keep_first(parts: list[DataFrame], group: str, key: str, order: str) -> DataFrame:
    """(group, key, position): ordered union that keeps the first place of every key."""
    u = None
    for i, p in enumerate(parts):
        q = p.select(group, key, F.struct(F.lit(i), F.col(order).cast("long")).alias("at"))
        u = q if u is None else u.unionByName(q)
    first = u.groupBy(group, key).agg(F.min("at").alias("at"))
    return first.select(group, key, F.row_number().over(Window.partitionBy(group).orderBy("at", key)).cast("long").alias("position"))


def choose(pool: DataFrame, group: list[str], final: int | Column = FINAL, floor: float | Column = FLOOR, min_keep: int = MIN_KEEP, reserve: int | Column = PIN_RESERVE) -> DataFrame:
    """Rows of ``pool`` that make the context of each group, with ``position`` by score.

    ``pool``: group columns, chunk_id, score, pinned, seat. Up to ``reserve`` pinned chunks stay whatever their
    score, one seat holds a place, the others need the floor; if fewer than ``min_keep`` reach it, so many stay.
    """
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    key = [F.coalesce("score", F.lit(0.0)).desc(), F.col("chunk_id")]
    w = Window.partitionBy(*group)
    p = pool.withColumn("_pin", F.col("pinned") & (F.row_number().over(Window.partitionBy(*group, "pinned").orderBy(*key)) <= lit(reserve)))
    p = p.withColumn("_s", F.col("seat") & ~F.col("_pin")).withColumn("_seat", F.col("_s") & (F.row_number().over(Window.partitionBy(*group, "_s").orderBy(*key)) <= SONGS_SEAT))
    p = p.withColumn("_held", F.col("_pin") | F.col("_seat")).withColumn("_rn", F.row_number().over(Window.partitionBy(*group, "_held").orderBy(*key)))
    room = F.greatest(F.lit(0), lit(final) - F.sum(F.col("_held").cast("int")).over(w))
    above = F.sum((~F.col("_held") & (F.coalesce("score", F.lit(0.0)) >= lit(floor))).cast("int")).over(w)
    p = p.withColumn("_room", room).withColumn("_above", F.least(above, room))
    keep = F.when(F.col("_above") < min_keep, F.least(F.lit(min_keep), F.col("_room"))).otherwise(F.col("_above"))
    p = p.where(F.col("_held") | (F.col("_rn") <= keep)).withColumn("position", F.row_number().over(w.orderBy(*key)).cast("long"))
    return p.where(F.col("position") <= lit(final)).drop("_pin", "_s", "_seat", "_held", "_rn", "_room", "_above")


def songs_seat(questions: DataFrame, recalled: DataFrame) -> DataFrame:
    """(qid, chunk_id): the first song chunk of the recall, for questions about songs."""
    ask = questions.where(F.col("question").rlike(SONGS_QUERY)).select("qid")
    return recalled.where("layer = 'songs'").join(ask, "qid").groupBy("qid").agg(F.min_by("chunk_id", F.struct("rn", "chunk_id")).alias("chunk_id"))


def compared(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(both_sets, first_only, is_subset) of the distinct keys of two selections, in one row."""
    sides = a.select(key, F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(b.select(key, F.lit(0).alias("a"), F.lit(1).alias("b")))
    inside = sides.groupBy(key).agg(F.max("a").alias("a"), F.max("b").alias("b"))
    only = F.count_if((F.col("a") == 1) & (F.col("b") == 0))
    return inside.agg(F.count_if((F.col("a") == 1) & (F.col("b") == 1)).alias("both_sets"), only.alias("first_only"), (only == 0).alias("is_subset"))
