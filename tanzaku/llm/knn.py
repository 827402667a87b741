"""k most similar vectors for every vector, by additive quantisation.

The index is a residual additive quantiser over whole vectors: a first stage of leaf centroids, from a
tree that splits a sample until each leaf holds about ``leaf_rows`` rows, then ``stages`` codebooks of
``codewords`` full-dimensional vectors for what remains. Rows are encoded by beam search and keep the
norm of their reconstruction. A query visits the ``probes`` leaves next to it; there, sums of lookup
tables over the codes give approximate cosines, and the best ``rerank`` of each leaf are scored exactly.

Distribution: a row goes to the leaves it visits (``probes`` copies of its bytes), so work and shuffle
grow in proportion to the rows, and a task holds one leaf. Leaves follow the density of the sample;
one that is heavy all the same is cut into ``parts``, each of which every visitor sees. Parts are
dealt out to tasks by the load that the sample shows, and there are as many tasks as the bytes ask for, so that
none reads more as the rows grow. Only the sample
(``sample_rows`` at most), the centroids and the codebooks ever reach the driver or are broadcast.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tanzaku.checkpoints import stored


@dataclass(frozen=True)
class Params:
    """Fixed parameters; none depends on the data beyond the count of rows that sets the leaves."""

    dim: int = 96
    k: int = 10
    leaf_rows: int = 1024
    probes: int = 4
    stages: int = 8
    codewords: int = 64
    beam: int = 4
    rerank: int = 40
    sample_rows: int = 65536  #: most rows that the training sample has, per collection
    sample_per_leaf: int = 48
    max_leaves: int = 16384  #: beyond so many times ``leaf_rows`` rows leaves grow; raise it and ``sample_rows`` together
    residual_rows: int = 16384  #: rows of the sample on which the codebooks are fitted
    tasks_per_core: int = 10  #: tasks of the search, more if they would read ``task_bytes`` each
    task_bytes: int = 64 << 20
    seed: int = 7


# ---------------------------------------------------------------- training, on a bounded sample


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator, spherical: bool) -> tuple[np.ndarray, np.ndarray]:
    c = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        at = (x @ c.T - 0.5 * (c * c).sum(1)).argmax(1)
        order = np.argsort(at, kind="stable")
        keys, starts = np.unique(at[order], return_index=True)
        c[keys] = np.add.reduceat(x[order], starts) / np.diff([*starts, len(x)])[:, None]
        if spherical:
            c = _unit(c)
    return c, (x @ c.T - 0.5 * (c * c).sum(1)).argmax(1)


TABLE = 1 << 21  #: numbers of a table of rows and leaves that are held at once


def nearest_leaves(x: np.ndarray, leaves: np.ndarray, probes: int) -> np.ndarray:
    """The ``probes`` leaves next to each row of ``x``, nearest first; rows in blocks, as whole samples times all leaves would fill the driver."""
    near, step = np.empty((len(x), probes), np.int64), max(1, TABLE // len(leaves))
    for lo in range(0, len(x), step):
        far = x[lo : lo + step] @ leaves.T
        np.negative(far, out=far)
        some = np.argpartition(far, probes - 1, axis=1)[:, :probes]
        near[lo : lo + step] = np.take_along_axis(some, np.argsort(np.take_along_axis(far, some, 1), axis=1, kind="stable"), 1)
    return near


def grow_leaves(x: np.ndarray, leaves: int, rng: np.random.Generator) -> np.ndarray:
    """Centroids of a tree that splits ``x`` until no part holds more than its even share of rows."""
    share, todo, out = max(1.0, len(x) / leaves), [np.arange(len(x))], []
    while todo:
        part = todo.pop()
        if len(part) <= 1.5 * share:
            out.append(x[part].mean(0))
            continue
        k = int(min(8, max(2, round(len(part) / share))))
        _, at = _kmeans(x[part], k, 6, rng, True)
        pieces = [part[at == i] for i in range(k)]
        if max(map(len, pieces)) == len(part):  # all alike: any cut is as good
            pieces = np.array_split(part, k)
        todo += [p for p in pieces if len(p)]
    return _unit(np.stack(out)).astype(np.float32)


@dataclass(frozen=True)
class Model:
    leaves: np.ndarray  #: leaf centroids
    parts: np.ndarray  #: into how many parts each leaf is cut
    load: np.ndarray  #: rows that a part of each leaf is expected to read, visitors included
    books: np.ndarray  #: stages x codewords x dim


def train(sample: np.ndarray, rows: int, p: Params, visiting: bool = True) -> Model:
    """The quantiser for a collection of ``rows`` rows from its sample (rows of any length, not zero); ``visiting``: whether all rows are queries."""
    rng = np.random.default_rng(p.seed)
    x = _unit(sample.astype(np.float32))
    leaves = grow_leaves(x, int(np.clip(rows / p.leaf_rows, 1, min(p.max_leaves, max(1, len(x) // 4)))), rng)
    near = nearest_leaves(x, leaves, min(p.probes, len(leaves)) if visiting else 1)
    home = near[:, 0]
    share = np.bincount(home, minlength=len(leaves)) / len(x) * rows
    parts = np.maximum(1, np.ceil(share / (8 * p.leaf_rows))).astype(np.int64)
    load = share / parts
    if visiting:
        load = load + (np.bincount(near.ravel(), minlength=len(leaves)) / len(x) * rows) - share
    rest, books = x - leaves[home], []
    if len(rest) > p.residual_rows:
        rest = rest[rng.choice(len(rest), p.residual_rows, replace=False)]
    for _ in range(p.stages):
        c, at = _kmeans(rest, p.codewords, 8, rng, False)
        books.append(c)
        rest = rest - c[at]
    return Model(leaves, parts, load, np.stack(books).astype(np.float32))


def spread_leaves(models: dict[str, Model], tasks: int) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """For each collection (where the parts of each leaf begin, the task of each part): heavy parts first, each to the task with least load."""
    first = {c: np.concatenate([[0], np.cumsum(m.parts)]) for c, m in models.items()}
    task = {c: np.zeros(first[c][-1], np.int32) for c in models}
    heap = [(0.0, t) for t in range(tasks)]
    for load, coll, part in sorted(((float(m.load[leaf]), c, int(i)) for c, m in models.items() for leaf in range(len(m.leaves)) for i in range(first[c][leaf], first[c][leaf + 1])), reverse=True):
        have, t = heapq.heappop(heap)
        task[coll][part] = t
        heapq.heappush(heap, (have + load + 1, t))
    return {c: (first[c], task[c]) for c in models}


# ---------------------------------------------------------------- encoding


def encode(rest: np.ndarray, books: np.ndarray, beam: int) -> np.ndarray:
    """Codes of residuals by beam search: after every stage the ``beam`` partial sums with least error stay."""
    m, kk, d = books.shape
    flat = books.reshape(m * kk, d)
    gain = (flat * flat).sum(1)[None, :] - 2 * (rest @ flat.T)  # error added by a word, without cross terms
    cross = 2 * flat @ flat.T
    n = len(rest)
    codes, error = np.zeros((n, 1, 0), np.int64), np.zeros((n, 1), np.float32)
    for s in range(m):
        cost = error[:, :, None] + gain[:, None, s * kk : (s + 1) * kk]
        for t in range(s):
            cost += cross[codes[:, :, t] + t * kk, s * kk : (s + 1) * kk]
        b = min(beam, cost.shape[1] * kk)
        cost = cost.reshape(n, -1)
        best = np.argpartition(cost, b - 1, axis=1)[:, :b]
        error = np.take_along_axis(cost, best, 1)
        codes = np.concatenate([np.take_along_axis(codes, (best // kk)[:, :, None], 1), (best % kk)[:, :, None]], 2)
    return codes[np.arange(n), error.argmin(1)].astype(np.uint8)


def decode(codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    return sum(books[s][codes[:, s]] for s in range(books.shape[0]))


# ---------------------------------------------------------------- search within a leaf


def _read(payload: pa.Array, dim: int) -> np.ndarray:
    """Unit vectors of payloads, which hold float16 or float32 numbers as their length tells."""
    payload = payload.combine_chunks() if isinstance(payload, pa.ChunkedArray) else payload
    out = np.empty((len(payload), dim), np.float32)
    if not len(payload):
        return out
    offsets = np.frombuffer(payload.buffers()[1], np.int32)[payload.offset : payload.offset + len(payload) + 1]
    raw = np.frombuffer(payload.buffers()[2], np.uint8)
    width = np.diff(offsets)
    for size, kind in ((2 * dim, "<f2"), (4 * dim, "<f4")):
        fits = np.flatnonzero(width == size)
        for lo in range(0, len(fits), 4096):  # bounds the table of the places of all bytes
            at = fits[lo : lo + 4096]
            out[at] = raw[offsets[at][:, None] + np.arange(size)].view(kind).astype(np.float32)
    return _unit(out)


def search_leaf(base: np.ndarray, base_id: np.ndarray, codes: np.ndarray, norms: np.ndarray, queries: np.ndarray, query_id: np.ndarray, centre: np.ndarray, books: np.ndarray, p: Params, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, neighbour id, cosine) of the up to ``k`` best of a leaf's rows for each query, exact cosines of at least ``least``."""
    out: list[tuple[np.ndarray, ...]] = []
    m, kk, _ = books.shape
    r = min(p.rerank, len(base))
    flat, step = codes.astype(np.int64), 256
    for lo in range(0, len(queries), step):
        q = queries[lo : lo + step]
        tables = books.reshape(m * kk, -1) @ q.T  # lookup tables: word x query
        score = np.repeat((q @ centre)[None, :], len(base), 0)
        for s in range(m):
            score += tables[s * kk : (s + 1) * kk][flat[:, s]]
        score /= norms[:, None]
        near = np.argpartition(score.T, len(base) - r, axis=1)[:, len(base) - r :] if r < len(base) else np.broadcast_to(np.arange(r), (len(q), r))
        exact = np.einsum("qrd,qd->qr", base[near], q, optimize=False)
        exact[base_id[near] == query_id[lo : lo + step, None]] = -2
        order = np.argsort(-exact, axis=1, kind="stable")[:, : p.k]
        cos, who = np.take_along_axis(exact, order, 1), base_id[np.take_along_axis(near, order, 1)]
        ok = cos >= max(least, -1.5)
        out.append((np.repeat(query_id[lo : lo + step], ok.sum(1)), who[ok], cos[ok]))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32))


# ---------------------------------------------------------------- the operator


def _payload_batches(dim: int, source: str):
    """(key, vec) batches to (key, payload) of usable vectors, each once a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, vec = b.column(0), b.column(1)
            if source == "list":
                size = np.asarray(vec.value_lengths().fill_null(0))
            else:
                fits = (np.asarray(b.column(2).fill_null(0)) == dim) & (np.asarray(pc.binary_length(vec).fill_null(0)) == 4 * dim)
                size = np.where(fits, dim, 0)
            at = np.flatnonzero((size == dim) & np.asarray(key.is_valid()))
            vec, key = vec.take(pa.array(at)), key.take(pa.array(at))
            if source == "list":
                x = np.asarray(vec.flatten().fill_null(np.nan), np.float32).reshape(-1, dim)
            else:
                x = np.frombuffer(b"".join(vec.to_pylist()), "<f4").reshape(-1, dim)
            with np.errstate(over="ignore", invalid="ignore"):
                half = x.astype("<f2")
                norm = (x.astype(np.float64) ** 2).sum(1)
                ok = np.isfinite(x).all(1) & (norm > 0)
                fits = (half.astype(np.float32) == x).all(1)
            payload = [h.tobytes() if f else v.tobytes() for h, v, f in zip(half[ok], x[ok].astype("<f4"), fits[ok])]
            rows = list(dict.fromkeys(zip(key.filter(pa.array(ok)).to_pylist(), payload)))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())], names=["key", "payload"])

    return run


def usable_vectors(df: DataFrame, key: str, vec: str, coll: str, dim: int = 96, dim_col: str | None = None) -> DataFrame:
    """(coll, key, payload) of the vectors that are finite, not zero and of ``dim`` numbers.

    ``vec`` is array<float>, or binary little-endian float32 when ``dim_col`` names the stated length.
    Rows with a null key or vector are left out. Numbers that float16 holds exactly are kept so.
    """
    cols = [F.col(key).cast("string").alias("key"), F.col(vec).alias("vec")] + ([F.col(dim_col).cast("int").alias("dim")] if dim_col else [])
    got = df.select(*cols).where("key is not null and vec is not null")
    return got.mapInArrow(_payload_batches(dim, "bytes" if dim_col else "list"), "key string, payload binary").select(F.lit(coll).alias("coll"), "key", "payload")


def representatives(vectors: DataFrame, k: int) -> DataFrame:
    """One row per distinct vector: (id, coll, payload, keys), ``keys`` the ``k`` + 1 smallest of its rows' keys.

    A group of copies may be of any size: the limit of the window acts before the shuffle, and no
    neighbour list of ``k`` can reach past the first ``k`` + 1 copies.
    """
    w = Window.partitionBy("coll", "payload").orderBy("key")
    first = vectors.withColumn("r", F.dense_rank().over(w)).where(F.col("r") <= k + 1)
    return first.groupBy("coll", "payload").agg(F.array_sort(F.collect_set("key")).alias("keys")).select(F.monotonically_increasing_id().alias("id"), "coll", "payload", "keys")


def neighbours(reps: DataFrame, p: Params = Params(), least: float = -1.5, query_filter: str = "true", label: str = "knn") -> DataFrame:
    """(id, other, cos): the up to ``k`` nearest distinct vectors of every vector, cosine at least ``least``.

    ``reps`` must be stored (its ids are used twice). ``query_filter`` picks the queries, all rows are
    searched. Empty input gives no rows; ties in cosine are broken by id.
    """
    spark = reps.sparkSession
    counts = {r["coll"]: r["n"] for r in reps.groupBy("coll").agg(F.count("*").alias("n")).collect()}  # a row per collection
    models: dict[str, Model] = {}
    for coll, n in sorted(counts.items()):
        want = int(min(p.sample_rows, max(4096, n / p.leaf_rows * p.sample_per_leaf)))
        picked = reps.where(F.col("coll") == coll).where(F.pmod(F.xxhash64("payload"), F.lit(1 << 30)) < int(min(1.0, 1.1 * want / n) * (1 << 30)) + 1)
        order = [F.xxhash64("payload"), F.col("payload")]  # the same sample at every run
        got = picked.select("payload").orderBy(*order).limit(want).toArrow().column(0)
        if len(got) == 0:
            got = reps.where(F.col("coll") == coll).select("payload").orderBy(*order).limit(want).toArrow().column(0)
        models[coll] = train(_read(got, p.dim), n, p, query_filter == "true")
    copies = p.probes if query_filter == "true" else 1  # elsewhere queries are few beside the rows
    tasks = max(p.tasks_per_core * spark.sparkContext.defaultParallelism, -(-sum(counts.values()) * copies * (2 * p.dim + p.stages + 40) // p.task_bytes))
    shared = spark.sparkContext.broadcast((models, spread_leaves(models, tasks)))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for coll, model in shared.value[0].items():
                first, task = shared.value[1][coll]
                part = b.filter(pc.equal(b.column(1), coll))
                step = 4096
                for lo in range(0, part.num_rows, step):
                    cut = part.slice(lo, step)
                    x, ids = _read(cut.column(2), p.dim), np.asarray(cut.column(0))
                    asks = np.asarray(cut.column(3).to_numpy(zero_copy_only=False), bool)
                    probes = min(p.probes, len(model.leaves))
                    near = nearest_leaves(x, model.leaves, probes)
                    home = near[:, 0]
                    codes = encode(x - model.leaves[home], model.books, p.beam)
                    norms = np.linalg.norm(decode(codes, model.books) + model.leaves[home], axis=1).astype(np.float32)
                    row, leaf, piece, is_base = [], [], [], []
                    for j in range(probes):
                        for i in range(int(model.parts[near[:, j]].max())):
                            here = np.flatnonzero(model.parts[near[:, j]] > i)
                            mine = (ids[here] % model.parts[near[here, j]] == i) & (j == 0)
                            keep = mine | asks[here]
                            row.append(here[keep])
                            leaf.append(near[here[keep], j])
                            piece.append(np.full(int(keep.sum()), i))
                            is_base.append(mine[keep])
                    row_, base_, leaf_, piece_ = (np.concatenate(x) for x in (row, is_base, leaf, piece))
                    n = len(row_)
                    word = codes[row_].tobytes()
                    code = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, (n + 1) * p.stages, p.stages, dtype=np.int32)), pa.py_buffer(word)])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([coll] * n, pa.string()), pa.array(task[first[leaf_] + piece_]), pa.array(leaf_.astype(np.int32)), pa.array(piece_.astype(np.int32)), pa.array(ids[row_]), pa.array(base_), pa.array(asks[row_]), cut.column(2).take(pa.array(row_)), pc.if_else(pa.array(base_), code, pa.scalar(None, pa.binary())), pa.array(norms[row_])],
                        names=["coll", "task", "leaf", "piece", "id", "base", "asks", "payload", "codes", "norm"],
                    )

    def answer(table: pa.Table) -> pa.Table:
        coll, leaf, piece = (np.asarray(table.column(c).to_numpy(zero_copy_only=False)) for c in ("coll", "leaf", "piece"))
        order = np.lexsort((piece, leaf, coll))
        coll, leaf, piece = coll[order], leaf[order], piece[order]
        cut = np.flatnonzero((coll[1:] != coll[:-1]) | (leaf[1:] != leaf[:-1]) | (piece[1:] != piece[:-1])) + 1
        parts = [one_leaf(table.take(pa.array(rows)), shared.value[0][coll[lo]], int(leaf[lo])) for lo, rows in zip(np.concatenate([[0], cut]).tolist(), np.split(order, cut))]
        q, o, c = (np.concatenate(x) for x in zip(*parts))
        return pa.table({"id": pa.array(q, pa.int64()), "other": pa.array(o, pa.int64()), "cos": pa.array(c, pa.float32())})

    def one_leaf(table: pa.Table, model: Model, leaf: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x, ids = _read(table.column("payload"), p.dim), np.asarray(table.column("id"))
        at = np.flatnonzero(np.asarray(table.column("base")))
        ask = np.flatnonzero(np.asarray(table.column("asks")))
        if not len(at) or not len(ask):
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32)
        at = at[np.argsort(ids[at])]
        codes = np.frombuffer(b"".join(table.column("codes").take(pa.array(at)).to_pylist()), np.uint8).reshape(len(at), -1)
        return search_leaf(x[at], ids[at], codes, np.asarray(table.column("norm"))[at], x[ask], ids[ask], model.leaves[leaf], model.books, p, least)

    routed = reps.select("id", "coll", "payload", F.expr(query_filter).alias("asks")).mapInArrow(route, "coll string, task int, leaf int, piece int, id long, base boolean, asks boolean, payload binary, codes binary, norm float")
    found = routed.repartitionById(tasks, "task").groupBy("task").applyInArrow(answer, "id long, other long, cos float")
    if query_filter == "true":  # similarity is symmetric: what one row found counts for both
        ways = F.array(F.struct("id", "other", "cos"), F.struct(F.col("other").alias("id"), F.col("id").alias("other"), "cos"))
        found = found.select(F.inline(ways)).groupBy("id", "other").agg(F.max("cos").alias("cos"))
    w = Window.partitionBy("id").orderBy(F.col("cos").desc(), "other")
    return found.withColumn("r", F.row_number().over(w)).where(F.col("r") <= p.k).drop("r")


def key_lists(reps: DataFrame, near: DataFrame, k: int, asked: DataFrame | None = None) -> DataFrame:
    """(coll, key, others array<struct<cos, key>>): the ``k`` nearest keys of each listed key, copies first.

    Lists exist for the first ``k`` + 1 keys of a group of copies, what lies beyond is in nobody's list; or,
    with ``asked`` (id, coll, key), for each of its keys, however many copies come before it.
    """
    names = reps.select(F.col("id").alias("other"), F.col("keys").alias("other_keys"))
    told = near.join(names, "other").groupBy("id").agg(F.collect_list(F.struct("cos", "other_keys")).alias("near"))  # k entries at most
    joined = reps.select("id", "coll", "keys").join(told, "id", "left").where("near is not null or size(keys) > 1")
    cand = F.expr(
        "array_sort(concat(transform(keys, x -> struct(-1.0D as far, x as key)),"
        " flatten(transform(coalesce(near, array()), n -> transform(n.other_keys, x -> struct(-cast(n.cos as double) as far, x as key))))))"
    )
    ranked = joined.withColumn("cand", F.slice(cand, 1, k + 1))  # a key is itself in its list at most once
    listed = ranked.select("coll", F.explode("keys").alias("key"), "cand") if asked is None else ranked.select("id", "cand").join(asked, "id")
    return listed.select(
        "coll", "key", F.expr(f"transform(slice(filter(cand, c -> c.key != key), 1, {k}), c -> struct(-c.far as cos, c.key as key))").alias("others")
    )


def all_vectors(plot_chunk: DataFrame, vectors: DataFrame) -> DataFrame:
    return usable_vectors(plot_chunk, "chunk_id", "vec", "plot_chunk").unionByName(usable_vectors(vectors, "k", "vec", "vectors", dim_col="dim"))


def mutual_pairs(vectors: DataFrame, least: float = 0.90, p: Params = Params()) -> DataFrame:
    """(coll, key_a, key_b), key_a < key_b: pairs of cosine >= ``least`` in which each is in the other's list."""
    reps = stored(representatives(vectors, p.k), "knn-reps")
    lists = key_lists(reps, neighbours(reps, p, least), p.k)
    one = lists.select("coll", "key", F.explode("others").alias("o")).where(F.col("o.cos") >= least)
    pairs = one.select("coll", F.least("key", "o.key").alias("key_a"), F.greatest("key", "o.key").alias("key_b"), (F.col("key") < F.col("o.key")).alias("up"))
    return pairs.groupBy("coll", "key_a", "key_b").agg(F.count_distinct("up").alias("n")).where("n = 2").select("coll", "key_a", "key_b")


def nearest_keys(vectors: DataFrame, asked: str, p: Params = Params()) -> DataFrame:
    """(coll, key, other, cos, position): the ``k`` nearest keys of the keys for which the predicate ``asked`` over (coll, key) holds.

    Queries are few beside the rows searched, so that they can visit many leaves; only they are copied, rows stay in one leaf.
    Every asked key gets its list, also one that is none of the ``k`` + 1 smallest of its group of copies.
    """
    reps = stored(representatives(vectors, p.k), "knn-reps")
    keys = stored(vectors.where(asked).distinct().join(reps.select("id", "coll", "payload"), ["coll", "payload"]).select("id", "coll", "key"), "knn-asked")
    marked = reps.join(keys.select("id", F.lit(True).alias("is_asked")).distinct(), "id", "left")
    near = neighbours(stored(marked, "knn-marked"), p, query_filter="is_asked is not null")
    lists = key_lists(reps, near, p.k, keys)
    return lists.select("coll", "key", F.posexplode("others").alias("position", "o")).select("coll", "key", F.col("o.key").alias("other"), F.round("o.cos", 6).alias("cos"), (F.col("position") + 1).cast("long").alias("position"))
