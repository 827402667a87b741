from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from tanzaku.llm import knn


def _rows(n: int, seed: int = 3) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(20, 96))
    x = centres[rng.integers(20, size=n)] + 0.7 * rng.normal(size=(n, 96))
    x[: n // 10] = x[n // 10 : 2 * (n // 10)] + 0.1 * rng.normal(size=(n // 10, 96))
    return x.astype(np.float16).astype(np.float32)


def _frame(spark, x, keys=None):
    rows = [(int(k), [float(v) for v in r]) for k, r in zip(keys if keys is not None else range(len(x)), x)]
    return spark.createDataFrame(rows, "chunk_id long, vec array<float>")


def _exact(x: np.ndarray, least: float, k: int = 10) -> set:
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    top = [set(np.argsort(-r, kind="stable")[:k].tolist()) for r in s]
    return {tuple(sorted((str(i), str(j)))) for i in range(len(x)) for j in top[i] if s[i, j] >= least and i in top[j]}


def test_mutual_pairs_against_brute_force(spark):
    x = _rows(1500)
    got = knn.mutual_pairs(knn.usable_vectors(_frame(spark, x), "chunk_id", "vec", "c"), 0.9, knn.Params(leaf_rows=200))
    got = {(r.key_a, r.key_b) for r in got.collect()}
    want = _exact(x, 0.9)
    assert len(want) > 100 and got <= want and len(got & want) >= 0.98 * len(want)


def test_lists_have_recall(spark):
    x = _rows(2000)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    kth = np.sort(s, axis=1)[:, -10]
    vec = knn.usable_vectors(_frame(spark, x), "chunk_id", "vec", "c")
    rows = knn.nearest_keys(vec, "cast(key as bigint) % 20 = 0", knn.Params(leaf_rows=200, stages=16, beam=2, probes=8, rerank=120)).collect()
    asked = {int(r.key) for r in rows}
    assert asked == set(range(0, 2000, 20)) and len(rows) == 10 * len(asked)
    good = sum(r.cos >= kth[int(r.key)] - 1e-4 for r in rows)
    assert good >= 0.9 * len(rows)


def test_copies_and_unusable_rows(spark):
    x = _rows(40)
    x[5:20] = x[4]  # sixteen copies of one vector
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(3, [float(v) for v in x[3]])]
    rows += [(100, None), (101, [0.0] * 96), (102, [float("nan")] * 96), (103, [1.0] * 95), (None, [1.0] * 96), (104, [None] * 96), (105, [])]
    df = spark.createDataFrame(rows, "chunk_id long, vec array<float>").selectExpr("*", "1 as key", "2 as payload")
    got = {(int(r.key_a), int(r.key_b)) for r in knn.mutual_pairs(knn.usable_vectors(df, "chunk_id", "vec", "c"), 0.9, knn.Params(leaf_rows=16)).collect()}
    keys = sorted(map(str, range(4, 20)))
    inside = {tuple(sorted((int(a), int(b)), key=str)) for i, a in enumerate(keys[:11]) for b in keys[:11][i + 1 :] if b in [k for k in keys if k != a][:10] and a in [k for k in keys if k != b][:10]}
    assert inside <= {tuple(sorted(p, key=str)) for p in got}
    assert not {i for p in got for i in p} & {100, 101, 102, 103, 104, 105}


def test_lists_of_every_asked_copy(spark):
    x = _rows(60)
    x[5:40] = x[4]  # thirty-six copies of one vector; the asked ones are mostly beyond the eleven smallest keys
    got = knn.nearest_keys(knn.usable_vectors(_frame(spark, x), "chunk_id", "vec", "c"), "cast(key as bigint) % 3 = 0", knn.Params(leaf_rows=16, probes=8)).collect()
    lists = {k: [r.other for r in sorted((r for r in got if r.key == k), key=lambda r: r.position)] for k in {r.key for r in got}}
    assert set(lists) == {str(i) for i in range(0, 60, 3)} and all(len(v) == 10 for v in lists.values())
    copies = sorted(map(str, range(4, 40)))
    assert all(lists[k] == [c for c in copies if c != k][:10] for k in lists if k in copies)


def test_query_lists_both_collections(spark, tmp_path):
    from tanzaku.llm.queries import p2_neighbors

    x = _rows(400)
    _frame(spark, x).write.parquet(f"{tmp_path}/plot_chunk.parquet")
    texts = [(f"{i:08x}" + "ab" * 28, 96, bytearray(v.astype("<f4").tobytes())) for i, v in enumerate(x[::-1])]
    spark.createDataFrame(texts, "k string, dim int, vec binary").write.parquet(f"{tmp_path}/vectors.parquet")
    rows = p2_neighbors(spark, str(tmp_path)).collect()
    asked = {(r.coll, r.key) for r in rows}
    assert asked == {("plot_chunk", str(i)) for i in range(0, 400, 50)} | {("vectors", texts[i][0]) for i in range(0, 400, 50)}
    assert len(rows) == 10 * len(asked) and all(len(r.other) == (64 if r.coll == "vectors" else len(str(int(r.other)))) for r in rows)
    u = (x / np.linalg.norm(x, axis=1, keepdims=True))[::-1]
    for i in range(0, 400, 50):
        want = [texts[j][0] for j in np.argsort(-(u @ u[i]), kind="stable") if j != i][:10]
        assert len(set(want) & {r.other for r in rows if r.key == texts[i][0]}) >= 9


def test_binary_vectors_and_empty_input(spark):
    x = _rows(60)
    rows = [(f"k{i}", 96, bytearray(r.astype("<f4").tobytes())) for i, r in enumerate(x)] + [("bad", 96, bytearray(b"abc")), ("dim", 95, bytearray(x[0].astype("<f4").tobytes())), ("none", 96, None)]
    df = spark.createDataFrame(rows, "k string, dim int, vec binary")
    v = knn.usable_vectors(df, "k", "vec", "v", dim_col="dim")
    assert v.count() == 60
    assert knn.mutual_pairs(v.where("key = 'nothing'")).count() == 0


def test_beam_search_beats_greedy_and_round_trip():
    x = _rows(800)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    m = knn.train(x, 800, knn.Params(leaf_rows=100))
    rest = x - m.leaves[(x @ m.leaves.T).argmax(1)]
    error = [((rest - knn.decode(knn.encode(rest, m.books, b), m.books)) ** 2).sum() for b in (1, 4)]
    assert error[1] <= error[0] < (rest**2).sum()


@pytest.mark.parametrize("n", [1, 2, 11])
def test_tiny_collections(spark, n):
    x = np.repeat(_rows(20)[:1], n, 0) + np.arange(n)[:, None] * 1e-3
    got = knn.mutual_pairs(knn.usable_vectors(_frame(spark, x), "chunk_id", "vec", "c"))
    assert got.count() == n * (n - 1) // 2


def _peak_mb(f) -> tuple[float, object]:
    tracemalloc.start()
    out = f()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return peak / 1e6, out


@pytest.mark.parametrize("visiting", [True, False])
def test_training_memory_does_not_grow_with_the_leaves(visiting):
    x = _rows(8192)
    p = knn.Params(leaf_rows=4)
    peak, m = _peak_mb(lambda: knn.train(x, len(x), p, visiting))
    assert len(m.leaves) > 1800 and peak < 60  # the table of all rows and leaves alone would have 60 MB and more
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    order = np.argsort(-(u @ m.leaves.T), axis=1, kind="stable")[:, : p.probes]
    assert (knn.nearest_leaves(u, m.leaves, p.probes) == order).mean() > 0.9999  # a last bit may decide
    assert abs(m.load @ m.parts - len(x) * (p.probes if visiting else 1)) < 1e-3 * len(x)


def test_reading_a_sample_takes_little_beyond_it():
    x = np.random.default_rng(1).normal(size=(20000, 96)).astype(np.float32)
    x[::3] = x[::3].astype(np.float16)
    payload = pa.array([(r.astype("<f2") if i % 3 == 0 else r).tobytes() for i, r in enumerate(x)], pa.binary())
    peak, got = _peak_mb(lambda: knn._read(payload, 96))
    assert np.allclose(got, x / np.linalg.norm(x, axis=1, keepdims=True), atol=1e-6) and peak < 40
