from __future__ import annotations

import random

from pyspark.sql import functions as F

from tanzaku.llm import packing as P


def _pack(spark, sizes, capacity=100, **k):
    df = spark.createDataFrame(list(enumerate(sizes)), "doc_id long, tokens long").withColumn("container", F.lit(1))
    return P.pack(df, "doc_id", "tokens", capacity, **k).collect()


def _check(rows, sizes, capacity=100):
    room: dict[int, int] = {}
    got: dict[int, list] = {}
    for r in rows:
        room[r.container] = room.get(r.container, 0) + r.size
        got.setdefault(r.doc_id, []).append(r)
    assert max(room.values(), default=0) <= capacity
    assert set(got) == {i for i, s in enumerate(sizes) if s and s > 0}
    for i, rs in got.items():
        rs.sort(key=lambda r: r.piece_no)
        assert len(rs) == -(-sizes[i] // capacity) == rs[0].n_pieces
        assert [r.tok_from for r in rs] == [capacity * j for j in range(len(rs))] and sum(r.size for r in rs) == sizes[i]
    assert sorted(room) == list(range(len(room)))
    return len(room)


def test_random_sizes(spark):
    rng = random.Random(2)
    sizes = [min(400, int(rng.paretovariate(1.1) * 6)) for _ in range(3000)] + [100] * 20 + [101, 250, 1]
    n = _check(_pack(spark, sizes), sizes)
    assert n <= 1.01 * -(-sum(sizes) // 100) + 3


def test_large_items_near_optimum(spark):
    sizes = [50] * 200 + [34] * 150 + [33] * 150 + [70] * 100 + [30] * 100
    best = 100 + 100 + 75 + 38  # 50 50, 70 30, 34 33 33, and what is left of 34 in pairs
    assert _check(_pack(spark, sizes), sizes) <= best + -(-len(sizes) // 24)  # linear grouping loses at most one group


def test_ties_one_size_and_small_only(spark):
    for sizes in ([60] * 301, [7] * 500, [100] * 50, [1], [99, 1]):
        n = _check(_pack(spark, sizes), sizes)
        assert n <= max(len(sizes) if sizes[0] > 50 else 0, -(-sum(sizes) // (100 // max(sizes) * max(sizes) if max(sizes) < 50 else 100))) + 1


def test_nulls_and_empty(spark):
    df = spark.createDataFrame([(1, None), (None, 5), (2, 0), (3, 5)], "doc_id long, tokens long")
    assert [r.doc_id for r in P.pack(df, "doc_id", "tokens", 100).collect()] == [3]
    assert P.pack(df.where("false"), "doc_id", "tokens", 100).count() == 0


def test_configurations_use_all_items():
    sizes, counts = [60, 45, 33, 20], [100, 90, 80, 70]
    plan = P.configurations(sizes, counts, 100)
    assert [sum(c[i] * n for c, n in plan) for i in range(4)] == counts
    assert all(sum(a * b for a, b in zip(c, sizes)) <= 100 for c, _ in plan)


def test_best_fit_takes_the_tightest_room():
    fills, new = P.best_fit({10: 1, 7: 1}, {7: 1}, 100)
    assert fills == [(7, 0, 1, (7,))] and new == 0


def test_tokens(spark):
    df = spark.createDataFrame([("aé漢",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(P.byte_tokens(F.col("t"))).collect()] == [7, 1, None]
