"""Filling containers of fixed capacity with whole items, by linear grouping.

Lengths of at least ``large_share`` of the capacity are sorted and cut into ``groups`` groups of equal
cardinality; each group's lengths are rounded up to its largest. For so few sizes the best configurations
(how many items of each group share a container) come from the configuration program: columns by a
knapsack, rows by a small simplex, both over group counts. Actual items then take the places of their
group, and the small ones are fitted best into what is left, again as counts: by room and by length.

All planning works on the histogram of lengths, which has at most ``capacity`` rows at any size of data,
and gives intervals of ranks. Items find their place by rank and interval, so no group of items, however
large, meets in one task; ranks come from a range-partitioned sort and per-partition counts.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tanzaku.checkpoints import stored


def byte_tokens(text: Column) -> Column:
    """Tokens of a byte-level tokenizer: one for every UTF-8 byte and one end mark; a null text has none."""
    return F.octet_length(text).cast("long") + 1


def pieces(items: DataFrame, key: str, tokens: str, capacity: int) -> DataFrame:
    """(key, piece_no, n_pieces, tok_from, size): items, cut only where they exceed ``capacity``.

    Null keys, null sizes and sizes below 1 are left out.
    """
    n = F.ceil(F.col(tokens) / F.lit(capacity)).cast("int")
    cut = items.select(key, F.col(tokens).cast("long").alias("tokens"), n.alias("n_pieces")).where(f"`{key}` is not null and tokens >= 1")
    each = cut.withColumn("piece_no", F.explode(F.sequence(F.lit(1), F.col("n_pieces"))))
    start = (F.col("piece_no") - 1).cast("long") * capacity
    return each.select(key, "piece_no", "n_pieces", start.alias("tok_from"), F.least(F.lit(capacity).cast("long"), F.col("tokens") - start).cast("int").alias("size"))


# ---------------------------------------------------------------- configurations, over group counts


def _knapsack(sizes: np.ndarray, value: np.ndarray, most: np.ndarray, capacity: int) -> tuple[np.ndarray, float]:
    """The configuration of greatest value within ``capacity``, with at most ``most`` items of each size."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        best[c], choice[c] = best[c - 1], -1
        ok = sizes <= c
        if ok.any():
            got = np.where(ok, value + best[np.maximum(c - sizes, 0)], -1)
            i = int(got.argmax())
            if got[i] > best[c] + 1e-12:
                best[c], choice[c] = got[i], i
    out, c = np.zeros(len(sizes), np.int64), capacity
    while c > 0:
        i = choice[c]
        if i < 0:
            c -= 1
        else:
            out[i] += 1
            c -= int(sizes[i])
    return np.minimum(out, most), float((np.minimum(out, most) * value).sum())


def configurations(sizes: list[int], counts: list[int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """[(items of each group in a container, containers)]: few containers that hold all ``counts`` items.

    Columns of the configuration program by a knapsack over the dual prices, rounded down, and the rest
    first-fit by decreasing size.
    """
    s, d = np.array(sizes, np.int64), np.array(counts, np.float64)
    g = len(s)
    if not g:
        return []
    basis = np.diag(np.maximum(1, capacity // s)).astype(float)
    x = d / np.diag(basis)
    most = np.array(counts, np.int64)
    for _ in range(40 * g):
        price = np.linalg.solve(basis.T, np.ones(g))
        col, worth = _knapsack(s, np.maximum(price, 0), most, capacity)
        if worth <= 1 + 1e-9:
            break
        step = np.linalg.solve(basis, col.astype(float))
        if not (step > 1e-9).any():
            break
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        x = x - ratio[out] * step
        x[out] = ratio[out]
        basis[:, out] = col
        x = np.maximum(x, 0)
    left, plan = most.copy(), []
    for j in np.argsort(-x):
        col = basis[:, j].astype(np.int64)
        n = int(min(np.floor(x[j] + 1e-7), *(left[i] // col[i] for i in range(g) if col[i]))) if col.any() else 0
        if n > 0:
            plan.append((tuple(int(v) for v in col), n))
            left -= n * col
    order = np.argsort(-s)
    while left.any():  # fill a container greedily and repeat it as often as the counts allow
        room, col = capacity, np.zeros(g, np.int64)
        for i in order:
            take = min(int(left[i]), room // int(s[i]))
            col[i] += take
            room -= take * int(s[i])
        n = int(min(left[i] // col[i] for i in range(g) if col[i]))
        plan.append((tuple(int(v) for v in col), n))
        left -= n * col
    return plan


def best_fit(rooms: dict[int, int], small: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, tuple[int, ...]]], int]:
    """Small lengths into rooms, as counts, longest first and each into the tightest room that takes it.

    ``rooms``: containers by room left; ``small``: items by length. Returns ([(room, first, containers,
    lengths put in)], new containers); ``first`` counts the containers of one room from 0, and new ones
    have the room ``capacity`` and follow those that there are.
    """
    piles: dict[int, list[list]] = {}
    begin: dict[int, int] = {}
    for room, n in rooms.items():
        if n:
            piles.setdefault(room, []).append([room, 0, n, ()])
            begin[room] = n
    keys, new = sorted(piles), 0
    for size in sorted(small, reverse=True):
        left = small[size]
        while left:
            i = bisect.bisect_left(keys, size)
            if i == len(keys):  # open new containers, as full of this length as they get
                per = capacity // size
                n, rest = divmod(left, per)
                for count, times in ((n, per), (1 if rest else 0, rest)):
                    if count:
                        room = capacity - times * size
                        if room not in piles or not piles[room]:
                            piles.setdefault(room, [])
                            bisect.insort(keys, room)
                        piles[room].append([capacity, begin.get(capacity, 0) + new, count, (size,) * times])
                        new += count
                break
            room = keys[i]
            pile = piles[room].pop()
            if not piles[room]:
                keys.pop(i)
            per = min(room // size, left)
            n = min(pile[2], left // per)
            if n < pile[2]:
                piles[room].append([pile[0], pile[1] + n, pile[2] - n, pile[3]])
                if len(piles[room]) == 1:
                    bisect.insort(keys, room)
            rest = room - per * size
            if not piles.get(rest):
                piles[rest] = []
                bisect.insort(keys, rest)
            piles[rest].append([pile[0], pile[1], n, pile[3] + (size,) * per])
            left -= n * per
    return [tuple(p) for pile in piles.values() for p in pile if p[3]], new


# ---------------------------------------------------------------- items to places


@dataclass(frozen=True)
class Places:
    """Intervals of ranks within a class of items: rank - ``start`` // ``per`` + ``base`` is the place."""

    start: dict[int, np.ndarray]
    per: dict[int, np.ndarray]
    base: dict[int, np.ndarray]

    def find(self, what: np.ndarray, rank: np.ndarray) -> np.ndarray:
        out = np.full(len(what), -1, np.int64)
        for w in np.unique(what):
            at = np.flatnonzero(what == w)
            if int(w) in self.start:
                i = np.searchsorted(self.start[int(w)], rank[at], side="right") - 1
                out[at] = self.base[int(w)][i] + (rank[at] - self.start[int(w)][i]) // self.per[int(w)][i]
        return out


def _places(rows: list[tuple[int, int, int, int]]) -> Places:
    """rows: (class, items a place, places, first place), in order."""
    start: dict[int, list] = {}
    per: dict[int, list] = {}
    base: dict[int, list] = {}
    filled: dict[int, int] = {}
    for what, each, places, first in rows:
        start.setdefault(what, []).append(filled.get(what, 0))
        per.setdefault(what, []).append(each)
        base.setdefault(what, []).append(first)
        filled[what] = filled.get(what, 0) + each * places
    arr = lambda d: {k: np.array(v, np.int64) for k, v in d.items()}
    return Places(arr(start), arr(per), arr(base))


def ranked(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """``df`` with ``rank``: its position from 0 among the rows of equal ``by`` in ``order``, for groups of any size.

    Rows are range-partitioned and sorted by both; a row's rank is its position within partition and group
    plus the rows of the group in earlier partitions, of which there are as many counts as partitions.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", part int, r long"

    def number(batches):
        seen: dict[tuple, int] = {}
        part = TaskContext.get().partitionId()
        for b in batches:
            keys = list(zip(*(b.column(c).to_pylist() for c in by)))
            r = np.empty(len(keys), np.int64)
            for i, k in enumerate(keys):
                r[i] = seen.get(k, 0)
                seen[k] = int(r[i]) + 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([part] * len(keys), pa.int32()), pa.array(r)], names=[*b.schema.names, "part", "r"])

    cut = stored(df.repartitionByRange(n, *by, *order).sortWithinPartitions(*by, *order).mapInArrow(number, schema), "packing-ranked")
    counts = cut.groupBy(*by, "part").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    return cut.join(before, [*by, "part"]).withColumn("rank", F.col("before") + F.col("r")).drop("part", "r", "before")


def _put(df: DataFrame, what: str, rank: str, place: str, shared) -> DataFrame:
    names = df.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", {place} long"

    def run(batches):
        for b in batches:
            t = pa.RecordBatch.from_arrays([*b.columns, pa.array(shared.value.find(np.asarray(b.column(names.index(what))), np.asarray(b.column(names.index(rank)))), pa.int64())], names=[*names, place])
            yield t

    return df.mapInArrow(run, schema)


def pack(items: DataFrame, key: str, tokens: str, capacity: int = 4096, large_share: float = 1 / 8, groups: int = 24) -> DataFrame:
    """(key, piece_no, n_pieces, tok_from, size, container): every item in one container, pieces of a cut item in several.

    No container holds more than ``capacity``. Keys are taken to be unique; rows of equal key and size are
    placed as separate items. An empty input gives no rows. ``tok_from`` counts from 0.
    """
    spark = items.sparkSession
    parts = pieces(items, key, tokens, capacity)
    hist = {r["size"]: r["n"] for r in parts.groupBy("size").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    full = hist.pop(capacity, 0)
    large_from = int(capacity * large_share)
    large = sorted(((s, n) for s, n in hist.items() if s >= large_from), reverse=True)
    total = sum(n for _, n in large)
    share = max(1, -(-total // groups))
    tops: list[int] = []  # a group may end within a length: ranks decide
    counts: list[int] = []
    seen = 0
    for s, n in large:
        while n:
            if seen % share == 0:
                tops.append(s)
                counts.append(0)
            take = min(n, share - seen % share)
            counts[-1] += take
            seen += take
            n -= take
    plan = configurations(tops, counts, capacity)
    rows, first = [], full
    for col, n in plan:
        rows += [(g, per, n, first) for g, per in enumerate(col) if per]
        first += n
    to_large = spark.sparkContext.broadcast(_places(rows))
    n_large = first

    kind = F.when(F.col("size") == capacity, 0).when(F.col("size") >= large_from, 1).otherwise(2)
    # large items share one order, largest first; small ones are ranked within their length
    lane = F.when(kind == 2, F.col("size")).otherwise(F.when(kind == 0, F.lit(-2)).otherwise(F.lit(-1)))
    placed = ranked(parts.withColumn("lane", lane).withColumn("desc", -F.col("size")), ["lane"], ["desc", key, "piece_no"]).drop("desc")
    big = placed.where("lane < 0").withColumn("grp", F.when(F.col("lane") == -1, F.floor(F.col("rank") / share)).otherwise(-1).cast("long"))
    big = big.withColumn("slot", F.when(F.col("lane") == -1, F.col("rank") % share).otherwise(F.col("rank")))
    big = stored(_put(big, "grp", "slot", "at", to_large), "packing-large")
    big = big.withColumn("container", F.when(F.col("lane") == -2, F.col("rank")).otherwise(F.col("at")))
    # what is left in each container, with its rank among containers of equal room
    rooms = big.where("lane = -1").groupBy("container").agg((F.lit(capacity) - F.sum("size")).cast("int").alias("room"))
    left = {r["room"]: r["n"] for r in rooms.groupBy("room").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    small = {s: n for s, n in hist.items() if s < large_from}
    fills, new = best_fit(left, small, capacity)
    # slots of a small length count through the fills in order; a place is a number over all fills
    spots, offset, ranges = [], 0, []
    for room, start, n, lengths in fills:
        spots += [(s, lengths.count(s), n, offset) for s in dict.fromkeys(lengths)]
        ranges.append((offset, room, start))
        offset += n
    to_small = spark.sparkContext.broadcast(_places(spots))
    out = _put(placed.where("lane >= 0").withColumn("lane", F.col("lane").cast("long")), "lane", "rank", "at", to_small)
    starts = spark.sparkContext.broadcast((np.array([r[0] for r in ranges], np.int64), np.array([r[1] for r in ranges], np.int32), np.array([r[2] for r in ranges], np.int64)))

    def to_room(batches):
        for b in batches:
            a, room, begin = starts.value
            at = np.asarray(b.column("at"))
            i = np.searchsorted(a, at, side="right") - 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(room[i] if len(room) else at.astype(np.int32)), pa.array(begin[i] + at - a[i] if len(a) else at)], names=[*b.schema.names, "room", "room_rank"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema) + ", room int, room_rank long"
    out = out.mapInArrow(to_room, schema)
    named = ranked(rooms, ["room"], ["container"]).select("room", F.col("rank").alias("room_rank"), F.col("container").alias("old"))
    known = left.get(capacity, 0)
    out = out.join(named, ["room", "room_rank"], "left").withColumn("container", F.coalesce("old", F.lit(n_large - known) + F.col("room_rank")))
    cols = [key, "piece_no", "n_pieces", "tok_from", "size", F.col("container").cast("long").alias("container")]
    return big.select(*cols).unionByName(out.select(*cols))
