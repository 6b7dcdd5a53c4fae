"""Exact top-k by inner product over a bit-sliced index.

Components are quantised to whole numbers. A block of vectors keeps, for each attribute, the bits of
(value - least value) and of (largest value - value) as bitmaps over its rows. A query's score is the sum of
the slices of the first kind times the bits of its positive components and of the second kind times those of
its negative ones, plus a constant: bitmaps of equal weight are added three at a time by full adders, so the
sums of all rows of the block stand in slices, one bit of each row's score in each. From the most significant
slice downward the rows that are surely among the best k are set aside; those that are equal to the last bit
stand at the boundary and are resolved by the smaller id. Scores of the chosen rows are computed exactly.

Rows with a component beyond WIDE stand outside the slices, whose bits and sums they would not fit; they, and
queries with such components, are scored by whole numbers of any length.

Queries are a stated set of rows; they are sent to every task in rounds of at most ROUND. Each task takes the
vectors that were dealt to it in blocks of at most BLOCK, keeps the best k of each query over its blocks and hands
on only those. So vectors are dealt once and never copied, and a task holds one block, one round of queries and
their best k, however many rows there are; blocks and rounds are smaller (BYTES) for long vectors. Vectors are
dealt by a hash of their numbers, so a vector that a third of all rows share makes no task larger.

Defined results: a vector that is null or holds null, NaN or infinite components takes no part, nor does a row
with null id. Missing components of shorter vectors count as zero. Rows are told apart by themselves, not by
their ids: all rows of one id are candidates, and each such row that asks has ranks of its own, the others of
that id among them; ties of id go to either. Quantised components beyond 64 bits are held at their ends, and so
is a score (rows are ranked by the exact one). An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import save, spread

BLOCK, ROUND, BYTES, WIDE, TOGETHER = 1 << 15, 1 << 15, 1 << 24, 1 << 24, 16
LOW = (1 << 62) - 1


def is_wide(values: np.ndarray) -> np.ndarray:
    return ((values > WIDE) | (values < -WIDE)).any(axis=1) if values.shape[1] else np.zeros(len(values), bool)


class Index:
    """The slices of one block. ids ascending; rows: the numbers of the rows; values: rows by attributes."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
        self.ids, self.numbers, self.values = ids, rows, values.astype(np.int64)
        n, width = values.shape
        wide = is_wide(self.values)
        self.wide = np.flatnonzero(wide)
        narrow = self.values[~wide]
        self.low, self.high = (f(narrow, axis=0) if len(narrow) else np.zeros(width, np.int64) for f in (np.min, np.max))
        self.words = -(-n // 64) or 1
        self.slices = [np.zeros(self.words, np.uint64)]
        self.at: dict[tuple[int, bool], list[int]] = {}
        for d in range(width):
            own = np.where(wide, self.low[d], self.values[:, d])
            for negative in (False, True):
                part = self.high[d] - own if negative else own - self.low[d]
                bits = int(self.high[d] - self.low[d]).bit_length()
                self.at[d, negative] = list(range(len(self.slices), len(self.slices) + bits))
                self.slices += [self.packed(part >> j & 1) for j in range(bits)]
        self.all = np.stack(self.slices)
        self.rows = self.packed(~wide)

    def packed(self, bits: np.ndarray) -> np.ndarray:
        out = np.zeros(self.words * 8, np.uint8)
        own = np.packbits(bits.astype(np.uint8), bitorder="little")
        out[: len(own)] = own
        return out.view(np.uint64)

    def sums(self, queries: np.ndarray) -> list[np.ndarray]:
        """Slices of the scores of all rows (less a constant for each query), least significant first."""
        lists: list[list[list[int]]] = []
        for i, q in enumerate(queries.tolist()):
            for d, v in enumerate(q):
                for e in range(abs(v).bit_length()):
                    if abs(v) >> e & 1:
                        for j, s in enumerate(self.at[d, v < 0]):
                            while len(lists) <= j + e:
                                lists.append([[] for _ in queries])
                            lists[j + e][i].append(s)
        out, carries = [], []
        w = 0
        while w < len(lists) or carries:
            ready, carries = carries, []
            todo = ready
            if w < len(lists):
                longest = max(map(len, lists[w]))
                table = np.zeros((longest, len(queries)), np.int64)  # 0: the empty slice
                for i, own in enumerate(lists[w]):
                    table[: len(own), i] = own
                todo = [*ready, *table]
            total = None
            place = 0
            get = lambda x: self.all[x] if x.ndim == 1 else x
            while place < len(todo):
                a = get(todo[place])
                if total is None:
                    total, place = a, place + 1
                    continue
                if place + 1 < len(todo):
                    b = get(todo[place + 1])
                    half = total ^ a
                    carries.append((total & a) | (half & b))
                    total, place = half ^ b, place + 2
                else:
                    carries.append(total & a)
                    total, place = total ^ a, place + 1
            out.append(total if total is not None else np.zeros((len(queries), self.words), np.uint64))
            w += 1
        return out

    def chosen(self, own: int, slices: list[np.ndarray], at: int, k: int) -> np.ndarray:
        """Places of the k best rows in the slices, but for the row with the number own."""
        sure, open_, held = np.zeros(self.words, np.uint64), self.rows.copy(), 0
        for place in np.flatnonzero(self.numbers == own):
            open_[place >> 6] &= ~np.uint64(1 << int(place & 63))
        for s in reversed(slices):
            high = open_ & s[at]
            n = int(np.bitwise_count(high).sum())
            if held + n > k:
                open_ = high
            else:
                sure |= high
                held += n
                open_ &= ~s[at]
                if held == k:
                    open_[:] = 0
                    break
        ties = np.flatnonzero(np.unpackbits(open_.view(np.uint8), bitorder="little"))[: k - held]
        return np.concatenate([np.flatnonzero(np.unpackbits(sure.view(np.uint8), bitorder="little")), ties])

    def best(self, query: np.ndarray, own: int, slices: list[np.ndarray] | None, at: int, k: int) -> tuple[np.ndarray, list[int] | np.ndarray]:
        """Places and scores of the k best rows but that with the number own, best first. slices: none for a wide query."""
        if slices is not None and not len(self.wide):
            rows = self.chosen(own, slices, at, k)
            scores = self.values[rows] @ query
            order = np.lexsort((rows, -scores))
            return rows[order], scores[order]
        rows = np.arange(len(self.ids)) if slices is None else np.concatenate([self.chosen(own, slices, at, k), self.wide])
        rows = rows[self.numbers[rows] != own]
        scores = (self.values[rows].astype(object) * query.astype(object)).sum(axis=1) if len(rows) else np.zeros(0, object)
        order = sorted(range(len(rows)), key=lambda i: (-scores[i], rows[i]))[:k]
        return rows[order], [int(scores[i]) for i in order]


def quantised(vector: str, scale: int) -> Column:
    """floor(scale * x) of each component, or null for vectors that take no part."""
    x = F.col(vector)
    sound = x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < F.lit(float("inf"))))
    return F.when(sound, F.transform(x, lambda v: F.floor(v.cast("double") * scale)))


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Lists of whole numbers as rows of that width, with zeros behind the shorter ones."""
    own = np.zeros((len(lists), width), np.int64)
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
    own[np.arange(width) < lengths[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return own


class Best:
    """The k best rows of each of n queries so far, by score and then id: high and low halves of scores, ids, scores."""

    def __init__(self, n: int, k: int) -> None:
        self.k, self.none = k, np.ones((n, k), bool)
        self.columns = [np.zeros((n, k), np.int64) for _ in range(4)]

    def add(self, first: int, found: list[tuple[np.ndarray, list[int] | np.ndarray]]) -> None:
        """found: ids and scores for each of the queries from the first on."""
        none = np.ones((len(found), self.k), bool)
        new = [np.zeros((len(found), self.k), np.int64) for _ in range(4)]
        for i, (ids, scores) in enumerate(found):
            if isinstance(scores, np.ndarray):
                halves = scores >> 62, scores & LOW, ids, scores
            else:
                held = lambda x: max(-(1 << 63), min((1 << 63) - 1, x))
                halves = [held(s >> 62) for s in scores], [s & LOW for s in scores], ids, [held(s) for s in scores]
            none[i, : len(ids)] = False
            for column, own in zip(new, halves, strict=True):
                column[i, : len(ids)] = own
        at = slice(first, first + len(found))
        none = np.concatenate([self.none[at], none], axis=1)
        both = [np.concatenate([old[at], own], axis=1) for old, own in zip(self.columns, new, strict=True)]
        order = np.lexsort((both[2], -both[1], -both[0], none), axis=1)[:, : self.k]
        self.none[at] = np.take_along_axis(none, order, 1)
        for old, own in zip(self.columns, both, strict=True):
            old[at] = np.take_along_axis(own, order, 1)


def top_k(vectors: DataFrame, queries: Column, k: int = 20, scale: int = 64, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products of each row where queries (a condition) holds."""
    spark = vectors.sparkSession
    taken = vectors.select(F.col(id_column).cast("long").alias("id"), quantised(vector, scale).alias("q"), F.coalesce(queries, F.lit(False)).alias("asked")).where("id is not null and q is not null")
    sound, _ = save(taken.withColumn("row", F.monotonically_increasing_id()), "vectors")  # written, so numbers stay
    n, asked, width = sound.agg(F.count("*"), F.count_if("asked"), F.coalesce(F.max(F.size("q")), F.lit(0))).head()
    fit = max(1, BYTES // (8 * max(1, width)))
    block, rounds = min(BLOCK, fit), max(1, -(-asked // min(ROUND, fit)))
    schema = "query_id long, query_row long, high long, low long, vec_id long, score long"
    tasks = max(1, min(spread(spark), 2 * spark.sparkContext.defaultParallelism, -(-4 * n // block)))  # small blocks cost more for each row
    dealt = sound.select("id", "row", "q").repartition(tasks, "row")

    def scored(part: int) -> DataFrame:
        own = sound.where(F.col("asked") & (F.pmod(F.xxhash64("row"), F.lit(rounds)) == part)).select("id", "row", "q").toArrow().combine_chunks()
        ids, numbers = (own.column(c).to_numpy() for c in ("id", "row"))
        values = _matrix(pa.concat_arrays(own.column("q").chunks), width) if own.num_rows else np.zeros((0, width), np.int64)
        size = next(t for t in (np.int8, np.int16, np.int32, np.int64) if not values.size or np.iinfo(t).min <= values.min() and values.max() <= np.iinfo(t).max)
        sent = spark.sparkContext.broadcast((ids, numbers, values.astype(size)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, numbers, ask = sent.value
            ask = ask.astype(np.int64)
            wide, best = is_wide(ask), Best(len(ids), k)

            def meet(own: list[np.ndarray]) -> None:
                order = np.lexsort((own[1], own[0]))
                index = Index(*(x[order] for x in own))
                for i in range(0, len(ids), TOGETHER):
                    slices = index.sums(np.where(wide[i : i + TOGETHER, None], 0, ask[i : i + TOGETHER]))
                    found = []
                    for j in range(i, min(i + TOGETHER, len(ids))):
                        rows, scores = index.best(ask[j], numbers[j], None if wide[j] else slices, j - i, k)
                        found.append((index.ids[rows], scores))
                    best.add(i, found)

            held, n = [], 0
            for batch in batches:
                held.append([batch.column(0).to_numpy(), batch.column(1).to_numpy(), _matrix(batch.column(2), width)])
                n += len(batch)
                if n >= block:
                    whole = [np.concatenate(x) for x in zip(*held, strict=True)]
                    for a in range(0, n - block + 1, block):
                        meet([x[a : a + block] for x in whole])
                    held, n = [[x[n - n % block :] for x in whole]], n % block
            if n:
                meet([np.concatenate(x) for x in zip(*held, strict=True)])
            for a in range(0, len(ids), 1024):
                there = ~best.none[a : a + 1024]
                which = a + np.nonzero(there)[0]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[which], numbers[which], *(c[a : a + 1024][there] for c in best.columns))], schema.replace(" long", "").split(", "))

        return dealt.mapInArrow(run, schema)

    per_task = reduce(DataFrame.union, [scored(part) for part in range(rounds)])
    order = Window.partitionBy("query_row").orderBy(F.desc("high"), F.desc("low"), "vec_id")
    return per_task.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
