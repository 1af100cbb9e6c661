"""Operator 9: approximate nearest neighbours by a permutation index.

A vector is represented by its nearest pivots in order.  Each block of rows keeps one inverted
file per pivot: of every row the place that the pivot has among the row's DEPTH nearest, DEPTH itself beyond
them, one byte each.  A query reads the files of its own READ nearest pivots and adds up the footrule
distance, the differences of places.  The CANDIDATES times square root of the block's rows of the smallest
footrule are reranked by exact Euclidean distance.  With ``exact`` their k-th distance then bounds the search: of the
other vectors all whose distance by single-precision inner products, less its rounding error, does not exceed it
are reranked, too, so the k found are the k nearest; those products are one matrix product per CHUNK of queries.

Plan: rows of each vector length are dealt to blocks by a hash, one block a task while tasks allow; queries go to every block of
their length.  A task reads a block's rows first, chooses its pivots from a bounded sample of them and builds the files once, then
streams the queries past them.  A block returns its best k per query, of which the best k remain.  No pairs of rows are made but those k.

Cost: READ bytes per query and row, and with ``exact`` an inner product: quadratic in rows, as queries are a share of them.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part, as query or
candidate, nor do rows with a null vec_id; only vectors of equal length are neighbours; equal distances go to
the smaller vec_id; exact repeats of a row are one; rows that repeat a vec_id with different vectors are each a
candidate and ask as one query, whose neighbours are the k nearest of any of them; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .embedding_dedup import usable
from .shared import mix64, release, written

PIVOTS, SAMPLE, DEPTH, READ = 256, 4096, 64, 32
CANDIDATES = 16
BLOCKS, LEAST_BLOCK, MOST_BLOCK, CHUNK = 16, 4096, 65536, 64
#: Tasks that search at most; beyond it a task takes several blocks, one after the other.
MOST_TASKS = 1 << 16


def pick_pivots(sample: np.ndarray, n: int = PIVOTS, apart: float = 1e-6) -> np.ndarray:
    """The first n of the sample that are no copies, or nearly so, of ones before them."""
    picked: list[int] = []
    for i in range(len(sample)):
        if not picked or np.linalg.norm(sample[picked] - sample[i], axis=1).min() > apart * np.linalg.norm(sample[i]):
            picked.append(i)
            if len(picked) == n:
                break
    return sample[picked]


def nearest_pivots(x: np.ndarray, pivots: np.ndarray, depth: int) -> np.ndarray:
    """For each row its nearest pivots in order."""
    squares, out = (pivots * pivots).sum(axis=1), np.empty((len(x), min(depth, len(pivots))), np.int16)
    for a in range(0, len(x), 4096):
        out[a : a + 4096] = np.argsort(squares - 2 * (x[a : a + 4096] @ pivots.T), axis=1, kind="stable")[:, :depth]
    return out


class PermutationIndex:
    """Inverted files of one block."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, pivots: np.ndarray):
        self.x, self.ids, self.pivots = x, ids, pivots
        self.squares = (x * x).sum(axis=1)
        with np.errstate(over="ignore"):
            self.single = x.astype(np.float32)
        self.depth = min(DEPTH, len(pivots))
        self.files = np.full((len(pivots), len(x)), self.depth, np.int8)
        order, rows = nearest_pivots(x, pivots, self.depth), np.arange(len(x))
        for place in range(self.depth):
            self.files[order[:, place], rows] = place

    def products(self, queries: np.ndarray) -> np.ndarray:
        """Inner products of queries and rows in single precision."""
        with np.errstate(over="ignore", invalid="ignore"):
            return queries.astype(np.float32) @ self.single.T

    def candidates(self, order: np.ndarray) -> np.ndarray:
        """Whether a row's footrule is among the smallest; all rows of the last value that takes part do."""
        foot, step = np.zeros(len(self.x), np.int16), np.empty(len(self.x), np.int8)
        for place, p in enumerate(order[:READ]):
            np.subtract(self.files[p], np.int8(place), out=step)
            np.abs(step, out=step)
            foot += step
        upto = np.cumsum(np.bincount(foot))
        n = min(len(foot), int(np.ceil(CANDIDATES * np.sqrt(len(foot)))))
        return foot <= np.searchsorted(upto, n)

    def search(self, query: np.ndarray, order: np.ndarray, own: int, k: int, products: np.ndarray | None = None, exact: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """(row numbers, distances) of the k nearest rows but those of the query's own id."""
        others = self.ids != own
        near = self.candidates(order) & others
        rows = np.flatnonzero(near)
        d = self.distances(rows, query)
        if len(rows) < k:
            rest = ~near & others
        elif exact:
            own_square = query @ query
            with np.errstate(over="ignore", invalid="ignore"):
                error = 4 * (len(query) + 8) * np.finfo(np.float32).eps * (np.sqrt(self.squares) + np.sqrt(own_square)) ** 2
                got = self.products(query[None])[0] if products is None else products
                beyond = self.squares + own_square - 2.0 * got - error > np.partition(d, k - 1)[k - 1] ** 2
            rest = ~beyond & ~near & others  # a product that overflows is not beyond
        else:
            rest = np.zeros(len(self.x), bool)
        more = np.flatnonzero(rest)
        rows, d = np.concatenate([rows, more]), np.concatenate([d, self.distances(more, query)])
        best = np.lexsort((self.ids[rows], d))[:k]
        return rows[best], d[best]

    def distances(self, rows: np.ndarray, query: np.ndarray) -> np.ndarray:
        """Components are added one after the other, so a distance does not depend on the block's shape."""
        total = np.zeros(len(rows))
        apart = np.ascontiguousarray((self.x[rows] - query).T)
        apart *= apart
        for c in apart:
            total += c
        return np.sqrt(total)


def _searched(k: int, exact: bool):  # noqa: ANN202
    """Of each block, whose rows come before its queries, the best k of every query."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        at: int | None = None
        parts: list[pa.RecordBatch] = []
        index: PermutationIndex | None = None
        for batch in batches:
            ids, blocks, asks = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "block", "asks"))
            border = np.flatnonzero((blocks[1:] != blocks[:-1]) | (asks[1:] != asks[:-1])) + 1
            for a, b in zip([0, *border], [*border, len(ids)], strict=True) if len(ids) else ():
                if blocks[a] != at:
                    at, parts, index = blocks[a], [], None
                part = batch.slice(a, b - a)
                if not asks[a]:
                    parts.append(part)
                    continue
                if index is None and parts:
                    index, parts = _index(parts), []
                if index is None:
                    continue
                x = _matrix(part.column("e"))
                for q in range(0, len(x), CHUNK):
                    own = x[q : q + CHUNK]
                    orders = nearest_pivots(own, index.pivots, index.depth)
                    products = index.products(own) if exact else [None] * len(own)
                    got = [(i, *index.search(v, o, i, k, p, exact)) for v, o, i, p in zip(own, orders, ids[a + q : a + q + CHUNK], products, strict=True)]
                    size = [len(rows) for _, rows, _ in got]
                    yield pa.record_batch([pa.array(np.repeat([i for i, *_ in got], size), pa.int64()), pa.array(np.concatenate([index.ids[rows] for _, rows, _ in got]), pa.int64()), pa.array(np.concatenate([d for *_, d in got]), pa.float64())], ["query_id", "vec_id", "score"])

    return found


def _matrix(vectors: pa.Array) -> np.ndarray:
    return vectors.flatten().to_numpy().reshape(len(vectors), -1)


def _index(parts: list[pa.RecordBatch]) -> PermutationIndex:
    t = pa.Table.from_batches(parts).combine_chunks()
    x, place = _matrix(t.column("e").combine_chunks()), t.column("place").to_numpy()
    sample = np.argsort(mix64(place.view(np.uint64)), kind="stable")[:SAMPLE]
    return PermutationIndex(x, t.column("vec_id").to_numpy(), pick_pivots(x[sample]))


def nearest(vectors: DataFrame, k: int = 10, every: int = 100, exact: bool = True) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose vec_id is divisible by ``every`` its k nearest found.

    exact: verify against the bound; without it the index alone answers.
    """
    wide = F.transform("embedding", lambda x: x.cast("double"))
    good = vectors.where(usable("embedding") & F.col("vec_id").isNotNull()).select("vec_id", wide.alias("e"), F.size("embedding").alias("dim"))
    good = written(good.distinct().withColumn("asks", F.pmod("vec_id", F.lit(every)) == 0), "search-rows")
    sizes = good.groupBy(F.col("dim").alias("d")).agg(F.count("*").alias("total"), F.count_if("asks").alias("n_queries")).where("n_queries > 0")
    size = F.least(F.lit(MOST_BLOCK), F.greatest(F.lit(LEAST_BLOCK), F.ceil(F.col("total") / BLOCKS)))
    sizes = sizes.withColumn("blocks", F.ceil(F.col("total") / size))
    before = Window.orderBy("d").rowsBetween(Window.unboundedPreceding, -1)  # over the lengths that there are
    sizes = written(sizes.select("d", "blocks", F.coalesce(F.sum("blocks").over(before), F.lit(0)).alias("first")), "search-blocks")
    tasks = min(MOST_TASKS, sizes.agg(F.sum("blocks")).first()[0] or 1)
    placed = good.join(sizes, good["dim"] == sizes["d"]).withColumn("place", F.xxhash64("vec_id", "e", F.lit("block")))
    columns = ["block", "asks", "place", "vec_id", "e"]
    rows = placed.withColumn("block", F.col("first") + F.pmod("place", F.col("blocks"))).withColumn("asks", F.lit(False)).select(*columns)
    asked = placed.where("asks").withColumn("block", F.explode(F.expr("sequence(first, first + blocks - 1)"))).select(*columns)
    dealt = rows.unionByName(asked).repartitionById(tasks, F.col("block").cast("int")).sortWithinPartitions("block", "asks")
    found = dealt.mapInArrow(_searched(k, exact), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
