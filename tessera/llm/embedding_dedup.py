"""Operator 8: embedding near-duplicates by randomised-rotation binary codes.

Vectors of unit length are rotated by one random orthogonal matrix; the signs of the result are a
vector's code, and the inner product of code and vector is stored as its correction
factor.  Against a vector with four-bit rotated components, sums of bits estimate the inner
product without bias, and the factor bounds the error.  Only pairs whose upper confidence
bound reaches the threshold are recomputed exactly, in double precision.

Plan: every vector is coded once, into a written table of its code, its correction factor, the four bit planes of its rotated
components with their offset and step, and its norm.  Pairs are compared within a label only, in tiles of two blocks of rows; a
hot label has more tiles, not larger ones.  A tile compares stored codes with stored planes; the vectors that it carries in
the input's own type serve the exact recomputation alone (pairs in doubt within a group of copies are too
many to be rows of their own).  A tile returns counts of links by vector and a spanning forest of its
links, never pairs, so a group of n copies costs n rows.  Components come from the forests.
The number of code comparisons is quadratic in a label's rows: 64 dimensions are one machine word each.

Defined results: null and empty vectors, zero vectors, ones with null or non-finite components and rows
with a null label or vec_id link with nothing (n_links 0, component_id vec_id itself); vectors of unequal
length never link; exact repeats of a row are one vector, and each of them gets its result;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .shared import U64, components, mix64, release, written

#: Half-width of the confidence bounds in standard deviations.
SIGMAS = 6.0
LEAST_BLOCK, MOST_BLOCK, BLOCKS = 1024, 16384, 8
STRIP = 256


def usable(vector: str) -> Column:
    """True for vectors of finite components, not all zero."""
    v = F.col(vector)
    wide = F.transform(v, lambda x: x.cast("double"))
    fine = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(v.isNotNull() & fine & F.exists(wide, lambda x: x != 0.0), F.lit(False))


@functools.lru_cache(4)
def rotation(dim: int, seed: int = 17) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def codes(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(packed signs, correction factors, rotated vectors) of unit vectors."""
    rotated = unit @ rotation(unit.shape[1])
    signs = rotated > 0
    pad = -signs.shape[1] % 64
    packed = np.packbits(np.pad(signs, ((0, 0), (0, pad))), axis=1).view(np.uint64)
    return packed, np.abs(rotated).sum(axis=1) / np.sqrt(unit.shape[1]), rotated


def quantised(rotated: np.ndarray, noise: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bit planes of the four-bit components, offset, step, sum of the components) of rotated vectors; noise in [0, 1) rounds without bias."""
    pad = -rotated.shape[1] % 64
    low = rotated.min(axis=1, keepdims=True)
    step = np.maximum((rotated.max(axis=1, keepdims=True) - low) / 15, 1e-30)
    q = np.clip(np.floor((rotated - low) / step + noise), 0, 15).astype(np.uint8)
    planes = np.stack([np.packbits(np.pad((q >> bit & 1).astype(bool), ((0, 0), (0, pad))), axis=1).view(np.uint64) for bit in range(4)], axis=1)
    return planes, low[:, 0], step[:, 0], q.sum(axis=1, dtype=np.int64)


def compared(packed: np.ndarray, factor: np.ndarray, planes: np.ndarray, low: np.ndarray, step: np.ndarray, total: np.ndarray, dim: int, cos: float) -> tuple[np.ndarray, np.ndarray]:
    """Unbiased estimates of the inner products, coded vectors x quantised ones, and the half-widths of their bounds.

    The bounds hold for pairs of at least the inner product ``cos``.
    """
    sums = np.zeros((len(packed), len(planes)), np.int32)
    for bit in range(4):
        for w in range(packed.shape[1]):
            sums += np.bitwise_count(packed[:, w, None] & planes[None, :, bit, w]).astype(np.int32) << bit
    ones = np.bitwise_count(packed).sum(axis=1, dtype=np.int64)
    inner = (2 * step * sums + 2 * low * ones[:, None] - step * total - dim * low) / np.sqrt(dim)
    f = factor[:, None]
    spread = np.sqrt(max(0.0, 1 - cos * cos)) * np.sqrt(np.maximum(0, 1 - f * f) / (max(dim - 1, 1) * f * f)) + step / 2 / f
    return inner / f, SIGMAS * spread


def estimates(packed: np.ndarray, factor: np.ndarray, rotated: np.ndarray, cos: float, seed: int = 23) -> tuple[np.ndarray, np.ndarray]:
    """The same against rotated vectors, quantised here."""
    return compared(packed, factor, *quantised(rotated, np.random.default_rng(seed).random(rotated.shape)), rotated.shape[1], cos)


@dataclass
class Coded:
    """Rows of one length with what is stored of them."""

    x: np.ndarray
    norm: np.ndarray
    packed: np.ndarray
    factor: np.ndarray
    planes: np.ndarray
    low: np.ndarray
    step: np.ndarray
    total: np.ndarray

    def __getitem__(self, rows: np.ndarray | slice) -> Coded:
        return Coded(*(getattr(self, f.name)[rows] for f in fields(self)))


def tile_links(a: Coded, b: Coded, cos: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Indices (i, j) of the pairs with cosine >= cos, found through codes and recomputed exactly; i < j where a is b."""
    found_i, found_j = [], []
    for s in range(0, len(b.x), STRIP):
        strip = b[s : s + STRIP]
        est, half = compared(a.packed, a.factor, strip.planes, strip.low, strip.step, strip.total, a.x.shape[1], cos)
        near = est + half >= cos
        if same:
            near &= np.arange(len(a.x))[:, None] < np.arange(s, s + len(strip.x))
        i, j = np.nonzero(near)
        for k in range(0, len(i), 1 << 16):
            p, q = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
            exact = (a.x[p] * strip.x[q]).sum(axis=1) / (a.norm[p] * strip.norm[q])
            found_i.append(p[exact >= cos])
            found_j.append(q[exact >= cos] + s)
    z = np.zeros(0, np.int64)
    return np.concatenate(found_i or [z]), np.concatenate(found_j or [z])


def forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """For each of n places the smallest place that the links (i, j) reach."""
    root = np.arange(n)
    while len(i):
        m = root.copy()
        np.minimum.at(m, i, root[j])
        np.minimum.at(m, j, root[i])
        while not np.array_equal(m, m[m]):
            m = m[m]
        if np.array_equal(m, root):
            break
        # hook roots, too
        np.minimum.at(m, root, m)
        root = m[m]
    return root


STORED = "norm double, factor double, low double, step double, total long, code binary, planes binary"


def _stored(columns: list[str]):  # noqa: ANN202
    """Rows with their codes; columns hold vec_id, row_key, dim and the vector e."""

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for d in np.unique(dims):
                own = batch.filter(pa.array(dims == d))
                x, keys = _vectors(own.column("e")), own.column("row_key").to_numpy().view(np.uint64)
                norm = np.sqrt((x * x).sum(axis=1))
                packed, factor, rotated = codes(x / norm[:, None])
                noise = mix64(keys[:, None] + np.arange(1, d + 1, dtype=np.uint64) * U64(0x9E3779B97F4A7C15)) / 2.0**64
                planes, low, step, total = quantised(rotated, np.minimum(noise, 1 - 1e-12))
                numbers = [pa.array(v, pa.float64()) for v in (norm, factor, low, step)]
                blobs = [pa.array([v.tobytes() for v in m], pa.binary()) for m in (packed, planes)]
                yield pa.record_batch([*own.columns, *numbers, pa.array(total, pa.int64()), *blobs], [*columns, *(c.split()[0] for c in STORED.split(", "))])

    return coded


def _vectors(e: pa.Array) -> np.ndarray:
    """List entries as rows of doubles."""
    return e.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(e), -1)


def _words(blobs: pa.ChunkedArray, *shape: int) -> np.ndarray:
    return np.frombuffer(b"".join(b.as_py() for b in blobs), np.uint64).reshape(len(blobs), *shape, -1)


def embedding_duplicates(vectors: DataFrame, cos: float = 0.93) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``vectors`` (vec_id, embedding, label)."""
    base = vectors.select("vec_id", "label", F.col("embedding").alias("e"), F.xxhash64("vec_id", "label", "embedding").alias("row_key"))
    good = base.where(usable("e") & F.col("vec_id").isNotNull() & F.col("label").isNotNull()).dropDuplicates(["vec_id", "row_key"])
    own_type = good.schema["e"].dataType.elementType.simpleString()
    e = F.col("e") if own_type in ("float", "double") else F.transform("e", lambda x: x.cast("double"))
    good = good.select("vec_id", "row_key", "label", e.alias("e"), F.size("e").alias("dim"))
    schema = StructType(good.schema.fields + StructType.fromDDL(STORED).fields)
    good = written(good.mapInArrow(_stored(good.columns), schema), "vectors")
    sizes = good.groupBy("label", "dim").count().select(F.col("label").alias("l"), F.col("dim").alias("d"), "count")
    block = F.greatest(F.lit(LEAST_BLOCK), F.least(F.lit(MOST_BLOCK), F.ceil(F.col("count") / BLOCKS)))
    placed = good.join(sizes, (good["label"] == sizes["l"]) & (good["dim"] == sizes["d"])).withColumn("blocks", F.ceil(F.col("count") / block))
    placed = placed.withColumn("own", F.pmod(F.xxhash64("vec_id", "row_key"), F.col("blocks")))
    other = F.explode(F.expr("sequence(0L, blocks - 1)"))
    tiles = placed.select("label", "own", "vec_id", "row_key", "e", "dim", *(c.split()[0] for c in STORED.split(", ")), other.alias("other"))
    tiles = tiles.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("other")

    def linked(t: pa.Table) -> pa.Table:
        own, i, j = (t.column(c).to_numpy() for c in ("own", "i", "j"))
        ids, keys = t.column("vec_id").to_numpy(), t.column("row_key").to_numpy()
        number = {c: t.column(c).to_numpy() for c in ("norm", "factor", "low", "step", "total")}
        every = Coded(_vectors(t.column("e").combine_chunks()), packed=_words(t.column("code")), planes=_words(t.column("planes"), 4), **number)
        p, q = np.flatnonzero(own == i), np.flatnonzero(own == j)
        if i[0] == j[0]:
            p = q = np.lexsort((keys, ids))
        a, b = tile_links(every[p], every[q], cos, i[0] == j[0])
        a, b = p[a], q[b]
        apart = ids[a] != ids[b]
        a, b = a[apart], b[apart]
        count = np.bincount(a, minlength=len(ids)) + np.bincount(b, minlength=len(ids))
        rank = np.argsort(ids, kind="stable")
        place = np.empty(len(ids), np.int64)
        place[rank] = np.arange(len(ids))
        root = ids[rank[forest(place[a], place[b], len(ids))]][place]
        hit = count > 0
        return pa.table({"vec_id": ids[hit], "row_key": keys[hit], "links": count[hit], "root": root[hit]})

    part = written(tiles.groupBy("label", "dim", "i", "j").applyInArrow(linked, "vec_id long, row_key long, links long, root long"), "links")
    degree = part.groupBy(F.col("vec_id").alias("v"), F.col("row_key").alias("k")).agg(F.sum("links").alias("n_links"))
    groups = components(part.select(F.col("vec_id").alias("a"), F.col("root").alias("b")))
    degree = degree.join(groups, degree["v"] == groups["node"], "left")
    out = base.join(degree, (base["vec_id"] == degree["v"]) & (base["row_key"] == degree["k"]), "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
