"""Operator 7: MinHash near-duplicates by improved consistent weighted sampling.

A document is a weighted set of five-word shingles: a shingle's count times its inverse document
frequency, 1 + ln((n + 1) / (df + 1)) / ln(n + 1), between 1 and 2.  Document frequencies are counted over
all documents in 2^20 hashed cells.  Improved consistent weighted sampling (r and c from a
Gamma distribution, beta uniform, the smallest ln a = ln c - r (floor(ln S / r + beta) - beta + 1))
draws K samples; two documents agree in one with probability their weighted Jaccard similarity.  BANDS
bands of ROWS samples find candidates; a pair is linked if its exact weighted
Jaccard similarity is at least ``least``.  With ``plain`` (op7 and the pipeline) as many bands of plain MinHash samples of the sets of
shingles find candidates, too, and a pair is also linked if its plain Jaccard similarity is at least ``least``, so
edits weigh no more in a large group than in a pair.  Classes are the components of links and exact copies.

Plan.  Copies (equal word sequences) collapse by a grouped minimum first, so a group of copies is one
row.  In each band bucket every member is verified against one hub, the member that shares most
buckets with others: as many pairs as rows.  Members that this leaves in different components are compared among
each other by their samples, in tiles of bounded size, twice: first each member's most similar one alone is
verified, again as many pairs as rows, which joins most of a large group; then, for what is still
apart, all pairs whose WIDE samples agree often enough for the threshold (no more than SIGMAS standard deviations
below), each in its first common band alone.
Texts travel compressed, to requests by document; what is broadcast is the table of 2^20 frequencies.
Nothing else reaches the driver.

A pair of similarity 0.8 is missed by all bands with probability 7e-5, one of 0.85 with 8e-7.

Defined results: a null text, or one without words, is a class of its own, as is a row with a null doc_id (class
null); a text of one to four words is one shingle; rows that repeat a doc_id with the same text are one document, ones
with different texts are documents of their own, of which in one class the one of the smallest key stays;
a class is named by its smallest doc_id, which is the one that stays; an empty table
gives an empty result; other columns are carried by ``near_distinct``, ignored otherwise.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import U64, components, mix64, pack_arrays, pack_rows, partitions, release, runs_of, span_hashes, steps, summed_blocks, text_buffers, unpack_arrays, window_hashes, word_spans, written
from .substring_dedup import GROUPED, ROWS_BYTES, Documents, by_group, dealt, grouped_rows, record_batches, split_by

SHINGLE = 5
BANDS, ROWS = 24, 5
K = BANDS * ROWS
CELL_BITS, BLOCK = 20, 1 << 14
CELLS = 1 << CELL_BITS
SIGMAS = 3.5
WIDE = 1024
TILE, SLOT = 512, 1024
STEP = 1 << 18
#: Rows of tiles that are looked at together, and pairs that are compared at once.
TILE_ROWS, PAIRS = 8192, 1 << 15

_rng = np.random.default_rng(31)
_SEEDS = _rng.integers(0, 1 << 63, WIDE, np.uint64)
_ODD = U64(0xD6E8FEB86659FD93)


#: Samples take a weight's logarithm in steps of 1 / LEVELS; those from LOW on are in the table, rarer ones are computed.
LEVELS, LOW, HIGH = 8, -8, 21
DRAWS = 1 << 16


@functools.cache
def _draws() -> tuple[np.ndarray, ...]:
    """(r, beta, ln c) of 65,536 draws, which a shingle picks one of for each sample."""
    rng = np.random.default_rng(37)
    r = rng.gamma(2.0, 1.0, DRAWS)
    c = rng.gamma(2.0, 1.0, DRAWS)
    return r, rng.random(DRAWS), np.log(c)


def _drawn(draw: np.ndarray, level: np.ndarray) -> np.ndarray:
    """ln a for draws and levels of weight, as numbers in the high half of a machine word that order like it."""
    r, beta, log_c = (x[draw] for x in _draws())
    a = log_c - r * (np.floor(level / LEVELS / r + beta) - beta + 1)
    bits = a.astype(np.float32).view(np.uint32)
    return np.where(bits >> np.uint32(31), ~bits, bits | np.uint32(1 << 31)).astype(np.uint64) << U64(32)


@functools.cache
def _table() -> np.ndarray:
    """The same for all draws and all levels from LOW to HIGH, in a row: 15 MB."""
    every = np.arange(DRAWS)
    return np.concatenate([_drawn(every, np.full(DRAWS, v)) for v in range(LOW, HIGH + 1)])


def shingles(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of 48 bits ascending within a text, counts, first, keys): text i has first[i] to first[i + 1];
    keys: 128 bits of each text's sequence of words."""
    n = len(off) - 1
    starts, ends, first = word_spans(data, off)
    size = np.diff(first)
    doc = np.repeat(np.arange(n), size)
    w = span_hashes(data, starts, ends)
    place = np.arange(len(w)) - first[:-1][doc]
    left = size[doc] - place
    at = np.flatnonzero(left >= SHINGLE)
    h = window_hashes(w, SHINGLE)[at] if len(at) else np.zeros(0, np.uint64)
    keys = np.zeros((n, 2), np.uint64)
    if len(w):
        some = np.flatnonzero(size)
        for k, salt in enumerate((U64(0x51ED270B7A1F35C3), U64(0xA0761D6478BD642F))):
            keys[some, k] = np.add.reduceat(mix64(w ^ mix64((place.astype(np.uint64) + U64(1)) * salt)), first[:-1][some])
    short = np.flatnonzero((size > 0) & (size < SHINGLE))
    h = np.concatenate([h, keys[short, 0]]) >> U64(16)
    owner = np.concatenate([doc[at], short])
    both = np.sort((owner.astype(np.uint64) << U64(48)) | h)
    run = runs_of(both)
    count = np.diff(np.append(run, len(both)))
    both = both[run]
    return both & U64((1 << 48) - 1), count, np.searchsorted(both >> U64(48), np.arange(n + 1).astype(np.uint64)), keys


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Documents by cell of their shingles, and documents, over all of ``docs``."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        total, n = np.zeros(CELLS, np.int64), 0
        for batch in batches:
            data, off = text_buffers(batch.column(0))
            for a, b in steps(data, off, STEP):
                h, _, first, _ = shingles(data[off[a] : off[b]], off[a : b + 1] - off[a])
                cell = (h >> U64(48 - CELL_BITS)).astype(np.int64)
                doc = np.repeat(np.arange(b - a), np.diff(first))
                new = np.ones(len(cell), bool)
                new[1:] = (cell[1:] != cell[:-1]) | (doc[1:] != doc[:-1])
                total += np.bincount(cell[new], minlength=CELLS)
                n += b - a
        for b in range(CELLS // BLOCK if n else 0):
            yield pa.record_batch([pa.array([b], pa.int32()), pa.array([n], pa.int64()), pa.array([pack_arrays(total[b * BLOCK : (b + 1) * BLOCK])], pa.binary())], ["block", "n", "counts"])

    df, n = np.zeros(CELLS, np.int64), 0
    for r in summed_blocks(docs.select("text").mapInArrow(counted, "block int, n long, counts binary")).collect():
        df[r.block * BLOCK : (r.block + 1) * BLOCK] = unpack_arrays(bytes(r.counts))[0]
        n = r.n
    return df, n


def inverse_frequencies(df: np.ndarray, n: int) -> np.ndarray:
    return (1 + np.log((n + 1) / (df + 1)) / np.log(max(n, 1) + 1)).astype(np.float32)


def weights(h: np.ndarray, count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return count * idf[(h >> U64(48 - CELL_BITS)).astype(np.int64)].astype(np.float64)


def samples(h: np.ndarray, weight: np.ndarray, first: np.ndarray, n: int = K) -> np.ndarray:
    """n samples of each text; texts without shingles are not to be passed."""
    table, level = _table(), np.maximum(np.rint(np.log(weight) * LEVELS), LOW).astype(np.int64)
    heavy = np.flatnonzero(level > HIGH)
    base, own = (np.minimum(level, HIGH) - LOW) * DRAWS, h & U64(0xFFFFFFFF)  # own tells shingles of one draw apart
    out = np.empty((len(first) - 1, n), np.uint64)
    mixed, a, at = np.empty(len(h), np.uint64), np.empty(len(h), np.uint64), np.empty(len(h), np.int64)
    draw, starts = mixed.view(np.uint16).reshape(-1, 4), first[:-1]
    for k in range(n):
        if k % 4 == 0:  # four draws from one word
            np.bitwise_xor(h, _SEEDS[k], out=mixed)
            np.multiply(mixed, _ODD, out=mixed)
            np.right_shift(mixed, U64(29), out=a)
            np.bitwise_xor(mixed, a, out=mixed)
            np.multiply(mixed, _ODD, out=mixed)
        np.add(base, draw[:, k % 4], out=at)
        np.take(table, at, out=a, mode="clip")
        if len(heavy):
            a[heavy] = _drawn(draw[heavy, k % 4], level[heavy])
        np.bitwise_or(a, own, out=a)
        out[:, k] = np.minimum.reduceat(a, starts)
    return mix64(out)


def plain_samples(h: np.ndarray, first: np.ndarray, n: int = K) -> np.ndarray:
    """n MinHash samples of each text's set of shingles; texts without shingles are not to be passed."""
    out = np.empty((len(first) - 1, n), np.uint64)
    i, t, starts = np.empty(len(h), np.uint64), np.empty(len(h), np.uint64), first[:-1]
    for k in range(n):
        np.bitwise_xor(h, _SEEDS[k], out=i)
        np.multiply(i, _ODD, out=i)
        np.right_shift(i, U64(29), out=t)
        np.bitwise_xor(i, t, out=i)
        np.multiply(i, _ODD, out=i)
        out[:, k] = np.minimum.reduceat(i, starts)
    return mix64(out)


def both_samples(h: np.ndarray, weight: np.ndarray, first: np.ndarray, plain: bool, n: int = K) -> list[np.ndarray]:
    return [samples(h, weight, first, n)] + [plain_samples(h, first, n)] * plain


def band_keys(s: np.ndarray, start: int = 0) -> np.ndarray:
    h = np.repeat(np.arange(start, start + BANDS, dtype=np.uint64)[None], len(s), axis=0)
    for k in range(ROWS):
        h = mix64(h * _ODD + s[:, k::ROWS])
    return h


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact weighted Jaccard similarity of two sorted weighted sets."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    low = np.minimum(a[1][i], b[1][j]).sum()
    return float(low / (a[1].sum() + b[1].sum() - low))


def plain_similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets of shingles, without weights."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


SIGNED = "doc_id long, h1 long, h2 long, bands array<long>, sketch binary"


def _signed(idf, plain: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:  # noqa: ANN001
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            batch = batch.filter(batch.column(0).is_valid())
            data, off = text_buffers(batch.column(1))
            for a, b in steps(data, off, STEP):
                h, count, first, keys = shingles(data[off[a] : off[b]], off[a : b + 1] - off[a])
                some = np.flatnonzero(np.diff(first) > 0)
                if not len(some):
                    continue
                s = both_samples(h, weights(h, count, idf.value), np.append(first[:-1][some], len(h)), plain)
                bands = np.hstack([band_keys(x, i * BANDS) for i, x in enumerate(s)]).view(np.int64)
                n = bands.shape[1]
                sketch = np.hstack([*(x.astype(np.uint8) for x in s), bands.view(np.uint32)[:, ::2].copy().view(np.uint8)])
                ids = batch.column(0).take(pa.array(some + a))
                k = keys[some].view(np.int64)
                yield pa.record_batch(
                    [ids, pa.array(k[:, 0].copy()), pa.array(k[:, 1].copy()), pa.ListArray.from_arrays(np.arange(0, len(some) * n + 1, n, dtype=np.int32), pa.array(bands.ravel())), pa.array([x.tobytes() for x in sketch], pa.binary())],
                    ["doc_id", "h1", "h2", "bands", "sketch"],
                )
        release()

    return rows


def _verified(texts: DataFrame, pairs: DataFrame, idf, least: float, plain: bool) -> DataFrame:  # noqa: ANN001
    """(a, b) of the pairs (hub, doc), a written table, whose exact similarity, or with plain one of the two, reaches ``least``.

    texts: packed texts by group.  A hub of more than SLOT members is compared in several places; there are few such hubs.
    """
    n = partitions(texts.sparkSession)
    hot = pairs.groupBy(F.col("hub").alias("h")).count().where(F.col("count") > SLOT).select("h", F.ceil(F.col("count") / SLOT).cast("int").alias("slots"))
    hot = written(hot, "hot-hubs")
    placed = pairs.join(hot, pairs["hub"] == hot["h"], "left").withColumn("slot", F.when(F.col("h").isNull(), 0).otherwise(F.pmod(F.xxhash64("doc"), F.col("slots"))).cast("int"))
    members = placed.select(F.col("doc").alias("doc_id"), "hub", "slot", F.lit(1).alias("role"))
    hubs = placed.select(F.col("hub").alias("doc_id"), "hub", "slot", F.lit(0).alias("role")).distinct()

    def requests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            ids, hub, slot, role = (c.to_numpy() for c in batch.columns)
            groups = Documents(ids, np.zeros(len(ids), np.uint32)).groups(n)
            yield from record_batches(((g, 0, pack_arrays(ids[i], hub[i], slot[i], role[i])) for g, i in split_by(groups)), GROUPED)

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for asked, rows in by_group(batches, Requests):
            ids, own = rows.column(0).to_pylist(), rows.column(1)
            out, size = [], 0
            for i, t in zip(ids, own, strict=True):
                if wanted := asked.of(i):
                    blob = pack_arrays(np.frombuffer((t.as_py() or "").encode(), np.uint8))
                    for hub, slot, role in wanted:
                        out.append((hub, slot, role, i, blob))
                        size += len(blob)
                        if size >= ROWS_BYTES:
                            yield _answers(out)
                            out, size = [], 0
            if out:
                yield _answers(out)

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        at, centre = None, None
        for batch in batches:
            a, b = [], []
            for hub, slot, role, i, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = unpack_arrays(blob)[0]
                h, count, _, _ = shingles(data, np.array([0, len(data)]))
                own = (h, weights(h, count, idf.value))
                if role == 0:
                    at, centre = (hub, slot), own
                elif at == (hub, slot) and len(h) and (similarity(own, centre) >= least or plain and plain_similarity(h, centre[0]) >= least):
                    a.append(hub)
                    b.append(i)
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    asked = members.unionByName(hubs).mapInArrow(requests, GROUPED)
    sent = texts.unionAll(asked).transform(dealt, n, "g", "kind").mapInArrow(answered, ANSWERED)
    return sent.repartition(n, "hub", "slot").sortWithinPartitions("hub", "slot", "role").mapInArrow(compared, "a long, b long")


ANSWERED = "hub long, slot int, role int, doc_id long, blob binary"


def _answers(rows: list[tuple]) -> pa.RecordBatch:
    hub, slot, role, i, blob = zip(*rows, strict=True)
    return pa.record_batch([pa.array(hub, pa.int64()), pa.array(slot, pa.int32()), pa.array(role, pa.int32()), pa.array(i, pa.int64()), pa.array(blob, pa.binary())], ["hub", "slot", "role", "doc_id", "blob"])


class Requests:
    """Who asks for which document of a group."""

    def __init__(self) -> None:
        self.by: dict[int, list[tuple[int, int, int]]] = {}

    def add(self, blob: bytes) -> None:
        for i, hub, slot, role in zip(*(x.tolist() for x in unpack_arrays(blob)), strict=True):
            self.by.setdefault(i, []).append((hub, slot, role))

    def of(self, doc: int) -> list[tuple[int, int, int]]:
        return self.by.get(doc, [])


def _least_agreement(least: float, n: int) -> float:
    """How many of n samples agree at least in a pair of similarity ``least``, but for SIGMAS standard deviations."""
    return n * (least - SIGMAS * np.sqrt(least * (1 - least) / n))


def _close_pairs(least: float, best: bool, plain: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Tiles in order, many small ones at a time."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= TILE_ROWS:
                t = pa.Table.from_batches(held).combine_chunks()
                last = int(_tiles(t)[-1])  # this tile may go on
                if last:
                    yield _close(t.slice(0, last), least, best, plain)
                held, size = t.slice(last).to_batches(), t.num_rows - last
        if size:
            yield _close(pa.Table.from_batches(held).combine_chunks(), least, best, plain)

    return found


def _tiles(t: pa.Table) -> np.ndarray:
    """Where tiles start."""
    return runs_of(*(t.column(c).to_numpy() for c in ("key", "kind", "i", "j")))


def _close(t: pa.Table, least: float, best: bool, plain: bool) -> pa.RecordBatch:
    """Of whole tiles the pairs of different components that may be similar enough.

    best: of each member of a tile the pair that agrees most, of equals the one with the smallest document; else all, each in its first common band.
    """
    ids, comp, side, kind, i, j, band = (t.column(c).to_numpy() for c in ("doc", "component", "side", "kind", "i", "j", "band"))
    raw = np.frombuffer(b"".join(x.as_py() for x in t.column("sketch")), np.uint8).reshape(len(ids), -1)
    kinds = 1 + plain
    n = raw.shape[1] // kinds - 4 * BANDS
    drawn, bands = [raw[:, c * n : (c + 1) * n] for c in range(kinds)], np.ascontiguousarray(raw[:, kinds * n :]).view(np.uint32)
    at = _tiles(t)
    tile = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(ids))))
    # Side 0 comes first; where a block meets itself there is no other side, and its members meet each other.
    first = np.add.reduceat(side == 0, at)
    alone = (kind[at] == 1) & (i[at] == j[at])
    start = np.where(alone, at, at + first)
    count = np.where(side == 0, np.where(alone, first, np.diff(np.append(at, len(ids))) - first)[tile], 0)
    upto = np.cumsum(count)
    got: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    a = 0
    while a < len(ids):
        b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + PAIRS, "right")))
        x = np.repeat(np.arange(a, b), count[a:b])
        y = np.arange(len(x)) - np.repeat(upto[a:b] - count[a:b] - (upto[a - 1] if a else 0), count[a:b]) + start[tile[x]]
        a = b
        keep = (comp[x] != comp[y]) & ((ids[y] > ids[x]) | ~alone[tile[x]])
        x, y, agree = x[keep], y[keep], np.zeros(0, np.int64)
        for k in dict.fromkeys((K, n)):
            agree = np.zeros(len(x), np.int64)
            for c in range(0, len(x), max(1, (PAIRS * K) // k)):
                part = slice(c, c + max(1, (PAIRS * K) // k))
                agree[part] = np.max([(s[x[part], :k] == s[y[part], :k]).sum(axis=1) for s in drawn], axis=0)
            near = agree >= _least_agreement(least, k)
            x, y, agree = x[near], y[near], agree[near]
        if not best:
            own = (bands[y] == bands[x]).argmax(axis=1) == band[x]
            x, y, agree = x[own], y[own], agree[own]
        got.append((x, y, agree))
    x, y, agree = (np.concatenate(c) for c in zip(*got, strict=True))
    if best:
        x, y, agree = np.concatenate([x, y]), np.concatenate([y, x]), np.concatenate([agree, agree])
        order = np.lexsort((ids[y], -agree, x))
        order = order[runs_of(x[order])]
        x, y = x[order], y[order]
    return pa.record_batch([pa.array(np.maximum(ids[x], ids[y])), pa.array(np.minimum(ids[x], ids[y]))], ["doc", "hub"])


def _apart(rows: DataFrame, links: DataFrame, near: DataFrame | None = None) -> DataFrame:
    """(key, band, doc, component, big, n_big, n_rest): members of the buckets that still hold several components; near: the only documents (n) that matter.

    big: the member's component is the bucket's largest; n_big and n_rest: members of that one and of the others.
    """
    found = components(links, "near")
    if near is not None:
        rows = rows.join(near, rows["doc"] == near["n"], "left_semi")
    labelled = written(rows.join(found, rows["doc"] == found["node"], "left").select("key", "band", "doc", F.coalesce("component", "doc").alias("component")), "labelled")
    parts = labelled.groupBy("key", "component").count()
    top = parts.groupBy(F.col("key").alias("k")).agg(F.max(F.struct("count", (-F.col("component")).alias("c"))).alias("top"), F.sum("count").alias("size"), F.count("*").alias("parts"))
    top = written(top.where("parts > 1").select("k", (-F.col("top.c")).alias("c"), F.col("top.count").alias("n_big"), (F.col("size") - F.col("top.count")).alias("n_rest")), "tops")
    apart = labelled.join(top, labelled["key"] == top["k"])
    return written(apart.select("key", "band", "doc", "component", (F.col("component") == F.col("c")).alias("big"), "n_big", "n_rest"), "apart")


def _candidates(apart: DataFrame, sketches: DataFrame, least: float, best: bool, plain: bool) -> DataFrame:
    """(hub, doc) from the tiles of the buckets; sketches: (s, sketch).

    Members of a bucket's largest component meet those of the others (kind 0), and the others each other (kind 1); none meets its
    own component's, so a stray document in a large group costs rows in proportion to the group.
    """
    blocks = lambda c: F.ceil(F.col(c) / TILE)
    named = apart.join(sketches, apart["doc"] == sketches["s"]).withColumn("own", F.pmod(F.xxhash64("doc"), F.when(F.col("big"), blocks("n_big")).otherwise(blocks("n_rest"))))
    cell = lambda kind, i, j, side: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), side.cast("int").alias("side"))
    own = F.col("own")
    with_rest = F.transform(F.sequence(F.lit(0), blocks("n_rest") - 1), lambda j: cell(0, own, j, F.lit(0)))
    with_big = F.transform(F.sequence(F.lit(0), blocks("n_big") - 1), lambda i: cell(0, i, own, F.lit(1)))
    among = F.transform(F.sequence(F.lit(0), blocks("n_rest") - 1), lambda o: cell(1, F.least(own, o), F.greatest(own, o), own > o))
    placed = named.withColumn("t", F.explode(F.when(F.col("big"), with_rest).otherwise(F.concat(with_big, among))))
    tiles = placed.select("key", "t.kind", "t.i", "t.j", "t.side", "band", "doc", "component", "sketch")
    order = ["key", "kind", "i", "j"]
    tiles = tiles.repartition(partitions(apart.sparkSession), *order).sortWithinPartitions(*order, "side")
    found = tiles.mapInArrow(_close_pairs(least, best, plain), "doc long, hub long")
    return written(found.select("hub", "doc").distinct(), "close-pairs")


def _chosen(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The texts of the documents ``ids`` (doc), packed by group, as a written table."""
    n = partitions(docs.sparkSession)

    def picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        parts: list[pa.Table] = []
        size = 0
        for asked, rows in by_group(batches, Named):
            rows = rows.filter(pa.array([i in asked.ids for i in rows.column(0).to_pylist()], pa.bool_()))
            parts.append(rows)
            size += rows.nbytes
            if size >= ROWS_BYTES:
                yield from _packed(parts, n)
                parts, size = [], 0
        yield from _packed(parts, n)

    asked = ids.select(F.col("doc").alias("doc_id")).distinct().mapInArrow(_names(n), GROUPED)
    texts = docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(grouped_rows(n, tagged=False), GROUPED)
    return written(texts.unionAll(asked).transform(dealt, n, "g", "kind").mapInArrow(picked, GROUPED), "bucket-texts")


def _packed(parts: list[pa.Table], n: int) -> Iterator[pa.RecordBatch]:
    for batch in pa.concat_tables(parts).combine_chunks().to_batches() if parts else ():
        ids = batch.column(0).to_numpy()
        groups = Documents(ids, np.zeros(len(ids), np.uint32)).groups(n)
        yield from record_batches(((g, 1, pack_rows(batch.take(pa.array(i)))) for g, i in split_by(groups)), GROUPED)


def _wide_sketches(texts: DataFrame, ids: DataFrame, bands: DataFrame, idf, plain: bool) -> DataFrame:  # noqa: ANN001
    """(s, sketch) with WIDE samples of the documents ``ids`` (doc); bands: (s, sketch) of all; texts: packed."""
    n = partitions(texts.sparkSession)

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for asked, rows in by_group(batches, Named):
            rows = rows.filter(pa.array([i in asked.ids for i in rows.column(0).to_pylist()], pa.bool_()))
            data, off = text_buffers(rows.column(1))
            for a, b in steps(data, off, STEP):
                h, count, first, _ = shingles(data[off[a] : off[b]], off[a : b + 1] - off[a])
                some = np.flatnonzero(np.diff(first) > 0)
                if len(some):
                    s = np.hstack([x.astype(np.uint8) for x in both_samples(h, weights(h, count, idf.value), np.append(first[:-1][some], len(h)), plain, WIDE)])
                    yield pa.record_batch([rows.column(0).combine_chunks().take(pa.array(some + a)), pa.array([x.tobytes() for x in s], pa.binary())], ["w", "wide"])

    asked = ids.select(F.col("doc").alias("doc_id")).distinct().mapInArrow(_names(n), GROUPED)
    wide = texts.unionAll(asked).transform(dealt, n, "g", "kind").mapInArrow(drawn, "w long, wide binary").dropDuplicates(["w"])
    return wide.join(bands, wide["w"] == bands["s"]).select("s", F.concat("wide", F.expr(f"substring(sketch, {(1 + plain) * K + 1}, {(1 + plain) * 4 * BANDS})")).alias("sketch"))


def _names(n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Ids of documents, sent to the documents' groups."""

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            groups = Documents(ids, np.zeros(len(ids), np.uint32)).groups(n)
            yield from record_batches(((g, 0, pack_arrays(ids[i])) for g, i in split_by(groups)), GROUPED)

    return told


class Named:
    """Ids of a group."""

    def __init__(self) -> None:
        self.ids: set[int] = set()

    def add(self, blob: bytes) -> None:
        self.ids.update(unpack_arrays(blob)[0].tolist())


def _keyed(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """docs with a key of doc_id and text as doc_id, and (key, id) where that is not doc_id itself: for all texts but one of
    a doc_id that repeats with different texts."""
    told = docs.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("h"))
    several = told.groupBy("doc_id").agg(F.min("h").alias("low"), F.max("h").alias("high")).where("low <> high").select(F.col("doc_id").alias("id"), "low")
    several = written(several, "several-texts")
    if several.isEmpty():
        return docs, None
    extra = told.join(several, told["doc_id"] == several["id"]).where("h <> low").select("id", "h").distinct()
    extra = written(extra.select("id", "h", F.xxhash64("id", "h", F.lit("text")).alias("key")), "keys")
    with_key = docs.withColumn("_h", F.xxhash64("text")).join(extra, (F.col("doc_id") == extra["id"]) & (F.col("_h") == extra["h"]), "left")
    rest = [c for c in docs.columns if c != "doc_id"]
    return with_key.select(F.coalesce("key", "doc_id").alias("doc_id"), *rest, F.col("doc_id").alias("_id")), extra.select("key", "id")


def near_classes(docs: DataFrame, least: float = 0.8, plain: bool = False) -> DataFrame:
    """(doc_id, class_id, kept) of every document; plain: pairs of that plain Jaccard similarity are links, too."""
    keyed, extra = _keyed(docs.select("doc_id", "text"))
    return _named(_key_classes(keyed, least, plain), extra).select("doc_id", "class_id", "kept")


def _named(classes: DataFrame, extra: DataFrame | None) -> DataFrame:
    """(key, doc_id, class_id, kept): a class is named by its smallest doc_id."""
    if extra is None:
        return classes.withColumn("key", F.col("doc_id"))
    rows = classes.select(F.col("doc_id").alias("k"), F.col("class_id").alias("c"))
    rows = written(rows.join(extra, rows["k"] == extra["key"], "left").select("k", "c", F.coalesce("id", "k").alias("id")), "members")
    top = rows.where("c is not null").groupBy(F.col("c").alias("t")).agg(F.min(F.struct("id", "k")).alias("top"))
    out = rows.join(top, rows["c"] == top["t"], "left")
    return out.select(F.col("k").alias("key"), F.col("id").alias("doc_id"), F.col("top.id").alias("class_id"), F.coalesce(F.col("k") == F.col("top.k"), F.lit(True)).alias("kept"))


def _key_classes(docs: DataFrame, least: float, plain: bool) -> DataFrame:
    """(doc_id, class_id, kept) of documents that repeat a doc_id with the same text alone."""
    spark = docs.sparkSession
    texts = docs.select("doc_id", "text")
    idf = spark.sparkContext.broadcast(inverse_frequencies(*document_frequencies(texts)))
    signed = written(texts.mapInArrow(_signed(idf, plain), SIGNED), "signed")
    copies = signed.groupBy("h1", "h2").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"))
    named = signed.select("doc_id", F.col("h1").alias("k1"), F.col("h2").alias("k2"))
    copies = written(copies.where("n > 1"), "copied")
    same = named.join(copies, (named["k1"] == copies["h1"]) & (named["k2"] == copies["h2"])).select("doc_id", "first_id")
    same = written(same.where("doc_id <> first_id"), "copies")
    repeated = same.select("doc_id").distinct()
    firsts = signed.join(repeated, "doc_id", "left_anti").dropDuplicates(["doc_id"])

    rows = firsts.select(F.col("doc_id").alias("doc"), F.posexplode("bands").alias("band", "key"))
    full = written(rows.groupBy("key").count().where("count > 1").select(F.col("key").alias("k"), F.col("count").alias("size")), "full-buckets")
    rows = written(rows.join(full, rows["key"] == full["k"]).drop("k"), "buckets")
    degree = rows.groupBy(F.col("doc").alias("d")).agg(F.sum(F.col("size") - 1).alias("degree"))
    ranked = rows.join(degree, rows["doc"] == degree["d"]).drop("d")
    hubs = ranked.groupBy(F.col("key").alias("k")).agg(F.max(F.struct("degree", (-F.col("doc")).alias("doc"))).alias("top")).select("k", (-F.col("top.doc")).alias("hub"))
    hubs = written(hubs, "hubs")
    pairs = rows.join(hubs, rows["key"] == hubs["k"]).where("doc <> hub").select("hub", "doc").distinct()
    bucketed = _chosen(docs, rows)
    links = written(_verified(bucketed, written(pairs, "hub-pairs"), idf, least, plain), "hub-links")

    sketches = firsts.select(F.col("doc_id").alias("s"), "sketch")
    close = _candidates(_apart(rows, links), sketches, least, True, plain)
    best = _verified(bucketed, close, idf, least, plain)
    links = written(links.unionByName(best), "best-links")
    # A document that no other is close to by its first samples has no pair left to look for.
    near = written(close.select(F.explode(F.array("hub", "doc")).alias("n")).distinct(), "near-documents")
    apart = _apart(rows, links, near)
    wide = _wide_sketches(bucketed, apart, sketches, idf, plain)
    more = _verified(bucketed, _candidates(apart, wide, least, False, plain), idf, least, plain)

    edges = links.unionByName(more).unionByName(same.select(F.col("first_id").alias("a"), F.col("doc_id").alias("b")))
    found = components(edges, "near")
    ids = docs.select("doc_id")
    out = ids.join(found, ids["doc_id"] == found["node"], "left").select("doc_id", F.coalesce("component", "doc_id").alias("class_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)))


def near_distinct(docs: DataFrame, least: float = 0.8, plain: bool = False) -> DataFrame:
    """The documents that stay, one of each class, with their own columns."""
    n = partitions(docs.sparkSession)
    keyed, extra = _keyed(docs)
    if extra is not None:
        keyed = written(keyed, "keyed")
    gone = _named(_key_classes(keyed, least, plain), extra).where("not kept").select(F.col("key").alias("doc_id")).distinct()

    def stay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for marks, rows in by_group(batches, Named):
            left = rows.filter(pa.array([i is None or i not in marks.ids for i in rows.column(0).to_pylist()]))
            yield from left.combine_chunks().to_batches()

    whole = keyed.select("doc_id", "text", *[c for c in keyed.columns if c not in ("doc_id", "text")])
    grouped = whole.mapInArrow(grouped_rows(n, tagged=False), GROUPED).unionAll(gone.mapInArrow(_names(n), GROUPED))
    left = grouped.transform(dealt, n, "g", "kind").mapInArrow(stay, whole.schema)
    return (left if extra is None else left.withColumn("doc_id", F.col("_id"))).select(*docs.columns)

