"""Operator 4: substring deduplication through difference-cover anchors.

A window is WINDOW consecutive words of one document.  A word is removed if a window that covers
it starts, with the same words, in a document of a smaller doc_id; windows are judged on the
input.

{0, 1, 3} is a difference cover modulo 7: whatever the positions of two equal windows in
their documents, one of the first seven offsets lies at a cover position in both.  So
only runs of seven words at cover positions, three sevenths of all, are hashed as anchors and compared
across documents.  Around each anchor that another document shares, the match is
extended: the windows that hold it are hashed whole, by a hash of 64 bits and another of 32, independent from the words
on, and the smallest document of each window is found.  Words are not compared: two different windows
are taken for one with probability 2^-96.

Plan: five stages of one job.  Anchors go to buckets by hash as compressed arrays, what is shared comes back to the
documents, candidate windows go to buckets, what is to be removed comes back, words are cut.  Each task
settles repeats among its own rows first and sends one entry per hash, so a passage that
a third of all documents hold costs a bucket one entry per task.  Texts travel compressed and
grouped.  Groups of documents are as many as spark.sql.shuffle.partitions, which is to
grow with the input, and buckets SPLIT times as many; a task reads its buckets one after the other and holds one.  Nothing is collected or broadcast.

Defined results: a null text has no words; a row with a null doc_id has no order among
the others, keeps all its words and removes none; rows of equal doc_id do not remove each other's
words; texts shorter than a window lose nothing; an empty table gives an empty
result; other columns are carried by ``cut_documents`` and ignored by ``substring_duplicates``.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import STEP_BYTES, U64, mix64, pack_arrays, pack_rows, partitions, release, runs_of, span_hashes, steps, text_buffers, unpack_arrays, unpack_rows, window_hashes, word_spans

WINDOW = 13
PERIOD, COVER = 7, (0, 1, 3)
ANCHOR = WINDOW - PERIOD + 1
#: Entries that a task gathers before it settles repeats and sends them on.
GATHER = 1 << 19
#: Buckets to a task.
SPLIT = 2
ROWS_BYTES = 4 << 20

_IN_COVER = np.zeros(PERIOD, bool)
_IN_COVER[list(COVER)] = True
SENT = "k int, settled boolean, blob binary"
GROUPED = "g int, kind int, blob binary"


class Documents:
    """Rows of one step: a document's key is its doc_id and a checksum of its text."""

    def __init__(self, ids: np.ndarray, tags: np.ndarray):
        self.ids, self.tags = ids, tags

    def groups(self, n: int) -> np.ndarray:
        return (mix64(self.ids.astype(np.uint64) * U64(0x9E3779B97F4A7C15) + self.tags.astype(np.uint64)) % U64(n)).astype(np.int64)


def _checksums(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    view = memoryview(np.ascontiguousarray(data))
    return np.fromiter((zlib.crc32(view[a:b]) for a, b in zip(off[:-1], off[1:], strict=True)), np.uint32, len(off) - 1)


def _within(first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each word its text and its place there."""
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    return doc, np.arange(n) - first[:-1][doc]


def _packed_entries(docs: Documents, doc: np.ndarray, pos: np.ndarray, *more: np.ndarray) -> bytes:
    """Entries in order of their document: its key once, then places and what else belongs to each."""
    order = np.lexsort((pos, doc))
    doc = doc[order]
    at = runs_of(doc)
    return pack_arrays(docs.ids[doc[at]], docs.tags[doc[at]], np.diff(np.append(at, len(doc))).astype(np.uint32), pos[order].astype(np.uint32), *(m[order] for m in more))


def split_by(place: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(value, indices) for each value."""
    order = np.argsort(place, kind="stable")
    at = runs_of(place[order])
    for a, b in zip(at, np.append(at[1:], len(order)), strict=True):
        yield int(place[order[a]]), order[a:b]


def _to_groups(docs: Documents, doc: np.ndarray, pos: np.ndarray, n: int) -> Iterator[tuple[int, bytes]]:
    if len(doc):
        for g, i in split_by(docs.groups(n)[doc]):
            yield g, _packed_entries(docs, doc[i], pos[i])


class Sender:
    """Gathers (hash, document, place) of one task, settles what its own rows decide and sends the rest to buckets."""

    def __init__(self, n: int, judge: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], narrow: bool):
        self.n, self.judge, self.narrow = n, judge, narrow
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.size = self.docs = 0
        self.ids: list[np.ndarray] = []
        self.tags: list[np.ndarray] = []

    def add(self, ids: np.ndarray, tags: np.ndarray, doc: np.ndarray, pos: np.ndarray, *keys: np.ndarray) -> None:
        self.ids.append(ids)
        self.tags.append(tags)
        self.parts.append((doc + self.docs, pos, *keys))
        self.docs += len(ids)
        self.size += len(doc)

    def sent(self) -> Iterator[tuple[int, bool, bytes]]:
        if not self.size:
            self.parts, self.ids, self.tags, self.docs = [], [], [], 0
            return
        doc, pos, *keys = (np.concatenate(c) for c in zip(*self.parts, strict=True))
        docs = Documents(np.concatenate(self.ids), np.concatenate(self.tags))
        self.parts, self.ids, self.tags, self.size, self.docs = [], [], [], 0, 0
        order = np.lexsort((docs.ids[doc], *reversed(keys)))
        doc, pos, keys = doc[order], pos[order], [k[order] for k in keys]
        settled, ask = self.judge(docs.ids[doc], runs_of(*keys))
        for g, blob in _to_groups(docs, doc[settled], pos[settled], self.n):
            yield g, True, blob
        for k, i in split_by(((keys[0][ask] >> U64(32)) % U64(SPLIT * self.n)).astype(np.int64)):
            own = ask[i]
            yield k, False, _packed_entries(docs, doc[own], pos[own], *(x[own].astype(np.uint32) if self.narrow else x[own] for x in keys), np.isin(own, settled, assume_unique=True).astype(np.uint8))


def record_batches(rows: Iterator[tuple], schema: str) -> Iterator[pa.RecordBatch]:
    """Record batches of about ROWS_BYTES."""
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [{"int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}[x.split()[1]] for x in schema.split(", ")]
    part, size = [], 0
    for r in rows:
        part.append(r)
        size += len(r[-1])
        if size >= ROWS_BYTES:
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*part, strict=True), kinds, strict=True)], names)
            part, size = [], 0
    if part:
        yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*part, strict=True), kinds, strict=True)], names)
    part = []
    release()


def _share(ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Anchors: entries known here to be shared by documents, and the entries to ask about, one per hash."""
    if not len(at):
        return at, at
    size = np.diff(np.append(at, len(ids)))
    shared = np.repeat(ids[at] != ids[at + size - 1], size)
    # A document that repeats an anchor asks for each place; where several share it, the first entry tells the others.
    ask = ~shared
    ask[at] = True
    return np.flatnonzero(shared), np.flatnonzero(ask)


def _later(ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows: entries known here to start in a smaller document, too, and the smallest document's entries."""
    if not len(at):
        return at, at
    later = ids > np.repeat(ids[at], np.diff(np.append(at, len(ids))))
    return np.flatnonzero(later), np.flatnonzero(~later)


def _anchors(n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bool, bytes]]:
        release()
        out = Sender(n, _share, narrow=True)
        for batch in batches:
            batch = batch.filter(batch.column(0).is_valid())
            ids = batch.column(0).to_numpy()
            data, off = text_buffers(batch.column(1))
            for a, b in steps(data, off):
                d, o = data[off[a] : off[b]], off[a : b + 1] - off[a]
                starts, ends, first = word_spans(d, o)
                doc, pos = _within(first, len(starts))
                left = np.diff(first)[doc] - pos
                at = np.flatnonzero(_IN_COVER[pos % PERIOD] & (left >= ANCHOR))
                if len(at):
                    h = window_hashes(span_hashes(d, starts, ends), ANCHOR)[at]
                    out.add(ids[a:b], _checksums(d, o), doc[at], pos[at], h)
                if out.size >= GATHER:
                    yield from out.sent()
        yield from out.sent()

    return lambda batches: record_batches(entries(batches), SENT)


def _settle(n: int, anchors: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Which entries of each bucket to answer.  Anchors: those whose hash several documents have; windows: those of a document above the smallest."""

    def bucket(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        parts, ids, tags, base = [], [], [], 0
        for b in blobs:
            i, g, count, *rest = unpack_arrays(b)
            parts.append((np.repeat(np.arange(base, base + len(i), dtype=np.int32), count), *rest))
            ids.append(i)
            tags.append(g)
            base += len(i)
        doc, pos, *keys, known = (np.concatenate(c) for c in zip(*parts, strict=True))
        parts = []
        docs = Documents(np.concatenate(ids), np.concatenate(tags))
        order = np.lexsort(keys[::-1])
        own, at = docs.ids[doc[order]], runs_of(*(k[order] for k in keys))
        size = np.diff(np.append(at, len(doc)))
        low = np.minimum.reduceat(own, at)
        if anchors:
            told = np.bitwise_or.reduceat(known[order], at) > 0
            hit = np.repeat(told | (low < np.maximum.reduceat(own, at)), size) & (known[order] == 0)
        else:
            hit = own > np.repeat(low, size)
        hit = order[hit]
        return docs.ids[doc[hit]], docs.tags[doc[hit]], pos[hit]

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes]]:
        release()
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        at, held, size = None, [], 0

        def answers() -> Iterator[tuple[int, int, bytes]]:
            """What the task's buckets have found so far: one blob to a group."""
            nonlocal out, size
            ids, tags, pos = (np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.uint32), np.zeros(0, np.uint32))
            out, size = [], 0
            order = np.lexsort((tags, ids))
            ids, tags, pos = ids[order], tags[order], pos[order]
            first = runs_of(ids, tags)
            doc = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(ids))))
            for g, b in _to_groups(Documents(ids[first], tags[first]), doc, pos, n):
                yield g, 0, b

        for batch in batches:
            for k, done, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if done:
                    i, g, count, pos = unpack_arrays(blob.as_py())
                    out.append((np.repeat(i, count), np.repeat(g, count), pos))
                    size += len(pos)
                else:
                    if k != at and held:
                        out.append(bucket(held))
                        size += len(out[-1][0])
                        held = []
                    at = k
                    held.append(blob.as_py())
                if size >= GATHER:
                    yield from answers()
        if held:
            out.append(bucket(held))
        yield from answers()

    return lambda batches: record_batches(entries(batches), GROUPED)


def grouped_rows(n: int, tagged: bool = True) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (doc_id, text, ...) by group, compressed; tagged: rows of one doc_id may go to several groups by their text."""

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes]]:
        release()
        held: list[pa.RecordBatch] = []
        size = 0

        def flushed() -> Iterator[tuple[int, int, bytes]]:
            nonlocal held, size
            t = pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
            for batch in t:
                ids = batch.column(0).fill_null(0).to_numpy()
                data, off = text_buffers(batch.column(1))
                docs = Documents(ids, _checksums(data, off) if tagged else np.zeros(len(ids), np.uint32))
                for g, i in split_by(docs.groups(n)):
                    yield g, 1, pack_rows(batch.take(pa.array(i)))

        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                held.append(batch.slice(a, 256))
                size += held[-1].nbytes
                if size >= 8 * STEP_BYTES:
                    yield from flushed()
        if held:
            yield from flushed()

    return lambda batches: record_batches(entries(batches), GROUPED)


class Marks:
    """Places by document, from the answers to one group."""

    def __init__(self) -> None:
        self.parts: list[list[np.ndarray]] = []
        self.by: dict[tuple[int, int], np.ndarray] | None = None

    def add(self, blob: bytes) -> None:
        self.parts.append(unpack_arrays(blob))

    def of(self, ids: np.ndarray, tags: np.ndarray) -> list[np.ndarray | None]:
        if self.by is None:
            i, t, n = (np.concatenate([p[k] for p in self.parts]) if self.parts else np.zeros(0, np.int64) for k in range(3))
            pos = np.concatenate([p[3] for p in self.parts]) if self.parts else np.zeros(0, np.int64)
            start = np.concatenate([[0], np.cumsum(n, dtype=np.int64)])
            order = np.lexsort((t, i))
            rows = np.repeat(order, n[order].astype(np.int64))
            size = n[order].astype(np.int64)
            offset = np.arange(len(rows)) - np.repeat(np.cumsum(size) - size, size)
            pos = pos[start[rows] + offset].astype(np.int64) if len(rows) else pos
            both = np.stack([i[order], t[order].astype(np.int64)], axis=1).reshape(-1, 2)
            new = np.ones(len(both), bool)
            new[1:] = (both[1:] != both[:-1]).any(axis=1)
            at = np.flatnonzero(new)
            ends = np.concatenate([[0], np.cumsum(size)])
            cut = np.append(ends[:-1][at], ends[-1])
            self.by = {(int(a), int(b)): pos[cut[k] : cut[k + 1]] for k, (a, b) in enumerate(both[at])}
            self.parts = []
        return [self.by.get((int(a), int(b))) for a, b in zip(ids, tags, strict=True)]


def by_group(batches: Iterator[pa.RecordBatch], answers: type = Marks) -> Iterator[tuple]:
    """Each piece of rows with the answers to its group; a group's answers come first."""
    group, marks = None, answers()
    for batch in batches:
        for g, kind, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            if g != group:
                group, marks = g, answers()
            if kind == 0:
                marks.add(blob.as_py())
            else:
                yield marks, unpack_rows(blob.as_py())


def _windows(n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Around each shared anchor the windows that hold it."""

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bool, bytes]]:
        release()
        out = Sender(n, _later, narrow=False)
        for marks, rows in by_group(batches):
            rows = rows.filter(rows.column(0).is_valid())
            ids = rows.column(0).to_numpy()
            data, off = text_buffers(rows.column(1))
            tags = _checksums(data, off)
            found = marks.of(ids, tags)
            some = [i for i, f in enumerate(found) if f is not None]
            if not some:
                continue
            text = rows.column(1).take(pa.array(some))
            data, off = text_buffers(text)
            for a, b in steps(data, off):
                d, o = data[off[a] : off[b]], off[a : b + 1] - off[a]
                starts, ends, first = word_spans(d, o)
                # One more than the last window of each text, so that a text of a window has one place.
                near = np.zeros(len(starts) + 1, np.int32)
                for i in range(a, b):
                    p = found[some[i]]
                    size = int(first[i - a + 1] - first[i - a])
                    low, high = np.maximum(p - PERIOD + 1, 0), np.minimum(p, size - WINDOW) + 1
                    ok = high > low
                    np.add.at(near, first[i - a] + low[ok], 1)
                    np.add.at(near, first[i - a] + high[ok], -1)
                at = np.flatnonzero(np.cumsum(near)[:-1] > 0)
                if len(at):
                    h, more = (window_hashes(span_hashes(d, starts, ends, second), WINDOW)[at] for second in (False, True))
                    doc, pos = _within(first, len(starts))
                    own = np.array(some[a:b])
                    out.add(ids[own], tags[own], doc[at], pos[at], h, (more >> U64(32)).astype(np.uint32))
                if out.size >= GATHER:
                    yield from out.sent()
        yield from out.sent()

    return lambda batches: record_batches(entries(batches), SENT)


def _kept(text: bytes, cut: np.ndarray | None) -> tuple[list[bytes], int, bytes]:
    """(kept words, number of words, text without the others: whole stretches as they were, joined by one space)."""
    words = text.split()
    if cut is None:
        return words, len(words), text
    edge = np.zeros(len(words) + 1, np.int32)
    np.add.at(edge, cut, 1)
    np.add.at(edge, cut + WINDOW, -1)
    keep = np.cumsum(edge)[:-1] == 0
    data = np.frombuffer(text, np.uint8)
    starts, ends, _ = word_spans(data, np.array([0, len(data)]))
    turn = np.flatnonzero(np.diff(np.concatenate([[0], keep.astype(np.int8), [0]])))
    left = b" ".join(text[starts[a] : ends[b - 1]] for a, b in zip(turn[::2], turn[1::2], strict=True))
    return [w for w, k in zip(words, keep, strict=True) if k], len(words), left


def _answered(docs: DataFrame) -> tuple[DataFrame, int]:
    """Which windows to remove, by group of documents."""
    spark = docs.sparkSession
    n = partitions(spark)
    texts = docs.select("doc_id", "text")
    shared = dealt(texts.mapInArrow(_anchors(n), SENT), n, "k").mapInArrow(_settle(n, True), GROUPED)
    grouped = texts.mapInArrow(grouped_rows(n), GROUPED).unionAll(shared)
    windows = dealt(grouped, n, "g", "kind").mapInArrow(_windows(n), SENT)
    return dealt(windows, n, "k").mapInArrow(_settle(n, False), GROUPED), n


def dealt(df: DataFrame, n: int, number: str, *then: str) -> DataFrame:
    """Rows of a number together and in order, numbers evenly over n tasks."""
    return df.repartitionById(n, F.pmod(number, F.lit(n)).cast("int")).sortWithinPartitions(number, *then)


def substring_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every document."""
    answers, n = _answered(docs)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for marks, rows in by_group(batches):
            data, off = text_buffers(rows.column(1))
            cuts = marks.of(rows.column(0).fill_null(0).to_numpy(), _checksums(data, off))
            out = []
            for doc, a, b, cut in zip(rows.column(0).to_pylist(), off[:-1], off[1:], cuts, strict=True):
                kept, size, _ = _kept(data[a:b].tobytes(), cut if doc is not None else None)
                out.append((doc, size, size - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            doc, size, gone, sha = zip(*out, strict=True)
            yield pa.record_batch([pa.array(doc, pa.int64()), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    grouped = docs.select("doc_id", "text").mapInArrow(grouped_rows(n), GROUPED).unionAll(answers)
    return dealt(grouped, n, "g", "kind").mapInArrow(digests, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def cut_documents(docs: DataFrame) -> DataFrame:
    """The documents with the repeated words cut from ``text``; untouched texts and other columns stay as they are."""
    answers, n = _answered(docs)
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]

    def cut_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for marks, rows in by_group(batches):
            data, off = text_buffers(rows.column(1))
            cuts = marks.of(rows.column(0).fill_null(0).to_numpy(), _checksums(data, off))
            texts = [t.as_py() if doc is None or cut is None else _kept(data[a:b].tobytes(), cut)[2].decode() for doc, t, a, b, cut in zip(rows.column(0).to_pylist(), rows.column(1), off[:-1], off[1:], cuts, strict=True)]
            yield from rows.set_column(1, rows.schema.field(1), pa.array(texts, rows.schema.field(1).type)).combine_chunks().to_batches()

    whole = docs.select("doc_id", "text", *rest)
    grouped = whole.mapInArrow(grouped_rows(n), GROUPED).unionAll(answers)
    return dealt(grouped, n, "g", "kind").mapInArrow(cut_rows, whole.schema).select(*docs.columns)
