"""Operator 5: cost-balanced packing of token sequences.

Documents are gathered into packs of about ``pack`` tokens inside each task of the scan.  A pack
opens just as many sequences as its tokens fill.  Stretches of whole sequences are cut from
documents that are longer than one.  What remains goes, longest first, to the
sequence of the lowest estimated cost, linear in tokens plus quadratic for attention
within a document, among those with room for it; where none has room for the whole, it
is cut and fills the roomiest.  What does not fill a whole sequence is opened as sequences whose lengths
are powers of two, which need no padding, so nothing is padded.

Plan: one map over the scan, no shuffle; a pack lives in one task and its memory is bounded by ``pack`` plus
the longest document.  Words' ids are remembered in arrays of bounded size in each Python worker, some 30 MB.

Defined results: a null or empty text is the end mark alone; a null doc_id is returned as null;
repeated rows are packed each; equal lengths keep the order of reading; an empty table gives an empty
result; other columns are ignored.  Sequence numbers hold the task's number in the high bits, so a
retried task repeats them.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .shared import U64, mix64, release, remembered, steps, text_buffers, word_spans

#: Words that a Python worker remembers, and the slots of their table.
REMEMBERED = 1 << 19
SLOTS = 2 * REMEMBERED
#: Longest remembered word in bytes: with its length it fills two machine words.
LONGEST = 15
PACK = 1 << 18
#: Relative cost of a token in the linear layers and of a pair of tokens in attention.
LINEAR, QUADRATIC = 1.0, 1.0 / 2048

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_LETTER = np.zeros(256, bool)
_LETTER[ord("a") : ord("z") + 1] = True
_MARK = np.zeros(256, bool)
_MARK[list(b".,;:!?|")] = True
_LOW_BYTES = np.array([(1 << 8 * min(n, 8)) - 1 for n in range(LONGEST + 1)], np.uint64)
_HIGH_BYTES = np.array([(1 << 8 * max(n - 8, 0)) - 1 for n in range(LONGEST + 1)], np.uint64)


class WordIds:
    """Ids of whole texts by a vocabulary that drops white space: the library is asked once for each distinct word.

    Its normaliser and pattern never look across the six ASCII spaces, it lowers case, and a run of letters ends
    where a mark follows, so a text's ids are those of its lower-case words, cut before such marks, in a row.
    Known words are an open-addressed table of arrays: the bytes of a word and its length are its key.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.key = np.zeros((SLOTS, 2), np.uint64)
        self.number = np.zeros(SLOTS, np.int32)  # of the word in a slot, from 1 on; 0: free
        self.first = np.zeros(REMEMBERED + 2, np.int64)  # word w has ids first[w] to first[w + 1]
        self.ids = np.zeros(1 << 16, np.uint32)
        self.words = 0

    def _keys(self, data: np.ndarray, starts: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first 15 bytes of each word and its length, as two machine words; no key is 0."""
        padded = np.zeros(len(data) // 8 + 4, np.uint64)
        padded.view(np.uint8)[: len(data)] = data
        at, shift = starts >> 3, ((starts & 7) * 8).astype(np.uint64)
        back = U64(63) - shift
        x, y, z = padded[at], padded[at + 1], padded[at + 2]
        low = (x >> shift) | ((y << U64(1)) << back)
        high = (y >> shift) | ((z << U64(1)) << back)
        return low & _LOW_BYTES[size], (high & _HIGH_BYTES[size]) | (size.astype(np.uint64) << U64(56))

    def _find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The words' numbers; 0 where they are not known."""
        found = np.zeros(len(low), np.int32)
        slot = (mix64(low ^ mix64(high)) % U64(SLOTS)).astype(np.int64)
        todo = np.arange(len(low))
        while len(todo):
            n = self.number[slot]
            key = self.key[slot]
            hit = (key[:, 0] == low[todo]) & (key[:, 1] == high[todo])
            found[todo[hit]] = n[hit]
            on = ~hit & (n > 0)
            todo, slot = todo[on], (slot[on] + 1) % SLOTS
        return found

    def _remember(self, low: np.ndarray, high: np.ndarray, numbers: np.ndarray) -> None:
        """Puts distinct new words into free slots."""
        slot = (mix64(low ^ mix64(high)) % U64(SLOTS)).astype(np.int64)
        todo = np.arange(len(low))
        while len(todo):
            free = self.number[slot] == 0
            self.number[slot[free]] = numbers[todo[free]]  # of several for one slot the last gets it
            own = self.number[slot] == numbers[todo]
            self.key[slot[own], 0], self.key[slot[own], 1] = low[todo[own]], high[todo[own]]
            todo, slot = todo[~own], (slot[~own] + 1) % SLOTS

    def _hold(self, ids: list[np.ndarray], at: int) -> np.ndarray:
        """Writes ids behind place ``at`` and returns where each begins."""
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        begin = at + np.cumsum(size) - size
        end = at + int(size.sum())
        if end > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(end, len(self.ids)), np.uint32)])
        self.ids[at:end] = np.concatenate(ids)
        return begin

    def _asked(self, words: list[bytes]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.library.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)]

    def encode_step(self, data: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
        """The ids of each text."""
        folded = _LOWER[data]
        cut = np.zeros(len(data), bool)
        cut[1:] = _MARK[folded[1:]] & _LETTER[folded[:-1]]
        starts, ends, first = word_spans(folded, off, cut)
        size = ends - starts
        short = size <= LONGEST
        word = np.zeros(len(starts), np.int64)
        low, high = self._keys(folded, starts, np.minimum(size, LONGEST))
        word[short] = self._find(low[short], high[short])
        begin, count = self.first[word], self.first[word + 1] - self.first[word]
        new = np.flatnonzero(word == 0)
        if len(new):
            raw = folded.tobytes()
            spelled = [raw[a:b] for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True)]
            place = {w: i for i, w in enumerate(dict.fromkeys(spelled))}
            ids = self._asked(list(place))
            which = np.fromiter(map(place.__getitem__, spelled), np.int64, len(spelled))
            head = np.empty(len(place), np.int64)
            head[which[::-1]] = new[::-1]  # where each is first
            keep = np.flatnonzero(short[head])[: REMEMBERED - self.words]
            rest = np.ones(len(place), bool)
            rest[keep] = False
            order = np.concatenate([keep, np.flatnonzero(rest)])
            at = int(self.first[self.words + 1])
            own = np.empty(len(place), np.int64)
            own[order] = self._hold([ids[i] for i in order], at)
            length = np.fromiter(map(len, ids), np.int64, len(ids))
            begin[new], count[new] = own[which], length[which]
            if len(keep):
                numbers = self.words + 1 + np.arange(len(keep))
                self.first[numbers + 1] = at + np.cumsum(length[keep])
                self._remember(low[head[keep]], high[head[keep]], numbers.astype(np.int32))
                self.words += len(keep)
        total = np.concatenate([[0], np.cumsum(count)])
        flat = self.ids[np.repeat(begin - total[:-1], count) + np.arange(total[-1])]
        at = total[first]
        return [flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]

    def encode_all(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text, in order."""
        data, off = text_buffers(texts)
        for a, b in steps(data, off):
            part = data[off[a] : off[b]]
            found = self.encode_step(part, off[a : b + 1] - off[a])
            marks = np.flatnonzero((part[:-1] == ord("<")) & (part[1:] == ord("|"))) if len(part) else ()
            for i in np.unique(np.searchsorted(off[a : b + 1] - off[a], marks, "right") - 1) if len(marks) else ():
                # It may hold a special token's string: the library sees the whole text.
                found[i] = np.array(self.library.encode(part[off[a + i] - off[a] : off[a + i + 1] - off[a]].tobytes().decode(), add_special_tokens=False).ids, np.uint32)
            yield from found

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids of one text."""
        return next(iter(self.encode_all(pa.array([text], pa.string())))).astype("<u4").tobytes()


@remembered
def _words(path: str) -> WordIds:
    return WordIds(path)


def cost(length: float) -> float:
    return LINEAR * length + QUADRATIC * length * length


def place(lengths: list[int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) that cover every document exactly."""
    pieces, n_seq, tails = [], 0, []
    for d, n in enumerate(lengths):
        at = 0
        while n - at > capacity:
            pieces.append((d, at, capacity, n_seq, 0))
            at, n_seq = at + capacity, n_seq + 1
        tails.append((n - at, d, at))
    total = sum(t[0] for t in tails)
    rest = total % capacity
    room = [capacity] * (total // capacity) + [1 << k for k in reversed(range(rest.bit_length())) if rest >> k & 1]
    left, spent, used = np.array(room, np.int64), np.zeros(len(room)), np.zeros(len(room), np.int64)
    for n, d, at in sorted(tails, key=lambda t: -t[0]):
        while n:
            fits = np.flatnonzero(left >= n)
            s = int(fits[np.argmin(spent[fits])]) if len(fits) else int(np.argmax(left))
            k = min(n, int(left[s]))
            pieces.append((d, at, k, n_seq + s, int(used[s])))
            left[s] -= k
            used[s] += k
            spent[s] += cost(k)
            n, at = n - k, at + k
    return pieces


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long"


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = 4096, end: int = 2, pack: int = PACK) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_length."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release(keep=_words)
        words, mark = _words(vocabulary), np.array([end], np.uint32)
        task = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33
        opened, ids, docs_in, size = 0, [], [], 0

        def closed() -> pa.RecordBatch:
            nonlocal opened, ids, docs_in, size
            pieces = place([len(x) for x in ids], capacity)
            filled = np.zeros(1 + max(p[3] for p in pieces), np.int64)
            for p in pieces:
                filled[p[3]] += p[2]
            rows = [(docs_in[d], a, k, zlib.crc32(ids[d][a : a + k].astype("<u4", copy=False)), len(ids[d]), task + opened + s, o, int(filled[s])) for d, a, k, s, o in pieces]
            opened, ids, docs_in, size = opened + len(filled), [], [], 0
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            return pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)

        for batch in batches:
            for doc, own in zip(batch.column(0).to_pylist(), words.encode_all(batch.column(1)), strict=True):
                ids.append(np.concatenate([own, mark]))
                docs_in.append(doc)
                size += len(ids[-1])
                if size >= pack:
                    yield closed()
        if ids:
            yield closed()

    return docs.select("doc_id", "text").mapInArrow(packed, SCHEMA)
