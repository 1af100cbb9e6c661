"""Operator 2: token counts by heap-and-linked-list byte-pair merging.

A text is cut into the pieces of the byte-level vocabulary's own pattern.  Within a piece the
symbols form a linked list and a heap holds every adjacent pair that the vocabulary can merge;
the lowest rank (leftmost first) is popped until none is left.  The count of a piece is its initial
symbols minus its merges; no identifiers are emitted.  Counts of short
pieces are remembered within a bounded table of each Python worker.

Plan: one map over the scan, no shuffle.  Memory: an Arrow batch and the table.

Defined results: a null text counts as empty (0 bytes, 0 tokens); a null doc_id is returned as
null; repeated rows are counted each; long texts are read whole; strings of added special
tokens inside a text are one token each, as the vocabulary's library has it by
default; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .shared import release, remembered

#: White space as the vocabulary's pattern knows it.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Contractions that the vocabulary's pattern splits off.
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
PIECE = regex.compile("|".join(CONTRACTIONS) + rf"| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
#: No piece crosses the border of these coarser ones, which repeat often.
COARSE = re.compile(rf" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")

REMEMBERED = 500_000  # entries of either table
#: Bits that hold a symbol and, in the heap, a place.
PAIR, PLACE = 20, 40
MASK = (1 << PLACE) - 1
LONGEST = 48


def _byte_letters() -> dict[int, str]:
    """The byte-level vocabularies' spelling: printable bytes as themselves, others from U+0100 on in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


class PairMerger:
    """Counts of tokens from a byte-level BPE vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.first = [vocab[c] for _, c in sorted(_byte_letters().items())]
        self.rank: dict[int, int] = {}  # of a pair of symbols, packed into one number
        self.made: list[int] = []  # by rank
        for i, m in enumerate(spec["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.rank.setdefault(vocab[a] << PAIR | vocab[b], i)
            self.made.append(vocab[a + b])
        special = [t["content"] for t in spec.get("added_tokens", ())]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.known: dict[str, int] = {}  # coarse pieces
        self.pieces: dict[str, int] = {}

    def merged(self, piece: bytes) -> int:
        """Initial symbols minus merges."""
        n = left = len(piece)
        if n < 2:
            return n
        rank, made = self.rank.get, self.made
        sym = [self.first[b] for b in piece]
        own = [rank(a << PAIR | b, -1) for a, b in zip(sym, sym[1:])]  # rank of the pair that starts here; -1: none
        heap = [r << PLACE | i for i, r in enumerate(own) if r >= 0]
        if not heap:
            return n
        own.append(-1)
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        while heap:
            top = pop(heap)
            i, r = top & MASK, top >> PLACE
            if own[i] != r:
                continue  # one side has been merged meanwhile
            left -= 1
            s = sym[i] = made[r]
            j = after[i]
            own[j] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                own[i] = r = rank(s << PAIR | sym[k], -1)
                if r >= 0:
                    push(heap, r << PLACE | i)
            else:
                own[i] = -1
            h = before[i]
            if h >= 0:
                own[h] = r = rank(sym[h] << PAIR | s, -1)
                if r >= 0:
                    push(heap, r << PLACE | h)
        return left

    def _coarse(self, coarse: str) -> int:
        n, pieces = 0, self.pieces
        for p in PIECE.findall(coarse):
            if (k := pieces.get(p)) is None:
                k = self.merged(p.encode())
                if len(p) <= LONGEST and len(pieces) < REMEMBERED:
                    pieces[p] = k
            n += k
        if len(coarse) <= LONGEST and len(self.known) < REMEMBERED:
            self.known[coarse] = n
        return n

    def _plain(self, text: str) -> int:
        pieces = COARSE.findall(text)
        counts = list(map(self.known.get, pieces))
        if None in counts:
            counts = [self._coarse(p) if c is None else c for p, c in zip(pieces, counts, strict=True)]
        return sum(counts)

    def count(self, text: str) -> int:
        if self.special is None or not self.special.search(text):
            return self._plain(text)
        parts = self.special.split(text)
        return sum(map(self._plain, parts)) + len(parts) - 1


@remembered
def _merger(path: str) -> PairMerger:
    return PairMerger(path)


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 512) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every document; vocabulary: path of the file, on every executor."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release(keep=_merger)
        m = _merger(vocabulary)
        for batch in batches:
            tokens, size = [], []
            for text in batch.column(1):
                t = text.as_py() or ""
                tokens.append(m.count(t))
                size.append(len(t.encode()))
            yield pa.record_batch([batch.column(0), pa.array(size, pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select("doc_id", "text").mapInArrow(counted, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
