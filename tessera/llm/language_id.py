"""Operator 3: language identification by sparse multinomial logistic regression.

Features are hashed character n-grams (one to three letters, everything else one blank) weighted by
TF-IDF: the n-gram's share of the text times its inverse document frequency, counted
over all documents that may be learned from.  The weights are trained with
follow-the-regularised-leader under elastic-net penalties on a bounded sample (``each`` rows of every
language), and a temperature fitted on a fifth of it that was left out calibrates the scores.

Plan: one scan counts document frequencies (blocks of cells per task, added up as they come), one collects
the sample's features, one predicts.  The model, CELLS x languages numbers, is all that is
broadcast.  No text is shuffled.

Defined results: a null text and one without letters are ``und`` with score 0; so is every text where
nothing can be learned; a row with a null doc_id is not learned from and not held out; equal scores go to
the language first in code-point order; repeated rows count as often as they occur in the frequencies, once in the sample; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .learning import bounded_sample, remainder
from .shared import STEP_BYTES, pack_arrays, release, summed_blocks, unpack_arrays

CELLS = 1 << 16
BLOCK = 1 << 12
ORDERS = 3
UNKNOWN = "und"
#: Shares of a text are small numbers; the bias should not outrun them.
SCALE = 100.0
_FACTOR = np.uint32(0x9E3779B1)
_LAST = np.uint32(0x85EBCA6B)


@functools.cache
def _letters() -> np.ndarray:
    """For each code point a random number that its upper and lower case share; 0 where it is no letter."""
    lower = np.fromiter((ord(low[0]) if (low := chr(c).lower()) and low[0].isalpha() else 0 for c in range(0x110000)), np.int64, 0x110000)
    numbers = np.random.default_rng(11).integers(1, 1 << 32, 0x110000, np.uint32)
    numbers[0] = 0
    return numbers[lower]


def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(cells, off): cells[n - 1, off[i]:off[i + 1]] are text i's n-grams by position; cell 0 is for blanks alone."""
    gap = " " * (ORDERS - 1)
    codes = np.frombuffer((gap.join(texts) + gap).encode("utf-32-le", "surrogatepass"), np.uint32)
    off = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + len(gap) for t in texts], out=off[1:])
    c = np.zeros(len(codes) + ORDERS - 1, np.uint32)
    np.take(_letters(), codes, out=c[: len(codes)])
    cells, h = np.empty((ORDERS, len(codes)), np.uint16), c[: len(codes)].copy()
    for n in range(ORDERS):
        if n:
            h *= _FACTOR
            h += c[n : n + len(codes)]
        mixed = h ^ (h >> np.uint32(15))
        mixed *= _LAST
        np.right_shift(mixed, np.uint32(16), out=mixed)
        cells[n] = mixed
        for k in range(1, n + 1):  # these would reach into the next text
            cells[n, off[1:] - k] = 0
    return cells, off


def text_steps(batch_texts: pa.Array, limit: int = STEP_BYTES // 8) -> Iterator[list[str]]:
    """The texts in lists of about ``limit`` characters, one text at least."""
    part, size = [], 0
    for t in batch_texts:
        part.append(t.as_py() or "")
        size += len(part[-1])
        if size >= limit:
            yield part
            part, size = [], 0
    if part:
        yield part


def counted_cells(text: str) -> tuple[np.ndarray, np.ndarray]:
    """A text's cells but for blanks, and how often each occurs."""
    i, k = np.unique(ngrams([text])[0], return_counts=True)
    return i[i > 0], k[i > 0]


@dataclass
class LanguageModel:
    languages: list[str]
    weights: np.ndarray  # CELLS x languages, times inverse document frequency
    bias: np.ndarray
    temperature: float

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        cells, off = ngrams(texts)
        n = sum(np.add.reduceat(c > 0, off[:-1], dtype=np.int64) for c in cells) * (np.diff(off) > 0)
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        some = np.flatnonzero(n)
        if len(some) and self.languages:
            sums = sum(np.add.reduceat(np.take(self.weights, c, axis=0), off[:-1], axis=0) for c in cells)
            p = softmax((sums[some] / n[some, None] + self.bias) / self.temperature)
            for i, k, x in zip(some.tolist(), p.argmax(axis=1).tolist(), p.max(axis=1).tolist(), strict=True):
                names[i], scores[i] = self.languages[k], min(1.0, x)
        return names, scores


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z.astype(np.float64) - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train_ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, steps: int = 10_000, alpha: float = 0.5, beta: float = 1.0, l1: float = 1e-3, l2: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias by follow-the-regularised-leader with elastic net; rows: cells, values, class; steps: at least, and 3 rounds."""
    z, n = np.zeros((CELLS + 1, classes)), np.zeros((CELLS + 1, classes))

    def weight(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        return -np.sign(zi) * np.maximum(np.abs(zi) - l1, 0) / ((beta + np.sqrt(ni)) / alpha + l2)

    order = np.random.default_rng(7)
    for _ in range(max(3, -(-steps // len(rows)))):
        for r in order.permutation(len(rows)):
            cells, values, y = rows[r]
            i = np.append(cells, CELLS)  # the last cell is the bias
            x = np.append(values, 1.0)[:, None]
            zi, ni = z[i], n[i]
            w = weight(zi, ni)
            p = softmax((x * w).sum(axis=0)[None])[0]
            p[y] -= 1
            g = x * p
            grown = ni + g * g
            z[i] = zi + g - (np.sqrt(grown) - np.sqrt(ni)) / alpha * w
            n[i] = grown
    w = weight(z, n)
    w[0] = 0  # blanks
    return w[:CELLS], w[CELLS]


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of the least log loss, by golden-section search over its logarithm."""
    if not len(y):
        return 1.0
    loss = lambda t: -np.log(np.maximum(softmax(logits / np.exp(t))[np.arange(len(y)), y], 1e-12)).mean()
    a, b, g = np.log(0.02), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(40):
        c, d = b - g * (b - a), a + g * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Documents with each cell, and documents, over all of ``docs`` (text)."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        total, n = np.zeros(CELLS, np.int64), 0
        for batch in batches:
            for part in text_steps(batch.column(0)):
                cells, off = ngrams(part)
                for a, b in zip(off[:-1], off[1:], strict=True):
                    seen = np.zeros(CELLS, bool)
                    seen[cells[:, a:b]] = True
                    total += seen
                n += len(part)
        for b in range(CELLS // BLOCK if n else 0):
            yield pa.record_batch([pa.array([b], pa.int32()), pa.array([n], pa.int64()), pa.array([pack_arrays(total[b * BLOCK : (b + 1) * BLOCK])], pa.binary())], ["block", "n", "counts"])

    df, n = np.zeros(CELLS, np.int64), 0
    for r in summed_blocks(docs.select("text").mapInArrow(counted, "block int, n long, counts binary")).collect():
        df[r.block * BLOCK : (r.block + 1) * BLOCK] = unpack_arrays(bytes(r.counts))[0]
        n = r.n
    return df, n


def learn(docs: DataFrame, each: int = 800) -> LanguageModel:
    """A model from ``docs`` (doc_id, text, lang without nulls); each: bound of the sample per language."""
    df, n = document_frequencies(docs)
    idf = SCALE * (np.log((n + 1) / (df + 1)) + 1)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, t in zip(batch.column(1).to_pylist(), batch.column(0), strict=True):
                i, k = counted_cells(t.as_py() or "")
                yield pa.record_batch([pa.array([lang]), pa.array([i.astype(np.uint16).tobytes()], pa.binary()), pa.array([k.astype(np.int32).tobytes()], pa.binary())], ["lang", "cells", "counts"])

    sample = bounded_sample(docs.select("doc_id", "lang", "text"), "lang", each).select("text", "lang").mapInArrow(features, "lang string, cells binary, counts binary").collect()
    sample.sort(key=lambda r: (r.lang, bytes(r.cells), bytes(r.counts)))
    languages = sorted({r.lang for r in sample})
    place = {x: i for i, x in enumerate(languages)}
    rows = []
    for r in sample:
        i, k = np.frombuffer(bytes(r.cells), np.uint16).astype(np.int64), np.frombuffer(bytes(r.counts), np.int32)
        if len(i):
            rows.append((i, k / k.sum() * idf[i], place[r.lang]))
    if not rows:
        return LanguageModel([], np.zeros((CELLS, 0), np.float32), np.zeros(0), 1.0)
    left = [r for i, r in enumerate(rows) if i % 5 == 4]
    w, bias = train_ftrl([r for i, r in enumerate(rows) if i % 5 != 4], len(languages))
    logits = np.array([(r[1][:, None] * w[r[0]]).sum(axis=0) + bias for r in left]).reshape(-1, len(languages))
    temperature = fit_temperature(logits, np.array([r[2] for r in left], int))
    return LanguageModel(languages, (w * idf[:, None]).astype(np.float32), bias, temperature)


def identify(docs: DataFrame, model: LanguageModel, *keep: str) -> DataFrame:
    """(*keep, lang_pred, score) of every document."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    n = len(keep)

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            names, scores = [], []
            for part in text_steps(batch.column(n)):
                a, b = held.value.predict(part)
                names += a
                scores += b
            yield pa.record_batch([*batch.columns[:n], pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*keep, "lang_pred", "score"])

    schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double")
    return docs.select(*keep, "text").mapInArrow(predicted, schema)


def language_id(docs: DataFrame, each: int = 800) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): learned from documents whose crc32 of doc_id leaves 0 or 2 by 3."""
    fold = docs.select("doc_id", "text", "lang", F.coalesce(remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out"))
    model = learn(fold.where("not held_out and doc_id is not null and lang is not null").select("doc_id", "text", "lang"), each)
    return identify(fold, model, "doc_id", "held_out")
