"""Operator 6: severity of toxicity by cumulative-link ordinal regression.

Features are sparse: hashed words (lower case, cut at white space and ASCII marks) and their first
three, four and five bytes, each with log(1 + its count).  One weight vector is shared by all ordered thresholds:
P(grade > k) = sigmoid(w x - theta_k), trained with an L1 penalty by accelerated proximal gradients on a
bounded sample.  A fifth of the sample is left out, on which one scale of the weights and the thresholds are fitted by
likelihood.  The output is the expected severity, the sum of these probabilities, as where either side of a threshold is as frequent.

Labels that only say toxic or not are graded first: among the sample's toxic documents
those whose share of telling words (seen almost only in toxic ones) is at or above the median are
grade 2, the others grade 1.

Plan: a bounded sample of labelled ids is broadcast to find its documents, whose word counts
are gathered; one map over the scan scores every whole text, with no shuffle.

Defined results: a null text or one without words scores as empty; a row with a null doc_id or label is not
learned from (a null doc_id is not held out), nor is one with a negative label; of repeated labels of an id the largest counts;
repeated documents are scored each; without both labels to learn from nothing is toxic; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .learning import bounded_sample, remainder
from .shared import STEP_BYTES, U64, mix64, release, span_hashes, steps, text_buffers, word_spans

CELLS = 1 << 20
_FOLD = np.arange(256, dtype=np.uint8)
for _b in range(128):
    _FOLD[_b] = ord(chr(_b).lower()) if chr(_b).isalnum() else 32


PREFIXES = (3, 4, 5)


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cells, text): the features of all texts, in no order, and the text that each is from."""
    folded = _FOLD[data]
    starts, ends, first = word_spans(folded, off)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    spans = [(starts, ends, doc)]
    for n in PREFIXES:
        long = ends - starts > n
        spans.append((starts[long], starts[long] + n, doc[long]))
    sizes = [len(s[0]) for s in spans]
    h = span_hashes(folded, np.concatenate([s[0] for s in spans]), np.concatenate([s[1] for s in spans]))
    h = mix64(h + np.repeat(np.arange(len(spans), dtype=np.uint64), sizes))
    return (h >> U64(44)).astype(np.int64), np.concatenate([s[2] for s in spans])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass
class OrdinalModel:
    weights: np.ndarray  # CELLS, float32
    thetas: np.ndarray  # ascending

    def exceed(self, cells: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
        """P(grade > k) for each of n texts and each threshold."""
        telling = np.flatnonzero(self.weights[cells])
        key, count = np.unique(text[telling] * CELLS + cells[telling], return_counts=True)
        z = np.bincount(key // CELLS, self.weights[key % CELLS] * np.log1p(count), minlength=n)
        return _sigmoid(z[:, None] - self.thetas)


def train(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, rounds: int = 300, l1: float = 0.02, least: float = 0.004) -> OrdinalModel:
    """Shared weights and ordered thresholds of the least mean log loss plus l1 times the weights' size, by accelerated proximal gradients.

    rows: cells and counts; least: share of the rows that a cell must occur in.
    """
    top, n = int(grades.max()), len(rows)
    seen = np.bincount(np.concatenate([c for c, _ in rows]), minlength=CELLS)
    used = np.flatnonzero(seen >= max(2, least * n))
    place = np.full(CELLS, -1)
    place[used] = np.arange(len(used))
    row = np.repeat(np.arange(n), [len(c) for c, _ in rows])
    col = place[np.concatenate([c for c, _ in rows])]
    x = np.log1p(np.concatenate([k for _, k in rows]).astype(float))
    row, col, x = row[col >= 0], col[col >= 0], x[col >= 0]
    size = np.sqrt(np.bincount(col, x * x, minlength=len(used)) / n) + 1e-12  # a rare word weighs as much as a common one
    x = x / size[col]
    over = grades[:, None] > np.arange(top)
    times = lambda w: np.bincount(row, w[col] * x, minlength=n)
    back = lambda d: np.bincount(col, d[row] * x, minlength=len(used))
    v = np.ones(len(used)) / max(1, len(used)) ** 0.5
    curve = 1e-9
    for _ in range(12):  # the largest curvature, by powers
        u = back(times(v))
        curve = float(np.linalg.norm(u)) + 1e-9
        v = u / curve
    step, step_theta = 1 / (top * curve / (4 * n)), 2.0
    w = y = np.zeros(len(used))
    theta = np.linspace(-0.5, 0.5, top) if top > 1 else np.zeros(1)
    pace = 1.0
    for _ in range(rounds):
        d = (_sigmoid(times(y)[:, None] - theta) - over) / n
        moved = y - step * back(d.sum(axis=1))
        new = np.sign(moved) * np.maximum(0, np.abs(moved) - step * l1)
        theta = np.maximum.accumulate(theta + step_theta * d.sum(axis=0))
        faster = (1 + (1 + 4 * pace * pace) ** 0.5) / 2
        y = new + (pace - 1) / faster * (new - w)
        if ((y - new) * (new - w)).sum() < 0:
            faster = 1.0
        w, pace = new, faster
    weights = np.zeros(CELLS, np.float32)
    weights[used] = w / size
    return OrdinalModel(weights, theta)


def _middle(z: np.ndarray, above: np.ndarray, weight: np.ndarray) -> float:
    """The threshold of the greatest likelihood for scores z of rows above it and not, by bisection: its slope only rises."""
    low, high = float(z.min()) - 40, float(z.max()) + 40
    for _ in range(60):
        t = (low + high) / 2
        if (weight * (_sigmoid(z - t) - above)).sum() > 0:
            low = t
        else:
            high = t
    return (low + high) / 2


def calibrated(model: OrdinalModel, rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray) -> OrdinalModel:
    """The model with one scale and the thresholds of the greatest likelihood on rows that it was not trained on: L1 has shrunk the weights.

    Rows on both sides of a threshold weigh the same in all, so probabilities are as where either side is as frequent; a small
    penalty on the scale's logarithm keeps it finite where the rows can be told apart without error.
    """
    z = np.array([model.weights[c] @ np.log1p(n) for c, n in rows], float)
    best = None
    for scale in 2.0 ** np.arange(-4, 8.1, 0.25):
        loss, cuts = 0.02 * np.log(scale) ** 2, []
        for k in range(len(model.thetas)):
            above = grades > k
            weight = np.where(above, 0.5 / max(1, above.sum()), 0.5 / max(1, (~above).sum()))
            t = _middle(scale * z, above, weight)
            cuts.append(t)
            loss += (weight * np.logaddexp(0, np.where(above, t - scale * z, scale * z - t))).sum()
        if best is None or loss < best[0]:
            best = (loss, scale, cuts)
    return OrdinalModel((model.weights * best[1]).astype(np.float32), np.maximum.accumulate(np.array(best[2])))


def graded(rows: list[tuple[np.ndarray, np.ndarray]], toxic: np.ndarray) -> np.ndarray:
    """Grades 0, 1, 2 from labels 0, 1 by the share of telling words."""
    seen = np.bincount(np.concatenate([c for c, _ in rows]), minlength=CELLS)
    bad = [c for (c, _), y in zip(rows, toxic, strict=True) if y]
    in_bad = np.bincount(np.concatenate(bad), minlength=CELLS) if bad else np.zeros(CELLS)
    telling = (in_bad >= max(3, 0.01 * len(bad))) & (in_bad >= 0.9 * seen)
    share = np.array([n[telling[c]].sum() / max(1, n.sum()) for c, n in rows])
    cut = np.median(share[toxic > 0]) if bad else 0
    return np.where(toxic > 0, 1 + (share >= max(cut, 1e-12)), 0)


def learn(docs: DataFrame, labels: DataFrame, each: int = 2500) -> OrdinalModel | None:
    """A model from ``labels`` (doc_id, label): grades from 0 on, or 0 and 1 alone, which are graded first."""
    named = labels.where("doc_id is not null and label >= 0").groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    sample = bounded_sample(named, "label", each).withColumnRenamed("doc_id", "label_id")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = text_buffers(batch.column(1))
            for i, y in enumerate(batch.column(0).to_pylist()):
                c, n = np.unique(words(data[off[i] : off[i + 1]], np.array([0, off[i + 1] - off[i]]))[0], return_counts=True)
                yield pa.record_batch([pa.array([y], pa.int32()), pa.array([c.astype(np.int32).tobytes()], pa.binary()), pa.array([n.astype(np.int32).tobytes()], pa.binary())], ["label", "c", "n"])

    got = docs.join(F.broadcast(sample), docs["doc_id"] == sample["label_id"]).select("label", "text").mapInArrow(counted, "label int, c binary, n binary").collect()
    got.sort(key=lambda r: (r.label, bytes(r.c), bytes(r.n)))
    rows = [(np.frombuffer(bytes(r.c), np.int32).astype(np.int64), np.frombuffer(bytes(r.n), np.int32)) for r in got]
    y = np.array([r.label for r in got], int)
    if len(set(y.tolist())) < 2:
        return None
    grades = graded(rows, y) if y.max() == 1 else y
    left = np.arange(len(rows)) % 5 == 4
    if grades[~left].max() < grades.max() or len(set(grades[left].tolist())) <= grades.max():
        return train(rows, grades)  # too few rows to leave some out
    split = lambda keep: [r for r, k in zip(rows, keep, strict=True) if k]
    return calibrated(train(split(~left), grades[~left]), split(left), grades[left])


def score(docs: DataFrame, model: OrdinalModel | None, *keep: str) -> DataFrame:
    """(*keep, severity, p_toxic, grade): expected severity, P(grade > 0), and the most thresholds passed with one half."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    n = len(keep)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            data, off = text_buffers(batch.column(n))
            out = [np.zeros((0, 1))]
            for a, b in steps(data, off, STEP_BYTES // 2):
                if held.value is None:
                    out.append(np.zeros((b - a, 1)))
                else:
                    out.append(held.value.exceed(*words(data[off[a] : off[b]], off[a : b + 1] - off[a]), b - a))
            p = np.concatenate(out[1:] or out)
            yield pa.record_batch([*batch.columns[:n], pa.array(p.sum(axis=1)), pa.array(p[:, 0].copy()), pa.array((p >= 0.5).sum(axis=1), pa.int32())], [*keep, "severity", "p_toxic", "grade"])

    schema = docs.select(*keep).schema.add("severity", "double").add("p_toxic", "double").add("grade", "integer")
    return docs.select(*keep, "text").mapInArrow(scored, schema)


def toxicity(docs: DataFrame, labels: DataFrame, each: int = 2500) -> DataFrame:
    """(doc_id, held_out, severity, p_toxic, grade, toxic): learned from labels whose crc32 of doc_id does not leave 1 by 4."""
    own = labels.where(remainder("doc_id", 4) != 1).select("doc_id", F.col("toxic").alias("label"))
    model = learn(docs.select("doc_id", "text"), own, each)
    fold = docs.select("doc_id", "text", F.coalesce(remainder("doc_id", 4) == 1, F.lit(False)).alias("held_out"))
    return score(fold, model, "doc_id", "held_out").withColumn("toxic", (F.col("grade") > 0).cast("int"))
