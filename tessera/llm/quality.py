"""Operator 10: a quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of 64 words (the last may be shorter).  Every passage is encoded
by the make-up of its bytes (classes, and which class follows which), by its words (length, variety,
immediate repetition) and by how many of its three-word runs the document repeats.  A
small network turns each encoding into a hidden vector; gated attention, learned from
the labels of whole documents, weighs the passages, and the weighted sum is scored.

Plan: a bounded sample of labelled ids (``each`` per label) is broadcast to find its documents,
whose encodings are gathered to train on; one map over the scan scores every whole text, with no
shuffle.  A training label never reaches a prediction but through the weights.

Defined results: a null, empty or blank text is one passage of zeros; a row with a null doc_id or
label, or a label other than 0 and 1, is not learned from (a null doc_id is not held out); of repeated labels of an id the largest
counts; repeated documents are scored each; with fewer than two labels to learn
from, every score is the share of label 1 (one half without any); an
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
from .shared import STEP_BYTES, U64, release, span_hashes, steps, text_buffers, window_hashes, word_spans

PASSAGE = 64
HIDDEN, GATES = 16, 8


def _classes() -> tuple[np.ndarray, np.ndarray, int]:
    """Byte to class: letters by case, digits, blanks, line ends, non-ASCII, every other mark on its own; and to eight coarse classes."""
    fine, coarse = np.zeros(256, np.int64), np.zeros(256, np.int64)
    n = 6
    for b in range(256):
        c = chr(b)
        if b >= 128:
            fine[b], coarse[b] = 5, 4
        elif "a" <= c <= "z":
            fine[b], coarse[b] = 0, 0
        elif "A" <= c <= "Z":
            fine[b], coarse[b] = 1, 1
        elif c.isdigit():
            fine[b], coarse[b] = 2, 2
        elif c in "\n\r\x0b\x0c":
            fine[b], coarse[b] = 4, 6
        elif b <= 32 or b == 127:
            fine[b], coarse[b] = 3, 3
        else:
            fine[b], coarse[b] = n, 5 if c in ".,;:'\"-" else 7
            n += 1
    return fine, coarse, n


_FINE, _COARSE, _N_FINE = _classes()
_N_PAIRS = 64
FEATURES = _N_FINE + _N_PAIRS + 7


def _share_repeated(keys: np.ndarray, group: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct, largest count) by group, and for each key whether its group holds it again."""
    order = np.argsort((group.astype(np.uint64) << U64(40)) | (keys >> U64(24)), kind="stable")
    k, g = keys[order] >> U64(24), group[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (g[1:] != g[:-1])
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(k)))
    distinct, most = np.bincount(g[at], minlength=n), np.zeros(n, np.int64)
    np.maximum.at(most, g[at], count)
    again = np.zeros(len(k), bool)
    again[order] = np.repeat(count > 1, count)
    return distinct, most, again


def encode(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features, first): text i's passages are rows first[i] to first[i + 1]; a text without words has one of zeros."""
    starts, ends, first = word_spans(data, off)
    words = np.diff(first)
    bags = np.maximum(1, -(-words // PASSAGE))
    bag_first = np.concatenate([[0], np.cumsum(bags)])
    x = np.zeros((int(bag_first[-1]), FEATURES), np.float32)
    if not len(starts):
        return x, bag_first
    doc = np.repeat(np.arange(len(words)), words)
    within = np.arange(len(starts)) - first[:-1][doc]
    bag = bag_first[:-1][doc] + within // PASSAGE  # of each word
    real, head = np.unique(bag, return_index=True)
    n_words = np.diff(np.append(head, len(bag)))
    a, b = starts[head], ends[head + n_words - 1]
    cuts = np.empty(2 * len(real) + 1, np.int64)
    cuts[0], cuts[1:-1:2], cuts[2::2] = a[0], b - a, np.append(a[1:], len(data)) - b
    names = np.full(2 * len(real) + 1, len(real), np.int64)
    names[1::2] = np.arange(len(real))
    lab = np.repeat(names, cuts)
    size = (b - a)[:, None]
    fine = np.bincount(lab * _N_FINE + _FINE[data], minlength=(len(real) + 1) * _N_FINE).reshape(-1, _N_FINE)[: len(real)]
    c = _COARSE[data]
    pair = np.bincount(lab[1:] * _N_PAIRS + c[:-1] * 8 + c[1:], minlength=(len(real) + 1) * _N_PAIRS)
    # A passage's first byte follows a blank, whatever stands before it.
    np.add.at(pair, np.arange(len(real)) * _N_PAIRS + 3 * 8 + c[a], 1)
    inner = a > 0
    np.subtract.at(pair, np.flatnonzero(inner) * _N_PAIRS + c[a[inner] - 1] * 8 + c[a[inner]], 1)
    pair = pair.reshape(-1, _N_PAIRS)[: len(real)]
    h, length = span_hashes(data, starts, ends), (ends - starts).astype(np.float64)
    compact = np.repeat(np.arange(len(real)), n_words)
    distinct, most, _ = _share_repeated(h, compact, len(real))
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (compact[1:] == compact[:-1])
    runs = np.zeros(len(h), bool)
    if len(h) >= 3:
        r = window_hashes(h, 3)
        whole = doc[:-2] == doc[2:]
        again = np.zeros(len(r), bool)
        again[whole] = _share_repeated(r[whole], doc[:-2][whole], len(words))[2]
        runs[:-2] = again
    total = np.add.reduceat(length, head)
    mean = total / n_words
    spread = np.sqrt(np.maximum(0, np.add.reduceat(length * length, head) / n_words - mean * mean))
    own = [distinct / n_words, np.add.reduceat(same, head, dtype=np.int64) / n_words, most / n_words, np.minimum(mean, 40) / 10, np.minimum(spread, 40) / 10, n_words / PASSAGE, np.add.reduceat(runs, head, dtype=np.int64) / n_words]
    x[real] = np.hstack([fine / size, pair / size, np.stack(own, axis=1)])
    return x, bag_first


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass
class AttentionModel:
    shift: np.ndarray
    scale: np.ndarray
    p: dict[str, np.ndarray]
    prior: float = 0.0  # log odds between the corpus and the sample

    def forward(self, x: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        x = np.clip((x - self.shift) * self.scale, -6, 6)
        h = np.tanh(x @ p["W"] + p["b"])
        t, s = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        e = (t * s) @ p["w"]
        n = np.diff(first)
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, first[:-1]), n))
        a = e / np.repeat(np.add.reduceat(e, first[:-1]), n)
        z = np.add.reduceat(a[:, None] * h, first[:-1], axis=0)
        return {"x": x, "h": h, "t": t, "s": s, "a": a, "z": z, "logit": z @ p["c"] + p["d"][0]}

    def score(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        return _sigmoid(self.forward(x, first)["logit"].astype(np.float64) + self.prior)

    def gradients(self, x: np.ndarray, first: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        f, p, n = self.forward(x, first), self.p, np.diff(first)
        dl = (_sigmoid(f["logit"]) - y) / len(y)
        dz = np.repeat(dl[:, None] * p["c"], n, axis=0)
        da = (f["h"] * dz).sum(axis=1)
        de = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, first[:-1]), n))
        gate = de[:, None] * p["w"]
        dt, ds = gate * f["s"] * (1 - f["t"] ** 2), gate * f["t"] * f["s"] * (1 - f["s"])
        dh = (f["a"][:, None] * dz + dt @ p["V"].T + ds @ p["U"].T) * (1 - f["h"] ** 2)
        return {"W": f["x"].T @ dh, "b": dh.sum(axis=0), "V": f["h"].T @ dt, "U": f["h"].T @ ds, "w": (f["t"] * f["s"]).T @ de, "c": f["z"].T @ dl, "d": np.array([dl.sum()])}


def train(bags: list[np.ndarray], y: np.ndarray, epochs: int = 30, batch: int = 64, rate: float = 0.01, decay: float = 1e-4, seed: int = 5) -> AttentionModel:
    """The network by Adam over the sample's bags."""
    rng = np.random.default_rng(seed)
    every = np.concatenate(bags)
    shift, scale = every.mean(axis=0), 1 / np.maximum(every.std(axis=0), 1e-3)
    shapes = {"W": (FEATURES, HIDDEN), "b": (HIDDEN,), "V": (HIDDEN, GATES), "U": (HIDDEN, GATES), "w": (GATES,), "c": (HIDDEN,), "d": (1,)}
    p = {k: rng.normal(0, 1 / np.sqrt(s[0]), s) if k not in "bd" else np.zeros(s) for k, s in shapes.items()}
    m, v, t = {k: np.zeros(s) for k, s in shapes.items()}, {k: np.zeros(s) for k, s in shapes.items()}, 0
    model = AttentionModel(shift, scale, p)
    for epoch in range(epochs):
        for i in np.array_split(rng.permutation(len(bags)), max(1, len(bags) // batch)):
            own = [bags[k] for k in i]
            g = model.gradients(np.concatenate(own), np.concatenate([[0], np.cumsum([len(b) for b in own])]), y[i])
            t += 1
            step = rate * (1 - epoch / epochs) + 1e-4
            for k in p:
                g[k] = g[k] + decay * p[k]
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                p[k] -= step * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return model


def learn(docs: DataFrame, labels: DataFrame, each: int = 2000, most: int = 256) -> AttentionModel | float:
    """A model from ``labels`` (doc_id, label in 0, 1); the share of label 1 where there is only one label or none.

    each: documents of either label to learn from; most: passages that one of them may bring, spread evenly over
    the whole text, so what reaches the driver is bounded.  Scores are of all passages.
    """
    named = labels.where("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    counts = {r.label: r["count"] for r in named.groupBy("label").count().collect()}
    sample = bounded_sample(named, "label", each).withColumnRenamed("doc_id", "label_id")

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            data, off = text_buffers(batch.column(1))
            for i, y in enumerate(batch.column(0).to_pylist()):
                x, _ = encode(data[off[i] : off[i + 1]], np.array([0, off[i + 1] - off[i]]))
                x = x[np.arange(min(len(x), most)) * len(x) // min(len(x), most)]
                yield pa.record_batch([pa.array([y], pa.int32()), pa.array([x.tobytes()], pa.binary())], ["label", "x"])

    rows = docs.join(F.broadcast(sample), docs["doc_id"] == sample["label_id"]).select("label", "text").mapInArrow(encoded, "label int, x binary").collect()
    rows.sort(key=lambda r: (r.label, bytes(r.x)))
    y = np.array([r.label for r in rows], float)
    if len(set(y)) < 2:
        return float(y.mean()) if len(y) else 0.5
    model = train([np.frombuffer(bytes(r.x), np.float32).reshape(-1, FEATURES) for r in rows], y)
    model.prior = float(np.log(counts[1] / counts[0]) - np.log(y.sum() / (len(y) - y.sum())))
    return model


def score(docs: DataFrame, model: AttentionModel | float, *keep: str) -> DataFrame:
    """(*keep, score) of every document."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    n = len(keep)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            data, off = text_buffers(batch.column(n))
            out = np.full(len(off) - 1, held.value if isinstance(held.value, float) else 0.0)
            for a, b in steps(data, off, STEP_BYTES // 2) if not isinstance(held.value, float) else ():
                out[a:b] = held.value.score(*encode(data[off[a] : off[b]], off[a : b + 1] - off[a]))
            yield pa.record_batch([*batch.columns[:n], pa.array(out)], [*keep, "score"])

    schema = docs.select(*keep).schema.add("score", "double")
    return docs.select(*keep, "text").mapInArrow(scored, schema)


def _foldless(labels: DataFrame) -> DataFrame:
    return labels.where(remainder("doc_id", 4) != 2).select("doc_id", F.col("quality").alias("label"))


def quality(docs: DataFrame, labels: DataFrame, each: int = 2000, threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted): learned from labels whose crc32 of doc_id does not leave 2 by 4."""
    model = learn(docs.select("doc_id", "text"), _foldless(labels), each)
    fold = docs.select("doc_id", "text", F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"))
    return score(fold, model, "doc_id", "held_out").withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def good_documents(docs: DataFrame, labels: DataFrame, each: int = 2000, threshold: float = 0.7) -> DataFrame:
    """The documents that the classifier accepts, with their own columns."""
    model = learn(docs.select("doc_id", "text"), _foldless(labels), each)
    columns = docs.columns
    whole = docs.select(F.struct(*[docs[c] for c in columns]).alias("kept_row"), "text")
    return score(whole, model, "kept_row").where(F.col("score") >= threshold).select("kept_row.*")
