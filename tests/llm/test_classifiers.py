import os
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from tessera.llm import language_id, quality, toxicity
from tessera.llm.queries import op3_language_id, op6_toxicity, op10_quality

DIR = "/root/testdata/sf0.01"
have = pytest.mark.skipif(not os.path.exists(DIR), reason="test tables are missing")
DOCS = "doc_id long, text string, lang string, source string, score double"
EDGE = [(None, "null id", "en", "s", 1.0), (1, None, None, None, None), (2, "", "en", "", 0.0), (3, " \n\t", "de", "", 0.0), (4, "12 !!", None, "", 0.0), (5, "same text", "en", "", 0.0), (5, "same text", "en", "", 0.0), (6, "word " * 30000, None, "", 0.0), (7, "é", "fr", "", 0.0)]


def folds(got, divisor, left):
    return [zlib.crc32(str(i).encode()) % divisor == left for i in got.doc_id]


@have
def test_language_of_held_out_documents(spark):
    got = op3_language_id(spark, DIR).toPandas().merge(pd.read_parquet(f"{DIR}/documents.parquet")[["doc_id", "lang"]], on="doc_id")
    assert len(got) == 1000 and got.held_out.tolist() == folds(got, 3, 1)
    own = got[got.held_out & got.lang.notna()]
    assert (own.lang_pred == own.lang).mean() > 0.97 and got.score.between(0, 1).all()


@have
def test_quality_of_held_out_documents(spark):
    got = op10_quality(spark, DIR).toPandas()
    assert len(got) == 1000 and got.held_out.tolist() == folds(got, 4, 2) and (got.predicted == (got.score >= 0.7)).all()
    own = got[got.held_out].merge(pd.read_parquet(f"{DIR}/labels.parquet"), on="doc_id")
    assert (own.predicted == own.quality).mean() > 0.95


@have
def test_toxicity_of_held_out_documents(spark):
    got = op6_toxicity(spark, DIR).toPandas()
    assert len(got) == 1000 and got.held_out.tolist() == folds(got, 4, 1) and got.severity.between(0, 2).all()
    own = got[got.held_out].merge(pd.read_parquet(f"{DIR}/labels.parquet"), on="doc_id", suffixes=("_pred", ""))
    assert (own.toxic_pred == own.toxic).mean() > 0.93
    assert own[own.toxic == 1].severity.mean() > own[own.toxic == 0].severity.mean()


def test_edges(spark):
    docs = spark.createDataFrame(EDGE, DOCS)
    got = {r.doc_id: r for r in language_id.language_id(docs).collect()}
    assert got[1].lang_pred == got[2].lang_pred == got[3].lang_pred == got[4].lang_pred == "und" and got[4].score == 0.0
    assert got[None].held_out is False and len(got) == 8
    labels = spark.createDataFrame([(2, 0, 0), (5, 1, 1), (5, 0, 1), (None, 1, 1), (6, None, None), (7, 1, 0), (8, 1, 1)], "doc_id long, quality int, toxic int")
    assert quality.quality(docs, labels).count() == toxicity.toxicity(docs, labels).count() == len(EDGE)
    assert all(0 <= r.score <= 1 for r in quality.quality(docs, labels).collect())
    assert quality.good_documents(docs, labels).columns == docs.columns
    none = labels.limit(0)
    assert {r.score for r in quality.quality(docs, none).collect()} == {0.5}
    assert {r.toxic for r in toxicity.toxicity(docs, none).collect()} == {0}


def test_empty_tables(spark):
    docs, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert language_id.language_id(docs).count() == quality.quality(docs, labels).count() == toxicity.toxicity(docs, labels).count() == 0


def test_passages_do_not_depend_on_neighbours():
    texts = ["  lead and !!! trail  ", "", None, "x " * 200, "a\nb", "É ê"]
    from tessera.llm.shared import text_buffers

    x, first = quality.encode(*text_buffers(pa.array(texts)))
    for i, t in enumerate(texts):
        own, _ = quality.encode(*text_buffers(pa.array([t], pa.string())))
        assert np.allclose(own, x[first[i] : first[i + 1]])


def test_gradients_of_the_attention_network():
    rng = np.random.default_rng(0)
    bags = [rng.random((n, quality.FEATURES)).astype(np.float32) for n in (1, 3, 2)]
    y = np.array([0.0, 1.0, 1.0])
    model = quality.train(bags, y, epochs=1)
    x, first = np.concatenate(bags), np.array([0, 1, 4, 6])
    g = model.gradients(x, first, y)

    def loss():
        z = model.forward(x, first)["logit"]
        return np.mean(np.log1p(np.exp(-z)) * y + np.log1p(np.exp(z)) * (1 - y))

    for k in ("V", "U", "w", "c", "W"):
        p = model.p[k].reshape(-1)
        i = len(p) // 2
        p[i] += 1e-5
        up = loss()
        p[i] -= 2e-5
        assert (up - loss()) / 2e-5 == pytest.approx(g[k].reshape(-1)[i], rel=1e-3, abs=1e-7)
        p[i] += 1e-5


def test_thresholds_are_ordered_and_temperature_calibrates():
    rng = np.random.default_rng(1)
    rows, grades = [], []
    for g in rng.integers(0, 3, 300):
        cells = np.unique(np.append(rng.integers(10, 200, 20), [1] * int(g > 0)).astype(int))
        rows.append((cells, np.where(cells == 1, 1 + 6 * (g > 1), 1)))
        grades.append(g)
    m = toxicity.train(rows, np.array(grades))
    assert m.thetas[0] < m.thetas[1]
    p = np.array([m.exceed(np.repeat(c, n), np.zeros(n.sum(), int), 1).sum() for c, n in rows])
    assert p[np.array(grades) == 2].mean() > p[np.array(grades) == 1].mean() > p[np.array(grades) == 0].mean()
    z = rng.normal(size=(2000, 3))
    y = np.array([rng.choice(3, p=q) for q in language_id.softmax(z / 2.0)])
    assert language_id.fit_temperature(z, y) == pytest.approx(2.0, rel=0.15)
