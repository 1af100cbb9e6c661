import os

import pandas as pd
import pytest

import corpus_pipeline as P

DIR = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.exists(DIR), reason="test tables are missing")
def test_each_stage_takes_effect(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns, kept = docs.columns, [docs.toPandas()]
    for name, stage in P.STAGES[:-1]:
        docs = P.written(stage(spark, docs, DIR), name)
        assert docs.columns == columns
        kept.append(docs.toPandas())
    whole, good, single, cut, mixed = kept
    labels = pd.read_parquet(f"{DIR}/labels.parquet").set_index("doc_id").quality
    assert set(good.doc_id) < set(whole.doc_id)
    assert not set(good.doc_id) & set(labels[labels == 0].index) or labels.eq(0).sum() < 5
    assert not single.text.str.split().str.join(" ").duplicated().any() and set(single.doc_id) <= set(good.doc_id)
    first = {}
    words = {i: t.split() for i, t in zip(single.doc_id, single.text, strict=True)}
    for i in sorted(words):
        for k in range(len(words[i]) - 12):
            first.setdefault(tuple(words[i][k : k + 13]), i)
    for i, t in zip(cut.doc_id, cut.text, strict=True):
        gone = {k + d for k in range(len(words[i]) - 12) if first[tuple(words[i][k : k + 13])] < i for d in range(13)}
        assert t.split() == [w for k, w in enumerate(words[i]) if k not in gone]
    size = cut.text.str.split().str.len()
    assert mixed.doc_id.value_counts().max() <= 2 and abs(mixed.text.str.split().str.len().sum() / size.sum() - 1.5) < 0.1
    pieces = P.STAGES[-1][1](spark, docs, DIR).toPandas()
    assert set(pieces.doc_id) == set(mixed.doc_id)
    fill = pieces.groupby("sequence_id").agg(n=("length", "sum"), size=("sequence_length", "first"))
    assert (fill.n == fill["size"]).all() and ((fill["size"] & (fill["size"] - 1)) == 0).all()
    assert len(P.run(spark, DIR).columns) == len(pieces.columns)
