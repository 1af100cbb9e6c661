import random

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import near_dedup as M
from tessera.llm.queries import op7_near_dedup
from tessera.llm.shared import U64, text_buffers

SCHEMA = "doc_id long, text string, g string, kind int, component long"


def made(seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    rows = []
    for i in range(60):
        rows.append((1000 + i, " ".join(word() for _ in range(rng.randrange(5, 120)))))
    hub = rows[0][1].split() + [word() for _ in range(150)]
    for i in range(90):  # a large group whose members meet through a few
        w = list(hub)
        for _ in range(rng.randrange(1, 9)):
            w[rng.randrange(len(w))] = word()
        rows.append((rng.randrange(10**6), " ".join(w)))
    for i in range(40):  # chains
        w = rows[i][1].split()
        w[rng.randrange(len(w))] = word()
        rows.append((2000 + i, " ".join(w)))
    rows += [(5, rows[3][1]), (6, rows[3][1].replace(" ", "\n\t")), (7, None), (8, ""), (9, " "), (10, ""), (None, rows[3][1]), rows[4], (11, "one two"), (12, "one two"), (13, "one"), (14, "x " * 5000), (15, "x " * 4999), (16, "one two three four five six"), (17, "été " * 3)]
    return [(i, t, "g", 0, 0) for i, t in rows]


def brute(rows, least=0.8):
    texts = [t for _, t, *_ in rows]
    h, c, first, _ = M.shingles(*text_buffers(pa.array(texts)))
    sets = [(h[a:b], c[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
    df = np.zeros(M.CELLS, np.int64)
    for s, _ in sets:
        df[np.unique((s >> U64(28)).astype(int))] += 1
    idf = M.inverse_frequencies(df, len(rows))
    sets = [(s, M.weights(s, k, idf)) for s, k in sets]
    root = {i: i for i, *_ in rows if i is not None}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, (i, *_) in enumerate(rows):
        for y in range(x):
            j = rows[y][0]
            if i is not None and j is not None and i != j and len(sets[x][0]) and len(sets[y][0]) and M.similarity(sets[x], sets[y]) >= least:
                p, q = sorted((find(i), find(j)))
                root[q] = p
    return {i: find(i) for i in root}


def test_classes_equal_brute_force_and_one_of_each_stays(spark):
    rows = made()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got, want = M.near_classes(df).collect(), brute(rows)
    assert len(got) == len(rows) and len(set(want.values())) < len(want) - 30
    for r in got:
        if r.doc_id is not None:
            assert (r.class_id, r.kept) == (want[r.doc_id], r.doc_id == want[r.doc_id])
        else:
            assert r.class_id is None and r.kept
    left = M.near_distinct(df)
    assert left.columns == df.columns
    assert sorted(r.doc_id for r in left.collect() if r.doc_id is not None) == sorted(i for i, *_ in rows if i is not None and want[i] == i)


def test_samples_agree_as_often_as_sets_are_similar():
    rng = np.random.default_rng(5)
    h = np.sort(rng.integers(0, 1 << 48, 400, np.uint64))
    w = rng.random(400) * 3 + 0.5
    for share in (0.95, 0.8, 0.6):
        agree, want = [], []
        for _ in range(12):
            keep = rng.random(400) < share
            other = np.where(rng.random(400) < 0.5, w, w * 1.3)
            a, b = (h, w), (h[keep], other[keep])
            s = M.samples(np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]]), np.array([0, 400, 400 + keep.sum()]))
            agree.append((s[0] == s[1]).mean())
            want.append(M.similarity(a, b))
        assert np.mean(agree) == pytest.approx(np.mean(want), abs=0.05)


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert M.near_classes(df).count() == 0 and M.near_distinct(df).count() == 0


def test_plain_samples_agree_as_often_as_sets_are_similar():
    h = np.sort(np.random.default_rng(6).integers(0, 1 << 48, 400, np.uint64))
    s = M.plain_samples(np.concatenate([h, h[40:]]), np.array([0, 400, 760]), M.WIDE)
    assert M.plain_similarity(h, h[40:]) == 0.9 and (s[0] == s[1]).mean() == pytest.approx(0.9, abs=0.03)


def test_a_copy_in_a_hot_group_needs_no_more_than_one_in_a_pair(spark, tmp_path):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    hot = [word() for _ in range(100)]
    texts = [hot[:-4] + [word() for _ in range(4)] for _ in range(120)] + [[word() for _ in range(100)] for _ in range(240)]
    edited = list(hot)  # two single words of a hundred: 0.81 of the middle of the group
    edited[30], edited[60] = word(), word()
    rows = [(0, " ".join(hot)), (1, " ".join(edited))] + [(10 + i, " ".join(w)) for i, w in enumerate(texts)]
    h, _, first, _ = M.shingles(*text_buffers(pa.array([rows[0][1], rows[1][1]])))
    assert 0.8 <= M.plain_similarity(h[: first[1]], h[first[1] :]) < 0.82
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r.class_id for r in op7_near_dedup(spark, str(tmp_path)).collect()}
    assert found[1] == 0 and len({found[i] for i in range(130, 370)}) == 240


def test_different_texts_of_one_id_are_documents_of_their_own(spark):
    rng = random.Random(9)
    a, b, c = (" ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(60)) for _ in range(3))
    rows = [(1, a, "x"), (2, a, "x"), (2, b, "y"), (3, b, "x"), (4, c, "x"), (2, "", "x"), (None, a, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, g string")
    got = sorted(((r.doc_id or 0, r.class_id or 0, r.kept) for r in M.near_classes(df).collect()))
    assert got == [(0, 0, True), (1, 1, True), (2, 1, False), (2, 2, True), (2, 2, True), (3, 2, False), (4, 4, True)]
    left = M.near_distinct(df)
    assert left.columns == df.columns
    assert sorted(map(tuple, left.collect()), key=str) == sorted([rows[0], rows[2], *rows[4:]], key=str)
