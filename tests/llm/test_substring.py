import hashlib
import random

import pytest

from tessera.llm import substring_dedup as S

SCHEMA = "doc_id long, text string, g string, kind int, blob string"


def made(seed=1):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") + rng.choice("xyz") + str(rng.randrange(40))
    passages = [[word() for _ in range(rng.choice([12, 13, 14, 20, 60]))] for _ in range(12)]
    rows = []
    for i in range(160):
        w = [word() for _ in range(rng.randrange(40))]
        for _ in range(rng.randrange(4)):
            w += rng.choice(passages) + [word() for _ in range(rng.randrange(9))]
        if i % 3 == 0:
            w += passages[0]  # a passage that a third holds
        rows.append((rng.randrange(10**9), rng.choice([" ", "\n", "\t  "]).join(w)))
    rows += [(5, "same " * 30), (6, "same " * 13), (7, "same " * 12), (8, None), (9, ""), (10, " \n "), (None, " ".join(passages[0])), rows[3], rows[4], (rows[5][0], "other " + " ".join(passages[1])), (11, "ü é " * 20 + " ".join(passages[2])), (12, " ".join(passages[3] * 400))]
    return [(i, t, f"s{k}", k, "b") for k, (i, t) in enumerate(rows)]


def brute(rows):
    first, out = {}, []
    split = [(i, (t or "").encode().split()) for i, t, *_ in rows]
    for i, w in split:
        if i is not None:
            for k in range(len(w) - 12):
                key = tuple(w[k : k + 13])
                first[key] = min(first.get(key, i), i)
    for i, w in split:
        gone = set()
        for k in range(len(w) - 12):
            if i is not None and first[tuple(w[k : k + 13])] < i:
                gone.update(range(k, k + 13))
        kept = [x for k, x in enumerate(w) if k not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("gather", [1 << 21, 50])
def test_equals_brute_force(spark, monkeypatch, gather):
    monkeypatch.setattr(S, "GATHER", gather)
    rows = made()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = sorted(map(tuple, S.substring_duplicates(df).collect()), key=str)
    want = brute(rows)
    assert sum(r[2] for r in want) > 1000
    assert got == want


def test_rows_are_carried(spark):
    rows = made()
    df = spark.createDataFrame(rows, SCHEMA)
    out = S.cut_documents(df)
    assert out.columns == df.columns
    got = {r.g: r for r in out.collect()}
    digests = {}
    for i, t, g, *_ in rows:
        digests.setdefault((i, t), []).append(g)
    assert len(got) == len(rows)
    want = sorted((i, sha) for i, _, _, sha in brute(rows) if i is not None)
    assert want == sorted((r.doc_id, hashlib.sha256(" ".join((r.text or "").split()).encode()).hexdigest()) for r in got.values() if r.doc_id is not None)
    untouched = [r for r in got.values() if r.doc_id in (7, 8, 9, 10, None)]
    original = {g: t for _, t, g, *_ in rows}
    assert untouched and all(r.text == original[r.g] for r in untouched)


def test_empty_table(spark):
    assert S.substring_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_cover_aligns_any_two_positions():
    for i in range(S.PERIOD):
        for j in range(S.PERIOD):
            assert any((i + d) % S.PERIOD in S.COVER and (j + d) % S.PERIOD in S.COVER for d in range(S.PERIOD))
