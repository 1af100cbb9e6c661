import numpy as np
import pytest

from tessera.llm import embedding_dedup as E
from tessera.llm import neighbours as N

SCHEMA = "vec_id long, embedding array<float>, label int, links long"


def made(n=300, dim=24, seed=2):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    for i in range(0, n, 3):  # chains and groups of near copies
        x[i] = x[i // 9] + rng.normal(size=dim) * 0.25
    x[200:240] = x[7] + rng.normal(size=(40, dim)) * 0.05
    rows = [(i, [float(np.float32(v)) for v in x[i]], int(i % 3 == 1), 0) for i in range(n)]
    return rows + [(900, None, 1, 0), (901, [], 1, 0), (902, [0.0] * dim, 1, 0), (903, [float("nan")] * dim, 1, 0), (904, [float("inf")] + [1.0] * (dim - 1), 1, 0), (905, rows[0][1], None, 0), (None, rows[0][1], 0, 0), (906, [None] + rows[0][1][1:], 0, 0), (907, [1.0, 2.0], 0, 0), rows[7]]


def brute_links(rows, cos):
    good = {}
    for i, e, label, _ in rows:
        if i is not None and label is not None and e and all(v is not None and np.isfinite(v) for v in e) and any(e):
            good[i] = (np.array(e, float), label)
    links, root = {i: 0 for i, *_ in rows}, {i: i for i, *_ in rows}
    ids = sorted(good)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            (x, p), (y, q) = good[a], good[b]
            if a < b and p == q and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= cos:
                links[a] += 1
                links[b] += 1
                s, t = sorted((find(a), find(b)))
                root[t] = s
    return {i: (links[i], find(i)) for i in links}


@pytest.mark.parametrize("block", [1024, 40])
def test_links_and_components_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(E, "LEAST_BLOCK", block)
    rows = made()
    got = E.embedding_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    want = brute_links(rows, 0.93)
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_links, r.component_id) == want[r.vec_id]
        assert r.kept == (r.vec_id is not None and r.vec_id == r.component_id)
    assert max(n for n, _ in want.values()) >= 25


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(4)
    a = rng.normal(size=(400, 64))
    b = 0.95 * a + 0.3 * rng.normal(size=a.shape)
    a, b = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (a, b))
    packed, factor, _ = E.codes(a)
    est, half = E.estimates(packed, factor, E.codes(b)[2], 0.9)
    err = np.diag(est) - (a * b).sum(axis=1)
    assert abs(err.mean()) < 0.01 and (np.abs(err) <= np.diag(half)).all()
    assert abs((est - a @ b.T).mean()) < 0.01


def test_empty_tables(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert E.embedding_duplicates(df).count() == 0 and N.nearest(df).count() == 0


@pytest.mark.parametrize("blocks", [1, 5])
def test_search_of_a_small_table_is_exact(spark, monkeypatch, blocks):
    monkeypatch.setattr(N, "LEAST_BLOCK", 4096 if blocks == 1 else 64)
    monkeypatch.setattr(N, "BLOCKS", blocks)
    rows = made()
    got = {}
    for r in N.nearest(spark.createDataFrame(rows, SCHEMA), every=10).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    good = {i: np.array(e, float) for i, e, *_ in rows if i is not None and i < 900 or i == 905}
    assert sorted(got) == [i for i in sorted(good) if i % 10 == 0]
    for q, found in got.items():
        want = sorted((float(np.sqrt(((good[q] - x) ** 2).sum())), i) for i, x in good.items() if i != q)[:10]
        assert [(k, i) for k, i, _ in sorted(found)] == [(k + 1, i) for k, (_, i) in enumerate(want)]
        assert np.allclose([s for *_, s in sorted(found)], [d for d, _ in want], rtol=1e-12)


def test_fewer_candidates_than_asked_for(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], 0, 0), (1, [0.0, 1.0], 0, 0), (2, [0.0, 2.0], None, 0)], SCHEMA)
    assert [(r.query_id, r.rank, r.vec_id) for r in sorted(N.nearest(df).collect(), key=lambda r: r.rank)] == [(0, 1, 1), (0, 2, 2)]


def test_recall_on_directions_without_structure():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(6000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = np.arange(len(x))
    pivots = N.pick_pivots(x[rng.permutation(len(x))[: N.SAMPLE]])
    index = N.PermutationIndex(x, ids, pivots)
    hit = 0
    for q in range(40):
        rows, _ = index.search(x[q], N.nearest_pivots(x[q : q + 1], pivots, index.depth)[0], q, 10)
        d = ((x - x[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        hit += len(set(rows.tolist()) & set(np.argsort(d)[:10].tolist()))
    assert hit >= 0.9 * 400


@pytest.mark.parametrize("n", [700, 6000])
def test_search_is_exact_beside_a_tight_cluster(n):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(n, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[::3] = x[0] + rng.normal(size=x[::3].shape) * 0.002
    sample = x[rng.permutation(n)[: N.SAMPLE]]
    pivots = N.pick_pivots(np.concatenate([sample[:5], sample]))
    dense = np.linalg.norm(pivots - x[0], axis=1) < 0.1
    assert len(pivots) == N.PIVOTS == len(np.unique(pivots, axis=0)) and dense.sum() > N.PIVOTS / 5
    index = N.PermutationIndex(x, np.arange(n), pivots)
    for q in range(120):
        rows, _ = index.search(x[q], N.nearest_pivots(x[q : q + 1], pivots, index.depth)[0], q, 10)
        d = ((x - x[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        assert rows.tolist() == np.argsort(d)[:10].tolist()


def test_every_length_and_every_vector_of_a_repeated_id_take_part(spark, monkeypatch):
    monkeypatch.setattr(N, "LEAST_BLOCK", 32)
    monkeypatch.setattr(N, "CHUNK", 4)
    rng = np.random.default_rng(9)
    rows = [(i, [float(np.float32(v)) for v in rng.normal(size=24 if i % 3 else 7)], 0, 0) for i in range(240)]
    rows += [(i, [float(np.float32(v)) for v in rng.normal(size=n)], 0, 0) for i, n in ((20, 24), (31, 24), (31, 7), (60, 24))]
    got = {}
    for r in N.nearest(spark.createDataFrame([*rows, rows[1], rows[60]], SCHEMA), every=10).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert sorted(got) == list(range(0, 240, 10))
    for q, found in got.items():
        asked = [np.array(e) for i, e, *_ in rows if i == q]
        want = sorted((float(np.sqrt(((a - np.array(e)) ** 2).sum())), i) for a in asked for i, e, *_ in rows if i != q and len(e) == len(a))[:10]
        assert [(k, i) for k, i, _ in sorted(found)] == [(k + 1, i) for k, (_, i) in enumerate(want)]
        assert np.allclose([s for *_, s in sorted(found)], [d for d, _ in want], rtol=1e-12)
