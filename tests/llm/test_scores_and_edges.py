"""Scores and links by plain loops over one text at a time, and cases at the edges."""

import itertools
import math
import os
import random
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline as P
from tessera.llm import language_id, near_dedup, neighbours, quality, shared, toxicity

DIR = "/root/testdata/sf0.001"
have = pytest.mark.skipif(not os.path.exists(DIR), reason="test tables are missing")
MORE = ["", " \n\t ", "a", "Ünïcödé ßtraße, 東京 🙂", "x " * 700, "one two\x85three\x1cfour|five", "REPEAT repeat Repeat " * 90, "!!! ??? 123", "tab\tand\nline\r\nends " * 70]


def mixed(h):
    """The 64-bit finaliser in whole numbers."""
    m = (1 << 64) - 1
    h ^= h >> 33
    h = h * 0xFF51AFD7ED558CCD & m
    h ^= h >> 33
    h = h * 0xC4CEB9FE1A85EC53 & m
    return h ^ h >> 33


def hashed(word):
    return mixed(sum(int(shared._BYTE[b]) * pow(0x9E3779B97F4A7C15, i, 1 << 64) for i, b in enumerate(word)) % (1 << 64))


def texts(spark, n=200):
    return [r.text for r in spark.read.parquet(f"{DIR}/documents.parquet").select("text").limit(n).collect()] + MORE


def frame(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)


def sigmoid(z):
    return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


@have
def test_languages_equal_a_loop_over_ngrams(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").where("lang is not null and doc_id is not null")
    model = language_id.learn(docs.select("doc_id", "text", "lang"))
    number, every = language_id._letters(), texts(spark)
    got = {r.doc_id: r for r in language_id.identify(frame(spark, every), model, "doc_id").collect()}
    for i, t in enumerate(every):
        t, sums, n = (t or "") + "  ", np.zeros(len(model.languages)), 0
        for size in (1, 2, 3):
            for k in range(len(t) - size + 1):
                h = 0
                for c in t[k : k + size]:
                    h = (h * 0x9E3779B1 + int(number[ord(c)])) % (1 << 32)
                cell = (h ^ h >> 15) * 0x85EBCA6B % (1 << 32) >> 16
                if cell:
                    n += 1
                    sums += model.weights[cell]
        if not n:
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        z = (sums / n + model.bias) / model.temperature
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert got[i].score == pytest.approx(p.max(), abs=2e-3)
        assert p[model.languages.index(got[i].lang_pred)] >= p.max() - 4e-3


@have
def test_toxicity_equals_a_loop_over_words(spark):
    docs, labels = (spark.read.parquet(f"{DIR}/{t}.parquet") for t in ("documents", "labels"))
    model, every = toxicity.learn(docs.select("doc_id", "text"), labels.selectExpr("doc_id", "toxic as label")), texts(spark, 80)
    got = {r.doc_id: r for r in toxicity.score(frame(spark, every), model, "doc_id").collect()}
    for i, t in enumerate(every):
        folded = bytes(b if b >= 128 else ord(chr(b).lower()) if chr(b).isalnum() else 32 for b in (t or "").encode())
        cells = Counter()
        for w in folded.split():
            for kind, n in enumerate((None, 3, 4, 5)):
                if n is None or len(w) > n:
                    cells[mixed((hashed(w[:n]) + kind) % (1 << 64)) >> 44] += 1
        z = sum(float(model.weights[c]) * math.log1p(n) for c, n in cells.items())
        p = [sigmoid(z - x) for x in model.thetas]
        assert got[i].severity == pytest.approx(sum(p), abs=1e-5) and got[i].p_toxic == pytest.approx(p[0], abs=1e-5)
        assert got[i].grade == sum(x >= 0.5 for x in p) or min(abs(x - 0.5) for x in p) < 1e-5


def test_thresholds_of_greatest_likelihood():
    rng = np.random.default_rng(3)
    rows, grades = [], []
    for g in rng.integers(0, 3, 900):
        rows.append((np.array([1]), np.array([max(0, round(np.expm1(2 * g + 1 + rng.normal())))])))
        grades.append(g)
    weights = np.zeros(toxicity.CELLS, np.float32)
    weights[1] = 0.1  # shrunk
    m = toxicity.calibrated(toxicity.OrdinalModel(weights, np.zeros(2)), rows, np.array(grades))
    assert m.weights[1] > 1 and m.thetas[0] < m.thetas[1]
    p = np.array([m.exceed(np.repeat(c, n), np.zeros(n.sum(), int), 1)[0] for c, n in rows])
    for k in range(2):
        above = np.array(grades) > k
        balanced = (p[above, k].mean() + p[~above, k].mean()) / 2
        assert balanced == pytest.approx(0.5, abs=0.02)  # calibrated where both sides weigh the same


def passages(text):
    """Features of each passage, word by word."""
    words, at = [], 0
    data = (text or "").encode()
    for w in data.split():
        a = data.index(w, at)
        words.append((w, a))
        at = a + len(w)
    if not words:
        return [np.zeros(quality.FEATURES)]
    runs = Counter(tuple(w for w, _ in words[i : i + 3]) for i in range(len(words) - 2))
    out = []
    for k in range(0, len(words), 64):
        own = words[k : k + 64]
        span = data[own[0][1] : own[-1][1] + len(own[-1][0])]
        x = np.zeros(quality.FEATURES)
        before = 3
        for b in span:
            x[quality._FINE[b]] += 1 / len(span)
            x[quality._N_FINE + before * 8 + quality._COARSE[b]] += 1 / len(span)
            before = quality._COARSE[b]
        size, n = [len(w) for w, _ in own], len(own)
        again = sum(runs[tuple(w for w, _ in words[i : i + 3])] > 1 for i in range(k, k + n) if i + 2 < len(words))
        x[-7:] = [len({w for w, _ in own}) / n, sum(own[i][0] == own[i - 1][0] for i in range(1, n)) / n, max(Counter(w for w, _ in own).values()) / n, min(np.mean(size), 40) / 10, min(np.std(size), 40) / 10, n / 64, again / n]
        out.append(x)
    return out


@have
def test_quality_equals_a_loop_over_passages(spark):
    docs, labels = (spark.read.parquet(f"{DIR}/{t}.parquet") for t in ("documents", "labels"))
    model, every = quality.learn(docs.select("doc_id", "text"), labels.selectExpr("doc_id", "quality as label")), texts(spark, 60)
    got = {r.doc_id: r.score for r in quality.score(frame(spark, every), model, "doc_id").collect()}
    p = model.p
    for i, t in enumerate(every):
        hidden, weigh = [], []
        for x in passages(t):
            h = np.tanh(np.clip((x - model.shift) * model.scale, -6, 6) @ p["W"] + p["b"])
            hidden.append(h)
            weigh.append(float((np.tanh(h @ p["V"]) / (1 + np.exp(-(h @ p["U"])))) @ p["w"]))
        e = np.exp(np.array(weigh) - max(weigh))
        z = (np.array(hidden) * (e / e.sum())[:, None]).sum(axis=0)
        assert got[i] == pytest.approx(sigmoid(float(z @ p["c"] + p["d"][0]) + model.prior), abs=2e-3)


def test_other_labels_and_long_samples(spark):
    docs = frame(spark, ["good prose of some length here. " * 2000, "zz!! " * 50, "fine words, in a row. " * 9, "@@@ ### " * 40])
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, 2), (3, None), (3, -1)], "doc_id long, label int")
    model = quality.learn(docs, labels, most=5)
    assert isinstance(model, quality.AttentionModel) and model.prior == pytest.approx(0.0)
    assert isinstance(quality.learn(docs, labels.where("label = 2")), float)
    assert toxicity.learn(docs, labels.where("label is null or label < 0")) is None


def jaccard(a, b):
    keys = a.keys() | b.keys()
    return sum(min(a.get(k, 0), b.get(k, 0)) for k in keys) / sum(max(a.get(k, 0), b.get(k, 0)) for k in keys)


def test_near_classes_equal_an_independent_similarity(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    texts = [[word() for _ in range(rng.randrange(20, 90))] for _ in range(50)]
    for base in range(25):
        for _ in range(3):
            w = list(texts[base])
            for _ in range(rng.randrange(0, 4)):
                w[rng.randrange(len(w))] = word()
            texts.append(w)
    texts += [["short", "one"], ["short", "one"], ["short", "two"], ["again"] * 30, ["again"] * 29]
    counts = [Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)]) for w in texts]
    df, n = Counter(s for c in counts for s in c), len(texts)
    weighted = [{s: k * (1 + math.log((n + 1) / (df[s] + 1)) / math.log(n + 1)) for s, k in c.items()} for c in counts]
    got = {r.doc_id: r.class_id for r in near_dedup.near_classes(frame(spark, [" ".join(w) for w in texts])).collect()}
    links = {(i, j): jaccard(weighted[i], weighted[j]) for i, j in itertools.combinations(range(n), 2)}
    assert sum(s >= 0.8 for s in links.values()) > 40
    assert all(got[i] == got[j] for (i, j), s in links.items() if s >= 0.801)
    root = list(range(n))
    for (i, j), s in sorted(links.items()):
        if s >= 0.799:
            a, b = root[i], root[j]
            root = [min(a, b) if r in (a, b) else r for r in root]
    assert all(root[i] == root[c] for i, c in got.items())


def test_ties_go_to_the_smaller_id_and_equal_vectors_are_all_found(spark):
    rng = random.Random(5)
    rows = [(i, [float(rng.randrange(3)) + 1 for _ in range(4)], "extra", i) for i in range(500)]
    got = {}
    for r in neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>, block string, place int")).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    for q, found in got.items():
        want = sorted((math.dist(rows[q][1], e), i) for i, e, *_ in rows if i != q)[:10]
        assert [i for _, i in sorted(found)] == [i for _, i in want]


def test_recall_of_the_index_alone():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(50_000, 64))
    index = neighbours.PermutationIndex(x, np.arange(len(x)), neighbours.pick_pivots(x[: neighbours.SAMPLE]))
    hit = 0
    for q in range(60):
        rows, _ = index.search(x[q], neighbours.nearest_pivots(x[q : q + 1], index.pivots, index.depth)[0], q, 10, exact=False)
        d = ((x - x[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        hit += len(set(rows.tolist()) & set(np.argpartition(d, 10)[:10].tolist()))
    assert hit >= 0.9 * 600


def test_the_pipeline_at_the_edges(spark, tmp_path):
    rng = random.Random(1)
    prose = lambda: " ".join(rng.choice(["the", "river", "ran", "under", "old", "stone", "bridges", "while", "people", "walked", "home"]) + rng.choice(["", "", ","]) for _ in range(60)) + "."
    junk = lambda: "".join(rng.choice("@#$%&*!~^") for _ in range(200))
    rows = [(i, prose() if i % 3 else junk(), "en", f"s{i % 4}", 7, "k", i) for i in range(60)]
    rows += [(100, None, None, None, None, None, None), (101, "", "en", "s1", 0, "", 0), (None, prose(), "en", "s1", 1, "x", 1), (4, rows[4][1], "en", "s0", 7, "again", 9), (102, rows[5][1], "en", "s2", 7, "copy", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int, g string, component long")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(50)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    empty = docs.limit(0)
    empty.write.parquet(f"{tmp_path}/none/documents.parquet")
    labels.write.parquet(f"{tmp_path}/none/labels.parquet")
    assert P.run(spark, f"{tmp_path}/none").count() == 0
    before = P.made()
    out = P.run(spark, str(tmp_path))
    kept = {r.doc_id for r in out.select("doc_id").distinct().collect()}
    assert P.made() == before + 4  # what the stages returned
    assert kept and not kept & {i for i in range(0, 60, 3)} and 102 not in kept and 100 not in kept
    assert P.drop_written(spark, before) == 4
