import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from codeloom.llm import queries, toxicity

DOCS = "doc_id long, text string, score string, toxic string"


def corpus():
    r = random.Random(3)
    words = [f"wort{k}" for k in range(200)]
    docs, labels = [], []
    for k in range(240):
        toxic = k % 6 == 0
        text = [r.choice(words) for _ in range(40)] + ([r.choice(["nasty", "vilest", "vilely"]) for _ in range(3)] if toxic else [])
        r.shuffle(text)
        docs.append((k, " ".join(text)))
        labels.append((k, int(toxic)))
    return docs, labels


def brute(docs, labels):
    """Scores of all texts by plain counting, without the index: features, weights, cosines and votes."""
    sets = [Counter(f for w in re.findall(r"\w+", (t or "").lower()) for f in toxicity.features_of(w)) for _, t in docs]
    texts = {i: c for (i, _), c in zip(docs, sets, strict=True) if i is not None}
    known = sorted((i, y) for i, y in labels if y is not None and i in texts)
    n1 = sum(y for _, y in labels if y is not None)
    n0 = sum(y is not None for _, y in labels) - n1
    held, by_class = Counter(f for c in sets for f in c), [Counter(), Counter()]
    for i, y in known:
        by_class[y].update(texts[i].keys())
    scale = {}
    for f in set(by_class[0]) | set(by_class[1]):
        a, b = by_class[0][f], by_class[1][f]
        p = (a + b) / (n0 + n1)
        z = abs((b / n1 - a / n0) / math.sqrt(p * (1 - p) * (1 / n0 + 1 / n1) + 1e-12))
        if a + b >= toxicity.LEAST_DOCS and z >= toxicity.LEAST_Z:
            scale[f] = z * (math.log((1 + len(docs)) / (1 + held[f])) + 1)

    def vector(c):
        v = {f: (1 + math.log(n)) * scale[f] for f, n in c.items() if f in scale}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {f: x / norm for f, x in v.items()}

    examples = [(i, y, vector(texts[i])) for i, y in known]
    rate = n1 / (n0 + n1)
    none = [y for _, y, v in examples if not v]
    out = []
    for c in sets:
        v = vector(c)
        if not v:
            out.append((sum(none) + toxicity.PRIOR * rate) / (len(none) + toxicity.PRIOR))
            continue
        near = [(sum(x * e[f] for f, x in v.items() if f in e), i, y) for i, y, e in examples]
        near = sorted((n for n in near if n[0] > 1e-9), key=lambda n: (-round(n[0], 6), n[1]))[: toxicity.NEIGHBOURS]
        votes = [(s * s, y) for s, _, y in near]
        out.append((sum(s * y for s, y in votes) + toxicity.PRIOR * rate) / (sum(s for s, _ in votes) + toxicity.PRIOR))
    return out


def test_search_is_exact_and_learns(spark, monkeypatch):
    docs, labels = corpus()
    docs += [(900, None), (901, ""), (902, "unseen words only"), (None, "nasty"), (903, "nasty " * 3000)]
    monkeypatch.setattr(toxicity, "BLOCK", 8)
    frame = spark.createDataFrame([(*d, "own", "own") for d in docs], DOCS)
    given = labels[:180]
    index, every = toxicity.train(frame, spark.createDataFrame([*given, (5000, None)], "doc_id long, toxic int"))
    got = toxicity.score(every, index).collect()
    assert len(got) == len(docs)
    want = {i: s for (i, _), s in zip(docs, brute(docs, given), strict=True)}
    for r in got:
        assert abs(r.share - want[r.doc_id]) < 1e-4, r.doc_id
        assert 0 <= r.score <= 1
    by_id = {r.doc_id: r.score for r in got}
    assert all((by_id[k] >= 0.3) == bool(y) for k, y in labels[180:])
    assert by_id[900] == by_id[901] == by_id[902] < 0.3


def brute_isotonic(x, y, rate):
    """Max-min formula: the rate at a place is the greatest over starts of the least mean over ends."""
    order = np.argsort(x, kind="stable")
    y = np.asarray(y, float)[order]
    n = len(y)
    return [max(min(y[a : b + 1].mean() for b in range(k, n)) for a in range(k + 1)) for k in range(n)]


def test_monotone_map():
    r = random.Random(8)
    shares = np.array([r.random() for _ in range(60)])
    labels = np.array([float(r.random() < s) for s in shares])
    at, to = toxicity.monotone_map(shares, labels, 0.2)
    assert (np.diff(at) > 0).all() and (np.diff(to) >= 0).all() and at[0] == to[0] == 0 and at[-1] == to[-1] == 1
    pooled = sorted(set(np.round(brute_isotonic(shares, labels, 0.2), 9)))
    assert len(at) - 2 == len(pooled)
    alike, same = toxicity.monotone_map(np.array([0.5] * 10), np.array([1.0] * 3 + [0.0] * 7), 0.3)
    assert np.allclose(alike, [0, 0.5, 1]) and np.allclose(same, [0, 0.3, 1])


def test_sample_is_bounded_by_characters(spark, monkeypatch):
    docs, labels = corpus()
    frame, known = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    whole, _ = toxicity.train(frame, known)
    monkeypatch.setattr(toxicity, "SAMPLE_CHARS", sum(len(t) for _, t in docs) // 2)
    half, _ = toxicity.train(frame, known)
    assert 0 < len(half.ids) < len(whole.ids) <= 240
    assert (np.diff([whole.calibrated(x / 50) for x in range(51)]) >= 0).all()


def test_counts_of_features(monkeypatch):
    space = toxicity.Space(["=ab", "abcd", "=abcde", "abcde"])
    for most in (toxicity.KNOWN_WORDS, 2):
        monkeypatch.setattr(toxicity, "KNOWN_WORDS", most)
        for text in ("ab abcde ab", "abcdx abcde other " * 3, None, "", " ".join(f"w{k}" for k in range(3000)) + " ab"):
            want = Counter()
            for w, n in toxicity.word_counts(text).items():
                for f in toxicity.features_of(w):
                    if f in space.place:
                        want[space.place[f]] += n
            places, counts = space.counts(text)
            assert dict(zip(places.tolist(), counts.tolist(), strict=True)) == want


def test_blocks_and_word_table_change_nothing(monkeypatch):
    text = "One two_three, vier! " * 400
    want = toxicity.word_counts(text)
    monkeypatch.setattr(toxicity, "TEXT_BLOCK", 100)
    assert toxicity.word_counts(text) == want


def test_no_labels_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    for rows, want in ((docs, [0.0]), (docs.limit(0), [])):
        index, every = toxicity.train(rows, none)
        assert [r.score for r in toxicity.score(every, index).collect()] == want


def test_held_out_rows_of_the_tables(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = queries.op10_toxicity(spark, sf_dir).collect()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    trained = {texts[i] for i in labels if i in texts and zlib.crc32(str(i).encode()) % 4 != 2}
    held = [r for r in rows if r.held_out and r.doc_id in labels and texts.get(r.doc_id) not in trained]
    toxic, clean = [r.score for r in held if labels[r.doc_id]], [r.score for r in held if not labels[r.doc_id]]
    assert np.mean([(a > b) + 0.5 * (a == b) for a in toxic for b in clean]) > 0.9
    assert np.mean([r.predicted for r in held if not labels[r.doc_id]]) < 0.05
