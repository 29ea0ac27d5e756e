import math
import random

from codeloom.llm import decontaminate as d

DOCS = "doc_id long, text string, item_id string, score string"


def substring_distance(pattern, words):
    row = [0] * (len(words) + 1)
    for i, x in enumerate(pattern, 1):
        new = [i]
        for j, y in enumerate(words, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_least_distance():
    r = random.Random(2)
    for _ in range(3000):
        p, w = ["".join(r.choice("abc") for _ in range(r.randrange(n))) for n in (9, 16)]
        assert d.least_distance(list(p), list(w)) == substring_distance(p, w)


def brute(index, text):
    """Hits from scoring every entry for every passage."""
    words = d.words_of(text)
    out = {}
    for start in range(-d.ENTRY, len(words), d.ENTRY):
        terms = {index.term_ids[w] for w in words[max(start, 0) : start + 2 * d.ENTRY] if w in index.term_ids}
        for entry, place in enumerate(index.item_of):
            score = sum(w for t in terms for e, w in zip(index.entries[t], index.weights[t]) if e == entry)
            if score < d.THRESHOLD - 1e-9:
                continue
            _, q, a = index.items[place]
            around = words[max(start - index.margin, 0) : start + 2 * d.ENTRY + index.margin]
            asked, answered = 1 - substring_distance(q, around) / max(len(q), 1), 1 - substring_distance(a, around) / max(len(a), 1)
            if min(asked, answered) >= d.OVERLAP - 1e-9 and (place not in out or out[place][0] < score - 1e-12):
                out[place] = (score, asked, answered)
    return out


def fixture():
    r = random.Random(4)
    vocabulary = [f"w{k}" for k in range(120)] + ["the", "of"] * 20
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(k, text(r.randrange(3, 40)) + ("\n" + text(r.randrange(1, 6)) if k % 2 else "")) for k in range(12)] + [(12, text(200)), (13, None), (14, ""), (12, "x y z")]
    docs = [(k, text(r.randrange(300))) for k in range(12)]
    for k, (_, t) in enumerate(items):
        if t:
            words = t.split(" ")
            half = words[: len(words) // 2]
            docs += [(100 + k, f"{text(90)} {t.upper()}! {text(150)}"), (200 + k, f"{text(50)} {' '.join(half)} {text(50)}"), (300 + k, text(30) + " " + " ".join(w if r.random() > 0.08 else "other" for w in words))]
    return items, docs + [(900, None), (901, ""), (902, "!!")]


def test_hits_against_scoring_everything(spark):
    items, docs = fixture()
    index = d.Index(items)
    want = {i: brute(index, t) for i, t in docs}
    frame = spark.createDataFrame([(*x, "own", "own") for x in docs], DOCS)
    tests = spark.createDataFrame(items, "item_id long, text string")
    rows = d.leaks(frame, tests).collect()
    got = {(r.doc_id, r.item_id, round(r.score, 9)) for r in rows}
    assert got == {(i, index.items[p][0], round(h[0], 9)) for i, hits in want.items() for p, h in hits.items()}
    assert all(any(i == 100 + k for i, *_ in got) for k in range(13) if k not in (13, 14))
    kept = d.without_leaks(frame, tests)
    assert kept.columns == frame.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, hits in want.items() if not hits}


def test_blocks_and_shards_change_nothing(spark, monkeypatch):
    items, docs = fixture()
    frame, tests = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    index = d.Index(items)
    whole = [index.hits(t).keys() for _, t in docs]
    monkeypatch.setattr(d, "TEXT_BLOCK", 1500)
    assert [index.hits(t).keys() for _, t in docs] == whole
    monkeypatch.setattr(d, "SHARD_CHARS", 600)
    found = {(r.doc_id, r.item_id) for r in d.leaks(frame, tests).collect()}
    assert found >= {(100 + k, k) for k in range(12)}
    assert {r.doc_id for r in d.without_leaks(frame, tests).collect()} == {i for i, _ in docs} - {i for i, _ in found}


def test_weights_are_shares_of_bm25():
    """Weights of all postings by plain counting over the entries."""
    items, _ = fixture()
    index = d.Index(items)
    entries = []
    for place, (item, *_) in enumerate(index.items):
        words = d.words_of(next(t for i, t in [x for x in items if d.words_of(x[1])][place:] if i == item))
        pieces = math.ceil(len(words) / d.ENTRY)
        entries += [words[k * len(words) // pieces : (k + 1) * len(words) // pieces] for k in range(pieces)]
    mean = sum(map(len, entries)) / len(entries)

    def bm25(term, words):
        holds = sum(term in e for e in entries)
        return math.log(1 + (len(entries) - holds + 0.5) / (holds + 0.5)) * words.count(term) * 2.2 / (words.count(term) + 1.2 * (0.25 + 0.75 * len(words) / mean))

    for e, words in enumerate(entries):
        whole = sum(bm25(t, words) for t in set(words))
        for t in set(words):
            k = index.term_ids[t]
            assert abs(index.weights[k][index.entries[k].index(e)] - bm25(t, words) / whole) < 1e-12
    assert sum(map(len, index.entries)) == sum(len(set(e)) for e in entries)


def test_leaks_of_the_tables(spark, sf_dir):
    docs, items = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in d.leaks(docs, items).collect()}
    whole = {(a.doc_id, b.item_id) for a in docs.collect() for b in items.collect() if b.text in a.text}
    assert whole and whole <= got


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert d.leaks(docs, items).count() == 0
    assert d.leaks(spark.createDataFrame([(1, "a")], "doc_id long, text string"), items).count() == 0
