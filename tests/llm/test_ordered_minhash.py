import itertools
import math
import random

import numpy as np
import pytest

from codeloom.llm import components, ordered_minhash

SCHEMA = "doc_id long, text string, node string, label string"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(r, words, edits, letters):
    out = list(words)
    for _ in range(edits):
        at = r.randrange(len(out) + 1)
        kind = r.randrange(3)
        if kind == 0 or not out or at == len(out):
            out.insert(at, r.choice(letters))
        elif kind == 1:
            del out[at]
        else:
            out[at] = r.choice(letters)
    return out


def test_banded_distance_is_exact():
    r = random.Random(3)
    for _ in range(4000):
        a = [r.choice("abcd") for _ in range(r.randrange(14))]
        b = edited(r, a, r.randrange(5), "abcd") if r.random() < 0.7 else [r.choice("abcd") for _ in range(r.randrange(14))]
        most, d = r.randrange(8), distance(a, b)
        assert ordered_minhash.within(a, b, most) == (d if d <= most else None)


def brute(docs):
    """Least id of each document's component, by aligning all pairs."""
    ids = [i for i, _ in docs]
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    words = {i: (t or "").split() for i, t in docs}
    for k, i in enumerate(ids):
        for j in ids[:k]:
            x, y = words[i], words[j]
            longer = max(len(x), len(y))
            same = (dict(docs)[i] or "") == (dict(docs)[j] or "")
            if same or (min(len(x), len(y)) >= 0.8 * longer > 0 and root(i) != root(j) and ordered_minhash.within(x, y, int(0.2 * longer + 1e-9)) is not None):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: root(i) for i in ids}


def run(spark, docs):
    rows = ordered_minhash.classes(spark.createDataFrame([(*d, "own", "own") for d in docs], SCHEMA)).collect()
    assert len(rows) == len(docs)
    return {r.id: r.class_id for r in rows}


def test_classes_of_documents_against_all_pairs(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = run(spark, docs)
    assert got == brute(docs)
    assert len(set(got.values())) < len(docs)


def test_planted_groups_and_odd_rows(spark):
    r = random.Random(5)
    letters = [f"w{k}" for k in range(400)]
    base = [r.choice(letters) for _ in range(150)]
    docs = [(k, " ".join(edited(r, base, 4, letters))) for k in range(40)]
    docs += [(100 + k, " ".join(base[:60] + [r.choice(letters) for _ in range(90)])) for k in range(12)]  # share a passage only
    docs += [(200, None), (201, ""), (202, "one two"), (203, "one two"), (204, "one  two"), (205, " "), (206, "x " * 400), (207, "x " * 399), (208, "a b c d e")]
    got = run(spark, docs)
    assert got == brute(docs)
    assert {got[k] for k in range(40)} == {0}


@pytest.mark.parametrize("shared", [0.6, 0.7, 0.78])
def test_pairs_among_many_texts_that_share_a_passage(spark, shared):
    """Pairs that are 96 % alike, of 60 to 3000 words, most of which are a passage that all texts of that length share."""
    r = random.Random(int(shared * 100))
    letters = [f"w{k}" for k in range(5000)]
    docs, pairs = [], []
    for length, n in ((60, 60), (300, 60), (3000, 6)):
        passage = [r.choice(letters) for _ in range(int(length * shared))]
        for _ in range(n):
            own = [r.choice(letters) for _ in range(length - len(passage))]
            a = passage + own if r.random() < 0.5 else own + passage
            pairs.append((len(docs), len(docs) + 1))
            docs += [(len(docs), " ".join(a)), (len(docs) + 1, " ".join(edited(r, a, length // 25, letters)))]
    got = run(spark, docs)
    assert all(got[b] == got[a] == a for a, b in pairs)


def test_pairs_in_buckets_whose_least_texts_are_like_neither(spark):
    """All texts share a passage, and each has sentences that many others have in another order: only the pairs are alike."""
    r = random.Random(11)
    letters = [f"w{k}" for k in range(5000)]
    words = lambda n: [r.choice(letters) for _ in range(n)]
    passage, sentences = words(100), [words(10) for _ in range(24)]
    docs = []
    for _ in range(60):
        a = passage + sum(r.sample(sentences, 6), [])
        docs += [(len(docs), " ".join(a)), (len(docs) + 1, " ".join(edited(r, a, 3, letters)))]
    assert run(spark, docs) == brute(docs)


def test_all_blocks_of_a_bucket_meet(spark, monkeypatch):
    monkeypatch.setattr(ordered_minhash, "BLOCK_TEXTS", 3)
    test_pairs_in_buckets_whose_least_texts_are_like_neither(spark)


def test_pairs_of_mixed_buckets_are_compared_once(spark, monkeypatch):
    """Against all pairs: those that share a bucket of three texts or more, whatever other buckets they share, each once."""
    monkeypatch.setattr(ordered_minhash, "BLOCK_TEXTS", 3)
    r = random.Random(13)
    letters = [f"w{k}" for k in range(300)]
    passage = [r.choice(letters) for _ in range(60)]
    texts = [" ".join(passage + [r.choice(letters) for _ in range(r.choice([8, 14, 24, 40]))]) for _ in range(40)]
    nodes = spark.createDataFrame([(bytes([k]), t) for k, t in enumerate(texts)], "node binary, text string")
    labels = spark.createDataFrame([(bytes([k]), bytes([0])) for k in range(6)], "node binary, label binary")
    sketches = ordered_minhash.sketched(nodes).collect()
    shared, total = ordered_minhash._shared(spark.createDataFrame([(x.node, x.n, k) for x in sketches for k in x["keys"]], "node binary, n long, key long"), "key")
    members = ordered_minhash._members(shared, total)
    assert members.count() == members.select("key", "node").distinct().count() <= total
    rows = ordered_minhash._mixed(members, labels)
    got = [(x.u, x.v) for x in ordered_minhash._possible(rows, nodes).collect()]

    rows_of = {x.node: x for x in sketches}
    step = {x.node: math.floor(math.log(x.n) / math.log(1 / 0.8)) for x in sketches}
    counts = {x.node: np.array(x.counts).view(np.uint8) for x in ordered_minhash._hashed_words(nodes, ordered_minhash.binned, "counts").collect()}
    want = set()
    for u, v in itertools.combinations(sorted(rows_of), 2):
        longer, shorter = sorted((rows_of[u].n, rows_of[v].n), reverse=True)
        top = max(step[u], step[v])
        inside = [sum(k in x["keys"] and step[i] in (top - 1, top) for i, x in rows_of.items()) for k in set(rows_of[u]["keys"]) & set(rows_of[v]["keys"])]
        if max(u, v) >= bytes([6]) and shorter >= 0.8 * longer and max([0, *inside]) > 2 and ordered_minhash.edits_at_least(counts[u], counts[v][None])[0] <= int(0.2 * longer + 1e-9):
            want.add((u, v))
    assert len(got) == len(set(got)) and set(got) == want
    assert len(want) > 50


def test_keep_one_deals_rows_out_once(spark, capsys):
    docs = spark.createDataFrame([(k, f"text {k}", "n", "l") for k in range(9)], SCHEMA)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        capsys.readouterr()
        ordered_minhash.keep_one(docs).explain()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    plan = capsys.readouterr().out
    above = plan[: plan.index("Join")]  # what is done with whole rows after they have met the rows to keep
    assert "Aggregate" in above and "Exchange" not in above


def test_counts_of_words_bound_the_edits():
    r = random.Random(7)
    row = lambda words: ordered_minhash.binned(np.array(words, np.uint64)).view(np.uint8)
    for _ in range(200):
        a = [r.randrange(600) for _ in range(r.choice([3, 40, 400]))]
        others = [edited(r, a, k, range(600)) for k in (0, 1, 5, 30)]
        least = ordered_minhash.edits_at_least(row(a), np.stack([row(b) for b in others]))
        assert all(low <= k for low, k in zip(least, (0, 1, 5, 30))) and least[0] == 0
    assert ordered_minhash.edits_at_least(row([1] * 300), np.stack([row([2] * 300)])) == [255]  # counts stop there


@pytest.mark.parametrize("length", [60, 200, 1000])
def test_recall_at_the_threshold(spark, length):
    """Of pairs whose words differ at one place in five, at random, nine in ten are linked."""
    r = random.Random(length)
    letters = [f"w{k}" for k in range(5000)]
    docs = []
    for _ in range(200):
        words = [r.choice(letters) for _ in range(length)]
        other = list(words)
        for at in r.sample(range(length), length // 5):
            other[at] = r.choice(letters)
        docs += [(len(docs), " ".join(words)), (len(docs) + 1, " ".join(other))]
    got = run(spark, docs)
    assert sum(got[k + 1] == k for k in range(0, len(docs), 2)) >= 180


def test_keep_one_keeps_columns_and_single_rows(spark):
    text = " ".join(f"w{k}" for k in range(50))
    docs = spark.createDataFrame([(1, text, "n", "l"), (1, text, "n", "l"), (2, text + " more", "n", "l"), (None, "null id", "n", "l"), (3, None, "n", "l"), (4, "", "n", "l")], SCHEMA)
    out = ordered_minhash.keep_one(docs)
    assert out.columns == docs.columns
    assert sorted(str(r.doc_id) for r in out.collect()) == ["1", "3", "None"]


def test_components(spark):
    r = random.Random(9)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(40)] + [(k, k + 1) for k in range(100, 130)]
    parent = {}

    def root(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    for per_task in (1, components.EDGES):  # spread, and in one partition
        got = {x.node: x.label for x in components.components(spark.createDataFrame(edges, "u long, v long"), per_task).collect()}
        assert got == {k: root(k) for a, b in edges if a != b for k in (a, b)}


def test_links_of_a_group_are_thinned_and_read_few_times(spark, monkeypatch):
    """All pairs of a group are linked, in four tasks: the stars read fewer edges than each task has nodes, and each edge at most three times a round."""
    star, cut, read, times = components._large_star, components.cut, [], []
    monkeypatch.setattr(components, "_large_star", lambda edges, total: read.append(edges.count()) or star(edges, total))
    monkeypatch.setattr(components, "cut", lambda df: times.append(df._jdf.queryExecution().optimizedPlan().toString().count("Generate inline")) or cut(df))
    links = list(itertools.combinations(range(150), 2))
    random.Random(3).shuffle(links)
    got = {x.node: x.label for x in components.components(spark.createDataFrame(links, "u long, v long").repartition(4), 128).collect()}
    assert got == dict.fromkeys(range(150), 0)
    assert read and max(read) < 4 * 150
    assert 0 < sum(times) <= 3 * len(read)


def test_empty_table(spark):
    assert ordered_minhash.classes(spark.createDataFrame([], SCHEMA)).count() == 0
