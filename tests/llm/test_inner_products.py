import random

import numpy as np
from pyspark.sql import functions as F

from codeloom.llm import inner_products

SCHEMA = "vec_id long, embedding array<float>, row string, id int"


def brute(rows, step=5, k=10):
    kept = [(i, [int(np.floor(1024 * float(np.float32(x)))) for x in v]) for i, v in rows if v and all(x is not None and np.isfinite(x) and abs(x) <= 2**17 for x in v)]
    out = []
    for a, (i, x) in enumerate(kept):
        if i is None or i % step:
            continue
        found = [(-sum(p * q for p, q in zip(x, y, strict=True)), j is None, j) for b, (j, y) in enumerate(kept) if b != a and len(y) == len(x)]
        out += [(i, n + 1, j, -s) for n, (s, _, j) in enumerate(sorted(found, key=lambda f: (f[0], f[1], f[2] or 0))[:k])]
    return sorted(out, key=str)


def check(spark, rows, k=10, parts=3):
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], SCHEMA).repartition(parts)
    found = inner_products.top_k(df, F.col("id") % 5 == 0, k).collect()
    assert sorted(((r.query_id, r["rank"], r.vec_id, r.score) for r in found), key=str) == brute(rows, k=k)


def vectors(r, n, d=16, spread=1.0):
    return [[r.gauss(0, 1) * r.choice([0.1, 1, spread]) for _ in range(d)] for _ in range(n)]


def test_lengths_that_differ_copies_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(inner_products, "GROUP_ROWS", 7)
    r = random.Random(1)
    some = vectors(r, 200, spread=5.0)
    rows = list(enumerate(some))
    rows += [(500 + k, some[4]) for k in range(120)]  # a large group of copies: ties by id
    rows += [(10, some[10]), (10, some[11]), (None, some[12]), (None, some[4])]
    rows += [(700, None), (705, []), (710, [None] * 16), (715, [float("nan")] * 16), (720, [float("-inf")] * 16), (725, [1e9] * 16)]
    rows += [(800 + k, v) for k, v in enumerate(vectors(r, 12, d=3))] + [(900, [1.0])] + [(1000 + k, [0.0] * 16) for k in range(3)]
    check(spark, rows)


def test_fewer_rows_than_asked_and_none(spark):
    check(spark, [(0, [1.0, 2.0]), (1, [1.0, 1.0]), (5, [-1.0, 0.5])])
    check(spark, [(0, [1.0, 2.0])])
    check(spark, [(1, [1.0, 2.0])])
    assert inner_products.top_k(spark.createDataFrame([], SCHEMA), F.col("id") % 5 == 0).collect() == []


def test_bounds_prune_and_keep_ties(spark):
    """Against a block of far shorter vectors nothing is computed; equal scores stay."""
    group = inner_products.Prepared(np.array([[100, 0, 0, 0, 0, 0, 0, 0]]), None)
    best = inner_products.Best(np.array([500]), 2)
    short = inner_products.Prepared(np.full((4, 8), 1), None)
    assert inner_products.scan(short, np.arange(4), np.arange(4), group, np.array([99]), best) == 0
    tie = inner_products.Prepared(np.array([[5, 0, 0, 0, 0, 0, 0, 9], [5, 1, 0, 0, 0, 0, 0, 0]]), None)
    inner_products.scan(tie, np.array([7, 3]), np.array([0, 1]), group, np.array([99]), best)
    assert best.score.tolist() == [500, 500] and best.id.tolist() == [3, 7]


def test_products_beyond_exact_doubles(spark):
    r = random.Random(2)
    check(spark, [(k, [r.uniform(-130000, 130000) for _ in range(20)]) for k in range(60)])
