import random
from hashlib import sha256

import numpy as np

from codeloom.llm import elkan, queries

SCHEMA = "vec_id long, embedding array<float>, cluster string, v int"


def brute(rows, components=64, k=8, rounds=10, seed="3:"):
    """Lloyd's rounds in whole numbers: (id, cluster, distance) of every kept vector, and the centroids."""
    kept = [(i, [int(np.floor(1024 * float(np.float32(x)))) for x in v]) for i, v in rows if v is not None and len(v) == components and all(x is not None and np.isfinite(x) for x in v)]
    if not kept:
        return [], []
    x = [v for _, v in kept]
    order = sorted(kept, key=lambda r: (r[0] is None, sha256(f"{seed}{r[0]}".encode()).hexdigest(), r[1]))
    at = [v for _, v in order[:k]]

    def nearest():
        out = []
        for v in x:
            d = [sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in at]
            out.append((min(d), d.index(min(d))))
        return out

    for _ in range(rounds):
        own = [c for _, c in nearest()]
        for c in range(len(at)):
            mine = [v for v, o in zip(x, own, strict=True) if o == c]
            if mine:
                at[c] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    return sorted(((i, c, d) for (i, _), (d, c) in zip(kept, nearest(), strict=True)), key=str), at


def check(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], SCHEMA).repartition(3)
    found, at = elkan.clusters(df, **kw)
    result = found.collect()
    want, centroids = brute(rows, **kw)
    assert sorted(((r.id, r.cluster, r.distance) for r in result), key=str) == want
    assert at.tolist() == centroids
    return result, found, at


def test_random_vectors_copies_and_odd_rows(spark):
    r = random.Random(5)
    some = [[r.gauss(0, 0.2) + (k % 3) for _ in range(64)] for k in range(150)]
    rows = list(enumerate(some))
    rows += [(1000 + k, some[7]) for k in range(90)] + [(3, some[3]), (3, some[3]), (None, some[9]), (None, some[10])]
    rows += [(2000, None), (2001, []), (2002, some[0][:63]), (2003, [*some[0], 1.0]), (2004, [float("nan"), *some[0][1:]]), (2005, [float("inf"), *some[0][1:]]), (2006, [None, *some[0][1:]])]
    result, *_ = check(spark, rows)
    assert sum(x.computed for x in result) < 0.9 * len(result) * 8 * 11


def test_ties_go_to_the_smaller_number(spark):
    rows = [(k, [float(k % 4), float(k // 4 % 4)]) for k in range(64)]
    check(spark, rows, components=2, k=5, rounds=3)
    check(spark, [(k, [0.5, 0.5]) for k in range(20)], components=2, k=4, rounds=2)


def test_fewer_vectors_than_centroids_and_none(spark):
    check(spark, [(1, [1.0, 2.0]), (2, [5.0, 2.0])], components=2, k=8, rounds=2)
    check(spark, [(1, None), (2, [1.0])], components=2)
    found, at = elkan.clusters(spark.createDataFrame([], SCHEMA))
    assert elkan.with_inertia(found, at).collect() == []


def test_inertia_and_digest(spark):
    _, found, at = check(spark, [(k, [float(k % 7), 0.25 * k]) for k in range(40)], components=2, k=3, rounds=2)
    rows = elkan.with_inertia(found, at).collect()
    assert {r.inertia for r in rows} == {sum(r.distance for r in rows)}
    for r in rows:
        assert r.cluster_inertia == sum(x.distance for x in rows if x.cluster == r.cluster)
        assert r.centroid_sha256 == sha256(",".join(map(str, at[r.cluster].tolist())).encode()).hexdigest()


def test_too_large_components_take_no_part(spark):
    rows = spark.createDataFrame([(1, [1e30, 0.0], "", 0), (2, [100000.0, -100000.0], "", 0)], SCHEMA)
    assert [(r.id, r.distance) for r in elkan.clusters(rows, components=2)[0].collect()] == [(2, 0)]


def test_query(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").limit(120).collect()]
    check(spark, rows)
    assert "op11_elkan_clusters" in queries.ORACLES
