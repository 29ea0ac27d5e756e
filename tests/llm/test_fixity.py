import gzip

from codeloom.llm import fixity

SCHEMA = "file string, offset long, data binary, hash string"


def brute(a, b):
    def by_place(rows):
        out = {}
        for f, o, d in rows:
            out.setdefault((f, o), []).append(d or b"")
        return {k: sorted(v) for k, v in out.items()}

    x, y = by_place(a), by_place(b)
    return sorted((str(k[0]), k[1], "missing" if k not in y else "extra" if k not in x else "changed") for k in x.keys() | y.keys() if x.get(k) != y.get(k))


def run(spark, a, b, **kw):
    frames = [spark.createDataFrame([(*r, "own") for r in rows], SCHEMA) for rows in (a, b)]
    return sorted((str(r.file), r.offset, r.status) for r in fixity.audit(*frames, **kw).collect())


def test_audit_against_brute_force(spark):
    a = [(f"f{k % 3}", 100 * k, bytes([k % 251]) * (k % 7)) for k in range(200)] + [(None, 5, b"x"), ("f0", 0, b"second at 0"), ("f9", 3, None)]
    b = [r for k, r in enumerate(a) if k not in (17, 150)]
    b[40] = (b[40][0], b[40][1], b"spoilt")
    b += [("new", 1, b"n"), ("f1", 7, b"between")]
    for kw in ({}, {"span": 64, "fanout": 2}):
        assert run(spark, a, b, **kw) == brute(a, b)
    assert run(spark, a, a[::-1], span=64, fanout=2) == []
    assert run(spark, a, []) == brute(a, []) and run(spark, [], []) == []


def test_roots_change_with_a_byte(spark):
    a = [("f", 10 * k, b"abc%d" % k) for k in range(30)]
    roots = [fixity.roots(spark.createDataFrame([(*r, "") for r in rows], SCHEMA), span=32, fanout=2).collect() for rows in (a, a, [*a[:-1], ("f", 290, b"abd29")])]
    assert roots[0] == roots[1] != roots[2] and len(roots[0]) == 1


def test_files_round_trip(spark, tmp_path, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").limit(20)
    records = fixity.warc_records(pages, per_file=8).orderBy("page_id").collect()
    files = {}
    for r in records:
        files.setdefault(r.file, []).append(bytes(r.data))
    for k, (name, parts) in enumerate(files.items()):
        content = b"".join(gzip.compress(p) for p in parts) if k == 0 else b"".join(parts)
        (tmp_path / name).write_bytes(content)
    got = fixity.read_warc(spark, str(tmp_path / "*"))
    assert sorted((r.file, bytes(r.data)) for r in got.collect()) == sorted((r.file, bytes(r.data)) for r in records)
    placed = fixity.placed(fixity.warc_records(pages, per_file=8))
    assert fixity.audit(got, placed).count() == 0
