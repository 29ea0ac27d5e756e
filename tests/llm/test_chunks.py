import struct

import xxhash

from codeloom.llm import chunks

SCHEMA = "doc_id long, text string, th string"


def signed(n):
    return n - (1 << 64) if n >= 1 << 63 else n


def line_hash(line):
    return signed(xxhash.xxh64_intdigest(line.encode(), 42))


def fold(values):
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(struct.pack("<q", v), seed)
    return signed(seed)


def words(text):
    return [w for w in text.replace("\t", " ").replace("\n", " ").split(" ") if w]


def runs(text):
    lines = text.split("\n")
    long = [x.count(" ") >= chunks.LONG_LINE for x in lines]
    h = [line_hash(x) for x in lines]
    starts = [i for i in range(len(lines)) if i == 0 or long[i] or long[i - 1] or fold([h[max(i - 2, 0)], h[i - 1]]) % chunks.DIVISOR == 0]
    return [(a, lines[a:b]) for a, b in zip(starts, starts[1:] + [len(lines)])]


def brute(docs):
    """Cut texts by a plain walk over the documents in order of (id, text hash)."""
    seen, out = set(), {}
    for i, t in sorted({d for d in docs if d[1] is not None}, key=lambda d: (d[0] is not None, d[0], line_hash(d[1]))):
        kept = []
        for _, run in runs(t):
            joined = "\n".join(run)
            counts = len(run) > 1 and sum(bool(words(x)) for x in run) > 1 and sum(joined.count(c) for c in " \n") >= chunks.MIN_WORDS - 1 or joined.count(" ") >= chunks.LONG_LINE
            if counts and joined in seen:
                continue
            if counts:
                seen.add(joined)
            kept += run
        out[i, t] = "\n".join(kept)
    return out


def check(spark, docs):
    got = chunks.dedup_lines(spark.createDataFrame([(*d, "own") for d in docs], SCHEMA))
    assert got.columns == ["doc_id", "text", "th"]
    want = brute(docs)
    expected = sorted([(str(i), str(want.get((i, t), t))) for i, t in docs])
    rows = got.collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in rows) == expected
    assert {r.th for r in rows} <= {"own"}
    return expected


def test_generated_documents(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    out = dict(check(spark, docs))
    assert any(len(out[str(i)]) < len(t) for i, t in docs)


def test_planted_passages_and_odd_rows(spark):
    passage = "\n".join(f"shared line {k} with a few more words {k * k}" for k in range(14))
    single = " ".join(f"word{k}" for k in range(60))
    own = lambda n: "\n".join(f"document {n} says {k * 7 + n} things" for k in range(9))
    docs = [(k, f"{own(k)}\n{passage}\n{own(k + 100)}") for k in range(5)] + [(k, f"{own(k)}\n{single}\n{own(k + 200)}") for k in range(10, 14)]
    docs += [(20, None), (21, ""), (22, "\n\n\n"), (None, own(50)), (None, own(50)), (23, own(50)), (24, own(1)), (24, own(1)), (25, f"{single}\n{single}"), (26, "a\nb")]
    out = check(spark, docs)
    texts = dict(out)
    assert all(single in texts[str(k)] for k in (10,)) and all(single not in texts[str(k)] for k in (11, 12, 13))
    assert all(texts[str(k)].count("shared line") < 14 for k in range(1, 5)) and texts["0"].count("shared line") == 14


def all_passages(docs, most=None):
    """Cut texts by a look at every stretch of lines that counts, of at most so many lines with words.

    Ten lines with words always count, so longer repeated stretches consist of shorter repeated ones."""
    first, later = {}, {}
    for i, t in sorted({d for d in docs if d[1] is not None}, key=lambda d: (d[0] is not None, d[0], line_hash(d[1]))):
        lines = t.split("\n")
        worded = [k for k, x in enumerate(lines) if words(x)]
        for x, a in enumerate(worded):
            for b in worded[x : x + most if most else None]:
                inside = [k for k in worded if a <= k <= b]
                gaps = sum(lines[k].count(" ") + 1 for k in inside) - 1
                if gaps < (chunks.MIN_WORDS - 1 if len(inside) > 1 else chunks.LONG_LINE):
                    continue
                doc, at = first.setdefault(tuple(lines[a : b + 1]), ((i, t), a))
                if doc != (i, t) or a >= at + b - a + 1:
                    later.setdefault((i, t), set()).update(range(a, b + 1))
    return {(i, t): "\n".join(x for k, x in enumerate(t.split("\n")) if k not in later.get((i, t), ())) for i, t in docs if t is not None}


def test_short_passages_in_differing_surroundings(spark):
    line = lambda p, k: f"passage {p} line {k} of few words"
    own = lambda d, k: f"own line {k} of document {d} {k * d}"
    docs = []
    for n in range(2, 7):
        for copy in range(8):
            d = 100 * n + copy
            docs.append((d, "\n".join([own(d, k) for k in range(copy + 1)] + [line(n, k) for k in range(n)] + [own(d, k) for k in range(50, 60 - copy)])))
    docs += [(1, "\n".join(["again and again"] * 9)), (2, None), (3, ""), (4, "a\n\n  \nb"), (None, docs[0][1]), (None, docs[0][1]), (5, docs[3][1].replace("\n", "\n\n")), (6, docs[4][1].replace("\n", "\n\n"))]
    docs += [(7, "\n".join("abcdefghijklm")), (8, "x\ny y\n" + "\n".join("cdefghijklm") + "\nz z z")]
    got = chunks.remove_passages(spark.createDataFrame([(*d, "own") for d in docs], SCHEMA)).collect()
    want = all_passages(docs)
    assert sorted((str(r.doc.doc_id), str(r.kept)) for r in got) == sorted((str(i), str(want.get((i, t), t))) for i, t in docs)
    texts = {r.doc.doc_id: (r.kept, r.n_removed, r.doc.text) for r in got}
    for n in range(2, 7):
        assert all("passage" not in texts[100 * n + copy][0] and texts[100 * n + copy][1] == 1 for copy in range(1, 8))
    assert all(len(kept) <= len(t) for kept, _, t in texts.values() if t is not None)


def test_every_passage_of_generated_documents(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect() if r.text is None or r.text.count("\n") < 60]
    want = all_passages(docs)
    got = chunks.remove_passages(spark.createDataFrame([(*d, "own") for d in docs], SCHEMA)).collect()
    assert {(r.doc.doc_id, r.doc.text): r.kept for r in got} == {(i, t): want.get((i, t), t) for i, t in docs}
    assert any(r.n_removed for r in got)


def test_very_many_lines(spark):
    """Equal lines end no run, so a run can be as long as its text."""
    docs = [(1, "\n".join(["same line here"] * 20000)), (2, "\n".join(["same line here"] * 100000)), (3, "\n".join(f"line {k % 700} of a long text" for k in range(20000)))]
    frame = spark.createDataFrame([(*d, "own") for d in docs], SCHEMA)
    want = brute(docs)
    assert {(r.doc_id, r.text) for r in chunks.dedup_lines(frame).collect()} == {(i, want[i, t]) for i, t in docs}
    got = {r.doc.doc_id: r.kept for r in chunks.remove_passages(frame).collect()}
    assert got[1].count("\n") < 40 and got[2] == "" and got[3].count("\n") < 720


def test_stage_keeps_rows_and_columns(spark, sf_dir):
    docs = [(r.doc_id, r.text, "own") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()] + [(None, None, None), (1, "", "x"), (1, "", "x")]
    got = chunks.dedup_passages(spark.createDataFrame(docs, SCHEMA))
    assert got.columns == ["doc_id", "text", "th"]
    want = all_passages([d[:2] for d in docs], most=24)
    assert sorted(map(str, got.collect())) == sorted(map(str, spark.createDataFrame([(i, want.get((i, t), t), h) for i, t, h in docs], SCHEMA).collect()))


def test_empty_table(spark):
    assert chunks.dedup_lines(spark.createDataFrame([], SCHEMA)).count() == 0
    assert chunks.dedup_passages(spark.createDataFrame([], SCHEMA)).count() == 0
