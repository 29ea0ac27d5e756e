import math
import random
import re
import zlib
from collections import Counter
from hashlib import sha256

from codeloom.llm import resampling

SCHEMA = "doc_id long, text string, score string, digest int, copies int"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return len(words), [zlib.crc32(f.encode()) % 10000 for f in [*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))]]


def brute(docs, target):
    """The contract, document by document."""
    found = [(i, *features(t)) for i, t in docs]
    s, t = Counter(b for *_, f in found for b in f), Counter(b for x in target for b in features(x)[1])
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (n_s + 10000) / ((s[b] + 1) * (n_t + 10000))))
    out = []
    for i, n, f in found:
        weight = math.floor(sum(map(gain, f)) / len(f)) if f else 0
        h = int(sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    order = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2], r[3]))
    drawn = [(r[0], *r[2:], k + 1 if k < 25 * len(order) // 100 else None) for k, r in enumerate(order)]
    return sorted([*drawn, *((r[0], *r[2:], None) for r in out if r[1] < 20)], key=str)


def check(spark, docs, target):
    df = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in docs], SCHEMA).repartition(3)
    bench = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string")
    found = resampling.resample(df, bench)
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute(docs, target)


def test_corpus_with_copies_and_odd_texts(spark):
    r = random.Random(4)
    words = ["Haus", "maus", "ÄPFEL", "x1", "don't", "naïve", "ZEBRA", "über", "42", "日本"]
    docs = [(k, " ".join(r.choice(words) for _ in range(r.randint(1, 60)))) for k in range(300)]
    docs += [(1000 + k, docs[5][1] + " und noch viele weitere worte " * 5) for k in range(150)]
    docs += [(7, docs[7][1]), (7, docs[7][1]), (7, "other"), (None, docs[9][1]), (None, docs[20][1] * 3), (2000, None), (2001, ""), (2002, " \t\n!?"), (2003, "one"), (2004, "word " * 30000)]
    check(spark, docs, [docs[3][1], docs[4][1] + " benchmark", None, ""])


def test_empty_target_and_empty_tables(spark):
    docs = [(k, "ein kurzer text von mehr als zwanzig worten der nur einmal da ist " * 2 + str(k)) for k in range(9)]
    check(spark, docs, [])
    check(spark, [], ["a b"])
    check(spark, [(1, None), (2, "")], ["a b"])


def test_long_texts_in_blocks(monkeypatch):
    text = ("Ein Wort, noch eins; überlanges" + "wort" * 40 + " - ") * 9
    whole = resampling.buckets_of(text.encode())
    for size in (1, 2, 7, 64, 65):
        monkeypatch.setattr(resampling, "TEXT_BLOCK", size)
        n, found = resampling.buckets_of(text.encode())
        assert n == whole[0] and sorted(found) == sorted(whole[1])
        assert (n, sorted(found)) == (features(text)[0], sorted(features(text)[1]))


def test_draw_against_brute_force_on_the_table(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    check(spark, docs, [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()])
