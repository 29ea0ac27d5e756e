import hashlib

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from codeloom.llm import decontaminate
from codeloom.llm.queries import vocabulary
from tests.llm import test_chunks, test_ordered_minhash, test_quality


def brute(docs, items):
    """Token digests by plain Python over the whole list of documents."""
    kept = []
    for i, t in docs:
        n, chars, symbols, _, repeated = test_quality.brute(t)
        words = t.replace("\t", " ").split()
        lines = [x for x in t.split("\n") if x.strip()]
        stutter = sum(a == b for a, b in zip(words, words[1:]))
        bad = n < 20 or 100 * repeated > 30 * n or 10 * symbols > n or 100 * stutter > 20 * n or chars > 40 * n
        bad = bad or len(lines) >= 4 and 100 * (len(lines) - len(set(lines))) > 50 * len(lines) or n >= 50 and 100 * len(set(words)) < 10 * n
        if not bad:
            kept.append((i, t))
    cut = test_chunks.all_passages(kept, most=24)
    kept = [(i, cut[i, t]) for i, t in kept]
    classes = test_ordered_minhash.brute(kept)
    kept = [(i, t) for i, t in kept if classes[i] == i]
    index = decontaminate.Index(items)
    kept = [(i, t) for i, t in kept if not index.hits(t)]
    lib = Tokenizer.from_file(vocabulary())
    out = {}
    for i, t in kept:
        ids = lib.encode(t, add_special_tokens=False).ids
        out[i] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    return out


def test_run_against_brute_force(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, sf_dir).collect()}
    want = brute(docs, items)
    assert got == want
    assert 0 < len(want) < len(docs)


def test_stages_keep_columns_and_take_odd_rows(spark, sf_dir, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, n_words string"
    good = " ".join(f"w{k}" for k in range(60))
    rows = [(1, good, None, None, None, "own"), (1, good, None, None, None, "own"), (None, good + " x", "en", "s", 1, None), (3, None, None, None, 0, None), (4, "", "", "", 0, "")]
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, sf_dir)
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "n_words"]
        assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() == (1 if data else 0)
