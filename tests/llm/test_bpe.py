import hashlib
import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from codeloom.llm import bpe

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def samples():
    r = random.Random(7)
    odd = ["", "<|endoftext|>", "a<|endoftext|> b  \n\n c", "x" * 5000, "ab" * 300 + "日本" * 50, "it's I'LL we'll 12 345²", "\x85 \x1c a b ½ é’s", "   \t\n  " * 20, "the" * 40]
    return odd + ["".join(chr(r.choice((r.randrange(32, 127), r.randrange(1, 0x2FFF), 10))) for _ in range(r.randrange(400))) for _ in range(40)]


def test_digests_equal_the_librarys(spark):
    lib = Tokenizer.from_file(VOCABULARY)
    texts = samples()
    docs = spark.createDataFrame([*enumerate(texts), (-1, None), (0, texts[0])], "doc_id long, text string")
    rows = bpe.token_digests(docs, VOCABULARY).collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        ids = lib.encode("" if r.doc_id < 0 else texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_round_trip_and_long_pieces(spark, monkeypatch):
    texts = samples()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    back = bpe.decode_column(bpe.encode_column(docs, VOCABULARY), VOCABULARY).collect()
    assert {r.id: r.text for r in back} == dict(enumerate(texts))
    c = bpe.Codec(VOCABULARY)
    for word in (b"thethethe" * 9, "ünïcödé".encode() * 12, b"aaaa" * 20):
        rows = c.id_of_byte[np.frombuffer(word, np.uint8)][None, :].copy()
        assert c.merge_long(word) == c.merge_rows(rows)[0]


def test_slices_and_a_full_table_change_nothing(monkeypatch):
    whole = bpe.Codec(VOCABULARY)
    want = [b"".join(x) for x in whole.encode_all(samples())]
    monkeypatch.setattr(bpe, "SLICE", 17)
    monkeypatch.setattr(bpe, "KEPT_PIECES", 5)
    assert [b"".join(x) for x in bpe.Codec(VOCABULARY).encode_all(samples())] == want


def test_empty_table(spark):
    assert bpe.token_digests(spark.createDataFrame([], "doc_id long, text string"), VOCABULARY).count() == 0
