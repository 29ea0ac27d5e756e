import math
import re
from hashlib import blake2b, sha256

import pytest

from codeloom.operators import embeddings
from codeloom.operators.embeddings import DigestHash, LocalHash, delta, embedded, marked, semantic, upkeep

RECORD = "entity_id string, entity_type string, text string, file_path string"
TEXTS = ["def read_file(path): return Path2_x", "a_b_c __init__ 42 a_b_c", "", None, "Ünïcode naïve x1y2", "word " * 500, "_ __"]


def plain(text, number, size=256):
    """Token by token, as the weights say."""
    words = [w.lower() for w in re.findall(r"[A-Za-z_][A-Za-z0-9_]*|[0-9]+", text or "")]
    v = [0.0] * size
    for f, w in [*((w, 1.0) for w in words), *((f"part:{p}", 0.75) for w in words for p in re.findall("[a-z]+|[0-9]+", w)), *((f"{a}::{b}", 0.5) for a, b in zip(words, words[1:], strict=False))]:
        n = number(f)
        v[n % size] += w if n & 1 else -w
    length = math.sqrt(sum(x * x for x in v))
    return [x / length if length else x for x in v]


BLAKE = lambda f: int.from_bytes(blake2b(f.encode(), digest_size=8).digest(), "big")
DIGEST = lambda f: int(sha256(f.encode()).hexdigest()[:15], 16)


def frame(spark, texts, kind="node"):
    return spark.createDataFrame([(f"e{k}", kind, t, f"f{k}.py") for k, t in enumerate(texts)], RECORD)


@pytest.mark.parametrize(("provider", "number"), [(LocalHash(), BLAKE), (DigestHash(), DIGEST), (LocalHash(dimensions=7), BLAKE), (DigestHash(dimensions=10), DIGEST)])
def test_vectors_against_plain_python(spark, provider, number):
    found = {r.entity_id: r.vector for r in provider.vectors(frame(spark, TEXTS)).collect()}
    assert len(found) == len(TEXTS)
    for k, t in enumerate(TEXTS):
        want = plain(t, number, provider.dimensions)
        assert found[f"e{k}"] == pytest.approx(want, abs=1e-12)
        assert provider.of_text(t or "") == pytest.approx(want, abs=1e-12)


def test_fixed_values():
    v = LocalHash().of_text("read_file path")
    assert [(k, round(x, 4)) for k, x in enumerate(v) if x] == [(k, round(x, 4)) for k, x in enumerate(plain("read_file path", BLAKE)) if x]
    assert len(v) == 256 and abs(sum(x * x for x in v) - 1) < 1e-9 and LocalHash().of_text("  ") == [0.0] * 256


def test_remembered_features_start_anew(monkeypatch):
    monkeypatch.setattr(embeddings, "REMEMBERED", 3)
    assert LocalHash().of_text("a b c d e f g a b") == pytest.approx(plain("a b c d e f g a b", BLAKE))


@pytest.mark.parametrize("provider", [LocalHash(), DigestHash()])
def test_second_run_embeds_nothing_and_changes_are_found(spark, provider):
    records = frame(spark, ["one two", "three", None])
    empty = embedded(marked(records, provider), provider).where("false")
    stored, new = upkeep(records, empty, provider)
    assert new.count() == stored.count() == 3
    other = stored.withColumn("provider", embeddings.F.lit("another"))
    again, none = upkeep(records, stored.unionByName(other), provider)
    assert none.count() == 0 and again.count() == 6
    now = records.where("entity_id <> 'e1'").unionByName(frame(spark, ["one TWO three"]).limit(1).withColumn("entity_id", embeddings.F.lit("e9")))
    now = now.withColumn("text", embeddings.F.expr("case when entity_id = 'e0' then 'one other' else text end"))
    merged, changed = upkeep(now, stored, provider)
    assert sorted(r.entity_id for r in changed.collect()) == ["e0", "e9"]
    assert {r.entity_id: r.text for r in merged.collect()} == {"e0": "one other", "e2": None, "e9": "one TWO three"}


def test_repeated_entities_are_embedded_once(spark):
    twice = frame(spark, ["a", "b"]).withColumn("entity_id", embeddings.F.lit("same"))
    rows = delta(twice, embedded(marked(twice, LocalHash()), LocalHash()).where("false"), LocalHash()).collect()
    assert [r.text for r in rows] == ["b"]


def test_semantic_search_by_type_and_provider(spark):
    rows = frame(spark, ["login user token", "render page"]).unionByName(frame(spark, ["login form"], "chunk").withColumn("entity_id", embeddings.F.lit("c0")))
    stored = embedded(marked(rows, LocalHash()), LocalHash())
    assert [r.entity_id for r in semantic(stored, "login", 1).collect()] in (["e0"], ["c0"])
    assert [r.entity_id for r in semantic(stored, "login", types=("chunk",)).collect()] == ["c0"]
    assert semantic(stored, "login", provider=DigestHash()).count() == semantic(stored, " ").count() == 0


class Lengths:
    """A provider from outside: the protocol is all that upkeep needs."""

    name, model, dimensions = "lengths", "v1", 1

    def vectors(self, records):
        return records.select("entity_id", embeddings.F.expr("array(cast(length(text) as double)) as vector"))

    def of_text(self, text):
        return [float(len(text))]


def test_a_provider_from_outside(spark):
    records = frame(spark, ["ab", "abc"])
    stored, new = upkeep(records, embedded(marked(records, Lengths()), Lengths()).where("false"), Lengths())
    assert {r.entity_id: r.vector for r in stored.collect()} == {"e0": [2.0], "e1": [3.0]} and new.count() == 2


def test_records_are_embedded_without_a_shuffle(spark, monkeypatch):
    """Over several slices of a batch, each record comes with all its columns and its own vector."""
    monkeypatch.setattr(embeddings, "TEXTS", 3)
    texts = [f"a{k} b a{k % 3} b" if k % 4 else None for k in range(20)]
    found = embedded(marked(frame(spark, texts), DigestHash()), DigestHash())
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    rows = {r.entity_id: r for r in found.collect()}
    assert len(rows) == 20 and all(rows[f"e{k}"].vector == pytest.approx(plain(t, DIGEST)) and rows[f"e{k}"].file_path == f"f{k}.py" and rows[f"e{k}"].text == t for k, t in enumerate(texts))
