import re

from codeloom.llm import quality

SCHEMA = "doc_id long, text string, n_words string, doc string"


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    spans = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    covered = {k + j for k, s in enumerate(spans) if spans.count(s) > 1 for j in range(8)}
    return len(words), sum(map(len, words)), sum(c in quality.SYMBOLS for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_measures_against_brute_force(spark):
    texts = [None, "", " \n\t ", "a b c\n\na b c", " ".join("abcdefgh" * 4), "one two three four five six seven eight " * 3 + "nine", "x" * 5000, "### <a> | 日本 %", " ".join(str(k % 11) for k in range(300)), "a\x0bb\x85c d e", "q w e r t y u i\n" * 3]
    rows = [(k, t, "mine", "also mine") for k, t in enumerate(texts)] + [(1, "", "mine", "also mine")]
    got = quality.ledger(spark.createDataFrame(rows, SCHEMA)).selectExpr("doc.text as t", "n_words as a", "word_chars as b", "n_symbols as c", "n_dup_lines as d", "n_repeat_words as e", "doc.n_words as own").collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.a, r.b, r.c, r.d, r.e) == brute(r.t), r.t
        assert r.own == "mine"


def test_policies_and_ablation_agree_with_the_rows(spark):
    texts = ["good " + " ".join(f"w{k}" for k in range(40)), "short", "go " * 60, " ".join(f"w{k}#" for k in range(30)), None]
    docs = spark.createDataFrame([(k, t, "", "") for k, t in enumerate(texts)], SCHEMA)
    rows = quality.ledger(docs).cache()
    assert [r.doc_id for r in quality.keep_good(docs).collect()] == [0]
    assert quality.keep_good(docs).columns == docs.columns
    bits = [r.failed_bits for r in rows.collect()]
    for r in quality.ablate(rows).collect():
        mask = next(p.mask for p in quality.POLICIES if p.version == r.policy)
        assert r.kept == sum(b & mask == 0 for b in bits)
        assert r.failing == sum(b & quality.bit(r.rule) != 0 for b in bits)
        assert r.only_this_rule == sum(b & mask == quality.bit(r.rule) for b in bits)


def test_empty_table(spark):
    assert quality.ledger(spark.createDataFrame([], SCHEMA)).count() == 0
