"""Quality rules as a bitmask ledger.

Each rule is evaluated once for a document. What it measured and one failure bit stay in
a ledger; a policy is a version and a mask of the bits that reject. Policies are applied
and compared over the ledger alone, without another look at the texts.

Words, and windows of words, are the same where their 64-bit hashes are: of a text with n different words
some two are confused with a chance below n * n / 2^65, one in 10 billion for 60,000 words.

Defined cases: a null or empty text has no words and fails ``few_words``; rows are judged
one by one, so repeated rows, null ids and ties need nothing; an empty table gives an
empty ledger; columns of the input that are named like the ledger's are not touched, as
the input row travels inside one struct column.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import WORD, let, split_words

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
SPAN = 8


def covered_words(hashes: Column, span: int = SPAN) -> Column:
    """Words inside windows of ``span`` words that a text holds at least twice."""

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - span), lambda i: F.xxhash64(*[h[i + k] for k in range(span)]))

    def repeated_starts(g: Column) -> Column:
        placed = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("h"), i.alias("at"))))

        def starts(s: Column) -> Column:
            last = F.size(s) - 1
            alike = F.filter(
                F.sequence(F.lit(0), last),
                lambda i: F.when(i > 0, s[F.greatest(i - 1, F.lit(0))]["h"] == s[i]["h"]).otherwise(False)
                | F.when(i < last, s[F.least(i + 1, last)]["h"] == s[i]["h"]).otherwise(False),
            )
            return F.sort_array(F.transform(alike, lambda i: s[i]["at"]))

        return let(placed, starts)

    def total(starts: Column) -> Column:
        return F.aggregate(
            starts,
            F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
            lambda acc, at: F.struct((acc["n"] + at + span - F.greatest(at, acc["end"])).alias("n"), (at + span).alias("end")),
            lambda acc: acc["n"],
        )

    return let(
        hashes,
        lambda h: F.when(F.size(h) < span, F.lit(0)).otherwise(
            let(windows(h), lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(total(repeated_starts(g))))
        ),
    )


def _count_chars(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


@dataclass(frozen=True)
class Rule:
    """A rule fails where ``failed`` (SQL over the measurements) is true."""

    name: str
    failed: str


#: In bit order. New rules go to the end; a bit never changes its meaning.
RULES = (
    Rule("few_words", "n_words < 20"),
    Rule("repeated_words", "100 * n_repeat_words > 30 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("stutter", "100 * n_stutter > 20 * n_words"),
    Rule("repeated_lines", "n_lines >= 4 and 100 * n_dup_lines > 50 * n_lines"),
    Rule("long_words", "word_chars > 40 * n_words"),
    Rule("few_distinct_words", "n_words >= 50 and 100 * n_distinct_words < 10 * n_words"),
)
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stutter", "n_distinct_words")


def bit(*names: str) -> int:
    return sum(1 << k for k, rule in enumerate(RULES) if rule.name in names)


@dataclass(frozen=True)
class Policy:
    """Rejects a document with any failure bit of the mask."""

    version: str
    mask: int


BASE = Policy("base", bit("few_words", "repeated_words"))
CURRENT = Policy("2", bit(*(r.name for r in RULES)))
POLICIES = (BASE, Policy("1", BASE.mask | bit("symbols")), CURRENT)


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """Per row: the input row as ``doc``, the measurements, ``failed_bits``."""
    words = docs.select(F.struct("*").alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text")).select(
        "doc", "text", split_words(F.col("text")).alias("words"), F.filter(F.split("text", "\n", -1), lambda x: x.rlike(WORD)).alias("lines")
    )
    hashed = words.select("*", F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))
    stutter = let(F.col("hashes"), lambda h: F.size(F.filter(F.transform(h, lambda x, i: (i > 0) & (h[F.greatest(i - 1, F.lit(0))] == x)), lambda same: same)))
    measured = hashed.select(
        "doc",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("text", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        _count_chars(F.col("text"), SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        covered_words(F.col("hashes")).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        stutter.cast("long").alias("n_stutter"),
        F.size(F.array_distinct("hashes")).cast("long").alias("n_distinct_words"),
    )
    bits = sum((F.when(F.expr(rule.failed), F.lit(1 << k)).otherwise(F.lit(0)) for k, rule in enumerate(RULES)), F.lit(0))
    return measured.select("*", bits.cast("long").alias("failed_bits"))


def passes(policy: Policy) -> Column:
    """Whether a ledger row passes; a document that fails the base rules fails every policy."""
    return F.col("failed_bits").bitwiseAND(F.lit(policy.mask | BASE.mask)) == 0


def ablate(rows: DataFrame, policies: tuple[Policy, ...] = POLICIES) -> DataFrame:
    """Per policy and rule: documents that the policy keeps, that fail the rule, and that only this rule rejects.

    The ledger is first counted by its bits, at most one row for each set of failures.
    """
    counted = rows.groupBy("failed_bits").agg(F.count("*").alias("n"))
    marks = F.explode(
        F.array(*[F.struct(F.lit(p.version).alias("policy"), F.lit(p.mask).cast("long").alias("mask"), F.lit(r.name).alias("rule"), F.lit(1 << k).cast("long").alias("bit")) for p in policies for k, r in enumerate(RULES) if p.mask >> k & 1])
    )
    hit = F.col("failed_bits").bitwiseAND(F.col("m.mask"))
    fails = F.col("failed_bits").bitwiseAND(F.col("m.bit")) != 0
    return (
        counted.select("*", marks.alias("m"))
        .groupBy(F.col("m.policy").alias("policy"), F.col("m.rule").alias("rule"))
        .agg(
            F.sum(F.when(hit == 0, F.col("n")).otherwise(0)).alias("kept"),
            F.sum(F.when(fails, F.col("n")).otherwise(0)).alias("failing"),
            F.sum(F.when(hit == F.col("m.bit"), F.col("n")).otherwise(0)).alias("only_this_rule"),
        )
    )


def keep_good(docs: DataFrame, policy: Policy = CURRENT) -> DataFrame:
    """The rows that pass, with their own columns."""
    return ledger(docs).where(passes(policy)).select("doc.*")
