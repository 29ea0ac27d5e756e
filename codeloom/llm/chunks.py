"""Repeated line chunks with content-defined boundaries.

A text is cut into runs of whole lines. A rolling hash over the hashes of the last
``WINDOW`` lines says whether a line ends a run, so a boundary moves with the lines around
it and not with their place in the text. A line of more than ``LONG_LINE`` words is a run
of its own, whatever stands around it. A run that counts (several lines with words, or one
long line) and whose bytes occurred before goes; its first occurrence, by document id, then
text hash, then place, stays.

``remove_passages`` finds passages that runs miss, as few short lines seldom hold a whole run.
A passage is a stretch of lines that counts: several lines with words, or one long line. From
each line the shortest stretch that counts, forward and backward, is looked up; these hang on
the passage's own lines only, and together they cover every passage that occurred before,
whatever stands around it. So each line of such a passage goes, except from its first
occurrence; a repeat that overlaps its own first occurrence doesn't count. ``dedup_passages``
returns the input's rows without them, ``dedup_lines`` without repeated runs only.

Texts aren't shuffled to find repeats: only hashes are. The texts of runs whose hashes
repeat are then compared byte by byte with the first occurrence.

Defined cases: a null text stays null and an empty one empty; a document all of whose runs
occurred before gets an empty text; rows that agree in id and text are one document, and
both get its result; null ids are an id of their own; an empty table gives an empty table;
columns of the input keep their names and values, as the row travels inside one struct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import cut, let

WINDOW = 2
#: One line in so many ends a run.
DIVISOR = 3
#: Words above which a line is a run of its own.
LONG_LINE = 50
#: A run of several lines counts if it has so many words.
MIN_WORDS = 10

#: Places of one passage that one task compares with its first occurrence.
PLACES = 1024

_SPACES = " \t\x0b\x0c\r"


def _gaps(text: Column, chars: str = _SPACES) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def runs(text: Column) -> Column:
    """Array of (at, n): the first line of each run, counted from 0, and how many lines it has."""

    def cuts(lines: Column) -> Column:
        facts = F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("h"), (_gaps(x) >= LONG_LINE).alias("long")))

        def starts(f: Column) -> Column:
            def begins(i: Column) -> Column:
                before = F.greatest(i - 1, F.lit(0))
                rolled = F.xxhash64(*[f[F.greatest(i - 1 - k, F.lit(0))]["h"] for k in reversed(range(WINDOW))])
                return (i == 0) | f[i]["long"] | f[before]["long"] | (F.pmod(rolled, F.lit(DIVISOR)) == 0)

            return F.filter(F.sequence(F.lit(0), F.size(f) - 1), begins)

        return let(let(facts, starts), lambda s: F.transform(s, lambda at, k: F.struct(at.alias("at"), (F.coalesce(F.get(s, k + 1), F.size(lines)) - at).alias("n"))))

    return let(_lines(text), cuts)


def _run_texts(text: Column) -> Column:
    """Array of (at, n, text) of the runs that count."""
    with_text = let(_lines(text), lambda lines: F.transform(runs(text), lambda r: F.struct(r["at"].alias("at"), r["n"].alias("n"), F.array_join(F.slice(lines, r["at"] + 1, r["n"]), "\n").alias("text"))))
    worded = lambda t: F.size(F.filter(_lines(t), lambda x: F.translate(x, _SPACES, "") != ""))
    several = lambda r: (r["n"] > 1) & (_gaps(r["text"], _SPACES + "\n") >= MIN_WORDS - 1) & (worded(r["text"]) > 1)
    return F.filter(with_text, lambda r: several(r) | (_gaps(r["text"]) >= LONG_LINE))


def _key(text: Column) -> tuple[Column, Column]:
    """96 bits; only runs of equal bytes are taken as equal in the end."""
    return F.xxhash64(text).alias("h"), F.hash(text).alias("g")


def repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, th, at): document, hash of its text, and first line of each run that occurred before."""
    keyed = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("th")).where("text is not null")
    signed = cut(keyed.select("id", "th", F.explode(_run_texts(F.col("text"))).alias("r")).select("id", "th", F.col("r.at").alias("at"), *_key(F.col("r.text"))))
    first = signed.groupBy("h", "g").agg(F.count("*").alias("n"), F.min(F.struct("id", "th", "at")).alias("first")).where("n > 1").select("h", "g", "first")
    likely = (
        signed.join(first, ["h", "g"])
        .select("id", "th", F.struct("at", (F.struct("id", "th", "at") != F.col("first")).alias("later")).alias("place"))
        .groupBy("id", "th")
        .agg(F.collect_set("place").alias("places"))
    )
    places = keyed.join(likely.select(F.col("id").alias("_id"), F.col("th").alias("_th"), "places"), F.expr("id <=> _id and th = _th")).select(
        "id", "th", let(F.map_from_entries("places"), lambda m: F.filter(_run_texts(F.col("text")), lambda r: F.map_contains_key(m, r["at"]))).alias("rs"), F.map_from_entries("places").alias("later")
    )
    found = places.select("id", "th", "later", F.explode("rs").alias("r")).select("id", "th", F.col("r.at").alias("at"), F.col("r.text").alias("run"), F.element_at("later", F.col("r.at")).alias("later"), *_key(F.col("r.text")))
    originals = found.where("not later").select("h", "g", F.col("run").alias("original")).distinct()
    return found.where("later").join(originals, ["h", "g"]).where("run = original").select("id", "th", "at")


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the input row as ``doc``, its ``kept`` text, ``n_removed`` runs and ``removed_lines``."""
    gone = repeats(docs, doc_id, text).groupBy("id", "th").agg(F.collect_set("at").alias("ats"))
    rows = docs.select(F.col(doc_id).alias("id"), F.xxhash64(text).alias("th"), F.struct("*").alias("doc"))  # the text moves once
    joined = rows.join(gone.select(F.col("id").alias("_id"), F.col("th").alias("_th"), "ats"), F.expr("id <=> _id and th = _th"), "left").withColumn("text", F.col(f"doc.`{text}`"))
    kept_lines = let(_lines(F.col("text")), lambda lines: F.flatten(F.transform(F.filter(runs(F.col("text")), lambda r: ~F.array_contains("ats", r["at"])), lambda r: F.slice(lines, r["at"] + 1, r["n"]))))
    cut_text = F.when(F.col("ats").isNull(), F.col("text")).otherwise(F.array_join(kept_lines, "\n"))
    return joined.select("doc", cut_text.alias("kept"), F.coalesce(F.size("ats"), F.lit(0)).cast("long").alias("n_removed"), "text").select(
        "doc", "kept", F.when(F.col("n_removed") > 0, F.col("n_removed")).otherwise(0).alias("n_removed"), (F.length("text") - F.length("kept")).cast("long").alias("removed_chars")
    )


def _span(at: Column, n: Column) -> Column:
    """First line and number of lines as one number, as arrays of numbers lose their doubles in linear time."""
    return F.shiftleft(at.cast("long"), 32) + n


def _shortest(text: Column) -> Column:
    """Array of (at, n, h, g) of the shortest stretches that count from each line with words, forward and backward."""

    def grown(lines: Column) -> Column:
        """How many of some lines, from the first on, count together; 0 if all of them don't."""
        start = F.struct(F.lit(0).alias("n"), F.lit(-1).alias("gaps"))
        enough = lambda a: (a["n"] > 1) & (a["gaps"] >= MIN_WORDS - 1)
        add = lambda a, x: F.when(enough(a), a).otherwise(F.struct((a["n"] + 1).alias("n"), (a["gaps"] + x["gaps"] + 1).alias("gaps")))
        return F.aggregate(lines, start, add, lambda a: F.when(enough(a), a["n"]).otherwise(0))

    def stretches(f: Column) -> Column:
        worded = F.filter(F.transform(f, lambda x, k: F.struct(k.alias("at"), x["gaps"].alias("gaps"), x["worded"].alias("worded"))), lambda x: x["worded"])

        def spans(w: Column) -> Column:
            def around(x: Column, i: Column) -> Column:
                low = F.greatest(i - MIN_WORDS + 1, F.lit(0))
                ahead, back = grown(F.slice(w, i + 1, MIN_WORDS)), grown(F.reverse(F.slice(w, low + 1, i - low + 1)))
                span = lambda a, b: _span(a["at"], b["at"] - a["at"] + 1)
                both = F.array(F.when(ahead > 0, span(x, F.get(w, i + ahead - 1))), F.when(back > 0, span(F.get(w, i - back + 1), x)))
                return F.when(x["gaps"] >= LONG_LINE, F.array(_span(x["at"], F.lit(1)))).otherwise(both)

            return F.array_distinct(F.filter(F.flatten(F.transform(w, around)), lambda r: r.isNotNull()))

        keyed = lambda s, h: let(F.struct(F.shiftright(s, 32).cast("int").alias("at"), s.bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("n")), lambda r: hashed(r, h))
        hashed = lambda r, h: let(F.slice(h, r["at"] + 1, r["n"]), lambda x: F.struct(r["at"].alias("at"), r["n"].alias("n"), F.xxhash64(x).alias("h"), F.hash(x).alias("g")))
        return let(F.transform(f, lambda x: x["h"]), lambda h: F.transform(let(worded, spans), lambda r: keyed(r, h)))

    facts = F.transform(_lines(text), lambda x: F.struct(F.xxhash64(x).alias("h"), _gaps(x).alias("gaps"), (F.translate(x, _SPACES, "") != "").alias("worded")))
    return let(facts, stretches)


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(id, text, th, rest): each row with the hash of its text and, if there are any, its other columns."""
    others = [F.col(c) for c in docs.columns if c not in (doc_id, text)]
    return docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("th"), *([F.struct(*others).alias("rest")] if others else []))


def passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, th, at, n): document, hash of its text, first line and number of lines of each shortest stretch that occurred before."""
    keyed = _keyed(docs, doc_id, text)
    apart = lambda r: F.struct(*[r[c].alias(c) for c in ("at", "n", "h", "g")])
    packed = cut(keyed.where("text is not null").select("id", "th", let(_shortest(F.col("text")), apart).alias("s")).select("id", "th", "s.*"))  # arrays of numbers, as each row would repeat id and th
    signed = packed.select("id", "th", F.explode(F.arrays_zip("at", "n", "h", "g")).alias("r")).select("id", "th", "r.*")
    first = signed.groupBy("h", "g").agg(F.count("*").alias("c"), F.min(F.struct("id", "th", "at")).alias("first")).where("c > 1").select("h", "g", "first", "c")
    later = ~(F.col("id").eqNullSafe(F.col("first.id")) & (F.col("th") == F.col("first.th"))) | (F.col("at") >= F.col("first.at") + F.col("n"))
    ways = F.ceil(F.col("c") / PLACES)  # tasks that compare the places of one passage
    likely = (
        signed.join(first, ["h", "g"])
        .where(later | (F.col("at") == F.col("first.at")))
        .select("id", "th", F.struct("at", "n", later.alias("later"), ways.cast("int").alias("ways")).alias("place"))
        .groupBy("id", "th")
        .agg(F.collect_set("place").alias("places"))
    )
    with_text = let(_lines(F.col("text")), lambda lines: F.transform("places", lambda r: F.struct(r["at"].alias("at"), r["n"].alias("n"), r["later"].alias("later"), r["ways"].alias("ways"), F.array_join(F.slice(lines, r["at"] + 1, r["n"]), "\n").alias("text"))))
    rows = keyed.join(likely.select(F.col("id").alias("_id"), F.col("th").alias("_th"), "places"), F.expr("id <=> _id and th = _th")).select("id", "th", F.explode(with_text).alias("r"))
    found = rows.select("id", "th", "r.at", "r.n", "r.later", "r.ways", F.col("r.text").alias("passage"), *_key(F.col("r.text")))
    originals = found.where("not later").groupBy("h", "g", F.col("passage").alias("original")).agg(F.max("ways").alias("ways")).select("h", "g", "original", F.explode(F.sequence(F.lit(0), F.col("ways") - 1)).alias("way"))
    dealt = found.where("later").withColumn("way", F.pmod(F.xxhash64("id", "th", "at"), F.col("ways")).cast("int"))
    return dealt.join(originals, ["h", "g", "way"]).where("passage = original").select("id", "th", "at", "n")


def remove_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the input row as ``doc``, its ``kept`` text, ``n_removed`` stretches of lines and ``removed_chars``.

    Rows with no columns but id and text meet their passages in the very shuffle that found these; others move once more.
    """
    gone = passages(docs, doc_id, text).groupBy("id", "th").agg(F.collect_set(F.struct("at", "n")).alias("spans"))
    joined = _keyed(docs, doc_id, text).join(gone.select(F.col("id").alias("_id"), F.col("th").alias("_th"), "spans"), F.expr("id <=> _id and th = _th"), "left")
    doc = F.struct(*[F.col({doc_id: "id", text: "text"}.get(c, f"rest.`{c}`")).alias(c) for c in docs.columns])
    numbers = F.array_distinct(F.flatten(F.transform("spans", lambda r: F.sequence(r["at"], r["at"] + r["n"] - 1))))
    own = F.col("text")
    kept = let(_lines(own), lambda lines: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("numbers")), lambda k: F.get(lines, k)), "\n"))
    out = joined.select(doc.alias("doc"), "text", numbers.alias("numbers")).select("doc", "text", "numbers", F.when(F.col("numbers").isNull(), own).otherwise(kept).alias("kept"))
    starts = F.size(F.array_except("numbers", F.transform("numbers", lambda k: k + 1)))
    return out.select("doc", "kept", F.when(F.col("numbers").isNull(), 0).otherwise(starts).cast("long").alias("n_removed"), (F.length(own) - F.length("kept")).cast("long").alias("removed_chars"))


def _with_kept(out: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    return out.select(*[F.col("kept").alias(c) if c == text else F.col(f"doc.`{c}`").alias(c) for c in docs.columns])


def dedup_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """The input's rows and columns, with texts without repeated runs."""
    return _with_kept(remove_repeats(docs, text=text), docs, text)


def dedup_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The input's rows and columns, with texts without repeated passages."""
    return _with_kept(remove_passages(docs, doc_id, text), docs, text)
