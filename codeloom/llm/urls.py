"""URL verdicts: longest matching rule first, boosted trees on lexical features for the rest.

Features of a URL: its length, those of host and path, path depth, labels of the host,
digit ratio, hyphens, parameter count, character entropy, and the smoothed share of blocked
URLs among the other training URLs with the same suffix (last host label, and last two). Trees
are trained on a bounded sample of labelled URLs with Spark's own gradient boosting.

Defined cases: a null URL, or one without ``://``, has an empty host and path, fits no rule
and is judged by its features; ties between rules of equal length go to the first by name;
rows are judged one by one, so repeated rows and null ids need nothing; an empty table gives
an empty table; training URLs of one class only give that class; columns with clashing names
don't matter, as only the named ones are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import let

#: At most so many labelled URLs train the trees: those distinct ones with the least hashes.
SAMPLE = 4000
TREES, DEPTH, SEED = 8, 3, 11
#: URLs at the overall rate that are added to those of a suffix.
SMOOTH = 5
FEATURES = ("n_url", "n_host", "n_path", "depth", "labels", "digits", "hyphens", "params", "entropy", "suffix_rate", "suffix2_rate")


@dataclass(frozen=True)
class Rule:
    """``pattern`` is a host suffix, a slash, and the start of the path."""

    verdict: str
    pattern: str

    @property
    def host(self) -> str:
        return self.pattern.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.pattern.partition("/")[2]


RULES = (Rule("block", "net/"), Rule("allow", "example.net/en/"), Rule("block", "example.com/de/"), Rule("allow", "org/fr/"))

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: Column) -> tuple[Column, Column]:
    """Host with A-Z in lower case, and path."""
    at = F.locate("://", url)
    rest = F.when(url.isNull() | (at == 0), F.lit("")).otherwise(F.substring(url, at + 3, F.length(url)))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """(verdict, pattern) of the longest rule that fits, else null."""
    out = F.lit(None).cast("struct<verdict:string,pattern:string>")
    for rule in sorted(rules, key=lambda r: (len(r.pattern), r.pattern)):  # later ones win
        on_host = (host == rule.host) | F.endswith(host, F.lit("." + rule.host))
        on_path = F.startswith(path, F.lit(rule.path))
        out = F.when(on_host & on_path, F.struct(F.lit(rule.verdict).alias("verdict"), F.lit(rule.pattern).alias("pattern"))).otherwise(out)
    return out


def _entropy(text: Column) -> Column:
    def of(chars: Column) -> Column:
        n = F.size(chars).cast("double")
        counts = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)) / n)
        return F.aggregate(counts, F.lit(0.0), lambda acc, p: acc - p * F.log2(p))

    return F.when(F.length(text) == 0, 0.0).otherwise(let(F.filter(F.split(text, ""), lambda c: c != ""), of))


def lexical(df: DataFrame, url: str = "url") -> DataFrame:
    """The input's columns as ``row``, with host, path, rule and the features."""
    host, path = parts(F.col("url"))
    base = df.select(F.struct("*").alias("row"), F.col(url).alias("url")).select("row", "url", host.alias("host"), path.alias("path"))
    text = F.coalesce("url", F.lit(""))
    query = F.regexp_extract(text, r"(?s)\?([^#]*)", 1)
    labels = F.split("host", r"\.")
    return base.select(
        "row", "host", "path", longest_rule(F.col("host"), F.col("path")).alias("rule"),
        F.length(text).cast("double").alias("n_url"),
        F.length("host").cast("double").alias("n_host"),
        F.length("path").cast("double").alias("n_path"),
        (F.length("path") - F.length(F.translate("path", "/", ""))).cast("double").alias("depth"),
        F.size(labels).cast("double").alias("labels"),
        ((F.length(text) - F.length(F.translate(text, "0123456789", ""))) / F.greatest(F.length(text), F.lit(1))).alias("digits"),
        (F.length("host") - F.length(F.translate("host", "-", ""))).cast("double").alias("hyphens"),
        F.when(query == "", 0.0).otherwise(F.size(F.split(query, "&")).cast("double")).alias("params"),
        _entropy(F.concat("host", "path")).alias("entropy"),
        F.element_at(labels, -1).alias("suffix"),
        F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".").alias("suffix2"),
    )


class UrlFilter:
    """Trees trained on labelled URLs; ``label`` is 1 for block."""

    def __init__(self, labelled: DataFrame, url: str = "url", label: str = "label", sample: int = SAMPLE):
        few = labelled.select(F.col(url).alias("url"), F.col(label).cast("double").alias("label")).where("label is not null").groupBy("url").agg(F.max("label").alias("label")).orderBy(F.xxhash64("url"), "url").limit(sample)
        rows = lexical(few).select("*", F.col("row.label").alias("label")).drop("row", "rule").toPandas()
        spark = labelled.sparkSession
        self.rates = {}
        self.prior = float(rows.label.mean()) if len(rows) else 0.0
        for name in ("suffix", "suffix2"):
            by = rows.groupby(name).label
            total, count = by.transform("sum"), by.transform("count")
            rows[f"{name}_rate"] = (total - rows.label + SMOOTH * self.prior) / (count - 1 + SMOOTH)  # without the row's own label
            known = [(k, float((s + SMOOTH * self.prior) / (n + SMOOTH))) for k, s, n in by.agg(["sum", "count"]).itertuples()]
            self.rates[name] = spark.createDataFrame(known, f"{name} string, {name}_rate double").coalesce(1)  # at most ``sample`` rows
        self.model = None
        if 0 < self.prior < 1:
            train = self._vectors(spark.createDataFrame(rows).coalesce(1)).select("features", "label").cache()
            self.model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=SEED, cacheNodeIds=False).fit(train)
            train.unpersist()

    def _rated(self, df: DataFrame) -> DataFrame:
        for name, rates in self.rates.items():
            df = df.join(F.broadcast(rates), name, "left").withColumn(f"{name}_rate", F.coalesce(f"{name}_rate", F.lit(self.prior)))
        return df

    def _vectors(self, df: DataFrame) -> DataFrame:
        return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(df)

    def judge(self, df: DataFrame, url: str = "url") -> DataFrame:
        """Per row: the input as ``row``, host, path, rule, verdict, and whether the trees say block."""
        rows = lexical(df, url)
        if self.model is None:
            judged = rows.withColumn("prediction", F.lit(float(self.prior >= 0.5)))
        else:
            judged = self.model.transform(self._vectors(self._rated(rows)))
        by_model = F.when(F.col("prediction") == 1, "block").otherwise("allow")
        return judged.select("row", "host", "path", F.col("rule.pattern").alias("rule"), F.coalesce("rule.verdict", by_model).alias("verdict"), by_model.alias("model_verdict"))


#: Words in a host that label a URL of the generated training set as one to block.
BAD_WORDS = ("casino", "pills", "bets", "spam", "ads-track", "viagra", "poker", "loans", "lottery")


def weak_labels(urls: DataFrame, url: str = "url") -> DataFrame:
    """(url, label): 1 where the host holds one of BAD_WORDS, else 0."""
    host, _ = parts(F.col(url))
    return urls.select(F.col(url).alias("url"), host.rlike("|".join(BAD_WORDS)).cast("int").alias("label"))


def held_out(url: Column) -> Column:
    """A quarter of the hosts, whose URLs don't train the query's trees."""
    return F.pmod(F.crc32(parts(url)[0].cast("binary")), F.lit(4)) == 2
