import re

from pyspark.sql import functions as F

from codeloom.llm import urls

SCHEMA = "page_id long, url string, host string, verdict string"


def brute(url):
    host = path = ""
    if url and "://" in url:
        rest = url[url.index("://") + 3 :]
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host) :]).group()
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in urls.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.pattern), default=None)
    return host, path, best and best.pattern, best and best.verdict


def test_rules_against_brute_force(spark, sf_dir):
    odd = [None, "", "x", "http://", "http://net", "http://net/", "http://A.NET/x?y", "https://example.net/en/1#a", "http://notexample.net/en/", "http://x.example.net/en", "ftp://example.com/de/?q=/", "http://b.org/fr/a?b#c", "http://org/fr/", "http://É.net/", "a://b://c.net/", "http://a.net?/x", "http://a.net\n/b\nc"]
    rows = [(k, u) for k, u in enumerate(odd)] + [(r.page_id + 100, r.url) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    frame = spark.createDataFrame([(*r, "own", "own") for r in rows], SCHEMA)
    got = urls.UrlFilter(urls.weak_labels(frame)).judge(frame).select("row.*", F.col("host").alias("h"), F.col("path").alias("p"), "rule", F.col("verdict").alias("v"), "model_verdict").collect()
    assert len(got) == len(rows)
    for r in got:
        host, path, rule, verdict = brute(r.url)
        assert (r.h, r.p, r.rule) == (host, path, rule), r.url
        assert r.v == (verdict or r.model_verdict)
        assert (r["host"], r["verdict"]) == ("own", "own")


def test_trees_on_held_out_urls(spark):
    good = [(f"http://site{k}.example.org/en/{k * 37 % 1000}", 0) for k in range(300)]
    bad = [(f"http://win-cash-{k}-now.example.info/x{k}{k}?a={k}&b=1&c=2", 1) for k in range(100)]
    frame = spark.createDataFrame([(u, y) for u, y in good[::2] + bad[::2]], "url string, label int")
    model = urls.UrlFilter(frame)
    test = spark.createDataFrame([(u, y) for u, y in good[1::2] + bad[1::2]], "url string, y int")
    wrong = model.judge(test).where("(model_verdict = 'block') <> (row.y = 1)").count()
    assert wrong <= 4


def test_one_class_and_empty(spark):
    one = urls.UrlFilter(spark.createDataFrame([("http://a.org/", 0)], "url string, label int"))
    assert one.judge(spark.createDataFrame([("http://b.com/",)], "url string")).first().verdict == "allow"
    empty = spark.createDataFrame([], "url string, label int")
    assert urls.UrlFilter(empty).judge(empty).count() == 0
