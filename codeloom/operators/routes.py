"""HTTP routes declared in source texts and by file places.

Each takes a frame with ``path`` and ``content`` and adds ``method``, ``route`` and ``line``
per route. A line is that of the route's own token.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codeloom.functions.matching import matches

#: Patterns of route declarations, in Java's dialect.
EXPRESS = r"(?i)\b(?:app|router|server)\.(get|post|put|patch|delete)\s*\(\s*[\"']([^\"']+)[\"']"
CONTROLLER = r"@Controller\s*\(\s*(?:[\"']([^\"']*)[\"'])?\s*\)"
DECORATED = r"@(Get|Post|Put|Patch|Delete|Options|Head|All)\s*\(\s*(?:[\"']([^\"']*)[\"'])?\s*\)"
NEXT_EXPORT = r"\bexport\s+(?:async\s+)?(?:const|function|let|var)\s+(GET|POST|PUT|PATCH|DELETE|OPTIONS|HEAD)\b"
PYTHON = r"(?im)^\s*@(?:[A-Za-z_]\w*\.)*([A-Za-z_]\w*)\.(get|post|put|patch|delete|options|head|websocket|route)\s*\(\s*[\"']([^\"']+)[\"']"
FLASK = r"(?im)^\s*@(?:[A-Za-z_]\w*\.)*(?:app|bp|blueprint|[a-z_]\w*)\.route\s*\(\s*[\"']([^\"']+)[\"'](?:[^)]*methods\s*=\s*\[([^\]]*)\])?"
DJANGO = r"\b(?:path|re_path|url)\s*\(\s*[\"']([^\"']+)[\"']\s*,\s*([A-Za-z_][\w.]*)"
#: Endings of page sources, and stems that are no page.
NEXT_ENDINGS = (".ts", ".tsx", ".js", ".jsx", ".mjs")
NEXT_SKIPPED = ("_app", "_document", "_error", "_middleware", "middleware")


def found(files: DataFrame, pattern: str, groups: int) -> DataFrame:
    """One row for each match in ``content``: groups ``g1..`` and ``line``."""
    rows = files.select("*", F.explode(matches(F.col("content"), pattern, groups)).alias("_m"))
    return rows.select(*files.columns, F.col("_m.line").alias("line"), *[F.col(f"_m.g{g}").alias(f"g{g}") for g in range(1, groups + 1)])


def normalized(path: Column) -> Column:
    return F.when(path == "/", path).otherwise(F.coalesce(F.nullif(F.regexp_replace(path, "/+$", ""), F.lit("")), F.lit("/")))


def express_routes(files: DataFrame) -> DataFrame:
    return found(files, EXPRESS, 2).select(*files.columns, F.upper("g1").alias("method"), F.col("g2").alias("route"), "line")


def python_routes(files: DataFrame) -> DataFrame:
    """FastAPI verbs and web sockets, Flask routes (once without a method, and once for each declared one), Django patterns."""
    decorated = found(files, PYTHON, 3).select(*files.columns, F.when(F.lower("g2") == "route", "ANY").otherwise(F.upper("g2")).alias("method"), F.col("g3").alias("route"), "line")
    flask = found(files, FLASK, 2).select("*", F.regexp_extract_all("g2", F.lit("[\"']([^\"']+)[\"']"), F.lit(1)).alias("ms"))
    methods = F.explode(F.when(F.size("ms") == 0, F.array(F.lit("GET"))).otherwise(F.transform("ms", lambda m: F.upper(m))))
    flask = flask.select(*files.columns, methods.alias("method"), F.col("g1").alias("route"), "line")
    django = found(files, DJANGO, 2).select(*files.columns, F.lit("ANY").alias("method"), F.col("g1").alias("route"), "line")
    return reduce(DataFrame.unionByName, [decorated, flask, django])


def nest_routes(files: DataFrame, key: str = "path") -> DataFrame:
    """A method takes the prefix of the last controller before it: an as-of join within the file."""
    prefix = found(files, CONTROLLER, 1).select(F.col(key).alias("_key"), "line", F.lit(0).alias("side"), F.col("g1").alias("prefix"), F.lit(None).cast("string").alias("verb"), F.lit(None).cast("string").alias("sub"))
    method = found(files, DECORATED, 2).select(F.col(key).alias("_key"), "line", F.lit(1).alias("side"), F.lit(None).cast("string").alias("prefix"), F.col("g1").alias("verb"), F.col("g2").alias("sub"))
    order = W.partitionBy("_key").orderBy("line", "side")
    joined = prefix.unionByName(method).withColumn("prefix", F.coalesce(F.last("prefix", ignorenulls=True).over(order), F.lit(""))).where("side = 1")
    whole = F.concat(F.lit("/"), F.array_join(F.filter(F.split(F.concat_ws("/", "prefix", "sub"), "/"), lambda x: x != ""), "/"))
    return joined.select(F.col("_key").alias(key), F.when(F.col("verb") == "All", "ANY").otherwise(F.upper("verb")).alias("method"), whole.alias("route"), "line")


def next_routes(files: DataFrame) -> DataFrame:
    """Routes by place under the last ``app`` or ``pages`` directory."""
    parts = F.filter(F.split("path", "/"), lambda x: x != "")
    back = F.reverse("_parts")
    at = F.array_position(F.transform(back, lambda x: x.isin("app", "pages")), True)  # from the end, 1-based
    cut = files.withColumn("_parts", parts).withColumn("_at", at.cast("int")).where("_at > 1")
    size = F.size("_parts")
    base = cut.select(
        *files.columns,
        F.get("_parts", size - F.col("_at")).alias("_anchor"),
        F.slice("_parts", size - F.col("_at") + 2, F.greatest(F.col("_at") - 2, F.lit(0))).alias("_dirs"),
        F.get("_parts", size - 1).alias("_file"),
    )
    ending = F.regexp_extract("_file", r"^.+(\.[^.]+)$", 1)
    stem = F.regexp_replace("_file", r"(?<=.)\.[^.]*$", "")
    named = base.where(F.lower(ending).isin(*NEXT_ENDINGS)).withColumn("_stem", stem)
    named = named.withColumn("_dirs", F.when(F.col("_anchor") == "app", F.filter("_dirs", lambda d: ~(F.startswith(d, F.lit("(")) & F.endswith(d, F.lit(")"))))).otherwise(F.col("_dirs")))
    url = lambda xs: normalized(F.concat(F.lit("/"), F.array_join(xs, "/")))
    own = files.columns
    page = named.where("_anchor = 'app' and _stem = 'page'").select(*own, F.lit("GET").alias("method"), url(F.col("_dirs")).alias("route"), F.lit(1).alias("line"))
    handlers = found(named.where("_anchor = 'app' and _stem = 'route'"), NEXT_EXPORT, 1).select(*own, F.upper("g1").alias("method"), url(F.col("_dirs")).alias("route"), "line")
    whole = F.when(F.col("_stem") == "index", F.col("_dirs")).otherwise(F.concat("_dirs", F.array("_stem")))
    is_api = F.coalesce(F.get("_dirs", F.lit(0)) == "api", F.lit(False))
    pages = named.where(F.col("_anchor") == "pages").where(~F.col("_stem").isin(*NEXT_SKIPPED)).select(*own, F.when(is_api, "ANY").otherwise("GET").alias("method"), url(whole).alias("route"), F.lit(1).alias("line"))
    return page.unionByName(handlers).unionByName(pages)
