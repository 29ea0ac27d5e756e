"""Reports and wiki pages: rows of (page, text) that Spark writes, and the newest report of a name."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions.text import safe_filename
from codeloom.operators import lookups, memories

REPORT = "name string, created_at timestamp, text string, payload string"
#: Types of symbols with a page, and how many symbols, flows and memories a wiki lists.
SYMBOL_TYPES = ("module", "class", "function", "test", "api_endpoint", "database_table", "config")
SYMBOLS, FLOWS, DECISIONS = 500, 300, 100


def write_report(rows: DataFrame, name: str, root: str) -> None:
    """Adds (text) and its JSON ``payload`` as a report of this name."""
    rows.select(F.lit(name).alias("name"), F.current_timestamp().alias("created_at"), "text", "payload").write.mode("append").parquet(f"{root}/reports")


def latest_report(spark: SparkSession, root: str, name: str) -> DataFrame:
    """(name, created_at, text, payload) of the newest report of a name; empty without one."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/reports")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], REPORT)
    return newest_report(spark.read.schema(REPORT).parquet(f"{root}/reports"), name)


def newest_report(reports: DataFrame, name: str) -> DataFrame:
    return reports.where(F.col("name") == name).orderBy(F.desc("created_at"), "text").limit(1)


def wiki_pages(files: DataFrame, nodes: DataFrame, edges: DataFrame, remembered: DataFrame, review: DataFrame | None = None) -> DataFrame:
    """(page, text): one page a live file and listed symbol, and the pages that link them. Files whose safe names are equal share a page, the last path's."""
    page = lambda folder, name: F.concat(F.lit(f"{folder}/"), safe_filename(name))
    live = files.where("not coalesce(is_deleted, false)").select("path", "language")
    counted = live.join(nodes.groupBy(F.col("file_path").alias("path")).agg(F.count("*").alias("n")), "path", "left")
    of_file = counted.select("path", page("files", F.col("path")).alias("page"), F.concat(F.lit("# "), "path", F.lit("\n\n- Language: "), F.coalesce("language", F.lit("unknown")), F.lit("\n- Node count: "), F.coalesce("n", F.lit(0)).cast("string")).alias("text"))
    shown = nodes.where(F.col("type").isin(*SYMBOL_TYPES)).orderBy("qualified_name", "id").limit(SYMBOLS)
    where = F.coalesce(F.when(F.col("file_path") != "", F.col("file_path")), F.lit("external"))
    number = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    body = F.concat(F.lit("# "), "qualified_name", F.lit("\n\n- Type: "), "type", F.lit("\n- File: [["), page("files", where), F.lit("|"), where, F.lit("]]\n- Lines: "), number("line_start"), F.lit("-"), number("line_end"), F.lit("\n\n## Backlinks\n- [[architecture]]"))
    of_symbol = shown.select("qualified_name", page("symbols", F.col("qualified_name")).alias("page"), body.alias("text"))
    flows = lookups.named_flows(edges, nodes, limit=FLOWS)
    decided = memories.listed(remembered, memories.WIKI_KINDS, DECISIONS)

    def listing(rows: DataFrame, name: str, head: str, order: list, line) -> DataFrame:
        lines = rows.agg(F.array_sort(F.collect_list(F.struct(*order, line.alias("line")))).alias("ls"))
        return lines.select(F.lit(name).alias("page"), F.concat(F.lit(head), F.array_join(F.transform("ls", lambda x: F.concat(F.lit("\n"), x["line"])), "")).alias("text"))

    pages = [
        of_file.groupBy("page").agg(F.max_by("text", "path").alias("text")), of_symbol.groupBy("page").agg(F.max_by("text", "qualified_name").alias("text")),
        listing(of_symbol, "architecture", "# Architecture\n\n## Key Symbols", ["qualified_name"], F.concat(F.lit("- [["), "page", F.lit("|"), "qualified_name", F.lit("]]"))),
        listing(flows, "flows", "# Flows\n", ["id"], F.concat(F.lit("- `"), "source", F.lit("` --"), "type", F.lit("--> `"), "target", F.lit("`"))),
        listing(decided, "decisions", "# Decisions\n", ["created_at", "id"], F.concat(F.lit("- **"), "kind", F.lit("**: "), "content")),
    ]
    known = nodes.sparkSession.range(1).select(F.lit("review").alias("page"), F.lit("# Review\n\nNo review artifact generated yet.").alias("text"))
    if review is not None:
        known = review.select(F.lit("review").alias("page"), "text").unionByName(known.withColumn("page", F.lit("~none"))).orderBy("page").limit(1).withColumn("page", F.lit("review"))
    return reduce(DataFrame.unionByName, [*pages, known])


def index_pages(files: DataFrame, per_page: int = 1000) -> DataFrame:
    """(page, text): all live files by path, so many a page; ``index`` is the first."""
    live = files.where("not coalesce(is_deleted, false)").select("path").distinct()
    line = F.concat(F.lit("- ["), "path", F.lit("](files/"), safe_filename(F.col("path")), F.lit(".md)"))
    # a file's page follows from its hash, so no order over all files is needed; a small tree has one page
    pages = max(1, -(-live.count() // per_page))
    dealt = live.select(F.pmod(F.crc32("path"), F.lit(pages)).cast("int").alias("nth"), "path", line.alias("line"))
    links = "\n".join(["# Wiki", "", "- [[architecture]]", "- [[flows]]", "- [[decisions]]", "- [[review]]", "", "## Files"])
    text = F.concat(F.when(F.col("nth") == 0, links).otherwise("# Files"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "line"))), lambda x: F.concat(F.lit("\n"), x["line"])), ""))
    return dealt.groupBy("nth").agg(text.alias("text")).select(F.when(F.col("nth") == 0, "index").otherwise(F.concat(F.lit("index-"), F.col("nth").cast("string"))).alias("page"), "text")


def write_wiki(pages: DataFrame, path: str) -> None:
    """Pages as text files, a folder each (``page=<name>``), with slashes of names escaped."""
    pages.repartition("page").write.mode("overwrite").partitionBy("page").option("lineSep", "\n").text(path)
