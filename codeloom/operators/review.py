"""Reviews of changes: files, symbols, blast radius, tests, sensitive areas, risk, and what to do.

All inputs have a ``change``, so one plan reviews any number of them: one diff of a working tree, or
every commit of a history. Lists of a report are short by their nature (what one change touches); those that a hub
could make long are top lists of ``LISTED`` entries, while their counts are whole.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.text import contains_any
from codeloom.operators import diffs, graph, lookups, risk
from codeloom.operators.checkpoints import cut

BY = ("change",)
CODE_SYMBOLS = ("class", "function", "type")
#: Files whose churn and patches count, entries of flows, lines of a patch that are shown.
FIRST_FILES, FIRST_FLOWS, SHOWN_LINES = 20, 5, 160
#: Entries of the lists of impacted files and affected tests.
LISTED = 100
#: Texts of a review.
NO_TESTS = "No directly related tests found in the graph."
NO_CHANGE = "No changed files were detected. Use --files to review specific paths."
NO_DIFF = "Review was scoped with --files; git change metadata was not available for those paths."
CHECKS = (
    "Verify changed behavior against related tests.",
    "Inspect graph impacted files for unintended blast radius.",
    "Check confidence tiers before treating inferred facts as certain.",
)
CHECK_CONFIG = "Validate config and infrastructure changes in a clean environment."
CHECK_AUTH = "Review authentication, authorization, and secret-handling paths."
CHECK_TESTS = "Add or update tests for the changed behavior."
CONFIG_ENDS = (".yml", ".yaml", ".toml", ".json", ".env")
RUN_TESTS = "Run related tests listed in the review output."


def reach_by(seeds: DataFrame, links: DataFrame, depth: int) -> DataFrame:
    """(change, id, hop) within ``depth`` links (here, there) of each change's own seeds (change, id)."""
    frontier = cut(seeds.select(*BY, "id").distinct())
    found = frontier.withColumn("hop", F.lit(0))
    for hop in range(1, depth + 1):
        last = frontier.select(*BY, F.col("id").alias("here"))
        frontier = cut(graph.met(links, last).select(*BY, F.col("there").alias("id")).distinct().join(found.select(*BY, "id"), [*BY, "id"], "left_anti"))
        found = found.unionByName(frontier.withColumn("hop", F.lit(hop)))
    return found


def snippet(patch: Column, most: int = SHOWN_LINES) -> Column:
    """The first lines of a patch; a longer one says how many are left out."""
    lines = F.split(F.regexp_replace(F.regexp_replace(patch, r"\r\n?", "\n"), r"\n\z", ""), "\n", -1)
    cut_off = F.concat(F.array_join(F.slice(lines, 1, most), "\n"), F.lit("\n... truncated "), (F.size(lines) - most).cast("string"), F.lit(" diff lines ..."))
    return F.when(F.size(lines) <= most, patch).otherwise(cut_off)


def _listed(rows: DataFrame, column: str, name: str, limit: int | None = None) -> DataFrame:
    """(change, name): the distinct values of a column in order, the first ``limit`` of them."""
    once = rows.where(F.col(column).isNotNull()).select(*BY, F.col(column).alias("_v")).distinct()
    if limit is not None:
        once = once.withColumn("_k", F.row_number().over(Window.partitionBy(*BY).orderBy("_v"))).where(F.col("_k") <= limit)
    return once.groupBy(*BY).agg(F.array_sort(F.collect_list("_v")).alias(name))


def changed_symbols(touched: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes, other than files and modules, with a changed line (change, file_path, line) in their span, once a change."""
    spans = nodes.where("line_start is not null and line_end is not null and type not in ('file', 'module')")
    at = touched.select(*BY, F.col("file_path").alias("_path"), "line").distinct()
    hit = spans.join(graph.near(at), F.expr("file_path = _path and line between line_start and line_end"))
    return hit.select(*BY, *nodes.columns).dropDuplicates([*BY, "id"])


def review(files: DataFrame, patches: DataFrame, churn: DataFrame, nodes: DataFrame, edges: DataFrame, depth: int = 2) -> DataFrame:
    """One row for each change.

    ``files`` has change, path and place (the order of paths); ``patches`` change, path and patch; ``churn`` change,
    path and commits; ``nodes`` id, type, name, qualified_name, file_path, line_start, line_end, confidence_tier.
    """
    files = files.groupBy(*BY, "path").agg(F.min("place").alias("place"))
    by_place = Window.partitionBy(*BY).orderBy("place", "path")
    ordered = cut(files.withColumn("nth", F.row_number().over(by_place)))
    of_files = ordered.join(patches.groupBy(*BY, "path").agg(F.max("patch").alias("patch")), [*BY, "path"], "left").where(F.length("patch") > 0).select(*ordered.columns, "patch")
    lines = diffs.numbered(diffs.patch_lines(of_files.select(F.struct(*BY, "path").alias("patch_id"), "patch")))
    touched = cut(lines.where(~F.col("is_hunk") & diffs.is_change(F.col("line"), F.col("new_line"))).select("patch_id.change", "file_path", F.col("new_line").alias("line")).distinct())
    symbols = cut(changed_symbols(touched, nodes))
    in_files = nodes.join(graph.near(ordered.select(*BY, F.col("path").alias("file_path"), "place")), "file_path").select(*BY, *nodes.columns)
    seeds = cut(symbols.unionByName(in_files.join(symbols.select(*BY).distinct(), list(BY), "left_anti").select(symbols.columns)))
    reached = reach_by(seeds, graph._reverse(edges), depth).where("hop > 0")
    hit = cut(reached.join(nodes, "id").select(*BY, *nodes.columns))
    related = edges.where("type = 'tested_by'").join(seeds.select(*BY, F.col("id").alias("source_id")), "source_id").select(*BY, F.col("target_id").alias("id")).distinct().join(nodes, "id").select(*BY, *nodes.columns)
    tests = reduce(DataFrame.unionByName, [in_files, hit, related]).where("type = 'test'").select(*BY, F.coalesce("file_path", "qualified_name").alias("test")).distinct()
    said = risk.migration_warnings(of_files, BY)

    path_flag = lambda hints: F.coalesce(F.bool_or(risk.path_has(F.col("path"), hints)), F.lit(False))
    ends = lambda which: F.bool_or(reduce(lambda a, b: a | b, [F.endswith("path", F.lit(e)) for e in which]))
    public, db = F.col("type").isin("api_endpoint", "service", "schema"), F.col("type").isin("database_table", "schema")
    exported = F.col("type").isin(*CODE_SYMBOLS) & ~F.startswith("name", F.lit("_"))
    shown = F.split(snippet(F.col("patch")), "\n", -1)
    marked = lambda sign: F.size(F.filter(shown, lambda x: F.startswith(x, F.lit(sign)) & ~F.startswith(x, F.lit(3 * sign)))).cast("string")
    within = F.col("patch").isNotNull() & (F.col("nth") <= FIRST_FILES)
    told = F.when(within & ((marked("+") != "0") | (marked("-") != "0")), F.concat("path", F.lit(": +"), marked("+"), F.lit("/-"), marked("-"), F.lit(" lines in available diff."))).otherwise(F.concat("path", F.lit(": no git diff available; using graph/source context.")))
    summary = ordered.join(of_files.select(*BY, "path", "patch"), [*BY, "path"], "left").select(*BY, "nth", told.alias("said"), F.col("patch").isNotNull().alias("has"))
    first_churn = ordered.where(F.col("nth") <= FIRST_FILES).join(churn.groupBy(*BY, "path").agg(F.sum("commits").alias("commits")), [*BY, "path"]).groupBy(*BY).agg(F.sum("commits").cast("int").alias("churn"))
    in_order = symbols.join(ordered.select(*BY, F.col("path").alias("file_path"), "place"), [*BY, "file_path"], "left")
    symbol = F.struct(F.coalesce("place", F.lit(10_000)).alias("place"), F.coalesce("line_start", F.lit(0)).alias("line"), "id", "qualified_name")
    entries = seeds.join(ordered.select(*BY, F.col("path").alias("file_path"), "place"), [*BY, "file_path"], "left")
    nth_seed = F.row_number().over(Window.partitionBy(*BY).orderBy(F.coalesce("place", F.lit(10_000)), F.coalesce("line_start", F.lit(0)), "id"))
    few = cut(entries.withColumn("k", nth_seed).where(F.col("k") <= FIRST_FLOWS).select(*BY, "k", "id", "qualified_name"))
    flows = few.join(lookups.flow_counts(few, edges), "id").groupBy(*BY).agg(F.array_sort(F.collect_list(F.struct("k", F.col("qualified_name").alias("entry"), "node_count", "edge_count"))).alias("impacted_flows"))
    hard = F.collect_set(F.when(F.col("severity") == "high", F.col("code")))
    items = lambda rows, name: _listed(rows, "item", name)
    whole = ordered.groupBy(*BY).agg(
        F.count("*").alias("files"), F.transform(F.array_sort(F.collect_list(F.struct("nth", "path"))), lambda x: x["path"]).alias("changed_files"), path_flag(risk.SECURITY).alias("security_path"), path_flag(risk.CONFIG).alias("config_path"),
        path_flag(risk.DATABASE).alias("database_path"), ends(CONFIG_ENDS).alias("_config"), F.bool_or(contains_any(F.lower("path"), ("auth", "token"))).alias("_auth"),
    )
    parts = [
        seeds.groupBy(*BY).agg(F.count("*").alias("nodes"), F.count_if(public).alias("public_nodes"), F.count_if(exported).alias("exported"), F.count_if(db).alias("database_nodes"), F.count_if(F.col("confidence_tier") == "ambiguous").alias("_seed_ambiguous"), F.bool_or(F.col("type") == "test").alias("_test")),
        hit.groupBy(*BY).agg(F.count("*").alias("impacted"), F.count_if(F.col("confidence_tier") == "ambiguous").alias("_hit_ambiguous")),
        tests.groupBy(*BY).agg(F.count("*").alias("tests")), touched.groupBy(*BY).agg(F.count("*").alias("changed_lines")), first_churn, flows,
        _listed(hit, "file_path", "impacted_files", LISTED), _listed(tests, "test", "affected_tests", LISTED),
        in_order.groupBy(*BY).agg(F.transform(F.array_sort(F.collect_list(symbol)), lambda x: x["qualified_name"]).alias("changed_symbols")),
        items(lookups.public_changes(ordered, symbols, BY), "public_api_changes"), items(lookups.config_changes(ordered, BY), "config_or_infra_changes"), items(lookups.database_changes(ordered, symbols, BY), "database_or_schema_changes"), items(lookups.security_changes(ordered, symbols, BY), "security_sensitive_changes"),
        said.groupBy(*BY).agg(F.array_sort(F.collect_list(F.struct("path", "code", "severity", "snippet"))).alias("migration_warnings"), hard.alias("high")),
        summary.groupBy(*BY).agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "said"))), lambda x: x["said"]).alias("diff_summary"), F.bool_or("has").alias("_diffs")),
    ]
    row = whole
    for p in parts:
        row = row.join(p, list(BY), "left")
    counts = ("nodes", "public_nodes", "exported", "database_nodes", "_seed_ambiguous", "impacted", "_hit_ambiguous", "tests", "changed_lines", "churn")
    lists = ("impacted_files", "affected_tests", "changed_symbols", "public_api_changes", "config_or_infra_changes", "database_or_schema_changes", "security_sensitive_changes")
    row = row.withColumns({c: F.coalesce(c, F.lit(0)) for c in counts} | {c: F.coalesce(c, F.array().cast("array<string>")) for c in lists})
    row = risk.score(row.withColumn("ambiguous", F.col("_seed_ambiguous") + F.col("_hit_ambiguous")))
    return _advice(row).drop("_seed_ambiguous", "_hit_ambiguous", "_test", "_config", "_auth", "_diffs", "high", *[flag for flag, _ in lookups.PRIORITIES])


def _advice(row: DataFrame) -> DataFrame:
    """Priorities, checklist, commands and warnings beside a review's lists."""
    some = lambda c: F.size(c) > 0
    flags = {"security": some("security_sensitive_changes"), "public_api": some("public_api_changes"), "database": some("database_or_schema_changes"), "config": some("config_or_infra_changes"), "impacted_area": some("impacted_files"), "untested": F.col("tests") == 0}
    asked = lookups.priorities(row.withColumns(flags)).withColumnRenamed("items", "prioritized_items")
    checks = F.array_compact(F.array(*map(F.lit, CHECKS), F.when(F.col("_config"), CHECK_CONFIG), F.when(F.col("_auth"), CHECK_AUTH), F.when(~F.coalesce("_test", F.lit(False)), CHECK_TESTS)))
    first = F.get("changed_files", F.lit(0))
    commands = F.array_compact(F.array(F.when(F.col("tests") > 0, RUN_TESTS), F.when(first.isNotNull(), F.concat(F.lit("explain "), first)), F.lit("explain <changed-file-or-symbol>"), F.lit("handoff")))
    warnings = F.array_compact(F.array(F.when((F.col("files") > 0) & ~F.coalesce("_diffs", F.lit(False)), NO_DIFF), F.when(F.col("files") == 0, NO_CHANGE)))
    missing = F.when(F.col("tests") == 0, F.array(F.lit(NO_TESTS))).otherwise(F.array().cast("array<string>"))
    return asked.withColumns({"checklist": checks, "commands": commands, "warnings": warnings, "missing_tests": missing})


def markdown(row: DataFrame) -> DataFrame:
    """(change, text) of reviews; ``row`` comes from ``review``."""
    empty = lambda text: F.array(F.lit(f"- {text}"))
    lines = lambda c, before="- ", after="": F.transform(c, lambda x: F.concat(F.lit(before), x, F.lit(after)))
    or_else = lambda c, none: F.when(F.size(c) > 0, lines(c, "- `", "`")).otherwise(empty(none))
    part = lambda title, body: F.concat(F.array(F.lit(""), F.lit(f"## {title}")), body)
    none = F.array().cast("array<string>")
    top = lambda c, kind: lines(F.slice(c, 1, 10), f"- {kind}: `", "`")
    areas = F.concat(top("public_api_changes", "Public/API"), top("config_or_infra_changes", "Config/infra"), top("database_or_schema_changes", "Database/schema"), top("security_sensitive_changes", "Security"))
    head = F.concat(F.lit("Risk: **"), "level", F.lit("** ("), F.col("risk").cast("string"), F.lit("/100)"))
    text = F.concat(
        F.array(F.lit("# Review"), F.lit(""), head), F.when(F.size("warnings") > 0, part("Warnings", lines("warnings"))).otherwise(none), part("Changed files", or_else("changed_files", "No changed files detected.")),
        part("Changed symbols", or_else("changed_symbols", "No changed symbols mapped from diff hunks.")), part("Diff summary", F.coalesce(lines("diff_summary"), empty("No diff summary available."))), part("Prioritized review items", lines("prioritized_items")),
        part("Sensitive areas", areas), part("Impacted files", or_else("impacted_files", "No impacted files detected.")), part("Risk explanation", lines("reasons")), part("Affected tests", or_else("affected_tests", "No directly affected tests found.")),
        part("Missing tests", F.when(F.size("missing_tests") > 0, lines("missing_tests")).otherwise(empty("No missing-test signal found."))), part("Review checklist", lines("checklist", "- [ ] ")), part("Suggested commands", lines("commands", "- `", "`")),
    )
    return row.select(*BY, F.array_join(text, "\n").alias("text"))
