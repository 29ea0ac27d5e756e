"""Composite workflows: update, review, debug, context pack, explain and ask, memories, onboarding, hand-off, wiki.

Each composes the operators over a ``Catalog``; what comes back to the driver is capped by
the feature itself (top lists of a report).
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.ids import stable_hash
from codeloom.operators import chunking, context, embeddings, extract, graph, inference, lookups, memories, overview, reports, search, store, traces
from codeloom.operators import review as reviews
from codeloom.operators.checkpoints import cut
from codeloom.sources import scan

CODE_SYMBOLS = ("class", "function", "type")


def update(catalog: store.Catalog, root: str, include: tuple[str, ...] = (), force: bool = False, provider: embeddings.Provider | None = None) -> dict[str, int]:
    """Indexes new and changed files, marks vanished ones deleted, renews inferred edges; counts what was done."""
    spark = catalog.spark
    found = cut(scan.files(spark, root, include))
    known = catalog.read("files")
    changed = found if force else cut(scan.unindexed(found, known))
    gone = cut(known.where("not coalesce(is_deleted, false)").join(found, "path", "left_anti").select("path"))
    n_changed, n_gone = changed.count(), gone.count()
    counts = {"scanned": found.count(), "indexed": n_changed, "deleted": n_gone}
    counts["skipped"] = counts["scanned"] - n_changed
    if not n_changed and not n_gone:
        return counts
    facts = cut(extract.facts(changed))
    new_nodes = extract.nodes(facts)
    spans = chunking.materialized(chunking.symbols(changed.select("path", "content"), new_nodes)).withColumnRenamed("path", "file_path")
    kept = store.replace_files(catalog.read("nodes"), catalog.read("edges"), catalog.read("chunks"), changed.select("path").union(gone), {"nodes": new_nodes, "edges": extract.edges(facts), "chunks": spans})
    nodes = cut(kept["nodes"])
    extracted = kept["edges"].where("confidence_tier <> 'inferred'")
    edges = cut(extracted.unionByName(inferred_edges(nodes, extracted), allowMissingColumns=True))
    rows = changed.select("path", "language", "category", "size_bytes", "content_hash", "raw_hash", F.lit(False).alias("is_deleted"), "is_generated", "is_test")
    files = store.tombstone(store.upsert(known, rows, ["path"]), gone)
    chunks = cut(kept["chunks"])
    vectors, new = embeddings.upkeep(lookups.node_records(nodes).unionByName(lookups.chunk_records(chunks)), catalog.read("embeddings"), provider or embeddings.LocalHash())
    now = F.current_timestamp()
    said = store.provenance(new_nodes, extract.edges(facts), spans).withColumn("created_at", now)
    log = changed.select("path", F.lit("M").alias("status")).union(gone.select("path", F.lit("D"))).withColumn("changed_at", now)
    logged = log.select(F.concat(F.lit("change:"), stable_hash(F.col("path"), F.col("status"), F.col("changed_at"), length=24)).alias("id"), F.col("path").alias("file_path"), "status", "changed_at", F.lit('{"operation":"update"}').alias("metadata"))
    snapshot = spark.range(1).select(F.lit("snapshot:latest").alias("id"), F.lit("latest").alias("name"), F.lit((catalog.version() or 0) + 1).cast("long").alias("version"), now.alias("created_at"))
    new = cut(new)
    counts["embedded"] = new.count()
    catalog.commit(
        {"files": files, "nodes": nodes, "edges": edges, "chunks": chunks, "embeddings": cut(vectors), "provenance": cut(store.merge_provenance(catalog.read("provenance"), said)), "changes": cut(catalog.read("changes").unionByName(logged)), "snapshots": store.upsert(catalog.read("snapshots"), snapshot, ["id"])}
    )
    return counts


def inferred_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges that follow from names: tests of subjects, and imports of local modules."""
    named = nodes.select("id", "qualified_name", "file_path", "name")
    imports = edges.where("type = 'imports'").select("source_id", "target_id").join(named.select(F.col("id").alias("source_id"), F.col("file_path").alias("source_file")), "source_id").join(named.select(F.col("id").alias("target_id"), F.col("name").alias("imported")), "target_id")
    local = inference.import_edges(imports, nodes.where("type = 'module' and file_path is not null").select("id", "qualified_name"))
    both = inference.test_edges(nodes.select("id", "type", "name", "file_path")).select("id", "source_id", "target_id", "type", "file_path", F.lit("test-convention").alias("provenance_source"))
    both = both.unionByName(local.select("id", "source_id", "target_id", "type", F.lit(None).cast("string").alias("file_path"), F.lit("local-import-resolver").alias("provenance_source")))
    return both.select("*", F.lit("inferred").alias("confidence_tier"), F.lit(0.7).alias("confidence"), F.lit(None).cast("int").alias("line"), F.lit(None).cast("string").alias("metadata")).dropDuplicates(["id"])


def review(catalog: store.Catalog, root: str, base: str | None = None, staged: bool = False, files: tuple[str, ...] = ()) -> DataFrame:
    """One row about a diff, or about ``files`` alone; see ``reviews.review``."""
    spark = catalog.spark
    found = scan.changed_files(spark, root, base, staged)
    if files:
        found = lookups.selected_changes(spark.createDataFrame([(f.removeprefix("./"),) for f in files], "path string"), found)
    paths = sorted({r.path for r in found.collect()})  # of one diff
    listed = spark.createDataFrame([(0, p, k) for k, p in enumerate(paths)], "change long, path string, place int")
    # the history of each of the first files by itself, as a commit counts for every file it touches
    touched = [(0, p, len(scan.git(root, "log", "--since=90.days", "--format=%h", "--", p).split())) for p in paths[: reviews.FIRST_FILES]]
    churn = spark.createDataFrame(touched, "change long, path string, commits int")
    kept = F.filter(F.split("patch", "\n(?=diff --git )"), lambda p: F.contains(p, F.lit("+++ ")))
    texts = scan.patches(spark, root, base, staged).select(F.explode(kept).alias("patch"))
    new, old = (F.regexp_extract("patch", rf"(?m)^{mark} (?:[ab]/)?(.+)$", 1) for mark in (r"\+\+\+", "---"))
    patches = texts.select(F.lit(0).cast("long").alias("change"), F.when(new == "/dev/null", old).otherwise(new).alias("path"), "patch").join(listed.select("path"), "path", "left_semi")
    return reviews.review(listed, patches, churn, catalog.read("nodes"), catalog.read("edges"))


def write_review(catalog: store.Catalog, row: DataFrame) -> None:
    """Stores a review as the report ``review``: its text, and all of it as JSON."""
    row = cut(row)
    told = reviews.markdown(row).join(row.select("change", F.to_json(F.struct("*")).alias("payload")), "change")
    reports.write_report(told, "review", catalog.root)


#: What a pack says it is for, and what to do next, by task.
INTENTS = {
    "review": "Assess changed files, impacted symbols, risk signals, and test coverage gaps.",
    "debug": "Map symptoms or stack frames to likely entry points, callers, callees, tests, and configs.",
    "explain": "Explain the requested file, symbol, or subsystem from parser facts and graph context.",
    "ask": "Answer a project question using graph facts, chunks, docs, configs, and memories.",
    "onboard": "Prioritize read-first files, major symbols, architecture layers, and glossary terms.",
    "refactor": "Identify dependent symbols, callers, tests, and risk before changing structure.",
    "handoff": "Preserve current project status, decisions, changed areas, and next-agent instructions.",
}
OTHER_INTENT = "Provide graph-grounded context for the requested task."
ACTIONS = {
    "review": ("- Run the related tests listed above.", "- Inspect changed public APIs and configs."),
    "debug": ("- Start from suspected entry points.", "- Check callers, configs, and recent changes."),
    "onboard": ("- Read the listed files first.", "- Ask follow-up questions by subsystem."),
    "handoff": ("- Start with the status.", "- Run a review before editing."),
}
OTHER_ACTION = ("- Explain a symbol or file for a narrower context pack.",)
DOCS = ("document", "section", "config", "resource", "pipeline")


@dataclass
class Request:
    """What a context pack is about."""

    task: str
    query: str = ""
    seed_files: tuple[str, ...] = ()
    seed_nodes: tuple[str, ...] = ()
    budget: str = "normal"
    snippets: dict[str, str] = field(default_factory=dict)


def seed_nodes(nodes: DataFrame, stored: DataFrame, request: Request, provider: embeddings.Provider) -> DataFrame:
    """Nodes a request starts from, each once, in order: those named, those of its files, those its words find, and those whose vectors are near."""
    ranked = lambda df, *by: df.withColumn("place", F.row_number().over(Window.orderBy(*by)).cast("int") - 1)  # noqa: E731  short lists
    columns = nodes.columns
    none = nodes.limit(0).withColumn("place", F.lit(0))
    asked = F.array_position(F.array(*map(F.lit, request.seed_nodes)).cast("array<string>"), F.col("id"))
    named = nodes.where(F.col("id").isin(*request.seed_nodes)).withColumn("place", asked.cast("int")) if request.seed_nodes else none
    in_files = ranked(nodes.where(F.col("file_path").isin(*request.seed_files)), "file_path", "line_start", "id") if request.seed_files else none
    if not request.query.strip():
        return context.ordered_union(named, in_files)
    found = ranked(search.find_nodes(nodes, request.query, limit=12), "source", "id").select(*columns, "place")
    near = embeddings.semantic(stored, request.query, 8, provider, ("node",)).select(F.col("entity_id").alias("id"), "score")
    close = ranked(nodes.join(near, "id"), F.desc("score"), "id").select(*columns, "place")
    return context.ordered_union(named.select(*columns, "place"), in_files.select(*columns, "place"), found, close)


def pack_lines(catalog: store.Catalog, request: Request, provider: embeddings.Provider | None = None) -> DataFrame:
    """(request, section, place, text): the lines of a pack, section by section, before any budget. Every section is a short list."""
    spark, provider = catalog.spark, provider or embeddings.LocalHash()
    nodes, edges, stored = catalog.read("nodes").select("id", "type", "name", "qualified_name", "file_path", "line_start", "line_end", "confidence_tier"), catalog.read("edges"), catalog.read("embeddings")
    seeds = cut(seed_nodes(nodes, stored, request, provider))
    near, links = graph.neighbourhood(seeds.select("id"), edges, nodes)
    around = cut(search.rank_nodes(near.drop("hop"), request.query).withColumn("place", F.row_number().over(Window.orderBy(F.desc("inside"), F.desc("extracted"), F.desc("qualified_name"), "id"))).where("place <= 80"))
    close = cut(embeddings.semantic(stored, request.query, 8, provider).select("entity_id", "entity_type", "file_path", "score"))
    paths = lookups.files_of(around, close).limit(8)
    chunks = lookups.first_chunks(catalog.read("chunks").join(F.broadcast(paths), "file_path", "left_semi"), 1)
    remembered = search.relevant_memories(catalog.read("memories").withColumnRenamed("created_at", "created"), request.query, 6)
    flows = links.orderBy("id").limit(20).alias("e").join(nodes.select(F.col("id").alias("source_id"), F.col("qualified_name").alias("s")), "source_id").join(nodes.select(F.col("id").alias("target_id"), F.col("qualified_name").alias("t")), "target_id")

    shown = F.concat(F.lit("- `"), "qualified_name", F.lit("` ("), "type", F.lit(", "), "confidence_tier", F.lit(")"))
    fact = F.concat(F.lit("- `"), "qualified_name", F.lit("` is a `"), "type", F.lit("` from `"), "file_path", F.lit("`."))
    unsure = F.concat(F.lit("- `"), "qualified_name", F.lit("` has confidence tier `"), "confidence_tier", F.lit("`."))
    number = lambda c, none: F.coalesce(F.col(c).cast("string"), F.lit(none))
    symbol = F.concat(F.lit("- Symbol: `"), "qualified_name", F.lit("` ("), "type", F.lit(", lines "), number("line_start", "None"), F.lit("-"), number("line_end", "None"), F.lit(")"))
    excerpt = F.concat(F.lit("### `"), "file_path", F.lit("` lines "), number("line_start", "1"), F.lit("-"), number("line_end", "?"), F.lit(" ("), "kind", F.lit(")\n```\n"), F.left("content", F.lit(2500)), F.lit("\n```"))
    told = F.concat(F.lit("- `"), "id", F.lit("` ("), "kind", F.lit("): "), F.left("content", F.lit(240)))
    match = F.concat(F.lit("- `"), "entity_id", F.lit("` ("), "entity_type", F.lit(", "), F.format_number("score", 2), F.lit(") from `"), F.coalesce("file_path", F.lit("graph")), F.lit("`"))
    flow = F.concat(F.lit("- `"), "s", F.lit("` --"), "type", F.lit("--> `"), "t", F.lit("` (source: `"), F.coalesce("provenance_source", F.lit("unknown")), F.lit("`)"))
    totals = around.agg(F.count("*").alias("n"), F.count_distinct("file_path").alias("files"))
    basis = F.when(F.col("n") == 0, F.lit(f"No graph nodes matched `{request.query}`.")).otherwise(F.concat(F.lit("Found "), F.col("n").cast("string"), F.lit(" relevant graph nodes across "), F.col("files").cast("string"), F.lit(f" files for `{request.query or request.task}`.")))
    plain = lambda lines: spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "place long, text string")
    top = lambda df, text, limit, by="place": df.withColumn("place", F.row_number().over(Window.orderBy(by)).cast("long")).where(F.col("place") <= limit).select("place", text.alias("text"))
    given = [f"- File: `{p}`" for p in request.seed_files[:20]]
    diffs_ = [f"### `{p}`\n```diff\n{t[:3000]}\n```" for p, t in list(request.snippets.items())[:8]]
    sections = (
        ("Task", plain([request.task]), ""), ("Intent", plain([INTENTS.get(request.task, OTHER_INTENT)]), ""), ("Direct answer basis", totals.select(F.lit(0).cast("long").alias("place"), basis.alias("text")), ""),
        ("High-confidence parser facts", top(around.where("confidence_tier = 'extracted' and file_path is not null"), fact, 20), "- No high-confidence parser facts matched the request."),
        ("Changed files and symbols", plain(given).union(top(around.where(F.col("id").isin(*request.seed_nodes) if request.seed_nodes else F.lit(False)), symbol, 20).withColumn("place", F.col("place") + 1000)), "- No changed files or explicit seed symbols were provided."),
        ("Impacted graph area", top(around, shown, 30), ""), ("Graph paths", top(flows, flow, 20, "id"), "- No graph paths found for the current seed nodes."), ("Changed code snippets", plain(diffs_), "No diff snippets were provided to this context pack."),
        ("Relevant source excerpts", top(chunks, excerpt, 8, "file_path"), "- No focused source chunks were selected."), ("Relevant tests", top(around.where("type = 'test'"), F.concat(F.lit("- `"), "qualified_name", F.lit("`")), 20), "- No directly related tests were found."),
        ("Relevant docs/config/infra", top(around.where(F.col("type").isin(*DOCS)), shown, 20), ""), ("Memories / decisions", top(remembered, told, 6, "created"), "- No user-approved project memories matched this request."),
        ("Semantic matches", top(close, match, 8, F.desc("score")), "- No local embedding matches were available."), ("Risks / uncertainty", top(around.where("confidence_tier <> 'extracted'"), unsure, 20), "- No non-extracted facts are required for this context pack."),
        ("Recommended next actions", plain(ACTIONS.get(request.task, OTHER_ACTION)), ""),
    )
    made = [plain(["# Context pack"]).withColumn("section", F.lit(-1))]
    for k, (title, rows, none) in enumerate(sections):
        rows = rows.unionByName(plain([none]).withColumn("place", F.lit(1 << 40))).where("text <> ''") if none else rows
        made.append(rows.withColumns({"section": F.lit(k), "_first": F.min("place").over(Window.partitionBy(F.lit(k)))}).where((F.col("place") < 1 << 40) | (F.col("_first") == 1 << 40)).drop("_first"))
        made.append(plain(["", f"## {title}"]).withColumns({"section": F.lit(k), "place": F.col("place") - 2}))
    return reduce(DataFrame.unionByName, made).select(F.lit(0).alias("request"), "section", "place", "text")


def pack(catalog: store.Catalog, request: Request, provider: embeddings.Provider | None = None) -> str:
    """A text of ranked facts around the seeds; the plan keeps what the token budget holds."""
    kept = context.fitted(pack_lines(catalog, request, provider), request.budget)
    return "\n".join(r.text for r in kept.orderBy("section", "place", "text").collect())  # as long as the budget


def explain(catalog: store.Catalog, target: str, budget: str = "normal") -> str:
    """A pack about a file or symbol; what has a slash, or a dot in its last part, is a file."""
    is_file = "/" in target or "\\" in target or "." in target.rsplit("/", 1)[-1]
    return pack(catalog, Request("explain", target, seed_files=(target,) if is_file else (), budget=budget))


def ask(catalog: store.Catalog, question: str, budget: str = "normal") -> str:
    return pack(catalog, Request("ask", question, budget=budget))


@dataclass
class Debugged:
    """What an issue points at: its frames and error, nodes by frame, what lies around them, steps in order, and a pack."""

    frames: DataFrame
    error: DataFrame
    around: DataFrame
    steps: list[str]
    pack: str


def debug(catalog: store.Catalog, issue: str, budget: str = "normal") -> Debugged:
    """Reads a stack trace, maps its frames to nodes, and lists the tests and configurations around them."""
    spark, nodes, edges = catalog.spark, catalog.read("nodes"), catalog.read("edges")
    issues = spark.createDataFrame([(0, issue)], "id long, issue string")
    frames = cut(traces.frames(issues))
    suspects = cut(traces.suspects(frames, nodes))
    around = cut(context.debug_order(suspects, edges, nodes).join(nodes.select("id", "qualified_name", "file_path"), "id"))
    configs = lookups.related_configs(catalog.read("files"), frames.select(F.col("file_path").alias("id")))
    first = frames.orderBy("place").limit(1).collect()
    named = around.where("kind = 'suspect'").orderBy("rank", "id").limit(12).collect()
    steps = [f"Open {r.file_path} at line {r.line}." for r in first] + [f"Inspect mapped graph node {r.qualified_name}." for r in named[:1]]
    steps.append("Walk callers and callees from the graph paths before broad searching.")
    if not configs.isEmpty():
        steps.append("Check related config files for environment or routing changes.")
    steps.append("Run or add the nearest tests around the suspected node.")
    files = tuple(dict.fromkeys(r.file_path for r in frames.orderBy("place").limit(20).collect()))
    text = pack(catalog, Request("debug", issue.strip().split("\n")[-1][:200], seed_files=files, seed_nodes=tuple(r.id for r in named), budget=budget))
    return Debugged(frames, traces.errors(issues), around, steps, text)


#: Sections of an onboarding text that say the same for every project.
LAYERS = (
    "- Code modules and files are represented as `module`, `class`, `function`, and `test` nodes.",
    "- Documentation is represented as `document` and `section` nodes.",
    "- Config and infra artifacts are represented as `config`, `pipeline`, and `resource` nodes.",
)
GLOSSARY = ("- extracted: deterministic parser result.", "- inferred: deterministic indirect inference.", "- ambiguous: uncertain result needing review.")
TOUR = ("1. Start with the README and top-level config files.", "2. Inspect high-degree modules from the key symbols list.", "3. Explain the entry point of each subsystem.", "4. Run a review before changing public APIs or configs.")
QUESTIONS = ("- How is the project organized?", "- Which files should I read before editing authentication or persistence?", "- What tests cover the module I am changing?")


def onboarding(catalog: store.Catalog) -> str:
    """Status, languages, files and symbols to read first, and how to go on; every list is a top list."""
    nodes, edges, files = catalog.read("nodes"), catalog.read("edges"), catalog.read("files")
    counts = overview.status(files=files, nodes=nodes, edges=edges).first()
    listed = [f"- `{r.file_path}`" for r in overview.important_files(nodes).collect()]
    symbols = graph.degrees(nodes.where(F.col("type").isin(*overview.SYMBOL_TYPES)), edges).orderBy(F.desc("degree"), "id").limit(overview.IMPORTANT_SYMBOLS).collect()
    known = overview.languages(files).orderBy(F.desc("files"), "language").collect()
    sections = {
        "Project overview": [f"- Files indexed: {counts.files}", f"- Nodes: {counts.nodes}", f"- Edges: {counts.edges}"], "Language summary": [f"- {r.language}: {r.files}" for r in known], "Architecture layers": LAYERS, "Important files": listed,
        "Read these files first": listed[:8], "Key symbols": [f"- `{r.qualified_name}`" for r in symbols[:20]], "Glossary": GLOSSARY, "Guided tour": TOUR, "Suggested questions": QUESTIONS,
    }
    return "\n".join(["# Onboarding", *(x for title, rows in sections.items() for x in ("", f"## {title}", *rows))])


def handoff(catalog: store.Catalog, root: str, limit: int = 20) -> tuple[str, DataFrame]:
    """(text, one row of all that it says): changed files and symbols, commits, memories by kind, open notes, status, latest review; recorded as a session."""
    spark = catalog.spark
    nodes, remembered = catalog.read("nodes"), catalog.read("memories")
    changes = scan.changed_files(spark, root).select("path").distinct().orderBy("path")
    symbols = nodes.join(changes.withColumnRenamed("path", "file_path"), "file_path", "left_semi").where("type not in ('file', 'module')").orderBy("file_path", F.coalesce("line_start", F.lit(0)), "id").limit(30)
    latest = reports.latest_report(spark, catalog.root, "review")
    review_of = latest.select(F.get_json_object("payload", "$.level").alias("level"), F.get_json_object("payload", "$.risk").cast("int").alias("risk"), F.from_json(F.get_json_object("payload", "$.impacted_files"), "array<string>").alias("impacted"))
    if latest.isEmpty() and not changes.isEmpty():
        review_of = review(catalog, root).select("level", "risk", F.col("impacted_files").alias("impacted"))
    told = review_of.collect()
    commits = scan.commits(spark, root).orderBy(F.desc("ts"), "commit").collect()
    notes = todo(scan.files(spark, root).select("path", "content")).limit(25).collect()
    kept = memories.listed(remembered).collect()
    counts = {name: catalog.read(name).count() for name in ("files", "nodes", "edges")}
    of = lambda kinds: [f"- {m.content}" for m in kept if m.kind in kinds]
    sections = {
        "Changed files": ([f"- `{r.path}`" for r in changes.collect()], "No changed files detected."),
        "Changed symbols": ([f"- `{r.qualified_name}` ({r.type}, `{r.file_path}`:{r.line_start})" for r in symbols.collect()], "No changed symbols detected."),
        "Impacted files": ([f"- `{p}`" for r in told for p in (r.impacted or [])[:30]], "No impacted files detected."),
        "Recent commits": ([f"- {c.commit} {c.subject}" for c in commits], "No git commits detected."),
        "Recent sessions": ([f"- {x.kind}: {x.title}" for x in memories.recent_sessions(catalog.read("sessions")).collect()], "No sessions recorded."),
        "Recent changes": ([f"- {c.status} `{c.file_path}`" for c in lookups.newest(catalog.read("changes"), "changed_at", limit).collect()], "No changes recorded."),
        "Project memories": ([f"- `{m.id}` [{m.kind}] {m.content}" for m in kept], "No project memories recorded."),
        "Accepted decisions": (of(memories.DECISIONS), "No accepted decisions recorded."),
        "Rejected attempts": (of(memories.REJECTED), "No rejected attempts recorded."),
        "Open tasks": (of(memories.TASKS), "No open tasks recorded."),
        "TODO/FIXME scan": ([f"- `{n.path}`:{n.line} {n.text}" for n in notes], "No TODO/FIXME items found."),
        "Latest review": ([f"- {r.level} ({r.risk}/100)" for r in told], "No review recorded."),
        "Graph status": ([f"- {name.capitalize()}: {n}" for name, n in counts.items()], ""),
    }
    head = ["# Hand-off", "", f"Branch: `{scan.branch(root)}`"]
    text = "\n".join([*head, *(x for title, (rows, none) in sections.items() for x in ("", f"## {title}", *(rows or [f"- {none}"])))])
    payload = spark.createDataFrame([(text, json.dumps({title: rows for title, (rows, _) in sections.items()}))], "text string, payload string")
    reports.write_report(payload, "handoff", catalog.root)
    now = spark.createDataFrame([("handoff", "Session handoff", "Generated handoff context.")], "kind string, title string, summary string").withColumn("created_at", F.current_timestamp())
    catalog.append("sessions", memories.session_rows(now))
    return text, payload


#: What marks an open note.
NOTES = ("TODO", "FIXME")


def todo(files: DataFrame, limit: int = 100, marks: tuple[str, ...] = NOTES) -> DataFrame:
    """(path, line, text) of the first lines with open notes, by path and line."""
    lines = files.select("path", F.posexplode(F.split("content", "\n", -1)).alias("k", "t"))
    hit = lines.where(F.upper("t").rlike("|".join(marks)))
    return hit.select("path", (F.col("k") + 1).alias("line"), F.left(F.trim("t"), F.lit(240)).alias("text")).orderBy("path", "line").limit(limit)


def remember(catalog: store.Catalog, kind: str, content: str) -> str:
    """Stores a memory without secrets; returns its id."""
    new = cut(memories.remembered(catalog.spark.createDataFrame([(kind, content)], "kind string, content string").withColumn("created_at", F.current_timestamp())))
    catalog.commit({"memories": catalog.read("memories").unionByName(new.select(*catalog.read("memories").columns))})
    return new.first().id


def forget(catalog: store.Catalog, memory: str) -> bool:
    """Whether a memory of this id was there; it no longer is."""
    known = catalog.read("memories")
    if known.where(F.col("id") == memory).isEmpty():
        return False
    catalog.commit({"memories": memories.forget(known, catalog.spark.createDataFrame([(memory,)], "id string"))})
    return True


def ingest(catalog: store.Catalog, root: str) -> dict[str, int]:
    """Indexes every file under a folder anew, whatever is known of it."""
    return update(catalog, root, force=True)


def wiki(catalog: store.Catalog, path: str) -> None:
    files = catalog.read("files")
    pages = reports.wiki_pages(files, catalog.read("nodes"), catalog.read("edges"), catalog.read("memories"), reports.latest_report(catalog.spark, catalog.root, "review"))
    reports.write_wiki(pages.unionByName(reports.index_pages(files)), path)


def doctor(catalog: store.Catalog) -> DataFrame:
    """(check, ok) of a catalog: it has a version and nodes, both ends of edges are nodes, vectors belong to entities, chunks to files."""
    nodes, edges, chunks = catalog.read("nodes"), catalog.read("edges"), catalog.read("chunks")
    ends = edges.select(F.explode(F.array("source_id", "target_id")).alias("id"))
    entities = nodes.select(F.col("id").alias("entity_id")).union(chunks.select("id"))
    checks = [
        ("has a version", catalog.version() is not None), ("has nodes", not nodes.isEmpty()), ("edges start and end at nodes", ends.join(nodes.select("id"), "id", "left_anti").isEmpty()),
        ("vectors belong to nodes or chunks", catalog.read("embeddings").join(entities, "entity_id", "left_anti").isEmpty()), ("chunks belong to files", chunks.join(catalog.read("files").select(F.col("path").alias("file_path")), "file_path", "left_anti").isEmpty()),
    ]
    return catalog.spark.createDataFrame(checks, "check string, ok boolean")
