"""Review risk: a score from signals of a change, path classes, and risky migration statements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.matching import matches
from codeloom.functions.text import contains_any

#: Parts of paths by what they say.
SECURITY = ("auth", "token", "secret", "password", "permission", "crypto")
CONFIG = (".env", "docker", "terraform", "kubernetes", "workflow", "settings", ".github")
DATABASE = ("schema", "migration", "sql", "database", "prisma", "alembic")
MIGRATION = ("migration", "migrations", "alembic", "versions/", "prisma/", "schema.prisma")
#: Code, pattern in Java's dialect, severity, message.
STATEMENTS = (
    ("drop_table", r"(?i)\bDROP\s+TABLE\b", "high", "DROP TABLE is destructive and irreversible without backup."),
    ("drop_column", r"(?i)\bDROP\s+COLUMN\b", "high", "DROP COLUMN removes data permanently; verify nothing reads the column."),
    ("alembic_drop_column", r"op\.drop_column\s*\(", "high", "Alembic op.drop_column is irreversible; provide a working downgrade or feature-flag the rollout."),
    ("alembic_drop_table", r"op\.drop_table\s*\(", "high", "Alembic op.drop_table is destructive; ensure all readers are removed first."),
    ("add_not_null_no_default", r"(?is)(?:ADD\s+COLUMN[^;]*?NOT\s+NULL)(?![^;]*\bDEFAULT\b)", "high", "Adding NOT NULL without DEFAULT will fail on populated tables; add DEFAULT or backfill first."),
    ("alter_column_type", r"(?i)\bALTER\s+COLUMN\b[^;]*\bTYPE\b", "high", "Type changes on populated columns can rewrite the table and lock writes."),
    ("rename_column", r"(?i)\b(?:RENAME\s+COLUMN|op\.alter_column[^;]*new_column_name)", "medium", "Renames break readers until they redeploy; do via expand/contract."),
    ("add_foreign_key", r"(?i)\bADD\s+CONSTRAINT\b[^;]*\bFOREIGN\s+KEY\b", "high", "Adding a FOREIGN KEY locks the referenced table; add NOT VALID then VALIDATE separately."),
)


def signals() -> tuple[str, ...]:
    """Columns that ``score`` reads, one row a change."""
    return ("files", "nodes", "impacted", "public_nodes", "exported", "security_path", "config_path", "database_path", "database_nodes", "changed_lines", "ambiguous", "churn", "tests")


#: The signal, the count above which it speaks, its points and its reason; of a signal only the first that speaks does.
TIERS = (
    ("files", 5, 15, "Change spans more than five files."),
    ("files", 1, 5, "Change spans multiple files."),
    ("nodes", 20, 15, "Large number of changed graph nodes."),
    ("nodes", 5, 8, "Multiple changed symbols detected."),
    ("impacted", 20, 20, "Broad blast radius through import/call dependents."),
    ("impacted", 5, 10, "Several dependent graph nodes may be impacted."),
    ("public_nodes", 0, 15, "Public API, service, or schema nodes changed."),
    ("exported", 0, 2, "Exported or public-looking symbols changed."),
    ("security_path", 0, 20, "Security-sensitive file path changed."),
    ("config_path", 0, 10, "Configuration or infrastructure file changed."),
    ("database_path", 0, 15, "Database or schema-related file changed."),
    ("database_nodes", 0, 15, "Database table or schema graph nodes changed."),
    ("changed_lines", 250, 15, "Large diff with more than 250 changed lines."),
    ("changed_lines", 80, 8, "Moderate-size diff with more than 80 changed lines."),
    ("ambiguous", 0, 8, "Some impacted dependencies are ambiguous parser facts."),
    ("churn", 5, 8, "Changed area has recent git churn."),
    ("untested", 0, 10, "No tests changed with this diff."),
)
#: Fixed value: exported symbols have their points each, up to this many in all.
EXPORTED_AT_MOST = 12
LOW = "Low graph-derived risk."


def parts() -> list[tuple[Column, Column]]:
    """Points and reason of each signal; no reason without points."""
    values = {"untested": (F.col("tests") == 0).cast("int")} | {s: F.col(s).cast("int") for s in ("security_path", "config_path", "database_path")}
    out = []
    for signal in dict.fromkeys(t[0] for t in TIERS):
        value = values.get(signal, F.col(signal))
        points, reason = F.lit(0), F.lit(None).cast("string")
        for _, above, worth, why in sorted((t for t in TIERS if t[0] == signal), key=lambda t: t[1]):
            got = F.least(F.lit(EXPORTED_AT_MOST), worth * value) if signal == "exported" else F.lit(worth)
            points, reason = F.when(value > above, got).otherwise(points), F.when(value > above, why).otherwise(reason)
        out.append((points, reason))
    return out


def score(changes: DataFrame) -> DataFrame:
    """``risk`` (0 to 100), ``level`` and ``reasons`` beside the signals."""
    found = parts()
    total = sum((points for points, _ in found), F.lit(0))
    reasons = F.filter(F.array(*[reason for _, reason in found]), lambda r: r.isNotNull())
    scored = changes.withColumn("risk", F.least(F.lit(100), total).cast("int"))
    return scored.withColumn("level", level(F.col("risk"))).withColumn("reasons", F.when(F.size(reasons) == 0, F.array(F.lit(LOW))).otherwise(reasons))


def level(risk: Column) -> Column:
    return F.when(risk >= 90, "critical").when(risk >= 70, "high").when(risk >= 35, "medium").otherwise("low")


def path_has(path: Column, hints: tuple[str, ...]) -> Column:
    return contains_any(F.lower(path), hints)


def is_migration(path: Column) -> Column:
    return path_has(path, MIGRATION) | F.endswith(F.lower(path), F.lit(".sql"))


def migration_warnings(patches: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(path, code, severity, snippet, message) beside the columns ``by``: risky statements among the added lines of migration files.

    ``patches`` has path and patch; the added lines of one file are one text, as statements span lines. All
    patterns read a text in its own row, in one scan.
    """
    lines = F.split(F.regexp_replace("patch", r"\r\n?", "\n"), "\n", -1)
    added = F.filter(lines, lambda x: F.startswith(x, F.lit("+")) & ~F.startswith(x, F.lit("+++")))
    texts = patches.where(is_migration(F.col("path"))).select(*by, "path", F.array_join(F.transform(added, lambda x: F.substr(x, F.lit(2))), "\n").alias("text"))

    def said(code: str, pattern: str, severity: str, message: str) -> Column:
        one = lambda x: F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), x.alias("snippet"), F.lit(message).alias("message"))
        # most texts hold no such statement, and a plain test is enough to know
        found = F.when(F.col("text").rlike(pattern), _match_lines(F.col("text"), pattern)).otherwise(F.array().cast("array<string>"))
        return F.transform(found, one)

    return texts.select(*by, "path", F.explode(F.flatten(F.array(*[said(*s) for s in STATEMENTS]))).alias("w")).select(*by, "path", "w.*").where("snippet is not null")


def _match_lines(text: Column, pattern: str) -> Column:
    """For each match the line in which it begins, trimmed."""
    numbered = F.struct(F.split(text, "\n", -1).alias("lines"), matches(text, pattern, 0).alias("found"))
    return F.flatten(F.transform(F.array(numbered), lambda n: F.transform(n["found"], lambda m: F.trim(F.get(n["lines"], m["line"] - 1)))))
