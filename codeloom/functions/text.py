"""Lines, redaction, token estimates and slugs as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that mark a line as secret-like.
SECRET_KEY_HINTS = ("api_key", "apikey", "secret", "token", "password", "passwd", "credential", "private_key", "access_key", "refresh_token")
#: Token budgets by name.
BUDGETS = {"tiny": 700, "normal": 4000, "deep": 12000, "full": 1_000_000}
TRIM_MARK = "\n\n[trimmed to token budget]"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"


def contains_any(text: Column, hints: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for hint in hints:
        found = found | F.contains(text, F.lit(hint))
    return found


def lines(text: Column) -> Column:
    """The lines of a text; an end of line at its end starts no further line."""
    whole = F.regexp_replace(text, LINE_END, "\n")
    return F.when(F.length(whole) == 0, F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(whole, r"\n\z", ""), "\n", -1))


def redact_line(x: Column, placeholder: str = "<redacted secret-like line>") -> Column:
    """A secret-like line keeps its key only."""
    kept = lambda mark: F.trim(F.substring_index(x, mark, 1))
    hidden = F.when(F.contains(x, F.lit("=")), F.concat(kept("="), F.lit("=<redacted>"))).when(F.contains(x, F.lit(":")), F.concat(kept(":"), F.lit(": <redacted>"))).otherwise(F.lit(placeholder))
    return F.when(contains_any(F.lower(x), SECRET_KEY_HINTS), hidden).otherwise(x)


def redact_lines(text: Column, split: Column) -> Column:
    """The lines ``split`` of a text, redacted; those of a text without any hint of a secret stay as they are, after one test of the whole."""
    return F.when(contains_any(F.lower(text), SECRET_KEY_HINTS), F.transform(split, lambda x: redact_line(x))).otherwise(split)


def redact(text: Column, placeholder: str = "<redacted secret-like line>") -> Column:
    """Secret-like lines keep their key only; lines end with a line feed, and the last has no end."""
    plain = F.regexp_replace(F.regexp_replace(text, LINE_END, "\n"), r"\n\z", "")
    return F.when(contains_any(F.lower(text), SECRET_KEY_HINTS), F.array_join(F.transform(lines(text), lambda x: redact_line(x, placeholder)), "\n")).otherwise(plain)


def estimate_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4).cast("int"))


def trim_to_budget(text: Column, budget: str | int) -> Column:
    """A text of more tokens than the budget is cut and marked; the full budget cuts nothing."""
    n = BUDGETS.get(budget, BUDGETS["normal"]) if isinstance(budget, str) else budget
    if n >= BUDGETS["full"]:
        return text
    cut = F.concat(F.regexp_replace(F.left(text, F.lit(max(256, 4 * n))), r"\s+\z", ""), F.lit(TRIM_MARK))
    return F.when(estimate_tokens(text) <= n, text).otherwise(cut)


def slug(text: Column) -> Column:
    made = F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.when(made == "", F.lit("section")).otherwise(made)


def safe_filename(text: Column, length: int = 120) -> Column:
    return F.left(F.regexp_replace(text, r"[^\p{L}\p{N}_-]", "_"), F.lit(length))


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits: the search tokenizer."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+", -1), "")
