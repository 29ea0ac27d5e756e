"""Chat records of many layouts, brought to canonical turns by the fingerprint of their schema.

A record is a JSON text. Its layout is the set of its nested field paths (array places are
all one), and a hash of the sorted paths is its fingerprint. A registry maps fingerprints to
declarative mappings: which list holds the turns and under which names their role and text
stand, or which fields give which role. Records of layouts that nobody has declared go to
``unknown`` instead of being guessed.

The template puts each turn between markers. Control strings that stand inside texts or
roles, the template's own and those of other common templates, are broken by a backslash
after their first character, and backslashes are doubled, which ``unescape`` takes back.

Defined cases: a null or missing text is empty, a null role is empty; turns are ordered by
(turn, role, text), so ties and repeated rows have one order and each counts; a null
conversation id is a conversation of its own; an empty table gives an empty table; only the
named columns are read. A conversation's turns come together in one task, as its output is
one text.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import small_batches

START, MIDDLE, END = "<|im_start|>", "\n", "<|im_end|>\n"
BROKEN = "\\" + MIDDLE  # a role's own line break
#: Control strings of common chat templates.
CONTROL = ("<|im_start|>", "<|im_end|>", "<|im_sep|>", "<|endoftext|>", "<|begin_of_text|>", "<|end_of_text|>", "<|eot_id|>", "<|start_header_id|>", "<|end_header_id|>", "<|system|>", "<|user|>", "<|assistant|>", "<|end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<start_of_turn>", "<end_of_turn>")

_BREAK = re.compile("|".join(f"(?<={re.escape(c[0])})(?={re.escape(c[1:])})" for c in CONTROL) + r"|(?=\\)")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(re.escape(START) + r"((?:\\.|[^\\\n])*)" + re.escape(MIDDLE) + r"(.*?)" + re.escape(END), re.DOTALL)


def escape(text: str) -> str:
    return _BREAK.sub(r"\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


@dataclass(frozen=True)
class Mapping:
    """How one layout becomes turns: fields for fixed roles, in order, and a list of turns."""

    name: str
    fields: tuple[tuple[str, str], ...] = ()
    turns: str | None = None
    role: str | None = None
    text: str | None = None
    foreign: bool = False  # roles may go by other names

    def paths(self) -> list[str]:
        nested = [self.turns, f"{self.turns}[]", f"{self.turns}[].{self.role}", f"{self.turns}[].{self.text}"] if self.turns else []
        return sorted({f for _, f in self.fields} | set(nested))

    def read(self, record: dict) -> list[tuple[str, str]]:
        out = [(role, _text(record.get(f))) for role, f in self.fields if f in record]
        for t in (record.get(self.turns) or []) if self.turns else []:
            role = _text(t.get(self.role))
            out.append((ROLES.get(role, role) if self.foreign else role, _text(t.get(self.text))))
        return out

    def fits(self, record: object) -> bool:
        """Whether the record is an object whose turns, if it has any, are a list of objects."""
        turns = record.get(self.turns) if isinstance(record, dict) and self.turns else []
        return isinstance(record, dict) and (turns is None or isinstance(turns, list) and all(isinstance(t, dict) for t in turns))


#: Other names of the canonical roles.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def _text(value: object) -> str:
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def paths_of(value: object, at: str = "") -> set[str]:
    """Nested field paths of a JSON value; all places of an array are one path."""
    if isinstance(value, dict):
        return set().union(*({p} | paths_of(v, p) for k, v in value.items() for p in [f"{at}.{k}" if at else k]))
    if isinstance(value, list):
        return {f"{at}[]"} | set().union(*(paths_of(v, f"{at}[]") for v in value)) if value else set()
    return set()


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


MAPPINGS = (
    Mapping("messages", turns="messages", role="role", text="content"),
    Mapping("share", turns="conversations", role="from", text="value", foreign=True),
    Mapping("turns", turns="turns", role="speaker", text="text", foreign=True),
    Mapping("prompt", fields=(("user", "prompt"), ("assistant", "response"))),
    Mapping("completion", fields=(("user", "prompt"), ("assistant", "completion"))),
    Mapping("system prompt", fields=(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Mapping("instruction", fields=(("user", "instruction"), ("assistant", "output"))),
    Mapping("instruction with input", fields=(("system", "instruction"), ("user", "input"), ("assistant", "output"))),
    Mapping("question", fields=(("user", "question"), ("assistant", "answer"))),
)


def registry(mappings: tuple[Mapping, ...] = MAPPINGS) -> dict[str, Mapping]:
    """Mappings by fingerprint; a list of no turns has no nested paths."""
    out = {fingerprint(m.paths()): m for m in mappings}
    return out | {fingerprint([m.turns]): m for m in mappings if m.turns and not m.fields}


def template(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text and the spans of it that count for the loss: what the assistant says."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape(role).replace(MIDDLE, BROKEN)}{MIDDLE}", escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        out += (head, body, END)
        at += len(head) + len(body) + len(END)
    return "".join(out), spans


def read_back(formatted: str) -> list[tuple[str, str]]:
    return [(unescape(role), unescape(body)) for role, body in _TURN.findall(formatted)]


def format_records(records: DataFrame, record: str = "record", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """(id, layout, fingerprint, formatted, spans) of each (id, record); unknown layouts have no text."""
    small_batches(records.sparkSession)
    by_print = registry(mappings)
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text in b.column(1).to_pylist():
                try:
                    value = json.loads(text or "")
                except ValueError:
                    value = None
                mark = fingerprint(paths_of(value))
                mapping = by_print.get(mark)
                mapping = mapping if mapping and mapping.fits(value) else None
                formatted, spans = template(mapping.read(value)) if mapping else (None, None)
                rows.append((mapping.name if mapping else "unknown", mark, formatted, spans and [{"start": s, "end": e} for s, e in spans]))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.string(), span), strict=True))], ["id", "layout", "fingerprint", "formatted", "spans"])

    picked = records.select(F.col("id"), F.col(record))
    return picked.mapInArrow(work, f"id {picked.schema['id'].dataType.simpleString()}, layout string, fingerprint string, formatted string, spans array<struct<start:long,end:long>>")


def records_of(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(id, record): a JSON record for each conversation, in one of the declared layouts.

    A hash of the id deals conversations out over the layouts that can hold their roles as they are: those of a user
    and an assistant turn over five, those of a system, a user and an assistant turn over two, and others over the
    lists of turns. A role that a foreign layout would rename stays in a list of messages.
    """
    said = turns.select(F.col(conv_id).alias("id"), F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("content")).alias("t"))
    talks = said.groupBy("id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    roles: Column = F.transform("ts", lambda t: t["role"])
    are = lambda *names: roles == F.array(*[F.lit(n) for n in names])
    content: Column = F.transform("ts", lambda t: t["content"])
    fields = lambda *names: F.to_json(F.struct(*[F.get(content, k).alias(n) for k, n in enumerate(names)]))
    listed = lambda name, role, text: F.to_json(F.struct(F.transform("ts", lambda t: F.struct(t["role"].alias(role), t["content"].alias(text))).alias(name)))
    turn_of = lambda n: F.pmod(F.xxhash64("id"), F.lit(n))
    messages = listed("messages", "role", "content")
    two = [("prompt", "response"), ("prompt", "completion"), ("instruction", "output"), ("question", "answer")]
    record = F.when(are("system", "user", "assistant"), F.when(turn_of(2) == 0, fields("system", "prompt", "response")).otherwise(fields("instruction", "input", "output")))
    for k, names in enumerate(two):
        record = record.when(are("user", "assistant") & (turn_of(5) == k), fields(*names))
    foreign = F.exists(roles, lambda r: r.isin(*ROLES))
    record = record.when(~foreign & (turn_of(3) == 1), listed("conversations", "from", "value")).when(~foreign & (turn_of(3) == 2), listed("turns", "speaker", "text")).otherwise(messages)
    return talks.select("id", record.alias("record"))


def digests(formatted: DataFrame) -> DataFrame:
    """Read back from the formatted texts: turns and text under the loss mask, with their digests; nulls for records of unknown layout."""
    small_batches(formatted.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if text is None:
                    rows.append((None,) * 5)
                    continue
                turns = read_back(text)
                all_turns = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode("utf-8", "replace")).hexdigest()
                loss = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
                rows.append((len(turns), all_turns, len(loss), hashlib.sha256(loss.encode("utf-8", "replace")).hexdigest(), len(text)))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], ["id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    picked = formatted.select("id", "formatted", "spans")
    return picked.mapInArrow(work, f"id {picked.schema['id'].dataType.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
