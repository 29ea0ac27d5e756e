"""Where symbols end and what encloses them: one pass over a file's lines."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: a symbol without a visible end is taken to be this long.
FALLBACK = 80
#: What begins a line that ends no indented symbol.
IGNORED = ("@", "#", "//")


def _later(lowest: list[int], n: int, counts=lambda i: True, less: bool = False) -> list[int]:
    """For each place the next later one that counts with a value no greater, or less, by a stack; ``n`` where there is none."""
    out, places, values = [n] * n, [], []  # values grow towards the top of the stack
    for i in range(n - 1, -1, -1):
        at = (bisect_left if less else bisect_right)(values, lowest[i])
        out[i] = places[at - 1] if at else n
        if counts(i):
            while values and values[-1] >= lowest[i]:
                places.pop(), values.pop()
            places.append(i), values.append(lowest[i])
    return out


def ends(lines: list[str], starts: list[int]) -> list[int]:
    """Last line of the symbols that begin at the 1-based ``starts``.

    A symbol with a brace before its indentation ends, ends where the braces opened since are closed again, on a later line;
    another ends before the next line, neither blank nor a comment or decorator, that is not deeper. Braces are
    prefix sums and the next line with no greater depth or indentation comes from a stack, so the cost is
    linear in the lines whatever the number of symbols.
    """
    n = len(lines)
    depth = list(accumulate((x.count("{") - x.count("}") for x in lines), initial=0))  # depth[i]: before line i, counted from 0
    shut = _later(depth, n + 1, less=True)
    bare = [x.strip() for x in lines]
    indent = [len(x) - len(x.lstrip()) for x in lines]
    dedent = _later(indent, n, lambda i: bool(bare[i]) and not bare[i].startswith(IGNORED))
    brace, following = n, [n] * (n + 1)
    for i in range(n - 1, -1, -1):
        following[i] = brace = i if "{" in lines[i] else brace
    out = []
    for start in starts:
        s = start - 1
        if s >= n:
            out.append(min(n, start + FALLBACK))
            continue
        first, d = following[s], dedent[s]
        if d < first:  # without a brace up to there
            out.append(d)
            continue
        at = max(first, s + 1) + 1  # depth after the first line that may close
        while at <= n and depth[at] > depth[s]:
            at = shut[at]
        out.append(at if first < n and at <= n else min(n, start + FALLBACK))
    return out


def owners(kinds: list[str], starts: list[int], last: list[int]) -> list[int]:
    """For each symbol the place of the innermost class around its first line, or -1."""
    out, around = [-1] * len(starts), []
    for k in sorted(range(len(starts)), key=lambda k: (starts[k], -last[k])):
        while around and last[around[-1]] < starts[k]:
            around.pop()
        out[k] = around[-1] if around and starts[around[-1]] < starts[k] else next((c for c in reversed(around) if starts[c] < starts[k]), -1)
        if kinds[k] == "class":
            around.append(k)
    return out


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("end", T.IntegerType()), T.StructField("owner", T.IntegerType())])))
def _spans(lines: pa.Array, kinds: pa.Array, starts: pa.Array) -> pa.Array:
    out = []
    for ls, ks, ss in zip(lines.to_pylist(), kinds.to_pylist(), starts.to_pylist(), strict=True):
        last = ends([x or "" for x in ls or []], ss or [])
        out.append([{"end": e, "owner": o} for e, o in zip(last, owners(ks or [], ss or [], last), strict=True)])
    return pa.array(out, pa.list_(pa.struct([("end", pa.int32()), ("owner", pa.int32())])))


def spans(lines: Column, symbols: Column) -> Column:
    """(end, owner) beside each of the symbols (kind, name, line) of a file with these lines; owner is the place of the enclosing class, or -1."""
    return _spans(lines, F.transform(symbols, lambda s: s["kind"]), F.transform(symbols, lambda s: s["line"]))
