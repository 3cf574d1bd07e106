"""Chunks of a text by any counter, in Arrow batches.

Named counters add up (a length, and one for a joining space), so a text is packed on
lengths and every chunk is joined once. A Python counter need not add up: it is asked
about joined texts, and the texts of a batch are packed side by side, so that one call
answers for many of them; each of them asks a few joins ahead, as many as its last chunk
took.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, functions as F
from pyspark.util import PythonEvalType

#: Length of a text whose white space is single spaces, what a joining space adds, tokens of a length.
ADDITIVE: dict[str, tuple[Callable[[str], int], int, Callable[[int], int]]] = {
    "chars4": (len, 1, lambda n: max(1, (n + 3) // 4)),
    "chars": (len, 1, lambda n: n),
    "words": (lambda t: t.count(" ") + 1 if t else 0, 0, lambda n: n),
}
MOST_AHEAD = 64

Count = Callable[[list[str]], list[int]]


def is_python(counter: object) -> bool:
    """Whether a counter is a Python function for Spark (udf, pandas_udf or arrow_udf)."""
    return hasattr(counter, "evalType") and hasattr(counter, "func")


def calls(counter: object) -> Count:
    """A function that counts many texts by a Python counter; what is not a non-negative integer is an error."""
    func, kind = counter.func, counter.evalType
    ask: dict[int, Callable[[list[str]], Iterable]] = {
        PythonEvalType.SQL_BATCHED_UDF: lambda texts: map(func, texts),
        PythonEvalType.SQL_ARROW_BATCHED_UDF: lambda texts: map(func, texts),
        PythonEvalType.SQL_SCALAR_PANDAS_UDF: lambda texts: func(pd.Series(texts, dtype=object)).tolist(),
        PythonEvalType.SQL_SCALAR_PANDAS_ITER_UDF: lambda texts: next(iter(func(iter([pd.Series(texts, dtype=object)])))).tolist(),
        PythonEvalType.SQL_SCALAR_ARROW_UDF: lambda texts: func(pa.array(texts, pa.string())).to_pylist(),
    }
    if kind not in ask:
        raise ValueError("a token counter must be a scalar udf, pandas_udf or arrow_udf")

    def count(texts: list[str]) -> list[int]:
        out = list(ask[kind](texts)) if texts else []
        for n in out:
            if n is None or isinstance(n, bool) or n != n or n != int(n) or n < 0:
                raise ValueError(f"a token count must be a non-negative integer, not {n!r}")
        if len(out) != len(texts):
            raise ValueError("a token counter must give a number for every text")
        return [int(n) for n in out]

    return count


def _cut(text: str, marks: str) -> list[str]:
    """Cut a text of single spaces behind any of the marks."""
    for mark in marks:
        text = text.replace(f"{mark} ", f"{mark}\n")
    return text.split("\n")


def sentences(text: str) -> list[str]:
    """str.split() knows the same white space as text.WS."""
    whole = " ".join(text.split())
    return _cut(whole, ".!?") if whole else []


def clauses(sentence: str) -> list[str]:
    return _cut(sentence, ",;:-–—")


def _pack_lengths(units: list[str], lengths: list[int], gap: int, fits: Callable[[int], bool]) -> tuple[list[str], list[int]]:
    """Runs of units joined by spaces, and their lengths."""
    out, sizes, first, total = [], [], 0, 0
    for i, n in enumerate(lengths):
        if i == first:
            total = n
        elif fits(total + gap + n):
            total += gap + n
        else:
            out.append(" ".join(units[first:i]))
            sizes.append(total)
            first, total = i, n
    if first < len(units):
        out.append(" ".join(units[first:]))
        sizes.append(total)
    return out, sizes


def chunk_by_length(text: str, budget: int, counter: str) -> tuple[list[str], bool]:
    """Chunks of a text, and whether one is over the budget."""
    measure, gap, tokens = ADDITIVE[counter]
    fits = lambda n: tokens(n) <= budget
    units, lengths = [], []
    for s in sentences(text):
        n = measure(s)
        if fits(n):
            units.append(s)
            lengths.append(n)
            continue
        for c in clauses(s):
            n = measure(c)
            if fits(n):
                units.append(c)
                lengths.append(n)
                continue
            words = c.split(" ")
            runs, sizes = _pack_lengths(words, [measure(w) for w in words], gap, fits)
            units += runs
            lengths += sizes
    chunks, sizes = _pack_lengths(units, lengths, gap, fits)
    return chunks, not all(map(fits, sizes))


def pack_by_count(lists: list[list[str]], budget: int, count: Count) -> list[list[str]]:
    """Of every list, its units greedily joined by spaces while the count of what is joined fits."""
    out: list[list[str]] = [[] for _ in lists]
    now = [units[0] if units else "" for units in lists]
    at, ahead = [1] * len(lists), [1] * len(lists)
    going = [k for k, units in enumerate(lists) if len(units) > 1]
    while going:
        joined, bounds = [], [0]
        for k in going:
            joined += itertools.islice(itertools.accumulate(lists[k][at[k] : at[k] + ahead[k]], "{} {}".format, initial=now[k]), 1, None)
            bounds.append(len(joined))
        counts = count(joined)
        for k, a, b in zip(going, bounds[:-1], bounds[1:]):
            took = next((i for i in range(a, b) if counts[i] > budget), b) - a
            if took:
                now[k] = joined[a + took - 1]
                at[k] += took
            if took < b - a:
                out[k].append(now[k])
                now[k] = lists[k][at[k]]
                at[k] += 1
                ahead[k] = max(1, took)
            else:
                ahead[k] = min(2 * ahead[k], MOST_AHEAD)
        going = [k for k in going if at[k] < len(lists[k])]
    for k, units in enumerate(lists):
        if units:
            out[k].append(now[k])
    return out


def _split_over(lists: list[list[str]], budget: int, count: Count, split: Callable[[list[str]], list[list[str]]]) -> list[list[str]]:
    """Every unit that is over the budget becomes what ``split`` makes of it."""
    flat = [u for units in lists for u in units]
    over = [n > budget for n in count(flat)]
    parts = iter(split([u for u, o in zip(flat, over) if o]))
    each = iter(next(parts) if o else [u] for u, o in zip(flat, over))
    return [[x for _ in units for x in next(each)] for units in lists]


def chunk_by_count(texts: list[str], budget: int, count: Count) -> tuple[list[list[str]], list[bool]]:
    """Chunks of many texts, and whether one of a text's is over the budget."""
    units = _split_over([sentences(t) for t in texts], budget, count, lambda over: _split_over([clauses(s) for s in over], budget, count, lambda long: pack_by_count([c.split(" ") for c in long], budget, count)))
    chunks = pack_by_count(units, budget, count)
    counts = iter(count([c for own in chunks for c in own]))
    return chunks, [any([next(counts) > budget for _ in own]) for own in chunks]


def chunks(text: Column, budget: int, counter: object = "chars4") -> Column:
    """struct<chunks, over> of a text by a named or a Python counter; null stays null."""
    count = calls(counter) if is_python(counter) else None

    @F.arrow_udf("struct<chunks: array<string>, over: boolean>")
    def run(column: pa.Array) -> pa.Array:
        texts = column.to_pylist()
        given = [t for t in texts if t is not None]
        if count is None:
            done = iter(chunk_by_length(t, budget, counter) for t in given)
        else:
            done = zip(*chunk_by_count(given, budget, count))
        rows = [None if t is None else dict(zip(("chunks", "over"), next(done))) for t in texts]
        return pa.array(rows, pa.struct([("chunks", pa.list_(pa.string())), ("over", pa.bool_())]))

    return run(text)
