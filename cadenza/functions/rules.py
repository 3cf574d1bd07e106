"""Ordered whole-word replacements, for tables of many rules."""

from __future__ import annotations

import bisect
import functools
import re
from collections.abc import Callable, Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, functions as F


@functools.lru_cache(maxsize=4)
def replacer(rules: tuple[tuple[str, str], ...]) -> Callable[[str], str]:
    """A function that applies the rules to a text, one after the other.

    A rule that is nowhere in a text as a whole word leaves it as it is. So an automaton
    over all written forms says which rule is the next that does something, that one is
    applied, and what it made is read again for the rules behind it.
    """
    finder, places = ahocorasick.Automaton(), {}
    for k, (written, _) in enumerate(rules):
        places.setdefault(written, []).append(k)
    for written, own in places.items():
        finder.add_word(written, (len(written), own))
    finder.make_automaton()
    inside = re.compile(r"\w")

    @functools.lru_cache(maxsize=4096)
    def pattern(written: str) -> re.Pattern:
        return re.compile(rf"(?<!\w){re.escape(written)}(?!\w)")

    def apply(text: str) -> str:
        last = -1
        while True:
            best = len(rules)
            for end, (size, own) in finder.iter(text):
                if own[-1] <= last or own[0] >= best:
                    continue
                k = own[bisect.bisect_right(own, last)]
                start = end + 1 - size
                if k < best and not (start and inside.match(text[start - 1])) and not (end + 1 < len(text) and inside.match(text[end + 1])):
                    best = k
            if best == len(rules):
                return text
            written, spoken = rules[best]
            text, last = pattern(written).sub(lambda _: spoken, text), best

    return apply if rules else lambda text: text


def apply_rules(text: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Texts with the rules applied in the order given; null stays null."""
    fixed = tuple((written, spoken) for written, spoken in rules)

    @F.arrow_udf("string")
    def run(column: pa.Array) -> pa.Array:
        apply = replacer(fixed)
        return pa.array([None if t is None else apply(t) for t in column.to_pylist()], pa.string())

    return run(text)
