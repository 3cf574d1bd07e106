"""Text expressions. All run inside the JVM; none needs a UDF."""

from __future__ import annotations

import html.entities
import json
import zlib
from collections.abc import Callable, Mapping

from pyspark.sql import Column, functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, FloatType, MapType, StructType

#: White space as Unicode text handling has it, U+001C-U+001F included (a plain \s knows ASCII only).
WS = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: The same as a set of characters, for trimming: that looks at the ends of a text only.
SPACES = "".join(map(chr, [*range(0x9, 0xE), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: Ends of lines.
EOL = r"(?:\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}])"
#: Quotation marks that are stripped, and dashes that lead an attribution.
QUOTES = "\"'“”‘’"
DASHES = "~\\-–—"
SLICE = 256
#: Maps that names of characters are dealt into.
NAME_PARTS = 1024
#: Longest run that a regular expression packs.
LONGEST_RUN = 2048

Counter = Callable[[Column], Column]


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once for all its uses: lambdas have no common subexpressions."""
    return F.transform(F.array(value), use)[0]


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.btrim(c, F.lit(SPACES))


def normalize_ws(c: Column) -> Column:
    """Runs of white space become one space, none at the ends; null stays null."""
    return F.btrim(F.regexp_replace(c, f"{WS}+", " "), F.lit(" "))


def is_blank(c: Column) -> Column:
    """Null, empty or white space only."""
    return ~F.coalesce(c, F.lit("")).rlike(f"[^{WS[1:]}")


def is_speaker_name(c: Column) -> Column:
    """1 to 80 code points: a letter, then letters, marks, space, full stop, apostrophes or hyphens."""
    return c.rlike(r"^\p{L}[\p{L}\p{M} .'’\-]{0,79}\z")


def split_attribution(c: Column) -> Column:
    """struct<text, speaker>: the speaker, where the last line that isn't blank is a dash and a name."""

    def parts(lines: Column, name: Column) -> Column:
        text = F.when(name.isNotNull(), F.array_join(F.slice(lines, 1, F.greatest(F.size(lines) - 1, F.lit(0))), "\n")).otherwise(F.array_join(lines, "\n"))
        return F.struct(text.alias("text"), name.alias("speaker"))

    def named(last: Column) -> Column:
        name = F.when(last.rlike(f"^[{DASHES}]"), strip(F.regexp_extract(last, f"^[{DASHES}](.*)$", 1)))
        return let(name, lambda n: F.when(is_speaker_name(n), n))

    lines = F.split(F.rtrim(c, F.lit(SPACES)), EOL)
    return let(lines, lambda x: let(let(strip(F.element_at(x, -1)), named), lambda name: parts(x, name)))


def strip_quotes(c: Column) -> Column:
    return F.btrim(c, F.lit(QUOTES))


def decode_entities(c: Column, names: Mapping[str, str] = html.entities.html5) -> Column:
    """Character references to text, as HTML 5 reads them in text.

    Names come from a table whose keys end in ";" or, for the old ones, don't; an old name
    also counts where other letters follow it. Numbers in decimal or hex: 128 to 159 mean
    Windows-1252, what is no character becomes U+FFFD, control characters and
    noncharacters go. All else stays as it is.

    One pass over the text's pieces: a reference, a run without "&", or a lone "&". A name
    is looked up in the one of NAME_PARTS small maps that its CRC-32 picks, as Spark searches
    a map from end to end.
    """
    reference = r"&#[0-9]+;?|&#[xX][0-9a-fA-F]+;?|&[^\t\n\f <&#;]{1,32};?"
    pieces = F.regexp_extract_all(c, F.lit(f"(?s)({reference}|[^&]+|&)"), F.lit(1))
    old = {n: t for n, t in names.items() if not n.endswith(";")}
    windows = F.array(*[F.lit(bytes([b]).decode("cp1252", "ignore") or chr(b)) for b in range(128, 160)])

    def in_parts(of: Mapping[str, str]) -> Callable[[Column], Column]:
        parts: list[dict[str, str]] = [{} for _ in range(NAME_PARTS)]
        for name, text in of.items():
            parts[zlib.crc32(name.encode()) % NAME_PARTS][name] = text
        table = F.from_json(F.lit(json.dumps(parts)), "array<map<string,string>>")  # folded to a literal
        return lambda name: F.try_element_at(F.get(table, (F.crc32(name.cast("binary")) % NAME_PARTS).cast("int")), name)

    of_all, of_old = in_parts(names), in_parts(old)

    def char(code: Column) -> Column:
        gone = code.between(1, 8) | (code == 11) | code.between(14, 31) | (code == 127) | code.between(0xFDD0, 0xFDEF) | (code.bitwiseAND(0xFFFE) == 0xFFFE)
        return (
            F.when(code.isNull() | (code == 0) | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF), "\ufffd")
            .when(code.between(128, 159), F.try_element_at(windows, (code - 127).cast("int")))
            .when(gone, "")
            .otherwise(F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
        )

    def number(p: Column, pattern: str, most: int) -> Column:
        """Digits of a numeric reference without leading zeros; "" if there are more than ``most``."""
        return let(F.regexp_extract(p, pattern, 1), lambda digits: F.when(F.char_length(digits) > most, "").when(digits == "", "0").otherwise(digits))

    def named(name: Column) -> Column:
        begun = [F.concat(of_old(F.substring(name, 1, n)), F.substr(name, F.lit(n + 1))) for n in range(max(map(len, old), default=0), 1, -1)]
        return F.coalesce(of_all(name), *begun)

    def piece(p: Column) -> Column:
        return (
            F.when(~p.startswith("&") | (p == "&"), p)
            .when(p.startswith("&#x") | p.startswith("&#X"), let(F.conv(number(p, "^&#[xX]0*([0-9a-fA-F]*)", 6), 16, 10).try_cast("long"), char))
            .when(p.startswith("&#"), let(number(p, "^&#0*([0-9]*)", 7).try_cast("long"), char))
            .otherwise(F.coalesce(let(F.substr(p, F.lit(2)), named), p))
        )

    return F.when(c.contains("&"), F.array_join(F.transform(pieces, piece), "")).otherwise(c)


def chars4(c: Column) -> Column:
    """A token for every four characters begun, one at least."""
    return F.greatest(F.lit(1), F.floor((F.char_length(c) + 3) / 4).cast("int"))


def words(c: Column) -> Column:
    """A token for every word."""
    return F.size(F.filter(F.split(c, f"{WS}+"), lambda w: w != ""))


COUNTERS: dict[str, Counter] = {"chars4": chars4, "words": words, "chars": F.char_length}


def token_count(c: Column, counter: str | Counter = "chars4") -> Column:
    """Tokens of a text by a named counter or any function from column to column (a pandas_udf too)."""
    if not callable(counter) and counter not in COUNTERS:
        raise ValueError(f"counter must be a function or one of {sorted(COUNTERS)}")
    return (counter if callable(counter) else COUNTERS[counter])(c)


def split_sentences(c: Column) -> Column:
    """Sentences of the normalised text: cut behind . ! or ? before white space."""
    return F.filter(F.split(normalize_ws(c), r"(?<=[.!?]) +"), lambda s: s != "")


def split_clauses(c: Column) -> Column:
    """Clauses of a normalised sentence: cut behind , ; : or a dash before white space."""
    return F.filter(F.split(c, r"(?<=[,;:\-–—]) +"), lambda s: s != "")


def pack(units: Column, budget: int, counter: str | Counter = "chars4") -> Column:
    """Greedily join consecutive units by spaces while the tokens fit the budget.

    A Python counter is an error here (lambdas can't hold one); chunk.build_chunks() takes it.
    The fold runs over slices of SLICE units, so that the array it appends to stays short.
    """
    if hasattr(counter, "evalType"):
        raise TypeError("a Python counter can't be used within a fold; chunk.build_chunks() and chunk.chunk_texts() take it")
    nothing = F.array().cast("array<string>")
    state = lambda done, now: F.struct(done.alias("done"), now.alias("now"))

    def step(x: Column, unit: Column) -> Column:
        def add(joined: Column) -> Column:
            full = state(F.when(x["now"] == "", x["done"]).otherwise(F.concat(x["done"], F.array(x["now"]))), unit)
            return F.when(token_count(joined, counter) <= budget, state(x["done"], joined)).otherwise(full)

        return let(F.when(x["now"] == "", unit).otherwise(F.concat(x["now"], F.lit(" "), unit)), add)

    def slice_step(x: Column, part: Column) -> Column:
        return let(F.aggregate(part, state(nothing, x["now"]), step), lambda y: state(F.concat(x["done"], F.array(y["done"])), y["now"]))

    def finish(x: Column) -> Column:
        return F.flatten(F.when(x["now"] == "", x["done"]).otherwise(F.concat(x["done"], F.array(F.array(x["now"])))))

    slices = F.transform(F.sequence(F.lit(0), F.floor((F.size(units) - 1) / SLICE).cast("int")), lambda k: F.slice(units, k * SLICE + 1, SLICE))
    start = state(F.array().cast("array<array<string>>"), F.lit(""))
    return F.when(F.size(units) > 0, F.aggregate(slices, start, slice_step, finish)).when(units.isNotNull(), nothing)


def pack_words(c: Column, budget: int, counter: str | Counter = "chars4") -> Column:
    """Word runs of a clause that fit the budget; words are never cut.

    Where the counter is a length, a regular expression finds the longest run that fits at
    each place, or a word that alone doesn't, so nothing is folded word by word.
    """
    most = {"chars4": 4 * budget, "chars": budget}.get(counter, 0) if isinstance(counter, str) else 0
    if not 3 <= most <= LONGEST_RUN:
        return pack(F.filter(F.split(c, " +"), lambda w: w != ""), budget, counter)
    run = rf"(?s)([^ ]{{{most + 1},}}+|[^ ](?:.{{0,{most - 2}}}[^ ])?(?= |\z))"
    return F.regexp_extract_all(F.regexp_replace(c, "  +", " "), F.lit(run), F.lit(1))


def split_units(c: Column, budget: int, counter: str | Counter = "chars4") -> Column:
    """Sentences; clauses of those over the budget; word runs of clauses over the budget."""
    fits = lambda x: token_count(x, counter) <= budget
    of_clause = lambda x: F.when(fits(x), F.array(x)).otherwise(pack_words(x, budget, counter))
    of_sentence = lambda x: F.when(fits(x), F.array(x)).otherwise(F.flatten(F.transform(split_clauses(x), of_clause)))
    return F.flatten(F.transform(split_sentences(c), of_sentence))


def canonical_json(value: Column, of: DataType) -> Column:
    """Compact JSON of a value of type ``of``: keys sorted at every level, nulls kept; NaN and infinities are an error."""
    return F.to_json(_canonical(value, of), {"ignoreNullFields": "false"})


def _canonical(c: Column, of: DataType) -> Column:
    if isinstance(of, StructType):
        fields = [_canonical(c[f.name], f.dataType).alias(f.name) for f in sorted(of.fields, key=lambda f: f.name)]
        return F.when(c.isNotNull(), F.struct(*fields))
    if isinstance(of, ArrayType):
        return F.transform(c, lambda x: _canonical(x, of.elementType))
    if isinstance(of, MapType):
        entries = F.transform(F.map_entries(c), lambda e: F.struct(e["key"].alias("key"), _canonical(e["value"], of.valueType).alias("value")))
        return F.map_from_entries(F.array_sort(entries, lambda a, b: F.when(a["key"] < b["key"], -1).otherwise(1)))
    if isinstance(of, (DoubleType, FloatType)):
        return F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.raise_error("canonical JSON has no NaN and no infinity").cast(of)).otherwise(c)
    return c
