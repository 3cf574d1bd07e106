"""Byte-level BPE encoding and decoding in batched numpy merge rounds.

The vocabulary file (its path is a parameter, it is read on the driver and sent
as a broadcast of fixed size) gives a table of mergeable pairs, sorted by key.
Texts are cut into words by the tokenizer's pattern; the distinct new words of a
batch lie symbol by symbol in one flat array. In a round every word's adjacent
pairs are looked up by binary search over the sorted pair keys, the lowest rank
of each word is found by a segmented minimum, and all its places are merged from
left to right; only pairs next to a merge are looked up again. Words without a
mergeable pair leave the array. A worker remembers encoded words from batch to batch,
KNOWN_BYTES of them at most besides those of the slice at hand.

A round over the whole array costs its length, and a word has a round for each of its
ranks, so words of over LONG_WORD bytes have rounds of their own: the same look-ups
and merges, but on linked places in the order of a queue of ranks, so that a round
costs what it merges.

Defined results: null is the empty text, which has no ids; the text of a special
token is that token, as the tokenizers library has it; decoding ids that are not
the UTF-8 of any text puts U+FFFD for the faulty bytes; unknown ids are an error;
rows that repeat a doc_id stay rows of their own; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common

#: Fixed value: how byte-level BPE cuts a text into words. White space is the Unicode property.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?<letter>+| ?<number>+| ?<other>+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Letters and numbers of the regex package that the tokenizers library's Unicode version does not have yet.
NEWER = (
    r"\u0558\u058B-\u058C\u088F\u0C5C\u0CDC\u208F\u209D-\u209F\uA7CE-\uA7CF"
    r"\uA7D2\uA7D4\uA7DD\uA7E2\uA7F1\uAB6C-\uAB6D\U000107BB-\U000107BF\U00010940-\U00010959"
    r"\U00010EC5-\U00010EC7\U00010ED9-\U00010EEE\U00011B0A\U00011DB0-\U00011DDB\U00011DE0-\U00011DE9\U00011DF1\U0001246F\U00012475-\U0001247F"
    r"\U00012550-\U00012686\U00016EA0-\U00016EB8\U00016EBB-\U00016ED3\U00016FF2-\U00016FF6\U000187F8-\U000187FF\U00018CD6-\U00018CDA\U00018D09-\U00018D20\U00018D80-\U00018DF2"
    r"\U00018E00-\U00019191\U000191A0-\U000191D2\U0001B123-\U0001B128\U0001B168\U0001D6A6\U0001DF1F-\U0001DF24\U0001DF2B-\U0001DF81\U0001DF90-\U0001DF96"
    r"\U0001DFCD-\U0001DFFF\U0001E6C0-\U0001E6DE\U0001E6E0-\U0001E6E2\U0001E6E4-\U0001E6E5\U0001E6E7-\U0001E6ED\U0001E6F0-\U0001E6F4\U0001E6FE-\U0001E6FF\U0002B73A-\U0002B73F"
    r"\U0002B81E\U0002CEA2-\U0002CEAD\U000323B0-\U00033479\U0003D000-\U0003FC3F"
)
FIRST_NEWER = 0x558
#: The pattern's classes for texts in Latin script up to U+017F and general punctuation: Python's own expressions cut those faster.
LATIN = {"letter": "[A-Za-z\xAA\xB5\xBA\xC0-\xD6\xD8-\xF6\xF8-\u017F]", "number": "[0-9\xB2\xB3\xB9\xBC-\xBE]", "space": "[\t-\r \x85\xA0]"}
PUNCTUATION = ((0x2010, 0x2027), (0x2030, 0x205E), (0x20A0, 0x20C0))


def pattern(newer: bool) -> str:
    """The pattern; with ``newer`` also right for texts with characters of NEWER, which costs time."""
    parts = {"letter": r"\p{L}", "number": r"\p{N}", "other": r"[^\p{White_Space}\p{L}\p{N}]"}
    if newer:
        parts = {"letter": rf"(?:(?![{NEWER}])\p{{L}})", "number": rf"(?:(?![{NEWER}])\p{{N}})", "other": rf"(?:{parts['other']}|[{NEWER}])"}
    return re.sub("<(letter|number|other)>", lambda m: parts[m[1]], PATTERN)


def latin_pattern() -> str:
    """The same for texts that are_latin()."""
    space = LATIN["space"][1:-1]
    parts = LATIN | {"other": f"[^{space}{LATIN['letter'][1:-1]}{LATIN['number'][1:-1]}]"}
    out = re.sub("<(letter|number|other)>", lambda m: parts[m[1]], PATTERN)
    return out.replace(r"\p{White_Space}", f"[{space}]").replace(r"\P{White_Space}", f"[^{space}]")


def are_latin(points: np.ndarray) -> bool:
    """Whether all code points are in Latin script up to U+017F, or general punctuation."""
    high = points[points > 0x17F]
    return not len(high) or bool(np.logical_or.reduce([(high >= a) & (high <= b) for a, b in PUNCTUATION]).all())


LONG_WORD = 512  # bytes
KNOWN_BYTES = 1 << 25  # of words and their ids that a worker remembers
WORD_BYTES = 150  # that a word takes besides its text and its ids, about
IDS_AT_ONCE = 1 << 18  # ids that are decoded together
NO_RANK = np.int32(2**31 - 1)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes stand for themselves, the rest follow from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def load_tables(path: str) -> dict:
    """Tables of a tokenizers-library file with a byte-level BPE model."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab, letters = spec["model"]["vocab"], byte_letters()
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    size = max([*vocab.values(), *special.values()]) + 1
    pieces = [b""] * size
    for piece, i in vocab.items():
        pieces[i] = bytes(letters[c] for c in piece)
    for text, i in special.items():
        pieces[i] = text.encode()
    keys, made = [], []
    for pair in spec["model"]["merges"]:
        a, b = pair if isinstance(pair, list) else pair.split(" ")
        keys.append((vocab[a] << 32) | vocab[b])
        made.append(vocab[a + b])
    keys = np.array(keys, np.int64)
    order = np.argsort(keys)
    first = np.zeros(256, np.int32)
    for letter, byte in letters.items():
        first[byte] = vocab[letter]
    return {
        "keys": keys[order], "ranks": order.astype(np.int32), "made": np.array(made, np.int32)[order], "first": first, "special": special,
        "flat": np.frombuffer(b"".join(pieces), np.uint8), "at": np.concatenate([[0], np.cumsum([len(p) for p in pieces])]).astype(np.int64),
    }


class Encoder:
    def __init__(self, tables: dict) -> None:
        self.t = tables
        self.cut, self.cut_newer, self.cut_latin = regex.compile(pattern(False)), regex.compile(pattern(True)), re.compile(latin_pattern())
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.held = 0
        self.ids = np.zeros(0, np.int32)
        self.at = np.zeros(1, np.int64)

    def _look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged id of pairs."""
        key = (left.astype(np.int64) << 32) | right
        found = np.minimum(np.searchsorted(self.t["keys"], key), len(self.t["keys"]) - 1)
        hit = self.t["keys"][found] == key
        return np.where(hit, self.t["ranks"][found], NO_RANK), self.t["made"][found]

    def merge_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many words in one flat array, and where each word's ids begin."""
        lengths = np.array([len(w) for w in words], np.int64)
        sym = self.t["first"][np.frombuffer(b"".join(words), np.uint8)]
        wid = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
        done_ids, done_wid = [], []
        rank = np.full(len(sym), NO_RANK, np.int32)
        made = np.zeros(len(sym), np.int32)
        stale = np.flatnonzero(wid[:-1] == wid[1:]) if len(sym) else np.zeros(0, np.int64)
        while len(sym):
            rank[stale], made[stale] = self._look_up(sym[stale], sym[stale + 1])
            new_word = np.concatenate([[True], wid[1:] != wid[:-1]])
            starts = np.flatnonzero(new_word)
            least = np.minimum.reduceat(rank, starts)
            lengths = np.diff(np.concatenate([starts, [len(sym)]]))
            each = np.repeat(least, lengths)
            over = each == NO_RANK
            if over.any():
                done_ids.append(sym[over])
                done_wid.append(wid[over])
                keep = ~over
                sym, wid, rank, made, each = sym[keep], wid[keep], rank[keep], made[keep], each[keep]
                if not len(sym):
                    break
            # of places that overlap (a run of one symbol), every second one merges, from the left
            merge = np.flatnonzero(rank == each)
            joined = np.concatenate([[False], merge[1:] == merge[:-1] + 1])
            if joined.any():
                at = np.arange(len(merge))
                merge = merge[(at - np.maximum.accumulate(np.where(joined, 0, at))) % 2 == 0]
            sym[merge] = made[merge]
            keep = np.ones(len(sym), bool)
            keep[merge + 1] = False
            place = np.cumsum(keep) - 1
            sym, wid, rank, made = sym[keep], wid[keep], rank[keep], made[keep]
            merged = place[merge]
            rank[merged] = NO_RANK
            # in order by a mask: np.unique() would hash them
            touched = np.zeros(len(sym) + 1, bool)
            touched[merged] = touched[merged - 1] = True  # before the first place is the one behind the last
            stale = np.flatnonzero(touched[: max(len(sym) - 1, 0)])
            stale = stale[wid[stale] == wid[stale + 1]]
        ids = np.concatenate(done_ids) if done_ids else np.zeros(0, np.int32)
        of = np.concatenate(done_wid) if done_wid else np.zeros(0, np.int64)
        order = np.argsort(of, kind="stable")
        return ids[order], np.searchsorted(of[order], np.arange(len(words) + 1))

    def merge_long_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """What merge_words() gives, with rounds by rank: each takes all places that have the lowest rank of all words."""
        lengths = np.array([len(w) for w in words], np.int64)
        sym = self.t["first"][np.frombuffer(b"".join(words), np.uint8)].copy()
        n, ends = len(sym), np.cumsum(lengths)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ends - 1] = -1
        before[ends - lengths] = -1
        rank, made = np.full(n, NO_RANK, np.int32), np.zeros(n, np.int32)
        waiting: dict[int, list[np.ndarray]] = {}  # places by rank; some are out of date
        queue: list[int] = []

        def look(places: np.ndarray) -> None:
            rank[places], made[places] = self._look_up(sym[places], sym[after[places]])
            places = places[rank[places] != NO_RANK]
            own = rank[places]
            order = np.argsort(own, kind="stable")
            own, places = own[order], places[order]
            cuts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else []
            for r, part in zip(own[cuts].tolist(), np.split(places, cuts[1:])):
                if r not in waiting:
                    waiting[r] = []
                    heapq.heappush(queue, r)
                waiting[r].append(part)

        look(np.flatnonzero(after >= 0))
        while queue:
            r = heapq.heappop(queue)
            at = np.unique(np.concatenate(waiting.pop(r)))
            at = at[rank[at] == r]
            if not len(at):
                continue
            if sym[at[0]] == sym[after[at[0]]]:  # places overlap in a run of one symbol: every second one merges, from the left
                place = np.arange(len(at))
                joined = np.concatenate([[False], after[at[:-1]] == at[1:]])
                at = at[(place - np.maximum.accumulate(np.where(joined, 0, place))) % 2 == 0]
            gone = after[at]
            sym[at] = made[at]
            sym[gone], rank[gone], rank[at] = -1, NO_RANK, NO_RANK
            after[at] = after[gone]
            behind = after[at]
            before[behind[behind >= 0]] = at[behind >= 0]
            look(np.unique(np.concatenate([at[behind >= 0], before[at][before[at] >= 0]])))
        left = sym >= 0
        return sym[left], np.concatenate([[0], np.cumsum(left)])[np.concatenate([[0], ends])]

    def _learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.known]
        if not new:
            return
        special = [w for w in self.t["special"] if w in words and w not in self.known]
        new = [w for w in new if w not in special] if special else new
        raw = [w.encode() for w in new]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        order = np.argsort(sizes > LONG_WORD, kind="stable")  # long words last
        if len(sizes) and sizes.max() > LONG_WORD:
            new, raw = [new[k] for k in order], [raw[k] for k in order]
        short = int((sizes <= LONG_WORD).sum())
        parts, lengths = [], []
        for merge, own in ((self.merge_words, raw[:short]), (self.merge_long_words, raw[short:])):
            if own:
                ids, at = merge(own)
                parts.append(ids)
                lengths += np.diff(at).tolist()
        parts.append(np.array([self.t["special"][w] for w in special], np.int32))
        lengths += [1] * len(special)
        new += special
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
        self.held += sum(map(len, raw)) + 4 * sum(lengths) + WORD_BYTES * len(new)
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(lengths)])
        self.ids = np.concatenate([self.ids, *parts])

    def words_of(self, text: str) -> list[str]:
        special, cut = self.t["special"], self.cut_latin
        if not text.isascii() and not are_latin(points := np.frombuffer(text.encode("utf-32-le"), np.uint32)):
            cut = self.cut_newer if points.max() >= FIRST_NEWER else self.cut
        if not any(s in text for s in special):
            return cut.findall(text)
        out: list[str] = []
        for part in regex.split("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")", text):
            out += [part] if part in special else cut.findall(part)
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one flat array, and where each text's ids begin."""
        if self.held > KNOWN_BYTES:
            self.forget()
        cut = [self.words_of(t) for t in texts]
        self._learn(set().union(*cut))
        word = np.fromiter(map(self.known.__getitem__, itertools.chain.from_iterable(cut)), np.int64, sum(map(len, cut)))
        lengths = self.at[word + 1] - self.at[word]
        upto = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
        bounds = upto[np.concatenate([[0], np.cumsum([len(ws) for ws in cut], dtype=np.int64)])]
        return self.ids[common.gather(self.at[word], lengths)], bounds

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        """Texts of the ids between the bounds."""
        if len(ids) and not 0 <= int(ids.min()) <= int(ids.max()) < len(self.t["at"]) - 1:
            raise ValueError("an id is not in the vocabulary")
        lengths = self.t["at"][ids + 1] - self.t["at"][ids]
        flat = self.t["flat"][common.gather(self.t["at"][ids], lengths)].tobytes()
        upto = np.concatenate([[0], np.cumsum(lengths)])[bounds]
        return [flat[a:b].decode("utf-8", "replace") for a, b in zip(upto[:-1], upto[1:])]


def slices(column):
    for first, offsets, flat in common.text_slices(column):
        raw = flat.tobytes()
        yield first, [raw[a:b].decode() for a, b in zip(offsets[:-1], offsets[1:])]


def _sent(docs: DataFrame, path: str | None):
    return docs.sparkSession.sparkContext.broadcast(load_tables(path or default_path()))


def encode(docs: DataFrame, path: str | None = None, text_col: str = "text", to: str = "ids", decoded: str | None = None) -> DataFrame:
    """``docs`` with a column of token ids, array<int>, and with ``decoded`` given one of their text, made in the same pass; both in place of columns of their names."""
    docs = docs.drop(to, *([decoded] if decoded else []))
    tables = _sent(docs, path)

    def run(batches):
        encoder = Encoder(tables.value)
        for batch in batches:
            for first, texts in slices(batch.column(text_col)):  # a batch out for every slice, so that little is held at once
                ids, bounds = encoder.encode(texts)
                more = [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))]
                if decoded:
                    more.append(pa.array(encoder.decode(ids, bounds), pa.string()))
                yield pa.RecordBatch.from_arrays([*batch.slice(first, len(texts)).columns, *more], [*batch.schema.names, to, *([decoded] if decoded else [])])

    return docs.mapInArrow(run, common.with_fields(docs, f"`{to}` array<int>" + (f", `{decoded}` string" if decoded else "")))


def decode(tokens: DataFrame, path: str | None = None, ids_col: str = "ids", to: str = "decoded") -> DataFrame:
    """``tokens`` with the text of its ids, in place of a column of that name; null ids are empty."""
    tokens = tokens.drop(to)
    tables = _sent(tokens, path)

    def run(batches):
        encoder = Encoder(tables.value)
        for batch in batches:
            column = batch.column(ids_col)
            ids = column.flatten().to_numpy(zero_copy_only=False)
            bounds = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)])
            texts, row = [], 0
            while row < batch.num_rows:
                end = max(int(np.searchsorted(bounds, bounds[row] + IDS_AT_ONCE, side="right")) - 1, row + 1)
                texts += encoder.decode(ids[bounds[row] : bounds[end]].astype(np.int64), bounds[row : end + 1] - bounds[row])
                row = end
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, to])

    return tokens.mapInArrow(run, common.with_fields(tokens, f"`{to}` string"))


def round_trip(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: digests of what encode() and decode() give, made in one pass."""
    tables = _sent(docs, path)

    def run(batches):
        encoder = Encoder(tables.value)
        for batch in batches:
            n, first, second = [], [], []
            for _, texts in slices(batch.column("text")):
                ids, bounds = encoder.encode(texts)
                raw = ids.astype("<u4").tobytes()
                for a, b, text in zip(bounds[:-1], bounds[1:], encoder.decode(ids, bounds)):
                    n.append(int(b - a))
                    first.append(hashlib.sha256(raw[4 * a : 4 * b]).hexdigest())
                    second.append(hashlib.sha256(text.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(common.documents(spark, sf_dir))
