"""Token counts under a unigram model by trie-shared dynamic programming.

The vocabulary is that of a byte-level tokenizer file (its path is a parameter).
A piece's cost is its share of bits under Zipf's law over the vocabulary's order,
log2(rank + 2) in 256ths; single bytes, the fallback, cost as much as the last
piece. A pre-token (a run of non-space characters with at most one space before
it, or a run of white space) is cut into the pieces of the least summed cost, the
fewest among equals, and counts their number.

The distinct pre-tokens of a batch go into a trie, level by level. The forward
score of a trie node (least cost of the bytes up to it) is computed once and
shared by all pre-tokens with that prefix; terminal nodes store the counts. All
nodes of a level are scored together in numpy, each from the vocabulary states
that reach it; where a level has few words left (the far end of very long ones), its
nodes are scored one by one, which is the same with less to set up. A worker
remembers pre-tokens from batch to batch, KNOWN_BYTES of them at most besides those
of the slice at hand.

Defined results: null and empty texts have 0 tokens (n_chars of null is 0); a
pre-token may be as long as its text; rows that repeat a doc_id stay rows of their own; an empty table gives an empty result; further columns
are ignored.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, common

PRE_TOKEN = re.compile(r" ?\S+|\s+")
KNOWN_BYTES, WORD_BYTES = 1 << 26, 150  # of pre-tokens that a worker remembers; what one takes besides its text, about
FEW, DEEP = 16, 1 << 22  # words and level at which nodes are scored one by one
_COUNT_BITS = 24  # more than DEEP needs


def piece_costs(path: str | None = None) -> dict[bytes, int]:
    tables = bpe.load_tables(path or bpe.default_path())
    special = set(tables["special"].values())
    at, raw = tables["at"], tables["flat"].tobytes()
    pieces = [raw[at[i] : at[i + 1]] for i in range(len(at) - 1) if i not in special]
    bits = lambda rank: int(round(256 * np.log2(rank + 2)))
    longer = {p: bits(k) for k, p in enumerate(x for x in pieces if len(x) > 1)}
    return {bytes([b]): bits(len(longer)) for b in range(256)} | longer


class Vocabulary:
    """The pieces as a trie in sorted arrays: key (node, byte) -> node, and each node's cost or -1."""

    def __init__(self, costs: dict[bytes, int]) -> None:
        nodes: dict[tuple[int, int], int] = {}
        cost = [-1]
        for piece, c in costs.items():
            node = 0
            for byte in piece:
                step = (node, byte)
                if step not in nodes:
                    nodes[step] = len(cost)
                    cost.append(-1)
                node = nodes[step]
            cost[node] = c
        keys = np.array([(n << 8) | b for n, b in nodes], np.int64)
        order = np.argsort(keys)
        self.keys, self.to, self.cost = keys[order], np.array(list(nodes.values()), np.int64)[order], np.array(cost, np.int64)

    @functools.cached_property
    def steps(self) -> dict[int, tuple[int, int]]:
        """Key -> node and its cost, for looking up one by one."""
        return dict(zip(self.keys.tolist(), zip(self.to.tolist(), self.cost[self.to].tolist())))


def count_words(words: list[bytes], v: Vocabulary) -> np.ndarray:
    """Number of pieces of every word; the words are distinct and not empty."""
    order = sorted(range(len(words)), key=words.__getitem__)
    lengths = np.array([len(words[k]) for k in order], np.int64)
    flat = np.frombuffer(b"".join(words[k] for k in order), np.uint8)
    begin = np.cumsum(lengths) - lengths
    out = np.zeros(len(words), np.int64)
    node = np.zeros(len(order), np.int64)  # trie node of each live word at this level, ascending
    live = np.arange(len(order))
    best = np.zeros(1, np.int64)  # of the nodes of this level: cost << 24 | pieces
    at, state, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)  # open pieces: node they have reached, vocabulary state, score where they began
    depth = 0
    while len(live) > FEW and depth < DEEP:
        # the next level of the trie: a node for each distinct (parent, byte)
        key = (node << 8) | flat[begin[live] + depth]
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        child = np.cumsum(fresh) - 1
        parent, byte = key[fresh] >> 8, key[fresh] & 255
        # open pieces at the parents, and one that begins there
        at = np.concatenate([at, np.arange(len(best))])
        state = np.concatenate([state, np.zeros(len(best), np.int64)])
        score = np.concatenate([score, best])
        by = np.argsort(at, kind="stable")
        at, state, score = at[by], state[by], score[by]
        first = np.searchsorted(at, np.arange(len(best) + 1))
        much = first[parent + 1] - first[parent]
        take = common.gather(first[parent], much)
        to = np.repeat(np.arange(len(parent)), much)
        look = (state[take] << 8) | np.repeat(byte, much)
        found = np.minimum(np.searchsorted(v.keys, look), len(v.keys) - 1)
        ok = v.keys[found] == look
        at, state, score = to[ok], v.to[found[ok]], score[take][ok]
        ends = v.cost[state] >= 0
        best = np.full(len(parent), np.iinfo(np.int64).max)
        np.minimum.at(best, at[ends], score[ends] + (v.cost[state[ends]] << _COUNT_BITS) + 1)
        depth += 1
        stop = lengths[live] == depth
        out[live[stop]] = best[child[stop]] & ((1 << _COUNT_BITS) - 1)
        node, live = child[~stop], live[~stop]
    if len(live):
        parts = lambda x: divmod(int(x), 1 << _COUNT_BITS)
        opened = lambda k: [(int(state[j]), *parts(score[j])) for j in np.flatnonzero(at == k)]
        nodes = [(*parts(best[k]), opened(k), [(w, words[order[w]]) for w in live[node == k]]) for k in np.unique(node)]
        for w, n in _count_rest(nodes, depth, v):
            out[w] = n
    result = np.zeros(len(words), np.int64)
    result[order] = out
    return result


def _count_rest(nodes: list, depth: int, v: Vocabulary):
    """Yields (word, pieces) of the words below some nodes of a level.

    A node: cost and pieces of its best cut, its open pieces (vocabulary state, cost and
    pieces where they began), its words.
    """
    steps = v.steps
    while nodes:
        below = []
        for cost, n, open_, words in nodes:
            by_byte: dict[int, list] = {}
            for word in words:
                by_byte.setdefault(word[1][depth], []).append(word)
            for byte, own in by_byte.items():
                grown, least = [], None
                for state, c, m in (*open_, (0, cost, n)):
                    step = steps.get(state << 8 | byte)
                    if step:
                        grown.append((step[0], c, m))
                        if step[1] >= 0 and (least is None or (c + step[1], m + 1) < least):
                            least = c + step[1], m + 1
                going_on = []
                for word in own:
                    if len(word[1]) == depth + 1:
                        yield word[0], least[1]
                    else:
                        going_on.append(word)
                if going_on:
                    below.append((*least, grown, going_on))
        nodes, depth = below, depth + 1


def count_tokens(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, n_pretokens, n_tokens of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(piece_costs(path))

    def run(batches):
        v, known, held = Vocabulary(sent.value), {}, 0
        for batch in batches:
            n, pre = [], []
            for _, texts in bpe.slices(batch.column("text")):
                if held > KNOWN_BYTES:
                    known.clear()
                    held = 0
                cut = [PRE_TOKEN.findall(t) for t in texts]
                new = [w for w in set().union(*cut) if w not in known]
                if new:
                    raw = [w.encode() for w in new]
                    known.update(zip(new, count_words(raw, v).tolist()))
                    held += sum(map(len, raw)) + WORD_BYTES * len(raw)
                n += [sum(map(known.__getitem__, ws)) for ws in cut]
                pre += map(len, cut)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_chars"), pa.array(pre, pa.int64()), pa.array(n, pa.int64())], ["doc_id", "n_chars", "n_pretokens", "n_tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(F.char_length(text_col), F.lit(0)).cast("long").alias("n_chars"))
    return rows.mapInArrow(run, "doc_id long, n_chars long, n_pretokens long, n_tokens long")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(common.documents(spark, sf_dir))
