"""Near-duplicate documents by circulant MinHash, banding and exact verification.

A document is the set of its distinct k-word shingles, hashed in numpy. One
permutation places a shingle on a ring of bins; a second one, read from that
place on, gives all signature coordinates: coordinate i is the least entry of
the second permutation, shifted i places, over the document's bins. Bands of the
signature are the buckets.

Rows with equal word sequences (by SHA-256) are one node from there on, so a node is a
text and not an id. In every bucket the members are held against hubs instead of
against each other, and every link between nodes is confirmed on the full shingle sets
of the two texts, those of equal hashes too. For that, the members of a hub are dealt
into parts of about MEMBERS, and the hub's text is sent once to each part:

1. each node against the hub (least node) it shares the most buckets with;
2. in buckets that still hold several components, each node against the
   bucket's hub and a random member of the bucket, if they are of other components;
3. in buckets that still hold several components, an inverted index over the rarest
   shingles: a pair at the threshold shares one of each side's first n - 0.8 n + 1
   shingles in order of rareness, so only those are joined on, and of the pairs they give
   only those whose sizes and places in that order allow a link are left. Between two
   components one pair is verified first, and the others only if it is no link.
   Shingles with over LIST such nodes are not joined on: nodes that have one are also
   held against each other in their buckets block by block, on 32-bit shingle hashes
   (pairs that are likely to be links are confirmed like the others).

Steps 2 and 3 leave out nodes and pairs that cannot reach the threshold: shingles
that no other component has can't be shared, and with those counted (a grouping
by shingle of the nodes still in question) the rest bounds the similarity.

After step 3 every two nodes of a bucket have been compared, or are already
connected, or differ too much in size to be linked; so components are exact for
all pairs that share a bucket. A pair with similarity 0.8 misses all buckets
with a probability of (1 - 0.8 ** 5) ** 32, about 3 in a million.

Aggregates that large groups (equal sets, buckets, common shingles, hubs) are joined
with are written first: both sides of such a join then come straight from a shuffle,
which is what lets Spark split a large group over tasks.

Defined results: null, empty and blank texts have no shingles, n_shingles 0, and
are linked with nothing; texts of fewer than k words have their whole word
sequence as one shingle; rows that repeat a doc_id are rows of their own, whether
their texts are equal or not; a row with a null doc_id links like any other and has
no id to offer, so its component_id is the smallest id it reaches, or null, and it is
never kept; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import common, graph

SHINGLE, PERCENT = 5, 80
RING_BITS, BANDS, ROWS = 20, 32, 5
RANDOM_HUBS = 1
LIST = 256  # nodes that have a shingle among their rarest, for the join on that shingle
BLOCK, BLOCK_SHINGLES = 512, 1 << 19  # nodes of one bucket that a task holds at once, and their shingles, about
MEMBERS = 128  # texts that one sending of their hub's text serves, about


@functools.lru_cache
def _ring(seed: int = 1) -> np.ndarray:
    """The second permutation, continued past its end by one signature's length, as overlapping windows."""
    ring = np.random.default_rng(seed).permutation(1 << RING_BITS).astype(np.uint32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([ring, ring[: BANDS * ROWS]]), BANDS * ROWS)


def word_numbers(offsets: np.ndarray, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Number of every word of every text, where each text's words begin (one place more than texts), a hash for each number, and each text's words joined by spaces."""
    raw, number = flat.tobytes().lower(), common.Numbers()  # bytes: only A-Z change, only ASCII white space splits
    texts = [raw[a:b].split() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
    begin = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])
    numbers = np.fromiter(map(number.__getitem__, itertools.chain.from_iterable(texts)), np.int64, int(begin[-1]))
    return numbers, begin, np.array([xxhash.xxh3_64_intdigest(w) for w in number], np.uint64), [b" ".join(t) for t in texts]


def shingle_sets(numbers: np.ndarray, begin: np.ndarray, hashes: np.ndarray, k: int) -> list[tuple[np.ndarray, int]]:
    """Of every text, the sorted distinct hashes of its shingles, and how many different shingles there are."""
    with np.errstate(over="ignore"):
        words = hashes[numbers]
        run = words.copy()
        for j in range(1, k):
            m = max(len(words) - j, 0)
            run[:m] = common.mix64(run[:m]) + words[j:]
        run = common.mix64(run)
        out = []
        for a, b in zip(begin[:-1].tolist(), begin[1:].tolist()):
            if b - a >= k:
                order = np.argsort(run[a : b - k + 1])
                own = run[a + order]
                same = own[1:] == own[:-1]
                one, other = a + order[1:][same], a + order[:-1][same]
                if all((numbers[one + j] == numbers[other + j]).all() for j in range(k)):
                    n = len(own) - len(one)
                else:  # a hash stands for several shingles
                    n = len(set(zip(*[numbers[a + j : b - k + 1 + j].tolist() for j in range(k)])))
                out.append((own[np.concatenate([[True], ~same])], n))
            elif b > a:
                own = np.uint64(b - a)
                for w in words[a:b]:
                    own = common.mix64(own) + w
                out.append((common.mix64(np.array([own])), 1))
            else:
                out.append((np.zeros(0, np.uint64), 0))
    return out


def signature(hashes: np.ndarray) -> np.ndarray:
    windows, bins = _ring(), np.unique(hashes >> np.uint64(64 - RING_BITS))
    best = None
    for a in range(0, len(bins), 2048):
        part = windows[bins[a : a + 2048].astype(np.int64)].min(axis=0)
        best = part if best is None else np.minimum(best, part)
    return best


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """(texts, coordinates) -> (texts, bands) of 64-bit bucket keys."""
    rows = signatures.reshape(len(signatures), BANDS, ROWS).astype(np.uint64)
    with np.errstate(over="ignore"):
        key = np.broadcast_to(common.mix64(np.arange(1, BANDS + 1, dtype=np.uint64)), rows.shape[:2])
        for j in range(ROWS):
            key = common.mix64(key + rows[:, :, j])
    return key.view(np.int64)


#: Of a row: its number, its id, and two hashes of id and text that find the text again.
SAME = ("r", "doc_id", "t", "u")


def _sketch(k: int):
    def run(batches):
        for batch in batches:
            sizes, prints, keys = [], [], []
            for _, offsets, flat in common.text_slices(batch.column("text")):
                numbers, begin, hashes, joined = word_numbers(offsets, flat)
                for (own, n), words in zip(shingle_sets(numbers, begin, hashes, k), joined):
                    sizes.append(n)
                    prints.append(hashlib.sha256(words).digest() if n else None)
                    keys.append(band_keys(signature(own)[None])[0] if n else None)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in SAME), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                [*SAME, "n_shingles", "print", "bands"],
            )

    return run


def shingles(text: str, k: int) -> set[tuple[bytes, ...]]:
    words = text.encode().lower().split()  # bytes: only A-Z change, only ASCII white space splits
    return set(zip(*[words[j:] for j in range(k)])) if len(words) >= k else {tuple(words)} if words else set()


def _verify(k: int, percent: int):
    """Rows in order of (b, part, side): the text of hub b, then those of its members; yields the pairs that are links."""
    def run(batches):
        hub_set = set()
        for batch in batches:
            left, right = [], []
            for at in range(0, batch.num_rows, 256):
                columns = (batch.column(c).slice(at, 256).to_pylist() for c in ("b", "side", "a", "text"))
                for b, side, a, text in zip(*columns):
                    own = shingles(text, k)
                    if side == 0:
                        hub_set = own
                        continue
                    shared = len(own & hub_set)
                    if own and 100 * shared >= percent * (len(own) + len(hub_set) - shared):
                        left.append(a)
                        right.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    return run


class _Links:
    """The confirmed links so far and the components that they make."""

    def __init__(self, texts: DataFrame, k: int, percent: int) -> None:
        self.texts, self.k, self.percent = texts, k, percent
        self.labels: DataFrame | None = None

    def confirm(self, pairs: DataFrame) -> None:
        """Verify written pairs (a, b), and join the components that the links connect."""
        parts = common.stored(pairs.groupBy("b").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("parts")))
        dealt = common.stored(pairs.join(parts.hint("shuffle_merge"), "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int").alias("part")))
        hubs = common.stored(dealt.select("b", "part").distinct())
        hubs = hubs.join(self.texts.withColumnRenamed("r", "b").hint("shuffle_merge"), "b").select("b", "part", F.lit(0).alias("side"), F.lit(None).cast("long").alias("a"), "text")
        members = dealt.join(self.texts.withColumnRenamed("r", "a").hint("shuffle_merge"), "a").select("b", "part", F.lit(1).alias("side"), "a", "text")
        both = hubs.union(members).repartition("b", "part").sortWithinPartitions("b", "part", "side")
        found = common.stored(both.mapInArrow(_verify(self.k, self.percent), "a long, b long"))
        if found.isEmpty():
            return
        links = self.label(found, "a", "b").select(F.col("label_a").alias("a"), F.col("label_b").alias("b"))
        new = graph.components(links).select(F.col("v").alias("u"), F.col("component").alias("m"))
        if self.labels is not None:
            old = self.labels.select(F.col("v").alias("u"), F.col("component").alias("m"))
            new = graph.follow(old, new).union(new.join(old, "u", "left_anti"))
        self.labels = common.stored(new.select(F.col("u").alias("v"), F.col("m").alias("component")))

    def label(self, rows: DataFrame, *columns: str) -> DataFrame:
        """Add label_<column>: the component of the node in each column, the node itself where it has no link."""
        for c in columns:
            if self.labels is None:
                rows = rows.withColumn(f"label_{c}", F.col(c))
            else:
                known = self.labels.select(F.col("v").alias(c), F.col("component").alias(f"label_{c}"))
                rows = rows.join(known, c, "left").withColumn(f"label_{c}", F.coalesce(f"label_{c}", c))
        return rows


def near_duplicates(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash (of id and text, see text_hash()), n_shingles, component_id, kept for every row of ``docs``."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    texts = texts.withColumns({"t": text_hash("doc_id", "text"), "u": F.xxhash64("text", F.lit("second"), "doc_id")})
    numbered = texts.withColumn("r", F.monotonically_increasing_id())  # written with the sketch, so it stays what it is
    sketch = common.stored(numbered.select(*SAME, "text").mapInArrow(_sketch(k), "r long, doc_id long, t long, u long, n_shingles long, print binary, bands array<long>"))
    # Equal word sequences are one node, known by the least of its rows.
    filled = sketch.filter("print IS NOT NULL")
    nodes = common.stored(filled.groupBy("print").agg(F.min("r").alias("node"), F.min("doc_id").alias("least")))
    rows = common.stored(filled.select("doc_id", "t", "n_shingles", "print").join(nodes.hint("shuffle_merge"), "print").drop("print"))
    sets = common.stored(filled.join(nodes.select(F.col("node").alias("r")).hint("shuffle_merge"), "r", "left_semi").select("r", "t", "u", "n_shingles", "bands"))
    members = sets.select(F.col("r").alias("a"), F.col("n_shingles").alias("n"), F.explode("bands").alias("key"))
    # Only buckets of two or more matter from here on.
    heads = common.stored(members.groupBy("key").agg(F.min("a").alias("b"), F.max("a").alias("most")).filter("b < most").drop("most"))
    members = common.stored(members.join(heads.hint("shuffle_merge"), "key"))
    star = members.filter("a <> b").groupBy("a", "b").agg(F.count("*").alias("met"))
    best = star.groupBy("a").agg(F.max(F.struct("met", (-F.col("b")).alias("minus"))).alias("x")).select("a", (-F.col("x.minus")).alias("b"))
    best = common.stored(best)
    links = None if best.isEmpty() else _linked(texts, sets, members, best, k, percent)
    if links is None or links.labels is None:
        known = rows.withColumn("component_id", F.col("least"))
    else:
        # the smallest id of every component's nodes, for each node, then for each row
        least = common.stored(links.labels.join(nodes.select(F.col("node").alias("v"), "least").hint("shuffle_merge"), "v"))
        smallest = common.stored(least.groupBy("component").agg(F.min("least").alias("component_id")))
        of_node = common.stored(least.select("component", F.col("v").alias("node")).join(smallest.hint("shuffle_merge"), "component").drop("component"))
        known = rows.join(of_node.withColumn("linked", F.lit(True)), "node", "left").withColumn("component_id", F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("least")))
    known = known.select("doc_id", "t", "n_shingles", "component_id").union(sketch.filter("print IS NULL").select("doc_id", "t", "n_shingles", "doc_id"))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))
    return known.select("doc_id", F.col("t").alias("text_hash"), "n_shingles", "component_id", kept.alias("kept"))


def text_hash(id_col: str, text_col: str) -> Column:
    """What tells rows of one id apart; null text is the empty text."""
    return F.xxhash64(F.col(id_col).cast("long"), F.coalesce(F.col(text_col), F.lit("")))


def _linked(texts: DataFrame, sets: DataFrame, members: DataFrame, best: DataFrame, k: int, percent: int) -> _Links:
    """The three steps. ``sets``: r, t, u of all nodes; ``members``: a, n, key, b of the buckets; ``best``: the pairs of step 1."""
    needed = sets.join(members.select(F.col("a").alias("r")).distinct().hint("shuffle_merge"), "r", "left_semi").select("r", "t", "u")
    own = texts.select("t", "u", "text").join(common.stored(needed).hint("shuffle_merge"), ["t", "u"]).dropDuplicates(["t", "u"])
    links = _Links(common.stored(own.select("r", "text")), k, percent)
    links.confirm(best)
    open_ = _open(links, members.drop("b"))
    if open_.isEmpty():
        return links
    open_, _ = _shared_counts(links, open_)
    drawn = [F.min(F.struct(F.xxhash64(F.lit(j), "a").alias("h"), "a", "n", "s", "label_a")).alias(f"hub{j}") for j in range(RANDOM_HUBS)]
    first = F.min(F.struct(F.col("a").alias("h"), "a", "n", "s", "label_a")).alias("hub")
    hub = lambda c: F.struct(*[F.col(f"{c}.{x}").alias(y) for x, y in OTHER.items()])
    hubs = open_.groupBy("key").agg(first, *drawn).select("key", F.explode(F.array_distinct(F.array(hub("hub"), *[hub(f"hub{j}") for j in range(RANDOM_HUBS)]))).alias("x"))
    hubs = common.stored(hubs.select("key", "x.*"))
    pairs = open_.join(hubs.hint("shuffle_merge"), "key").filter(_may_link(percent))
    tried = common.stored(_in_order(pairs).join(_in_order(best).hint("shuffle_merge"), ["a", "b"], "left_anti"))
    links.confirm(tried)
    tried = tried.union(_in_order(best))
    open_ = _open(links, open_.drop("label_a"))
    if open_.isEmpty():
        return links
    open_, sets = _shared_counts(links, open_)
    rare, common_ = _rare_pairs(open_, sets, percent)
    _confirm_between(links, rare, tried)
    if not common_.isEmpty():
        rest = _open(links, open_.drop("label_a").join(common_.hint("shuffle_merge"), "a", "left_semi"))
        if not rest.isEmpty():
            _confirm_between(links, _likely_pairs(rest, sets.select("a", "small"), percent), tried)
    return links


def _confirm_between(links: _Links, pairs: DataFrame, tried: DataFrame) -> None:
    """Verify those of the ``pairs`` that were not tried: of every two components one pair, then all whose components are still apart."""
    pairs = common.stored(_in_order(pairs).join(tried.hint("shuffle_merge"), ["a", "b"], "left_anti"))
    apart = common.stored(links.label(pairs, "a", "b").filter("label_a <> label_b"))
    if apart.isEmpty():
        return
    one = apart.groupBy(F.least("label_a", "label_b").alias("x"), F.greatest("label_a", "label_b").alias("y")).agg(F.min(F.struct("a", "b")).alias("p")).select("p.a", "p.b")
    one = common.stored(one)
    links.confirm(one)
    others = common.stored(links.label(apart.select("a", "b").join(one.hint("shuffle_merge"), ["a", "b"], "left_anti"), "a", "b").filter("label_a <> label_b").select("a", "b"))
    if not others.isEmpty():
        links.confirm(others)


def _in_order(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _open(links: _Links, members: DataFrame) -> DataFrame:
    """Members of the buckets that hold more than one component, with their component as label_a."""
    rows = common.stored(links.label(members, "a"))
    several = common.stored(rows.groupBy("key").agg(F.min("label_a").alias("x"), F.max("label_a").alias("y")).filter("x < y").select("key"))
    return common.stored(rows.join(several.hint("shuffle_merge"), "key", "left_semi"))


#: Columns of a bucket's member, and their names for the other one of a pair.
OTHER = {"a": "b", "n": "m", "s": "t", "label_a": "label_b"}


def _may_link(percent: int) -> Column:
    """Members of different components whose sizes and shareable shingles allow a link."""
    most = F.least("s", "t")
    return (F.col("label_a") != F.col("label_b")) & (most * 100 >= (F.col("n") + F.col("m") - most) * percent)


def _hashes(k: int):
    """Shingle hashes of documents, and their lower 32 bits."""
    def run(batches):
        for batch in batches:
            rows = [own for _, offsets, flat in common.text_slices(batch.column("text")) for own, _ in shingle_sets(*word_numbers(offsets, flat)[:3], k)]
            small = [np.unique(own.astype(np.uint32)).view(np.int32) for own in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("label_a"), pa.array([own.view(np.int64) for own in rows], pa.list_(pa.int64())), pa.array(small, pa.list_(pa.int32()))], ["a", "label_a", "hashes", "small"]
            )

    return run


def _shared_counts(links: _Links, open_: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``open_`` with s, the number of a document's shingles that open documents of other components have too, without those that have too few for any link; and of all of its documents a, label_a, hashes and small."""
    texts = links.texts.withColumnRenamed("r", "a").join(open_.select("a", "label_a").distinct().hint("shuffle_merge"), "a").select("a", "label_a", "text")
    sets = common.stored(texts.mapInArrow(_hashes(links.k), "a long, label_a long, hashes array<long>, small array<int>"))
    each = sets.select("a", "label_a", F.explode("hashes").alias("h"))
    several = common.stored(each.groupBy("h").agg(F.min("label_a").alias("x"), F.max("label_a").alias("y")).filter("x < y").select("h"))
    shared = common.stored(each.select("a", "h").join(several.hint("shuffle_merge"), "h", "left_semi").groupBy("a").agg(F.count("*").alias("s")))
    return common.stored(open_.drop("s").join(shared.hint("shuffle_merge"), "a").filter(F.col("s") * 100 >= F.col("n") * links.percent)), sets


def _rare_pairs(open_: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of different components that share one of their rarest shingles and may be links; and the documents a with a rare shingle that over LIST documents have.

    Of a document's n shingles, in order of rareness among the open documents, those that
    no other component has come first; they can't be shared, so they are counted only.
    """
    own = common.stored(open_.select("a", "n", "label_a").distinct())
    each = common.stored(sets.select("a", F.explode("hashes").alias("h")).join(own.hint("shuffle_merge"), "a"))
    often = common.stored(each.groupBy("h").agg(F.count("*").alias("df"), F.min("label_a").alias("x"), F.max("label_a").alias("y")).filter("x < y").select("h", "df"))
    shared = each.join(often.hint("shuffle_merge"), "h").groupBy("a", "n", "label_a").agg(F.array_sort(F.collect_list(F.struct("df", "h"))).alias("l"))
    s, need = F.size("l"), F.ceil(F.col("n") * percent / 100)
    rare = F.slice("l", F.lit(1), F.greatest(F.lit(0), (F.col("n") - need + 1 - (F.col("n") - s)).cast("int")))
    index = shared.select("a", "n", "label_a", (F.col("n") - s).alias("alone"), F.posexplode(rare).alias("at", "x")).select("a", "n", "label_a", (F.col("alone") + F.col("at")).alias("at"), F.col("x.h").alias("h"))
    index = common.stored(index)
    lists = common.stored(index.groupBy("h").agg(F.count("*").alias("size"), F.min("label_a").alias("x"), F.max("label_a").alias("y")).filter("x < y").select("h", "size"))
    index = common.stored(index.join(lists.hint("shuffle_merge"), "h"))
    one = index.filter(F.col("size") <= LIST).drop("size")
    other = one.select("h", *[F.col(c).alias(d) for c, d in (("a", "b"), ("n", "m"), ("label_a", "label_b"), ("at", "place"))])
    # the shared shingle and all behind it, on both sides
    most = 1 + F.least(F.col("n") - F.col("at") - 1, F.col("m") - F.col("place") - 1)
    pairs = one.join(other.hint("shuffle_merge"), "h").filter((F.col("a") > F.col("b")) & (F.col("label_a") != F.col("label_b")) & ((100 + percent) * most >= percent * (F.col("n") + F.col("m"))))
    return pairs.select("a", "b"), common.stored(index.filter(F.col("size") > LIST).select("a").distinct())


def _screen(percent: int):
    """Rows in order of (key, mine, theirs, side): side 0 is a block of documents, those of side 1 are held against it."""
    def run(batches):
        group, ids, labels, parts, index = None, [], [], [], None
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("key", "mine", "theirs"))))
            sides, rows, row_labels = (batch.column(c).to_pylist() for c in ("side", "a", "label_a"))
            lists = batch.column("small")
            offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
            left, right = [], []
            for i, key in enumerate(keys):
                own = flat[offsets[i] : offsets[i + 1]]
                if key != group:
                    group, ids, labels, parts, index = key, [], [], [], None
                if sides[i] == 0:
                    ids.append(rows[i])
                    labels.append(row_labels[i])
                    parts.append(own.copy())
                    continue
                if not ids:
                    continue
                if index is None:
                    sizes = np.array([len(p) for p in parts])
                    all_ = np.concatenate(parts)
                    order = np.argsort(all_, kind="stable")
                    index = all_[order], np.repeat(np.arange(len(parts)), sizes)[order], sizes, np.array(labels)
                hashes, owner, sizes, of = index
                low, high = np.searchsorted(hashes, own, "left"), np.searchsorted(hashes, own, "right")
                much = high - low
                met = np.bincount(owner[np.arange(int(much.sum())) + np.repeat(low - (np.cumsum(much) - much), much)], minlength=len(parts))
                good = (of != row_labels[i]) & (100 * met >= (percent - 1) * (sizes + len(own) - met))
                for j in np.flatnonzero(good):
                    left.append(rows[i])
                    right.append(ids[j])
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    return run


def _likely_pairs(open_: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of one bucket and different components whose hashes have about the similarity asked for.

    Of every bucket, the documents outside its largest component are held against
    all. Both are cut into blocks by their numbers and by their shingles, and each two blocks meet in one task.
    """
    sizes = open_.groupBy("key", "label_a").agg((F.count("*") / BLOCK + F.sum("n") / BLOCK_SHINGLES).alias("size"))
    total = sizes.groupBy("key").agg(F.max(F.struct("size", "label_a")).alias("x"), F.sum("size").alias("all"), F.count("*").alias("several")).filter("several > 1").select(
        "key", F.col("x.label_a").alias("main"), F.ceil("all").cast("int").alias("ours"), F.greatest(F.lit(1), F.ceil(F.col("all") - F.col("x.size"))).cast("int").alias("others")
    )
    rows = common.stored(open_.select("key", "a", "label_a").join(common.stored(total).hint("shuffle_merge"), "key"))
    dealt = lambda n: F.pmod(F.xxhash64("a"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    few = rows.filter("label_a <> main").select("key", each("ours").alias("mine"), dealt("others").alias("theirs"), F.lit(0).alias("side"), "a", "label_a")
    all_ = rows.select("key", dealt("ours").alias("mine"), each("others").alias("theirs"), F.lit(1).alias("side"), "a", "label_a")
    both = few.union(all_).join(sets.hint("shuffle_merge"), "a").select("key", "mine", "theirs", "side", "a", "label_a", "small")
    return both.repartition("key", "mine", "theirs").sortWithinPartitions("key", "mine", "theirs", "side").mapInArrow(_screen(percent), "a long, b long")


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.documents(spark, sf_dir), k=4, percent=80).drop("text_hash")


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: list_slice(w, i, i + 3)) WHEN len(w) > 0 THEN [w] ELSE [] END) AS s FROM w
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS v, doc_id AS x FROM documents UNION SELECT e.b, r.x FROM r JOIN e ON e.a = r.v AND r.x < e.b),
m AS (SELECT v, min(x) AS x FROM r GROUP BY v)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, x AS component_id, d.doc_id = x AS kept
FROM documents d JOIN m ON m.v = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
