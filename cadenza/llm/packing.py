"""Packing documents into sequences by Karmarkar-Karp multiway differencing.

A document is its token ids and a separator. Whole windows are cut off its front; what
is left of it, shorter than a window, is packed with others. Documents are packed in
groups, runs of rows of about GROUP_DOCS documents or GROUP_IDS ids that a task reads one
after another, so nothing is shuffled and the ids are made and cut in one pass.

In a group, differencing starts with a partial partition for each rest, one window of m
filled. The two partial partitions with the largest imbalance (largest less smallest
window) merge, the largest windows of one with the smallest of the other, until one
partition is left, with m windows of near-equal size. m begins with the least number
that could do and rises whenever the capacity is exceeded. The windows then fit but are not quite
full; so from the smallest ones pieces move to those with room, cut where the room
ends. All windows but the last one dissolved end up full; that one is cut at powers of two, which need
no padding. So only windows' rests of one group are short, about ten sequences.

Defined results: null is the empty text, which is its separator only; texts of any
length are packed whole; rows that repeat a doc_id are documents of their own, without
an id that tells them apart; a null doc_id stays null; an empty table gives an empty
result; further columns are ignored. Sequence numbers are unique, not consecutive: they
hold the number of the task's partition.
"""

from __future__ import annotations

import bisect
import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, common

CAPACITY, SEPARATOR = 1024, 0
GROUP_DOCS, GROUP_IDS = 2048, 1 << 21


def difference(sizes: list[int], windows: int) -> list[list[int]]:
    """Deal ``sizes`` into so many windows of near-equal sums; the places of each window's sizes."""
    # A partial partition: its windows that hold something, (sum, first place) in ascending order, and a number against ties.
    follow: list[int] = [-1] * len(sizes)
    last = list(range(len(sizes)))  # of the run that begins at a place
    queue = [(-size, k, [(size, k)]) for k, size in enumerate(sizes)]
    heapq.heapify(queue)
    number = len(sizes)
    while len(queue) > 1:
        one, other = heapq.heappop(queue)[2], heapq.heappop(queue)[2]
        if len(one) < len(other):
            one, other = other, one
        free = windows - len(one)
        alone, opposed = (other[-free:], other[:-free]) if free else ([], other)
        if len(opposed) == 1:  # the usual case, without sorting anew
            (size, k), (mine, j) = opposed[0], one.pop(0)
            follow[last[j]], last[j] = k, last[k]
            bisect.insort(one, (mine + size, j))
        elif opposed:
            for place, (size, k) in enumerate(reversed(opposed)):
                mine, j = one[place]
                follow[last[j]], last[j] = k, last[k]
                one[place] = (mine + size, j)
            one.sort()
        if len(alone) == 1:
            bisect.insort(one, alone[0])
        elif alone:
            one += alone
            one.sort()
        least = one[0][0] if len(one) == windows else 0
        heapq.heappush(queue, (least - one[-1][0], number, one))
        number += 1
    out = []
    for _, k in queue[0][2] if queue else ():
        own = []
        while k >= 0:
            own.append(k)
            k = follow[k]
        out.append(own)
    return out


def windows_of(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Near-equal windows within the capacity, which no size exceeds; the places of each window's sizes."""
    windows = max(1, -(-sum(sizes) // capacity))
    while True:
        dealt = difference(sizes, windows)
        if all(sum(sizes[k] for k in own) <= capacity for own in dealt):
            return dealt
        windows += max(1, windows // 64)


def fill(pieces: list[list[tuple[int, int, int]]], capacity: int = CAPACITY) -> list[list[tuple[int, int, int]]]:
    """Windows of pieces (document, start, length): the smallest ones move to where there is room, the last of them is cut at powers of two."""
    room = lambda own: capacity - sum(p[2] for p in own)
    left = sorted(pieces, key=room)
    full, i, j = [], 0, len(left) - 1
    while i < j:
        space = room(left[i])
        while space and i < j:
            doc, start, length = left[j].pop()
            moved = min(space, length)
            left[i].append((doc, start, moved))
            space -= moved
            if moved < length:
                left[j].append((doc, start + moved, length - moved))
            elif not left[j]:
                j -= 1
        if space:
            break
        full.append(left[i])
        i += 1
    rest = left[i] if i <= j else []
    total = sum(p[2] for p in rest)
    while total:
        size, own = 1 << total.bit_length() - 1, []
        total -= size
        while size:
            doc, start, length = rest.pop()
            moved = min(size, length)
            own.append((doc, start, moved))
            size -= moved
            if moved < length:
                rest.append((doc, start + moved, length - moved))
        full.append(own)
    return full


def pack_lengths(lengths: list[int], capacity: int = CAPACITY) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (document, start, length) of documents of the given lengths."""
    out = [[(k, start, capacity)] for k, n in enumerate(lengths) for start in range(0, n - capacity + 1, capacity)]
    rests = [(k, n - n % capacity, n % capacity) for k, n in enumerate(lengths) if n % capacity]
    dealt = windows_of([r[2] for r in rests], capacity) if rests else []
    return out + fill([[rests[k] for k in own] for own in dealt], capacity)


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, digest: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece: doc_id, start, length, ids (or, with ``digest``, ids_crc32), doc_tokens, sequence_id, offset.

    ``capacity`` is a power of two.
    """
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("the capacity must be a power of two")
    tables = docs.sparkSession.sparkContext.broadcast(bpe.load_tables(path or bpe.default_path()))

    def pieces(names, sizes, parts, sequence):
        """A group's pieces, about 2 ** 18 ids to a batch; ``parts``: its ids in order."""
        ids = np.concatenate(parts).astype("<u4")
        begin = np.cumsum(sizes) - sizes
        rows, held, first = [], 0, sequence
        for own in pack_lengths(sizes.tolist(), capacity):
            offset = 0
            for k, start, length in own:
                rows.append((k, start, length, sequence, offset))
                offset += length
            sequence += 1
            held += offset
            if held >= 1 << 18:
                yield batch_of(names, sizes, ids, begin, rows), sequence - first
                rows, held, first = [], 0, sequence
        if rows:
            yield batch_of(names, sizes, ids, begin, rows), sequence - first

    def batch_of(names, sizes, ids, begin, rows):
        k, start, length, sequence, offset = (np.array(c, np.int64) for c in zip(*rows))
        places = begin[k] + start
        if digest:
            raw = memoryview(ids).cast("B")
            shown = pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(places.tolist(), (places + length).tolist())], pa.int64())
        else:
            shown = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]), pa.int32()), pa.array(ids[common.gather(places, length)].astype(np.int32)))
        return pa.RecordBatch.from_arrays(
            [names.take(pa.array(k)), pa.array(start), pa.array(length), shown, pa.array(sizes[k]), pa.array(sequence), pa.array(offset)],
            ["doc_id", "start", "length", "ids_crc32" if digest else "ids", "doc_tokens", "sequence_id", "offset"],
        )

    def run(batches):
        encoder, sequence = bpe.Encoder(tables.value), TaskContext.get().partitionId() << 33
        names, sizes, parts, n_ids, n_docs = [], [], [], 0, 0
        for batch in batches:
            for first, texts in bpe.slices(batch.column("text")):
                ids, bounds = encoder.encode(texts)
                own = np.diff(bounds) + 1
                with_end = np.full(len(ids) + len(texts), SEPARATOR, np.int32)
                with_end[np.arange(len(ids)) + np.repeat(np.arange(len(texts)), own - 1)] = ids
                names.append(batch.column("doc_id").slice(first, len(texts)))
                sizes.append(own)
                parts.append(with_end)
                n_ids, n_docs = n_ids + len(with_end), n_docs + len(texts)
                if n_docs >= GROUP_DOCS or n_ids >= GROUP_IDS:
                    for out, used in pieces(pa.concat_arrays(names), np.concatenate(sizes), parts, sequence):
                        yield out
                        sequence += used
                    names, sizes, parts, n_ids, n_docs = [], [], [], 0, 0
        if n_docs:
            for out, _ in pieces(pa.concat_arrays(names), np.concatenate(sizes), parts, sequence):
                yield out

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    shown = "ids_crc32 long" if digest else "ids array<int>"
    return rows.mapInArrow(run, f"doc_id long, start long, length long, {shown}, doc_tokens long, sequence_id long, offset long")


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.documents(spark, sf_dir), digest=True)
