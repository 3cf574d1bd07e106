"""Exact top-k by inner product with block-at-a-time pruning.

Vectors become integers, floor(256 * x); a component is a term with a signed
weight. Candidates are dealt into groups of bounded size: by the nearest of at most
PIVOTS sample vectors, and by a hash within a cell that is too large, so that a group
holds vectors of one direction. In a group they are cut at medians into blocks, each
with its forward index (the rows) and the largest and smallest weight of every term.
For a query, the sum over its terms of weight times the block's best weight
bounds every score in the block, so a query takes the blocks in the order of
their bounds, in rounds of 1, 2, 4 and so on, and stops when the next bound is below its
k-th score.

A query meets its own group first. Its k-th score there goes on as the floor: the same
bound, taken over whole groups, says which other groups can reach it. Queries are dealt
into blocks too, and a block meets the groups that a query of it can reach; blocks and
groups travel as one row each, their vectors packed, so there is a row for each such
meeting and none for a query and a group. In a meeting a query that can't reach the group
is left out by the bounds of its blocks. A window merges the results.

What bounds can skip depends on the vectors. Where these have no directions in common
(many components, all alike), every block can reach every floor, and all are scored.

Defined results: vectors that are null or hold null or non-finite components (also
such as are beyond a double when taken 256-fold),
and rows without an id, take no part; missing components of shorter vectors
count as 0; rows that share a vec_id are one vector (the smallest by array
order); scores are exact integers, and beyond the range of a long they stop at
its ends; ties go to the smaller vec_id; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from . import common

K, QUERY_EVERY, PIVOTS = 5, 50, 256
GROUP_ROWS, QUERY_ROWS, BLOCK_ROWS = 8192, 4096, 32  # vectors in a candidate group, a query group, a block
_EXACT = float(1 << 53)
_TOP = (1 << 63) - 1


def _matrix(vectors, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for row, v in zip(out, vectors):
        row[: len(v)] = v
    return out


def block_order(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of the rows, and where its blocks begin: cut at the median of the widest term, again and again."""
    parts, waiting = [], [np.arange(len(v))]
    while waiting:
        rows = waiting.pop()
        if len(rows) <= BLOCK_ROWS or not v.shape[1]:
            parts += [rows[s : s + BLOCK_ROWS] for s in range(0, len(rows), BLOCK_ROWS)]
            continue
        own = v[rows]
        term = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
        order = np.argsort(own[:, term], kind="stable")
        middle = -(-len(rows) // (2 * BLOCK_ROWS)) * BLOCK_ROWS  # so that the left part has full blocks
        waiting += [rows[order[middle:]], rows[order[:middle]]]
    sizes = np.array([len(p) for p in parts], np.int64)
    return np.concatenate(parts) if parts else np.zeros(0, np.int64), np.cumsum(sizes) - sizes


def bounds(q: np.ndarray, most: np.ndarray, least: np.ndarray) -> np.ndarray:
    """The largest score that each row of q can have in each box."""
    return np.maximum(q, 0) @ most.T + np.minimum(q, 0) @ least.T


def search(qid: np.ndarray, q: np.ndarray, floor: np.ndarray, vid: np.ndarray, v: np.ndarray, k: int = K) -> tuple[list[list[tuple[int, int]]], int, int]:
    """For every row of q its k best rows of v that reach its floor, as (-score, id), best first; blocks that were scored, and all that there are, summed over queries."""
    if q.size and v.size and float(np.abs(q).max()) * float(np.abs(v).max()) * q.shape[1] >= _EXACT:
        q, v = (np.array([[int(x) for x in row] for row in m], dtype=object) for m in (q, v))
    order, starts = block_order(v)
    vid, v = vid[order], v[order]
    ends = np.append(starts[1:], len(v))
    most = np.array([v[a:b].max(axis=0) for a, b in zip(starts, ends)]).reshape(len(starts), -1)
    least = np.array([v[a:b].min(axis=0) for a, b in zip(starts, ends)]).reshape(len(starts), -1)
    bound = bounds(q, most, least)
    order = np.argsort(-bound, axis=1, kind="stable")
    low = np.array(floor, dtype=object if v.dtype == object else float)
    best = [np.zeros(0, np.int64), np.zeros(0, low.dtype), np.zeros(0, np.int64)]  # query, score, id; best first for each query
    open_, step, width, scored = np.arange(len(qid)), 0, 1, 0
    while len(open_) and step < len(starts):  # rounds of 1, 2, 4 .. blocks for each query, so that few are needed where little can be skipped
        block = order[open_, step : step + width]
        take = bound[open_[:, None], block] >= low[open_][:, None]
        open_, block, take = open_[take[:, 0]], block[take[:, 0]], take[take[:, 0]]
        who, which = np.repeat(open_, take.sum(axis=1)), block[take]
        scored += len(who)
        by = np.argsort(which, kind="stable")
        who, which = who[by], which[by]
        hits = [best]
        for part in np.split(np.arange(len(who)), np.flatnonzero(which[1:] != which[:-1]) + 1) if len(who) else []:
            rows, own = slice(starts[which[part[0]]], ends[which[part[0]]]), who[part]
            scores = q[own] @ v[rows].T
            i, j = np.nonzero((scores >= low[own][:, None]) & (vid[rows][None, :] != qid[own][:, None]))
            hits.append([own[i], scores[i, j], vid[rows][j]])
        of, score, ids = (np.concatenate(c) for c in zip(*hits))
        by = np.lexsort((ids, -score, of))
        of, score, ids = of[by], score[by], ids[by]
        place = np.arange(len(of)) - np.searchsorted(of, of)
        best = [c[place < k] for c in (of, score, ids)]
        full = place == k - 1
        low[of[full]] = np.maximum(low[of[full]], score[full])
        step, width = step + width, 2 * width
    found = [[] for _ in qid]
    for i, s, c in zip(*best):
        found[i].append((-int(s), int(c)))
    return found, scored, len(qid) * len(starts)


def group_top_k(qid: np.ndarray, q: np.ndarray, vid: np.ndarray, v: np.ndarray, k: int = K, floor: np.ndarray | None = None) -> pd.DataFrame:
    """The k best rows of v for every row of q, by exact score, then by smaller id; scores are kept within a long."""
    found, _, _ = search(qid, q, np.full(len(qid), -np.inf) if floor is None else floor, vid, v, k)
    rows = [(int(qid[i]), c, max(-_TOP - 1, min(_TOP, -s))) for i, best in enumerate(found) for s, c in best]
    return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"]).astype("int64")


_RESULT = "query_id long, vec_id long, score long"


def _own_group(k: int):
    def run(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        """The best of a query's own group; and, in a row of its own, the group's box."""
        v = _matrix(rows.v, max(rows.v.map(len)))
        if len(queries):
            out = group_top_k(queries.vec_id.to_numpy(), _matrix(queries.v, v.shape[1]), rows.vec_id.to_numpy(), v, k)
        else:
            out = pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        n = len(out)
        return pd.DataFrame(
            {
                **{c: pd.array([*out[c], None], "Int64") for c in ("query_id", "vec_id", "score")},
                "g": pd.array([None] * n + [int(rows.g.iloc[0])], "Int64"),
                "most": [None] * n + [v.max(axis=0).tolist()], "least": [None] * n + [v.min(axis=0).tolist()],
                "ids": [None] * n + [rows.vec_id.to_numpy().tolist()], "packed": [None] * n + [v.astype("<f8").tobytes()],
            }
        )

    return run


def _reachable(queries: pd.DataFrame, boxes: pd.DataFrame) -> pd.DataFrame:
    """(query block, group) pairs of which the group's bound reaches the floor of one of the block's queries."""
    if not len(queries) or not len(boxes):
        return pd.DataFrame({"qg": [], "g": []}).astype("int64")
    width = max(queries.v.map(len).max(), boxes.most.map(len).max())
    # a missing component counts as 0; in a box of shorter vectors so do its ends
    q, most, least = _matrix(queries.v, width), _matrix(boxes.most, width), _matrix(boxes.least, width)
    bound = bounds(q, most, least) + np.abs(q) @ np.maximum(np.abs(most), np.abs(least)).T * 1e-12  # sums of large numbers are rounded
    can = (bound >= queries.floor.to_numpy()[:, None]) & (queries.g.to_numpy()[:, None] != boxes.g.to_numpy()[None, :])
    g = boxes.g.to_numpy()[can.any(axis=0)]
    return pd.DataFrame({"qg": np.full(len(g), queries.qg.iloc[0]), "g": g}).astype("int64")


def _packed_queries(queries: pd.DataFrame) -> pd.DataFrame:
    q = _matrix(queries.v, queries.v.map(len).max())
    return pd.DataFrame({"qg": [queries.qg.iloc[0]], "qids": [queries.vec_id.tolist()], "floors": [queries.floor.tolist()], "gs": [queries.g.tolist()], "q": [q.astype("<f8").tobytes()]})


def _unpacked(raw: bytes, n: int, width: int) -> np.ndarray:
    own = np.frombuffer(raw, "<f8").reshape(n, -1)
    return np.hstack([own, np.zeros((n, width - own.shape[1]))])


def _meet(k: int):
    def run(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        """One block of queries and one group, a row each; queries of the group itself have met it."""
        if not len(queries) or not len(rows):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        one, other = queries.iloc[0], rows.iloc[0]
        qids, ids, away = np.array(one.qids, np.int64), np.array(other.ids, np.int64), np.array(one.gs) != other.g
        width = max(len(one.q) // 8 // len(qids), len(other.packed) // 8 // len(ids))
        q, v = _unpacked(one.q, len(qids), width), _unpacked(other.packed, len(ids), width)
        return group_top_k(qids[away], q[away], ids, v, k, np.array(one.floors)[away])

    return run


def _grouped(valid: DataFrame, n: int) -> tuple[DataFrame, int]:
    """``valid`` with g, its group, and the number of groups."""
    if n <= GROUP_ROWS:
        return valid.withColumn("g", F.lit(0)), 1
    # at most PIVOTS rows come to the driver and go to every task
    pivots = [r.v for r in valid.orderBy(F.xxhash64("vec_id")).limit(min(PIVOTS, math.ceil(n / GROUP_ROWS))).select("v").collect()]
    sent = valid.sparkSession.sparkContext.broadcast(pivots)

    def nearest(batches):
        for rows in batches:
            width = max([*map(len, sent.value), *rows.v.map(len)], default=0)
            p = _matrix(sent.value, width)
            cell = np.argmax(_matrix(rows.v, width) @ p.T - (p * p).sum(axis=1) / 2, axis=1) if len(rows) else []
            yield rows.assign(cell=np.asarray(cell, np.int32))

    celled = common.stored(valid.mapInPandas(nearest, common.with_fields(valid, "cell int")))
    sizes = dict(celled.groupBy("cell").count().collect())  # at most PIVOTS rows
    parts = [math.ceil(sizes.get(c, 0) / GROUP_ROWS) for c in range(len(pivots))]
    first = np.cumsum([0, *parts]).tolist()
    of = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("cell") + 1)
    return celled.withColumn("g", (of(first[:-1]) + F.pmod(F.xxhash64("vec_id"), F.greatest(of(parts), F.lit(1)))).cast("int")).drop("cell"), first[-1]


def exact_top_k(vectors: DataFrame, every: int = QUERY_EVERY, k: int = K) -> DataFrame:
    """For each vector whose vec_id is divisible by ``every``, its k best other vectors."""
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double") * 256.0) == float("inf")))
    whole = F.transform("embedding", lambda x: F.floor(F.lit(256.0) * x.cast("double")).cast("double"))
    valid = vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~odd).select("vec_id", whole.alias("v"))
    valid = common.stored(valid.groupBy("vec_id").agg(F.min("v").alias("v")))
    n, n_queries = valid.agg(F.count("*"), F.count_if(F.col("vec_id") % every == 0)).first()
    rows, groups = _grouped(valid, n)
    queries = rows.filter(F.col("vec_id") % every == 0)
    own = common.stored(queries.groupBy("g").cogroup(rows.groupBy("g")).applyInPandas(_own_group(k), _RESULT + ", g long, most array<double>, least array<double>, ids array<long>, packed binary"))
    found = own.filter("query_id IS NOT NULL").select("query_id", "vec_id", "score")
    if groups > 1:
        dealt = lambda c, m: F.pmod(F.xxhash64(c), F.lit(m)).cast("int")
        spread = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
        query_groups, box_groups = math.ceil(n_queries / QUERY_ROWS), math.ceil(groups / GROUP_ROWS)
        floors = common.stored(found.groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score")).alias("floor")).withColumnRenamed("query_id", "vec_id"))
        low = F.col("floor").cast("double") - F.abs(F.col("floor").cast("double")) * 1e-15  # a double may be above a large score
        asked = queries.join(floors.hint("shuffle_merge"), "vec_id", "left").withColumn("floor", F.coalesce(low, F.lit(float("-inf"))))
        asked = common.stored(asked.withColumn("qg", dealt("vec_id", max(1, query_groups))))
        boxes = own.filter("g IS NOT NULL").select("g", "most", "least").withColumn("bg", dealt("g", box_groups)).withColumn("qg", spread(max(1, query_groups)))
        met = asked.withColumn("bg", spread(box_groups)).groupBy("bg", "qg").cogroup(boxes.groupBy("bg", "qg")).applyInPandas(_reachable, "qg long, g long")
        met = common.stored(met)
        blocks = common.stored(asked.groupBy("qg").applyInPandas(_packed_queries, "qg long, qids array<long>, floors array<double>, gs array<long>, q binary"))
        sent = met.join(blocks.hint("shuffle_merge"), "qg")
        again = met.select(*[(F.col(c) + 0).alias(c) for c in ("qg", "g")])  # columns of its own, or Spark can't tell the two sides apart
        held = again.join(own.filter("g IS NOT NULL").select("g", "ids", "packed").hint("shuffle_merge"), "g")
        more = sent.groupBy("g", "qg").cogroup(held.groupBy("g", "qg")).applyInPandas(_meet(k), _RESULT)
        found = found.unionByName(more)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL = """
WITH v AS (
  SELECT vec_id, min(list_transform(embedding, lambda x: floor(256 * x::DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 GROUP BY vec_id
),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
