"""Centroid clustering by equal-average equal-variance search.

Vectors become integers, floor(SCALE * x) for each component. A round assigns every
vector to its nearest centroid and moves each centroid to the floor of its vectors'
mean. Centroids are sorted by the mean of their components; a vector scans outward from
its own mean, and stops on a side where the means alone are too far apart; of the
centroids it passes, those whose deviation from their mean differs too much are
rejected (the squared distance is at least k times the squared difference of means plus
the squared difference of deviations). What is left is measured in exact integers. The
bounds are floats with a margin, and only a bound above the best distance rejects, so
equal distances are decided by the smaller number.

A task adds up its vectors' components by cluster, so a round moves one row for each
task and cluster, and the driver sees centroids only.

Defined results: vectors that are null, have another number of components, or hold null or
non-finite ones take no part; rows that repeat a vec_id are vectors of their own; a null
vec_id begins a centroid only where there are too few others; ties of hashes go by the
vector; fewer vectors than centroids give fewer centroids; a centroid that gets no vector
stays; components of over LARGEST in size are an error, as their squared distances don't
fit 64 bits; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common

COMPONENTS, SCALE, CENTROIDS, ROUNDS = 64, 64, 16, 3
LARGEST = 1 << 26  # of a component, after scaling
ROWS_AT_ONCE = 1 << 14


def _integers(components: int, scale: int):
    def run(batches):
        for batch in batches:
            column = batch.column("vector")
            whole = np.diff(column.offsets.to_numpy()) == components
            if column.null_count:
                whole &= column.is_valid().to_numpy(zero_copy_only=False)
            rows = np.flatnonzero(whole)
            flat = column.take(pa.array(rows)).flatten()
            x = (flat.cast(pa.float64()).fill_null(np.nan) if flat.null_count else flat.cast(pa.float64())).to_numpy(zero_copy_only=False).reshape(-1, components)
            sound = np.isfinite(x).all(axis=1)
            rows, x = rows[sound], np.floor(x[sound] * scale)
            if len(x) and np.abs(x).max() > LARGEST:
                raise ValueError(f"a component is over {LARGEST / scale:g} in size")
            ends = np.arange(len(rows) + 1) * components
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(rows)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x.astype(np.int64).ravel()))], ["vec_id", "v"])

    return run


def integer_vectors(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, v: floor(scale * x) for each component x, as a double; vectors that are not sound are left out."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    return rows.mapInArrow(_integers(components, scale), "vec_id long, v array<long>")


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Number and squared distance of each vector's nearest centroid (of equals, the smaller number), and how many distances were measured."""
    n, k = x.shape
    sums, own = centroids.sum(axis=1), x.sum(axis=1)
    spread = lambda v, s: np.sqrt(np.maximum(0.0, (v.astype(np.float64) ** 2).sum(axis=1) - s.astype(np.float64) ** 2 / k))
    order = np.argsort(sums, kind="stable")
    sums, spreads, mine = sums[order], spread(centroids, sums)[order], spread(x, own)
    low = np.searchsorted(sums, own) - 1
    high = low + 1
    best, which, measured = np.full(n, np.iinfo(np.int64).max), np.full(n, len(centroids)), 0
    going = np.arange(n)
    largest = float(np.abs(np.concatenate([sums, own])).max()) if n else 0.0
    slack = 1e-9 * (largest**2 / k + float(max(spreads.max(), mine.max() if n else 0.0)) ** 2)  # what rounding may add to a bound
    while len(going):
        down = np.where(low[going] >= 0, own[going] - sums[np.maximum(low[going], 0)], np.iinfo(np.int64).max)
        up = np.where(high[going] < len(sums), sums[np.minimum(high[going], len(sums) - 1)] - own[going], np.iinfo(np.int64).max)
        below = down <= up
        at = np.where(below, low[going], high[going])
        bound = np.minimum(down, up).astype(np.float64) ** 2 / k - slack
        on = bound <= best[going]  # the other side is farther still, so who is not on is done
        on &= (at >= 0) & (at < len(sums))
        going, at, below, bound = going[on], at[on], below[on], bound[on]
        low[going[below]] -= 1
        high[going[~below]] += 1
        near = bound + (mine[going] - spreads[at]) ** 2 <= best[going]
        rows, at = going[near], order[at[near]]
        measured += len(rows)
        far = ((x[rows] - centroids[at]) ** 2).sum(axis=1)
        better = (far < best[rows]) | ((far == best[rows]) & (at < which[rows]))
        best[rows[better]], which[rows[better]] = far[better], at[better]
    return which, best, measured


def _matrix(batch) -> np.ndarray:
    return batch.column("v").flatten().to_numpy().reshape(batch.num_rows, -1)


def _sums(sent):
    """Count and componentwise sum of each cluster's vectors, a row for each cluster that the task has seen."""

    def run(batches):
        centroids = sent.value
        counts, sums = np.zeros(len(centroids), np.int64), np.zeros_like(centroids)
        for batch in batches:
            x = _matrix(batch)
            for at in range(0, len(x), ROWS_AT_ONCE):
                part = x[at : at + ROWS_AT_ONCE]
                which, _, _ = nearest(part, centroids)
                counts += np.bincount(which, minlength=len(centroids))
                np.add.at(sums, which, part)
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(counts[seen]), pa.array(list(sums[seen]), pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    return run


def _assigned(sent):
    def run(batches):
        for batch in batches:
            x, which, far = _matrix(batch), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for at in range(0, len(x), ROWS_AT_ONCE):
                a, b, _ = nearest(x[at : at + ROWS_AT_ONCE], sent.value)
                which.append(a)
                far.append(b)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(np.concatenate(which).astype(np.int32)), pa.array(np.concatenate(far))], ["vec_id", "cluster", "distance"])

    return run


def first_centroids(whole: DataFrame, count: int) -> np.ndarray:
    """The vectors with the smallest SHA-256 of '1:' and their id."""
    by_hash = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256).asc_nulls_last()
    return np.array([r.v for r in whole.orderBy(by_hash, "v").limit(count).collect()], np.int64)  # ``count`` rows


def moved(whole: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Every centroid that has vectors becomes the floor of their mean."""
    sent = whole.sparkSession.sparkContext.broadcast(centroids)
    parts = whole.mapInArrow(_sums(sent), "cluster int, n long, sums array<long>").select("cluster", "n", F.posexplode("sums").alias("i", "x"))
    new = centroids.copy()
    for r in parts.groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect():  # centroids x components rows
        new[r.cluster, r.i] = int(r.x) // r.n
    return new


def cluster(vectors: DataFrame, centroids: int = CENTROIDS, rounds: int = ROUNDS, components: int = COMPONENTS, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """vec_id, cluster, distance, cluster_inertia, inertia for every sound vector; and the final centroids."""
    whole = common.stored(integer_vectors(vectors, components, scale, id_col, vector_col))
    now = first_centroids(whole, centroids)
    if not len(now):
        now = np.zeros((1, components), np.int64)
    for _ in range(rounds):
        now = moved(whole, now)
    sent = whole.sparkSession.sparkContext.broadcast(now)
    rows = common.stored(whole.mapInArrow(_assigned(sent), "vec_id long, cluster int, distance long"))
    sums = [0] * len(now)
    for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect():  # a row for each centroid
        sums[r.cluster] = int(r.d)
    of = F.element_at(F.lit(sums).cast("array<bigint>"), F.col("cluster") + 1)
    return rows.withColumns({"cluster_inertia": of, "inertia": F.lit(sum(sums)).cast("long")}), now


def op11_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, centroids = cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    return rows.withColumn("centroid_sha256", F.element_at(F.lit(digests), F.col("cluster") + 1))


def _rounds() -> str:
    out = ["c0 AS (SELECT k, generate_subscripts(v, 1) AS i, unnest(v) AS c FROM (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS k, v FROM e) WHERE k < 16)"]
    for n in range(ROUNDS + 1):
        out.append(f"d{n} AS (SELECT r, k, sum((x - c) * (x - c))::BIGINT AS d FROM l JOIN c{n} USING (i) GROUP BY ALL)")
        out.append(f"a{n} AS (SELECT r, arg_min(k, (d, k)) AS k, min(d) AS d FROM d{n} GROUP BY ALL)")
        if n < ROUNDS:
            out.append(f"m{n} AS (SELECT k, i, ((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS c FROM l JOIN a{n} USING (r) GROUP BY ALL)")
            out.append(f"c{n + 1} AS (SELECT k, i, coalesce(m{n}.c, c{n}.c) AS c FROM c{n} LEFT JOIN m{n} USING (k, i))")
    return ",\n".join(out)


SQL = f"""
WITH e AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE len(embedding) = 64 AND list_count(list_filter(embedding, lambda x: isfinite(x))) = 64
),
l AS (SELECT r, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM e),
{_rounds()},
h AS (SELECT k, sha256(string_agg(c::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c{ROUNDS} GROUP BY k)
SELECT vec_id, k::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY k))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, centroid_sha256
FROM a{ROUNDS} JOIN e USING (r) JOIN h USING (k)
"""
