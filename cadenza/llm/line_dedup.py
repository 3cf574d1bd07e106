"""Line dedup with overlapping three-line windows, in DataFrame functions only.

Every three consecutive lines of a document form a window. The first occurrence
of a window in the corpus, in order of (doc_id, place), stays; every later one
marks its three lines as covered, and the covered lines of a document, merged,
are removed. Where a later occurrence overlaps the first one in the same
document, only the lines beyond the first are covered.

Defined results: null text stays null and has no lines; the empty text has one
empty line; documents of under three lines have no window and stay as they are;
windows of blank lines only are left alone; rows that share doc_id and text are
one document and get the same decision; rows that share a doc_id with other
texts are documents of their own; an empty table gives an empty result; further
columns pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common

LINES = 3


def covered_lines(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """For each document with repeated windows: _id, _fp, covered (sorted line numbers, from 0)."""
    lines = F.split(F.col(text_col), "\n", -1)
    at = lambda i: F.get(F.col("_l"), i)
    window = lambda i: F.struct(  # noqa: E731  128 bits, so that no two windows of a corpus meet by chance
        i.cast("int").alias("p"),
        F.xxhash64(F.lit(1), at(i), at(i + 1), at(i + 2)).alias("h"),
        F.xxhash64(F.lit("second"), at(i + 2), at(i), at(i + 1)).alias("g"),
    )
    filled = lambda w: F.concat(at(w["p"]), at(w["p"] + 1), at(w["p"] + 2)).rlike(r"\S")
    windows = (
        docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_fp"), lines.alias("_l"))
        .filter(F.size("_l") >= LINES)
        .select("_id", "_fp", F.explode(F.filter(F.transform(F.sequence(F.lit(0), F.size("_l") - LINES), window), filled)).alias("w"))
        .select("_id", "_fp", "w.p", "w.h", "w.g")
    )
    windows = common.stored(windows)
    first = windows.groupBy("h", "g").agg(F.min(F.struct("_id", "_fp", "p")).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    first = common.stored(first)  # so that the join's sides come straight from their shuffles and Spark can split a common passage
    later = windows.join(first.hint("shuffle_merge"), ["h", "g"]).filter(F.struct("_id", "_fp", "p") != F.col("first"))
    same = F.col("_id").eqNullSafe(F.col("first._id")) & (F.col("_fp") == F.col("first._fp"))
    start = F.when(same, F.greatest(F.col("p"), F.col("first.p") + LINES)).otherwise(F.col("p"))
    return (
        later.select("_id", "_fp", F.explode(F.filter(F.sequence(F.col("p"), F.col("p") + LINES - 1), lambda k: k >= start)).alias("k"))
        .groupBy("_id", "_fp")
        .agg(F.sort_array(F.collect_set("k")).alias("covered"))
    )


def line_dedup(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``docs`` with the covered lines taken out of the text.

    Adds _n_lines and _n_removed (in place of columns of these names); the other
    columns are as they were.
    """
    docs, back = common.aside(docs, "_cid", "_cfp", "covered", "_l")
    docs = docs.drop("_n_lines", "_n_removed")
    covered = covered_lines(docs, text_col, id_col).withColumnsRenamed({"_id": "_cid", "_fp": "_cfp"})
    removed = F.coalesce(F.size("covered"), F.lit(0))
    kept = F.array_except(F.sequence(F.lit(0), F.size("_l") - 1), F.col("covered"))
    left = F.array_join(F.transform(kept, lambda i: F.get(F.col("_l"), i)), "\n")
    on = docs[id_col].eqNullSafe(F.col("_cid")) & (F.xxhash64(docs[text_col]) == F.col("_cfp"))
    joined = docs.join(covered.hint("shuffle_merge"), on, "left").withColumn("_l", F.split(docs[text_col], "\n", -1))
    return joined.select(
        *[(F.when(removed > 0, left).otherwise(docs[c]) if c == text_col else docs[c]).alias(c) for c in docs.columns],
        F.coalesce(F.size("_l"), F.lit(0)).alias("_n_lines"),
        removed.alias("_n_removed"),
    ).withColumnsRenamed(back)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup(common.documents(spark, sf_dir))
    return done.select("doc_id", F.col("_n_lines").cast("long").alias("n_lines"), F.col("_n_removed").cast("long").alias("n_removed"), F.sha2("text", 256).alias("text_sha256"))


SQL = r"""
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
w AS (
  SELECT doc_id, p - 1 AS p, l[p] AS a, l[p + 1] AS b, l[p + 2] AS c
  FROM (SELECT doc_id, l, unnest(range(1, len(l) - 1)) AS p FROM l WHERE len(l) >= 3)
),
f AS (SELECT *, first_value(doc_id) OVER o AS fid, first_value(p) OVER o AS fp FROM w WHERE regexp_matches(a || b || c, '\S')
      WINDOW o AS (PARTITION BY a, b, c ORDER BY doc_id, p)),
k AS (
  SELECT DISTINCT doc_id, unnest(range(p, p + 3)) AS k, CASE WHEN doc_id = fid THEN greatest(p, fp + 3) ELSE p END AS s
  FROM f WHERE doc_id <> fid OR p <> fp
),
c AS (SELECT doc_id, list(DISTINCT k) AS covered FROM k WHERE k >= s GROUP BY doc_id)
SELECT doc_id, coalesce(len(l), 0) AS n_lines, coalesce(len(covered), 0) AS n_removed,
       sha256(CASE WHEN covered IS NULL THEN text
              ELSE array_to_string(list_transform(list_filter(range(1, len(l) + 1), lambda i: NOT list_contains(covered, i - 1)), lambda i: l[i]), chr(10)) END) AS text_sha256
FROM l LEFT JOIN c USING (doc_id)
"""
