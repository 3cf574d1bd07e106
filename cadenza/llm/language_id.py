"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of the hashed 1-, 2- and 3-grams of lower-cased training texts are summed
by Spark; the log-probability matrix (BUCKETS rows, a column for each language;
its size is fixed by these two numbers) is broadcast. Whole texts are scored batch by
batch in numpy: the batch's n-grams become a sparse matrix of counts (texts by
buckets, in compressed rows), which is multiplied with the broadcast one.

Training reads a bounded, repeatable sample of labelled rows: each language
gives PER_LANGUAGE documents in expectation (all, if it has fewer), chosen by a
hash of doc_id; the prior is each language's share of all labelled rows. Whole texts are
learned from and whole texts are scored.

Defined results: text that is null or has no letter is `und` with score 0; rows
with a null lang or a null doc_id teach nothing; without any training row every
text is `und` with score 0; among equal scores the first language in
alphabetical order wins; over MOST_LANGUAGES languages are an error, as the matrix that
is sent to every task has a checked size; rows that repeat a doc_id stay rows of their own; an
empty table gives an empty result; further columns pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import common

BUCKET_BITS, ORDERS, PER_LANGUAGE, SMOOTH, MOST_LANGUAGES = 15, (1, 2, 3), 1500, 0.5, 1000
BUCKETS = 1 << BUCKET_BITS
AT_ONCE = 1 << 21  # products that are held at once
UNDETERMINED = "und"
_LETTER = regex.compile(r"\p{L}")
_PAD = "\n\n\n"


def gram_buckets(texts: list[str]):
    """Yields, for each order of n-grams, the bucket at every place of all texts, with where texts start and end."""
    lowered = [t.lower() for t in texts]
    lengths = np.array([len(t) for t in lowered], np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths + len(_PAD))[:-1]])
    code = np.frombuffer((_PAD.join(lowered) + _PAD).encode("utf-32-le", "surrogatepass"), np.uint32)
    with np.errstate(over="ignore"):
        for n in ORDERS:
            h = np.full(len(code) - n + 1, n, np.uint32)
            for j in range(n):
                h = (h ^ code[j : len(code) - n + 1 + j]) * np.uint32(0x9E3779B1)
                h ^= h >> np.uint32(15)
            yield (h & np.uint32(BUCKETS - 1)).astype(np.int64), starts, starts + lengths


def _count(languages: list[str]):
    at = {lang: i for i, lang in enumerate(languages)}

    def run(batches):
        for batch in batches:
            langs = np.array([at[x] for x in batch.column("lang").to_pylist()], np.int64)
            for first, offsets, flat in common.text_slices(batch.column("text")):
                raw = flat.tobytes()
                begin, buckets, counts = sparse_counts([raw[a:b].decode() for a, b in zip(offsets[:-1], offsets[1:])])
                cells = np.repeat(langs[first : first + len(begin) - 1], np.diff(begin)) * BUCKETS + buckets
                cells, where = np.unique(cells, return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array(np.bincount(where, counts, len(cells)).astype(np.int64))], ["cell", "n"])

    return run


def train(docs: DataFrame, may_learn: Column | None = None, per_language: int = PER_LANGUAGE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages in order and their log-probability matrix (BUCKETS + 1 rows; the last one is the prior)."""
    usable = F.col(lang_col).isNotNull() & F.col(id_col).isNotNull()
    usable = usable if may_learn is None else usable & may_learn
    sizes = {r[0]: r[1] for r in docs.filter(usable).groupBy(lang_col).count().limit(MOST_LANGUAGES + 1).collect()}
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"over {MOST_LANGUAGES} languages to learn")
    languages = sorted(sizes)
    if not languages:
        return [], np.zeros((BUCKETS + 1, 0), np.float32)
    shares = F.map_from_arrays(F.lit(languages), F.lit([min(1.0, per_language / sizes[x]) for x in languages]))
    share = F.try_element_at(shares, F.col(lang_col))
    sample = docs.filter(usable & (common.unit_hash(F.lit("language"), F.col(id_col)) < share)).select(F.col(lang_col).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    cells = sample.mapInArrow(_count(languages), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    counts = np.full(len(languages) * BUCKETS, SMOOTH, np.float32)
    for r in cells.toLocalIterator():  # at most languages x BUCKETS rows
        counts[r["cell"]] += r["n"]
    counts = counts.reshape(len(languages), BUCKETS)
    n = np.array([sizes[x] for x in languages], float)
    matrix = np.empty((BUCKETS + 1, len(languages)), np.float32)
    for j, own in enumerate(counts):
        matrix[:-1, j] = np.log(own / own.sum(dtype=np.float64))
    matrix[-1] = np.log(n / n.sum())
    return languages, matrix


def sparse_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket counts of a batch in compressed rows: where each text's entries begin, their buckets, their counts."""
    keys = []
    for bucket, starts, ends in gram_buckets(texts):
        lengths = ends - starts
        owner = np.repeat(np.arange(len(texts)), lengths)
        places = np.arange(len(owner)) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
        keys.append((owner << BUCKET_BITS) | bucket[places])
    keys = np.concatenate(keys)
    if len(texts) <= 1 << (31 - BUCKET_BITS):
        keys = keys.astype(np.int32)  # sorts faster
    keys.sort()
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    counts, keys = np.diff(np.concatenate([first, [len(keys)]])), keys[first]
    return np.searchsorted(keys >> BUCKET_BITS, np.arange(len(texts) + 1)), keys & (BUCKETS - 1), counts


def score_texts(texts: list[str], languages: list[str], matrix: np.ndarray) -> tuple[list[str], list[float]]:
    begin, buckets, counts = sparse_counts(texts)
    total = np.zeros((len(texts), len(languages)))
    filled = np.flatnonzero(begin[1:] > begin[:-1])  # reduceat wants no empty rows
    wide = max(1, AT_ONCE // max(1, len(buckets)))
    for j in range(0, len(languages) if len(filled) else 0, wide):  # so many languages at once that little is held
        total[filled, j : j + wide] = np.add.reduceat(matrix[buckets, j : j + wide] * counts[:, None].astype(np.float64), begin[filled])
    total += matrix[-1]
    best = total.argmax(axis=1)
    share = 1 / np.exp(total - total[np.arange(len(texts)), best][:, None]).sum(axis=1)
    letters = [bool(_LETTER.search(t)) for t in texts]
    return [languages[b] if ok else UNDETERMINED for b, ok in zip(best, letters)], [float(s) if ok else 0.0 for s, ok in zip(share, letters)]


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred and lang_score, in place of columns of these names."""
    docs, (languages, _) = docs.drop("lang_pred", "lang_score"), model
    sent = docs.sparkSession.sparkContext.broadcast(model[1])
    most = max(1 << 15, (1 << 20) // max(1, len(languages)))  # keeps the score rows of a slice at about 25 MB

    def run(batches):
        for batch in batches:
            for first, offsets, flat in common.text_slices(batch.column(text_col), most):
                raw = flat.tobytes()
                texts = [raw[a:b].decode() for a, b in zip(offsets[:-1], offsets[1:])]
                if languages:
                    names, scores = score_texts(texts, languages, sent.value)
                else:
                    names, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
                yield pa.RecordBatch.from_arrays([*batch.slice(first, len(texts)).columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names, "lang_pred", "lang_score"])

    return docs.mapInArrow(run, common.with_fields(docs, "lang_pred string, lang_score double"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    held_out = common.fold_of(F.col("doc_id"), 4) == 2
    model = train(docs, ~held_out)
    return predict(docs.select("doc_id", "text"), model).select(
        "doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", F.col("lang_score").alias("score")
    )
