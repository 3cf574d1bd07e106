"""Source divergence audit by chunk factorization.

Documents are read in parts, runs of rows of about PART_BYTES, in which the chunks
between ASCII white space are counted per document.

1. A part gives a row for each of its chunks and languages: in how many documents of each
   source, and how often. Rows meet by chunk and are added up; each globally distinct
   chunk is tokenized once, by a regular expression in the JVM, and its terms take its
   numbers on. So occurrences are exact. Documents are so where only one chunk gives a
   term; else the largest number of one chunk and the sum over chunks bound them.
2. For terms whose bounds leave open whether they are in enough documents, the parts are
   read again, for the chunks that have one (a bitmap of fixed size says which may be, the
   join says which are). A chunk is one row of its part, with its documents (places in the
   part). Its terms are joined back to it, and the rows return to their part, which still
   holds whole documents: so documents with a term are counted exactly, though several
   chunks of a document give the same term.

A very common chunk has a row for each part and language, not for each document.

Kept terms are dealt into blocks; a block holds the terms' counts in all sources of its
language, as a matrix with the zeros that no row stands for, and gives the block's share
of every pair of sources and its best terms of every source. Arithmetic is in integers:
probabilities are divided in steps of a thousand, exact up to 9 * 10**15 occurrences.

Defined results: null text, lang and source are ''; documents are rows, so rows that
repeat a doc_id count each; a language without kept terms has pairs of value 0; a
language of one source has no pairs; a term that a source uses no more than its
language does is not listed; an empty table gives an empty result; further columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from . import common

PART_BYTES = 1 << 26  # of a part's texts
BLOCK_CELLS = 1 << 18  # counts of terms by source in one block
BITS = 24  # 2 ** BITS is the number of bits of the bitmap of chunks
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
LEAST_DOCS, ADDED, SCALE_STEPS, TOP = 30, 5, 3, 50  # probabilities are in parts of 1000 ** SCALE_STEPS
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lists(values: np.ndarray, ends: np.ndarray) -> pa.ListArray:
    """Lists of integers that begin at 0 and at the ends of those before them."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(values, pa.int32()))


def _parts(batch, order=None):
    """First row, number of rows, different chunks, and of every chunk in every text, in no order: (number of the chunk) * rows + row (or its place in ``order`` of the part's rows)."""
    for first, offsets, flat in common.text_slices(batch.column("text"), PART_BYTES):
        n = len(offsets) - 1
        texts = pa.LargeStringArray.from_buffers(n, pa.py_buffer(np.ascontiguousarray(offsets)), pa.py_buffer(flat))
        words = pc.ascii_split_whitespace(texts)
        rows = np.repeat(np.arange(n) if order is None else order(first, n), np.diff(words.offsets.to_numpy()))
        coded = words.flatten().dictionary_encode()
        chunks, numbers = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        del words, coded
        none = chunks.index("").as_py()  # before and behind white space at the ends
        if none >= 0:
            there = numbers != none
            numbers, rows = numbers[there], rows[there]
        numbers *= n
        numbers += rows
        yield first, n, chunks, numbers


def _counts(batches):
    """Rows (chunk, lang, sources, docs, ns): a part's documents with a chunk (at the first entry, which has no source), and how often each source has it."""
    for batch in batches:
        groups = sorted(set(zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist())))
        at = {g: i for i, g in enumerate(groups)}
        of = np.array([at[g] for g in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist())], np.int64)
        names = pa.array([g[1] for g in groups], pa.string())
        langs, lang_of = np.unique(np.array([g[0] for g in groups], object), return_inverse=True)

        def rank(first, n):
            """Documents of a group lie together, so what is sorted by document is sorted by group."""
            out = np.empty(n, np.int64)
            out[np.argsort(of[first : first + n], kind="stable")] = np.arange(n)
            return out

        for first, n, chunks, places in _parts(batch, rank):
            if not len(places):
                continue
            places.sort()
            new = np.flatnonzero(np.concatenate([[True], places[1:] != places[:-1]]))
            often, pairs = np.diff(np.concatenate([new, [len(places)]])), places[new]
            group, chunk = np.sort(of[first : first + n])[pairs % n], pairs // n
            cell = np.flatnonzero(np.concatenate([[True], (chunk[1:] != chunk[:-1]) | (group[1:] != group[:-1])]))
            docs, ns = np.diff(np.concatenate([cell, [len(pairs)]])), np.add.reduceat(often, cell).astype(np.int32)
            group, chunk = group[cell], chunk[cell]
            lang = lang_of[group]
            row = np.flatnonzero(np.concatenate([[True], (chunk[1:] != chunk[:-1]) | (lang[1:] != lang[:-1])]))
            # every row begins with an entry without a source, for the documents of all
            row_of = np.searchsorted(row, np.arange(len(cell)), side="right") - 1
            place = np.arange(len(cell)) + row_of + 1
            total, of_docs, of_ns, source = len(cell) + len(row), np.zeros(len(cell) + len(row), np.int32), np.zeros(len(cell) + len(row), np.int32), np.full(len(cell) + len(row), -1)
            of_docs[row + np.arange(len(row))] = np.add.reduceat(docs, row)
            of_ns[place], source[place] = ns, group
            ends = pa.array(np.concatenate([row + np.arange(len(row)), [total]]), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    chunks.take(pa.array(chunk[row])).cast(pa.string()), pa.array(langs.tolist(), pa.string()).take(pa.array(lang[row])),
                    *[pa.ListArray.from_arrays(ends, c) for c in (names.take(pa.array(source, mask=source < 0)), pa.array(of_docs), pa.array(of_ns))],
                ],
                ["chunk", "lang", "sources", "docs", "ns"],
            )


def _chunks(wanted):
    """Rows (part, chunk, docs) of the wanted chunks; a part's first row has no chunk but the languages of its documents."""

    def run(batches):
        part, bits = TaskContext.get().partitionId() << 33, wanted.value
        for batch in batches:
            langs = batch.column("lang")
            for first, n, chunks, places in _parts(batch):
                place = np.array([xxhash.xxh64_intdigest(c, 42) for c in chunks.to_pylist()], np.uint64) & np.uint64((1 << BITS) - 1)
                may = (bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
                kept = np.flatnonzero(may)
                pairs = np.unique(places[may[places // n]]) if len(kept) else np.zeros(0, np.int64)
                own = pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), langs.slice(first, n))
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.nulls(1, pa.string()), pa.nulls(1, pa.list_(pa.int32())), own], _NAMES)
                rows = len(kept)
                ends = np.searchsorted(pairs, (kept + 1) * n)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(rows, part), pa.int64()), chunks.take(pa.array(kept)).cast(pa.string()), lists(pairs % n, ends), pa.nulls(rows, pa.list_(pa.string()))], _NAMES)
                part += 1

    return run


_NAMES = ["part", "chunk", "docs", "langs"]


def _flat(column: pa.ListArray) -> tuple[pa.Array, np.ndarray]:
    """Values and lengths of a list column."""
    return column.flatten(), np.diff(column.offsets.to_numpy())


def _by_part(batches):
    """Whole parts: (header's languages, [record batches of chunk rows]); rows come in order of part, headers first."""
    part, langs, held = None, None, []
    for batch in batches:
        parts = batch.column("part").to_numpy()
        cuts = [0, *(np.flatnonzero(parts[1:] != parts[:-1]) + 1).tolist(), len(parts)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if a == b:
                continue
            if parts[a] != part:
                if part is not None:
                    yield langs, held
                part, held = parts[a], []
                langs = batch.column("langs")[a].as_py()
                a += 1
            if a < b:
                held.append(batch.slice(a, b - a))
    if part is not None:
        yield langs, held


def _documents_with(batches):
    """lang, term, docs: documents of each part with a term of the rows' chunks."""
    for langs, held in _by_part(batches):
        lang, number, keys = common.Numbers(), common.Numbers(), []
        of = np.array([lang[x] for x in langs], np.int64)
        for batch in held:
            (terms, much), (docs, sizes) = (_flat(batch.column(c)) for c in ("terms", "docs"))
            names = terms.dictionary_encode()
            numbers = np.array([number[t] for t in names.dictionary.to_pylist()], np.int64)[names.indices.to_numpy(zero_copy_only=False)]
            row = np.repeat(np.arange(len(much)), much)
            places = common.gather((np.cumsum(sizes) - sizes)[row], sizes[row])
            keys.append(np.repeat(numbers, sizes[row]) * len(of) + docs.to_numpy()[places])
        if not keys:
            continue
        keys = np.unique(np.concatenate(keys))
        cells, docs = np.unique(keys // len(of) * len(lang) + of[keys % len(of)], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(list(lang), pa.string()).take(pa.array(cells % len(lang))), pa.array(list(number), pa.string()).take(pa.array(cells // len(lang))), pa.array(docs)], ["lang", "term", "docs"])


def bitmap(chunks: DataFrame) -> np.ndarray:
    """Bits of the chunks' hashes, 2 ** BITS of them."""
    place = F.xxhash64("chunk").bitwiseAND((1 << BITS) - 1)
    bits = np.zeros((1 << BITS) // 8, np.uint8)
    for r in chunks.groupBy(F.shiftright(place, 15).alias("bucket")).agg(F.bitmap_construct_agg(place.bitwiseAND(32767)).alias("bits")).toLocalIterator():  # 2 ** (BITS - 15) rows of 4 KB at most
        bits[r.bucket * 4096 : r.bucket * 4096 + 4096] = np.frombuffer(bytes(r.bits), np.uint8)
    return bits


def _rows(docs: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((text_col, "text"), (lang_col, "lang"), (source_col, "source"))])


def chunk_counts(rows: DataFrame) -> DataFrame:
    """chunk, terms, counts array<struct<lang, source, docs, n>>: a row for each chunk that has terms; entries without a source have the documents of a language.

    Both groupings are by chunk first, so the rows are moved once.
    """
    each = rows.mapInArrow(_counts, "chunk string, lang string, sources array<string>, docs array<int>, ns array<int>").repartition("chunk")
    each = each.select("chunk", "lang", F.explode(F.arrays_zip("sources", "docs", "ns")).alias("x"))
    each = each.groupBy("chunk", "lang", F.col("x.sources").alias("source")).agg(F.sum("x.docs").alias("docs"), F.sum("x.ns").alias("n"))
    each = each.groupBy("chunk").agg(F.collect_list(F.struct("lang", "source", "docs", "n")).alias("counts"))
    return each.withColumn("terms", F.regexp_extract_all(F.translate("chunk", UPPER, LOWER), F.lit(TERM), F.lit(0))).filter(F.size("terms") > 0)


def term_counts(docs: DataFrame, least_docs: int = LEAST_DOCS, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, term, n: how often the terms that are in at least ``least_docs`` documents of a language are in each of its sources that have them."""
    rows = _rows(docs, text_col, lang_col, source_col)
    chunks = common.stored(chunk_counts(rows))
    one = F.size("terms") == 1
    times = F.when(one, 1).otherwise(F.size(F.filter("terms", lambda t: t == F.col("term"))))
    each = chunks.select(F.explode(F.when(one, F.col("terms")).otherwise(F.array_distinct("terms"))).alias("term"), "terms", "counts")
    each = each.select("term", times.alias("times"), F.explode("counts").alias("x")).select("x.lang", "term", "x.source", "x.docs", (F.col("x.n") * F.col("times")).alias("n"))
    by_source = each.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("docs").alias("most"), F.max("docs").alias("least"), F.sum("n").alias("n"))
    entry = F.when(F.col("source").isNotNull(), F.struct("source", "n"))  # collect_list() leaves nulls out
    by_term = by_source.groupBy("lang", "term").agg(F.sum("most").alias("most"), F.max("least").alias("least"), F.collect_list(entry).alias("sources"))
    found = common.stored(by_term.filter(F.col("most") >= least_docs))
    sure, open_ = found.filter(F.col("least") >= least_docs), found.filter(F.col("least") < least_docs)
    kept = sure.select("lang", "term", "sources")
    if not open_.isEmpty():
        exact = documents_with(rows, chunks.select("chunk", "terms"), open_.select("term").distinct())
        enough = common.stored(exact.filter(F.col("docs") >= least_docs).select("lang", "term"))
        kept = kept.union(open_.join(enough.hint("shuffle_merge"), ["lang", "term"]).select("lang", "term", "sources"))
    return kept.select("lang", "term", F.explode("sources").alias("s")).select("lang", "s.source", "term", "s.n")


def documents_with(rows: DataFrame, chunks: DataFrame, wanted: DataFrame) -> DataFrame:
    """lang, term, docs: exactly how many documents of a language have each of the wanted terms."""
    wanted = common.stored(wanted)
    pairs = chunks.select("chunk", F.explode(F.array_distinct("terms")).alias("term")).join(wanted, "term")  # stored tables: Spark broadcasts one that is under its threshold
    terms = common.stored(pairs.groupBy("chunk").agg(F.collect_list("term").alias("terms")))
    sent = rows.sparkSession.sparkContext.broadcast(bitmap(terms))
    cut = common.stored(rows.select("text", "lang").mapInArrow(_chunks(sent), "part long, chunk string, docs array<int>, langs array<string>"))
    none = F.lit(None).cast("array<string>")
    back = cut.filter("chunk IS NOT NULL").select("part", "chunk", "docs").join(terms.hint("shuffle_merge"), "chunk").select("part", F.lit(1).alias("kind"), "terms", "docs", none.alias("langs"))
    heads = cut.filter("chunk IS NULL").select("part", F.lit(0).alias("kind"), none.alias("terms"), "docs", "langs")
    whole = heads.union(back).repartition("part").sortWithinPartitions("part", "kind")
    return whole.mapInArrow(_documents_with, "lang string, term string, docs long").groupBy("lang", "term").agg(F.sum("docs").alias("docs"))


def shares(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(10**9 * counts / total) for counts <= total, without a product over 1000 * total."""
    out, rest = np.divmod(counts, total)
    for _ in range(SCALE_STEPS):
        digit, rest = np.divmod(rest * 1000, total)
        out = out * 1000 + digit
    return out + 1


def _blocks(top: int):
    """Rows in order of (lang, block, kind): kind 0 names a source of the language with its n, V; kind 1 is a count. Yields the block's share of each pair and its best terms."""

    def close(lang, names, sizes, kept, rows):
        place = {x: i for i, x in enumerate(names)}
        terms = sorted({t for _, t, _ in rows}, key=str.encode)
        at = {t: i for i, t in enumerate(terms)}
        matrix = np.zeros((len(names), len(terms)), np.int64)
        for source, term, n in rows:
            matrix[place[source], at[term]] = n
        sizes = np.array(sizes, np.int64)
        p = shares(matrix + ADDED, (sizes + ADDED * kept)[:, None])
        q = shares(matrix.sum(axis=0) + ADDED, sizes.sum() + ADDED * kept)
        out = []
        for a in range(len(names)):
            if a + 1 < len(names):
                value = np.abs(p[a + 1 :] - p[a]).sum(axis=1).tolist()
                out += [(lang, names[a], "pair", b, v) for b, v in zip(names[a + 1 :], value)]
                out += [(lang, b, "pair", names[a], v) for b, v in zip(names[a + 1 :], value)]
            good = np.flatnonzero((matrix[a] > 0) & (p[a] > q))
            more = (p[a] - q)[good]
            best = np.lexsort((good, -more))[:top]  # terms are in order of their bytes
            out += [(lang, names[a], "term", terms[t], int(v)) for t, v in zip(good[best], more[best])]
            if len(out) > 1 << 16:
                yield out
                out = []
        yield out

    def run(batches):
        key, names, sizes, kept, rows = None, [], [], 0, []
        for batch in batches:
            out = []
            for lang, block, kind, source, term, n, terms in zip(*(c.to_pylist() for c in batch.columns)):
                if (lang, block) != key:
                    if key is not None:
                        yield from map(_divergences, close(key[0], names, sizes, kept, rows))
                    key, names, sizes, kept, rows = (lang, block), [], [], terms, []
                if kind == 0:
                    names.append(source)
                    sizes.append(n)
                else:
                    rows.append((source, term, n))
        if key is not None:
            yield from map(_divergences, close(key[0], names, sizes, kept, rows))

    return run


def _divergences(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * 5
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in columns[:4]), pa.array(columns[4], pa.int64())], ["lang", "source", "part", "item", "value"])


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, part, item, value, rank: how far each source's words are from those of the language's other sources, and the terms that set it apart."""
    counts = common.stored(term_counts(docs, least_docs, text_col, lang_col, source_col))
    kept = counts.select("lang", "term").distinct()
    groups = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"))
    groups = common.stored(groups.distinct())
    sizes = common.stored(counts.groupBy("lang", "source").agg(F.sum("n").alias("n")))
    terms = common.stored(kept.groupBy("lang").agg(F.count("*").alias("terms")))
    langs = groups.groupBy("lang").agg(F.count("*").alias("sources")).join(terms.hint("shuffle_merge"), "lang", "left").withColumn("terms", F.coalesce("terms", F.lit(0)))
    langs = common.stored(langs.select("lang", "terms", F.greatest(F.lit(1), F.ceil(F.col("terms") * F.col("sources") / BLOCK_CELLS)).cast("int").alias("blocks")))
    groups = groups.join(sizes.hint("shuffle_merge"), ["lang", "source"], "left").select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"))
    groups = common.stored(groups).join(langs.hint("shuffle_merge"), "lang")
    heads = groups.select("lang", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(0).alias("kind"), "source", F.lit(None).cast("string").alias("term"), "n", "terms")
    cells = counts.join(langs.hint("shuffle_merge"), "lang").select("lang", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int").alias("block"), F.lit(1).alias("kind"), "source", "term", "n", "terms")
    found = heads.union(cells).repartition("lang", "block").sortWithinPartitions("lang", "block", "kind", "source").mapInArrow(_blocks(top), "lang string, source string, part string, item string, value long")
    whole = found.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    ranked = whole.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")))
    return ranked.filter((F.col("part") == "pair") | (F.col("rank") <= top))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(common.documents(spark, sf_dir))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(text, '') AS t, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w GROUP BY ALL),
k AS (SELECT lang, term FROM w GROUP BY ALL HAVING count(DISTINCT r) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
x AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM g JOIN k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (SELECT *, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang, source) + 5 * count(*) OVER (PARTITION BY lang, source)) AS p FROM x),
y AS (SELECT lang, term, sum(n) AS n FROM x GROUP BY ALL),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang) + 5 * count(*) OVER (PARTITION BY lang)) AS q FROM y),
f AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL) s
    ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT p.lang, p.source, 'term', p.term, p.p - q.q FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE p.n > 0 AND p.p > q.q
),
o AS (SELECT lang, source, part, item, value::BIGINT AS value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM f)
SELECT * FROM o WHERE part = 'pair' OR rank <= 50
"""
