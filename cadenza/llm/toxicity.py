"""Toxicity by a weighted finite-state pattern grammar.

Words and marks become symbols (insult, threat, target, negation, reporting verb,
intent, opening and closing quote, lead-in, other word). Small transducers read them,
each with its own state: the insult and threat transducers emit weights, the target
transducer notes whom a clause is about, the negation and reported-speech
transducers change what stands in their scope. Their composition, a product of
states built on demand, reads each clause once. Speech that a clause leaves open
goes on in the next one: a quote up to its closing mark or the end of the line, and
what a reporting verb leads in with a colon for one clause; a verb behind a quote reports it within the clause. A match needs a clause, at least two words; a word that stands
alone is none. A document is scored from its matches: of each kind (an insult said
plainly, aimed at somebody, negated, reported; a threat, a weak threat) the log of 1
+ the summed weights goes into a small logistic model.

The insult lexicon (words, and word beginnings of four to eight letters for
languages that bend their words) and the model's weights are learned from
labelled rows. A term must stand out by the texts that hold it and by the number of
distinct contexts (word before, word after) that it has in toxic and in other texts,
so that the words of one text with many copies don't; all terms that do are taken. The rows are a bounded sample, PER_CLASS documents of each label in
expectation, chosen by a hash of doc_id. Where that thins the labels unevenly, a row
counts for 1 / its share in a term's precision and in the model, so that the odds are
those of all labelled rows. Whether a term stands out by more than chance, and its
weight (a ratio of rates within the labels), do not depend on the shares and go by
the rows seen. Labels, language, source and doc_id are
no inputs of a score. Whole texts are read in training and scoring.

Defined results: null and empty texts match nothing and get the model's base
score; label rows with a null id or label teach nothing, of several labels for a
document the highest counts; without any toxic training row the lexicon is empty;
rows that repeat a doc_id stay rows of their own; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import common

PER_CLASS, LEAST_PRECISION = 5000, 0.9
MOST_CONTEXTS = 50_000  # that a task holds at once
KNOWN_BYTES, WORD_BYTES = 1 << 25, 150  # of words whose symbol a worker remembers; what one takes besides its letters, about
STEMS = (4, 5, 6, 7, 8)
#: Closed word classes of the grammar. English verbs stand for their regular forms, see forms_of().
THREATS = "kill hurt destroy beat shoot stab burn attack murder strangle"
MORE_THREATS = "beaten shot burnt töten töte tötet getötet umbringen umbringe tuer tuerai tuerons tuerez matar mataré mataremos"
INTENT = "will shall gonna going want must should i'll we'll werde werden voy vamos vais allons"
TARGETS = "you your yours u he him his she her they them their we us people person du dich dein ihr sie er tu te ton toi vous votre il elle ils tú usted él ella ellos"
NEGATIONS = "not no never isn't aren't wasn't don't doesn't without kein keine nie niemals pas jamais aucun nunca ni tampoco sin"
REPORTS = "said says say called calls wrote writes claimed claims according quoted sagte sagt dit disait dijo dice"
#: Marks. Curly apostrophes are read as straight ones; a mark that both opens and closes takes turns.
OPENING, CLOSING, EITHER = "“„«‹", "”»›", '"'
STEM_WORDS = 3  # distinct words that a word beginning must cover
SCOPE = 3  # words that a negation or an intent reaches
THREAT_WEIGHT = 4.0
FEATURES = ("plain", "aimed", "negated", "reported", "threat", "weak_threat")
PRIOR = np.array([-3.0, 2.0, 2.4, 1.2, 1.2, 2.6, 0.4])  # base score, then the features: what holds until the labels say otherwise; one plain threat is enough
_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
_TOKEN = re.compile(rf"{_WORD.pattern}|[{OPENING}{CLOSING}{EITHER}:]")
_CLAUSE = re.compile(r"(?<=[.!?;:\n])")  # the mark stays with the clause that it ends


def forms_of(verb: str) -> list[str]:
    """An English verb's base, third person, past and present participle, by the rules of spelling."""
    stem = verb.removesuffix("e")
    if re.search("[^aeiou][aeiou][^aeiouwxy]$", verb) and len(verb) < 5:
        stem += verb[-1]
    return [verb, verb + ("es" if re.search("(s|x|z|ch|sh)$", verb) else "s"), stem + "ed", stem + "ing"]


OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, INTENDS, OPENS, CLOSES, LEADS = range(10)
_CLASSES = {w: k for k, words in ((THREAT, " ".join([MORE_THREATS, *(f for v in THREATS.split() for f in forms_of(v))])), (INTENDS, INTENT), (REPORT, REPORTS), (NEGATION, NEGATIONS), (TARGET, TARGETS)) for w in words.split()}
_MARKS = dict.fromkeys(OPENING, OPENS) | dict.fromkeys(CLOSING, CLOSES) | {":": LEADS}


def _after(trigger: int):
    """Transducer whose state counts down SCOPE words from its trigger; it emits whether it is in scope."""
    return lambda state, symbol: (SCOPE, False) if symbol == trigger else (state, state > 0) if symbol >= OPENS else (max(0, state - 1), state > 0)


def _from(trigger: int):
    """Transducer that stays on from its trigger to the end of the clause."""
    return lambda state, symbol: (1, True) if symbol == trigger or state else (0, False)


def _marks(trigger: int):
    """Transducer that emits at its symbol."""
    return lambda state, symbol: (0, symbol == trigger)


SILENT, SPOKEN, QUOTED, LED = range(4)  # states of reported speech; LED: what follows the clause is spoken


def _reported(state: int, symbol: int) -> tuple[int, bool]:
    """Transducer of reported speech: on behind a reporting verb, and between quotes that one leads in."""
    if symbol == REPORT and state == SILENT:
        return SPOKEN, True
    if symbol == LEADS and state == SPOKEN:
        return LED, True
    if symbol == OPENS and state in (SPOKEN, LED):
        return QUOTED, True
    if symbol == CLOSES and state == QUOTED:
        return SILENT, True
    return state, state != SILENT


class Composition:
    """The product of transducers; the states that occur get their row on demand."""

    def __init__(self, *parts) -> None:
        self.parts, self.start, self.table = parts, (0,) * len(parts), {}

    def step(self, state: tuple, symbol: int) -> tuple[tuple, tuple]:
        found = self.table.get((state, symbol))
        if found is None:
            steps = [p(s, symbol) for p, s in zip(self.parts, state)]
            found = self.table[state, symbol] = (tuple(s for s, _ in steps), tuple(o for _, o in steps))
        return found

    def begin(self, reported: int) -> tuple:
        """The state at the start of a clause, with what reported speech carries over."""
        return (*self.start[:-1], reported)


def grammar() -> Composition:
    return Composition(_marks(INSULT), _marks(THREAT), _from(TARGET), _after(NEGATION), _after(INTENDS), _reported)


class Symbols(dict):
    """Token -> (symbol, weight), looked up in the lexicon once and remembered, KNOWN_BYTES of them at most from text to text."""

    def __init__(self, lexicon: dict[str, float]) -> None:
        super().__init__()
        self.lexicon = lexicon
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.update({mark: (symbol, 0.0) for mark, symbol in _MARKS.items()})
        self.held = 0

    def __missing__(self, word: str) -> tuple[int, float]:
        weight = term_weight(word, self.lexicon)
        self[word] = found = (INSULT if weight else _CLASSES.get(word, OTHER), weight)
        self.held += WORD_BYTES + len(word)
        return found


def clause_features(tokens: list[str], symbols: Symbols, machine: Composition, seen: np.ndarray, carried: int = SILENT, quoted: bool = False) -> tuple[int, bool]:
    """Raise ``seen`` (a document's summed weights) by what one clause matches; returns how speech goes on behind it."""
    state, events, aimed, threats, words, told = machine.begin(carried), [], False, [], 0, False
    for token in tokens:
        if token == EITHER:
            symbol, weight = (CLOSES if quoted else OPENS), 0.0
        else:
            symbol, weight = symbols[token]
            words += symbol < OPENS
        quoted = symbol == OPENS or quoted and symbol != CLOSES
        state, (insult, threat, target, negated, intended, reported) = machine.step(state, symbol)
        aimed = aimed or target
        told = told or symbol == REPORT and not quoted  # a verb behind a quote reports it too
        if insult:
            events.append((weight, negated, reported, quoted))
        elif threat:
            threats.append((intended and not negated, reported, quoted))
    if words > 1:
        for weight, negated, reported, inside in events:
            seen[2 if negated else 3 if reported or inside and told else 1 if aimed else 0] += weight
        for meant, reported, inside in threats:
            if aimed:
                seen[4 if meant and not (reported or inside and told) else 5] += THREAT_WEIGHT
    speech = state[-1]
    going_on = speech if speech == QUOTED else SPOKEN if speech == LED else SILENT
    return going_on, quoted


def term_weight(word: str, lexicon: dict[str, float]) -> float:
    """Weight of a word: its own, or that of the longest known beginning."""
    found = lexicon.get(word)
    if found is None:
        found = next((lexicon[s] for n in reversed(STEMS) if len(word) > n and (s := word[:n] + "*") in lexicon), 0.0)
    return found


def terms(words: set[str]) -> set[str]:
    return words | {w[:n] + "*" for w in words for n in STEMS if len(w) > n}


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(_plain(text))


def _plain(text: str | None) -> str:
    return (text or "").lower().replace("’", "'")


def document_features(text: str | None, symbols: Symbols, machine: Composition) -> np.ndarray:
    seen = np.zeros(len(FEATURES))
    low = _plain(text)
    if symbols.held > KNOWN_BYTES:
        symbols.forget()
    if any(symbols[w][0] in (INSULT, THREAT) for w in set(_WORD.findall(low))):
        carried, quoted = SILENT, False
        for clause in _CLAUSE.split(low):
            tokens = _TOKEN.findall(clause)
            if tokens:
                carried, quoted = clause_features(tokens, symbols, machine, seen, carried, quoted)
            if clause.endswith("\n"):
                carried, quoted = SILENT, False
    return np.log1p(seen)


def _terms_of(batches):
    for batch in batches:
        out_term, out_toxic = [], []
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            own = terms(set(words_of(text)))
            out_term += own
            out_toxic += [toxic] * len(own)
        yield pa.RecordBatch.from_arrays([pa.array(out_term, pa.string()), pa.array(out_toxic, pa.int32())], ["term", "toxic"])


def _contexts_of(batches):
    """Words with the words around them and the label; distinct in a run of rows."""
    def flushed(out):
        columns = list(zip(*out)) or [[]] * 3
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in columns[:2]), pa.array(columns[2], pa.int32())], ["word", "around", "toxic"])

    for batch in batches:
        out = set()
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            words = ["", *words_of(text), ""]
            out.update((word, f"{before} {after}", toxic) for before, word, after in zip(words, words[1:], words[2:]))
            if len(out) > MOST_CONTEXTS:
                yield flushed(out)
                out = set()
        yield flushed(out)


def _terms_in(word: Column) -> Column:
    """What terms() makes of one word."""
    return F.concat(F.array(word), *[F.when(F.char_length(word) > n, F.array(F.concat(F.substring(word, 1, n), F.lit("*")))).otherwise(F.array().cast("array<string>")) for n in STEMS])


def _features_of(lexicon):
    def run(batches):
        machine, symbols = grammar(), Symbols(lexicon)
        for batch in batches:
            rows = np.array([document_features(t, symbols, machine) for t in batch.column("text").to_pylist()]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), *map(pa.array, rows.T)], ["toxic", *FEATURES])

    return run


def fit(groups: list[tuple[np.ndarray, int, float]]) -> np.ndarray:
    """Logistic weights for (features, toxic, how many), drawn towards PRIOR."""
    weights = PRIOR.copy()
    if not groups:
        return weights
    x = np.array([[1.0, *f] for f, _, _ in groups])
    y, n = np.array([float(t) for _, t, _ in groups]), np.array([float(c) for _, _, c in groups])

    def fits(w: np.ndarray) -> float:
        z = x @ w
        return float(n @ (y * z - np.logaddexp(0, z)) - ((w - PRIOR) ** 2).sum() / 2)

    free = np.ones(len(weights), bool)
    while True:
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
            slope = x.T @ (n * (y - p)) - (weights - PRIOR)
            curve = (x * (n * p * (1 - p))[:, None]).T @ x + np.eye(len(weights))
            step = np.zeros(len(weights))
            step[free] = np.linalg.solve(curve[np.ix_(free, free)], slope[free])
            now = fits(weights)
            while np.abs(step).max() >= 1e-9 and fits(weights + step) < now:  # a full step can overshoot
                step /= 2
            weights = weights + step
            if np.abs(step).max() < 1e-9:
                break
        below = free & (weights < 0)
        below[0] = False
        if not below.any():
            return weights
        weights[below] = 0.0  # a matched clause never makes a text cleaner; the other weights are fitted beside that
        free &= ~below


def train(docs: DataFrame, labels: DataFrame, may_learn: Column | None = None, per_class: int = PER_CLASS) -> tuple[dict[str, float], np.ndarray]:
    """The insult lexicon (term -> weight) and the model's weights."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    known = (known if may_learn is None else known.filter(may_learn)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sizes = {r[0]: r[1] for r in known.groupBy((F.col("toxic") > 0).alias("t")).count().collect()}
    if not sizes.get(True):
        return {}, PRIOR.copy()
    shares = {1: min(1.0, per_class / sizes[True]), 0: min(1.0, per_class / max(1, sizes.get(False, 0)))}
    share = F.when(F.col("toxic") > 0, shares[1]).otherwise(shares[0])
    chosen = known.filter(common.unit_hash(F.lit("toxicity"), F.col("doc_id")) < share).select("doc_id", (F.col("toxic") > 0).cast("int").alias("toxic"))
    chosen = common.stored(chosen)
    # about 2 * per_class rows of two numbers; beyond twice that they are not sent to every task
    few = F.broadcast(chosen) if chosen.count() <= 4 * per_class else chosen.hint("shuffle_merge")
    sample = common.stored(docs.select("doc_id", "text").join(few, "doc_id").select("text", "toxic"))
    n, bad = sample.agg(F.count("*"), F.sum("toxic")).first()
    if not bad:
        return {}, PRIOR.copy()
    base = bad / n
    found = common.stored(sample.mapInArrow(_terms_of, "term string, toxic int").groupBy("term").agg(F.sum("toxic").alias("bad"), F.count("*").alias("n")))
    least_g = 2 * math.log(max(2, found.count()))  # so strict that of all the terms seen under one would pass by chance
    cut = lambda a, b: F.when(a > 0, a * F.log(a / b)).otherwise(0.0)
    g = 2 * (cut(F.col("bad"), F.col("n") * base) + cut(F.col("n") - F.col("bad"), F.col("n") * (1 - base)))
    weight = F.log((F.col("bad") + 0.5) / (bad + 1)) - F.log((F.col("n") - F.col("bad") + 0.5) / (n - bad + 1))
    all_bad, all_clean = F.col("bad") / shares[1], (F.col("n") - F.col("bad")) / shares[0]
    stands_out = (F.col("g") >= least_g) & (all_bad >= (all_bad + all_clean) * LEAST_PRECISION)
    wanted = common.stored(found.withColumn("g", g).filter(stands_out).select("term"))
    around = sample.mapInArrow(_contexts_of, "word string, around string, toxic int").distinct()
    words = around.groupBy("word").agg(F.sum("toxic").alias("bad"), F.count("*").alias("n"))
    by_context = words.withColumn("term", F.explode(_terms_in(F.col("word")))).groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"), F.count("*").alias("words"))
    several = ~F.col("term").endswith("*") | (F.col("words") >= STEM_WORDS)
    rows = by_context.withColumns({"g": g, "weight": weight}).filter(stands_out & several).join(wanted.hint("shuffle_merge"), "term").select("term", "weight").collect()  # bounded by the sample
    lexicon = {r["term"]: r["weight"] for r in rows}
    seen = sample.mapInArrow(_features_of(lexicon), "toxic int, " + ", ".join(f"{f} double" for f in FEATURES))
    seen = seen.groupBy("toxic", *[F.round(f, 2).alias(f) for f in FEATURES]).count().collect()  # no more rows than the sample has
    # the odds of all labelled rows, the sum of those seen: PRIOR is worth the same beside thinned rows
    scale = n / (bad / shares[1] + (n - bad) / shares[0])
    return lexicon, fit([(np.array([r[f] for f in FEATURES]), r["toxic"], r["count"] * scale / shares[r["toxic"]]) for r in seen])


def score(docs: DataFrame, model: tuple[dict[str, float], np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score and the features of every row."""
    lexicon, weights = model
    sent = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches):
        machine, symbols = grammar(), Symbols(sent.value)
        for batch in batches:
            rows = np.array([document_features(t, symbols, machine) for t in batch.column("text").to_pylist()]).reshape(-1, len(FEATURES))
            scores = 1 / (1 + np.exp(-np.clip(weights[0] + rows @ weights[1:], -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores), *map(pa.array, rows.T)], ["doc_id", "score", *FEATURES])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double, " + ", ".join(f"{f} double" for f in FEATURES))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    held_out = common.fold_of(F.col("doc_id"), 5) == 0
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~held_out)
    return score(docs, model).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
