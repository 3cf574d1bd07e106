"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells of (source, language, topic). Spark sums the tokens
(words between white space) of every cell; a category that a target does not
name falls under "*", so the number of cells is bounded by the targets, which are
parameters. The cells' token weights are raked: scaled to each target marginal in
turn until all three hold. A cell's documents are then kept with the probability
weight / tokens, scaled so that the largest is 1 (nothing is repeated) or so that
a token budget is met, each by a repeatable hash of its id.

Defined results: null source or language counts as "*", null text has no tokens
and topic "*"; a target category without any token gives its share to the others
of its marginal; "*" without a target takes what the named targets leave of 1, and
its natural share where they leave nothing (name "*": 0 to drop it); targets that no
weights of the given cells meet give what ROUNDS rounds come to and a warning with the
gap that is left; a document
without tokens is kept with its cell's probability; rows that share a doc_id get the
same decision within a cell; an empty table gives an empty result; further
columns pass through.
"""

from __future__ import annotations

import warnings
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import common

REST = "*"
#: Topics in order of precedence, with the pattern that marks them; the other texts are prose. A parameter, like the targets.
TOPICS = (("legal", r"(?i)licen[sc]ed? |copyright"), ("contact", r"@|https?://"), ("markup", r"[{}<>#]"))
TARGETS = {
    "source": {"src0": 0.10} | {f"src{i}": 0.90 / 19 for i in range(1, 20)},
    "lang": {"en": 0.55, "de": 0.16, "fr": 0.16, "es": 0.13},
    "topic": {"prose": 0.92, "legal": 0.03, "contact": 0.02, "markup": 0.03},
}
MARGINALS = ("source", "lang", "topic")
ROUNDS, CLOSE = 500, 1e-10


def topic_of(text: Column, topics: Sequence[tuple[str, str]] = TOPICS) -> Column:
    topic = F.when(text.isNotNull(), F.lit("prose")).otherwise(REST)
    for name, pattern in reversed(topics):
        topic = F.when(text.rlike(pattern), F.lit(name)).otherwise(topic)
    return topic


def token_count(text: Column) -> Column:
    words = F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+")
    return (F.size(words) - F.when(F.get(words, F.lit(0)) == "", 1).otherwise(0) - F.when((F.size(words) > 1) & (F.element_at(words, -1) == ""), 1).otherwise(0)).cast("long")


def rake(tokens: dict[tuple[str, str, str], float], targets: dict[str, dict[str, float]]) -> dict[tuple[str, str, str], float]:
    """Shares of the total for every cell that has tokens, with the target marginals."""
    cells = sorted(c for c, t in tokens.items() if t > 0)
    if not cells:
        return {}
    have = np.array([float(tokens[c]) for c in cells])
    share = have / have.sum()
    plans = []
    for axis, name in enumerate(MARGINALS):
        own = sorted({c[axis] for c in cells})
        where = np.array([own.index(c[axis]) for c in cells])
        natural = np.bincount(where, share, len(own))
        want = np.array([float(targets[name].get(x, 0.0)) for x in own])
        if REST in own and REST not in targets[name]:
            left = 1 - sum(targets[name].values())
            if left > CLOSE:
                want[own.index(REST)] = left
            else:  # the named targets are of each other: the rest stays as large as it is
                rest = natural[own.index(REST)] if want.sum() else 1.0
                want = want / want.sum() * (1 - rest) if want.sum() else want
                want[own.index(REST)] = rest
        plans.append((where, want / want.sum() if want.sum() else natural))
    for _ in range(ROUNDS):
        off = 0.0
        for where, want in plans:
            now = np.bincount(where, share, len(want))
            off = max(off, float(np.abs(now - want).max()))
            share = share * np.divide(want, now, out=np.zeros_like(want), where=now > 0)[where]
        if off < CLOSE:
            break
    else:
        warnings.warn(f"the targets cannot all be met: a marginal is off by {off:.2g} after {ROUNDS} rounds", UserWarning, stacklevel=2)
    return dict(zip(cells, share / share.sum()))


def keep_probabilities(tokens: dict, shares: dict, budget: float | None = None) -> dict[tuple[str, str, str], float]:
    """Of each cell: share / tokens, scaled to the budget (tokens to keep); by default as large as no repeats allow."""
    rate = {c: shares[c] / tokens[c] for c in shares}
    if not rate:
        return {}
    most = 1 / max(rate.values())
    if budget is None or budget <= most:
        scale = most if budget is None else budget
        return {c: min(1.0, scale * r) for c, r in rate.items()}
    low, high = most, most
    kept = lambda s: sum(min(1.0, s * r) * tokens[c] for c, r in rate.items())
    while kept(high) < min(budget, sum(tokens[c] for c in rate if rate[c] > 0)) * (1 - 1e-12) and high < 1e300:
        high *= 2
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if kept(mid) < budget else (low, mid)
    return {c: min(1.0, high * r) for c, r in rate.items()}


def mix(docs: DataFrame, targets: dict[str, dict[str, float]] = TARGETS, budget: float | None = None, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", topics: Sequence[tuple[str, str]] | Column = TOPICS) -> DataFrame:
    """``docs`` with _topic, _n_tokens, _weight (share of the mix that its cell has), _probability and _kept, in place of columns of these names.

    ``topics``: (name, pattern) in order of precedence, or a column that holds the topic, as a classifier gives it.
    """
    def category(c: Column, name: str) -> Column:
        return F.when(c.isin(*targets[name]), c).otherwise(REST)

    docs, back = common.aside(docs, "_cs", "_cl", "_ct")
    # the text is read once, for its topic and its tokens; the cell follows from the topic
    marked = docs.withColumns({"_topic": F.coalesce(topics, F.lit(REST)) if isinstance(topics, Column) else topic_of(F.col(text_col), topics), "_n_tokens": token_count(F.col(text_col))})
    marked = marked.withColumns({"_cs": category(F.col("source"), "source"), "_cl": category(F.col("lang"), "lang"), "_ct": category(F.col("_topic"), "topic")})
    rows = marked.groupBy("_cs", "_cl", "_ct").agg(F.sum("_n_tokens").alias("t")).collect()  # a row for each cell of the targets
    tokens = {(r["_cs"], r["_cl"], r["_ct"]): float(r["t"]) for r in rows}
    shares = rake(tokens, targets)
    kept = keep_probabilities(tokens, shares, budget)
    key = F.concat_ws("\x00", "_cs", "_cl", "_ct")

    def of(values: dict) -> Column:
        table = {"\x00".join(c): float(v) for c, v in values.items()}
        return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key), F.lit(0.0)) if table else F.lit(0.0)

    # a cell without tokens has nothing to weigh: its documents are kept or not like the largest cell's
    kept |= {c: max(kept.values(), default=1.0) for c in tokens if c not in kept}
    return marked.withColumns({"_weight": of(shares), "_probability": of(kept)}).withColumn("_kept", common.unit_hash(F.lit(seed), F.col(id_col)) < F.col("_probability")).drop("_cs", "_cl", "_ct").withColumnsRenamed(back)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = mix(common.documents(spark, sf_dir))
    return done.select("doc_id", "source", "lang", F.col("_topic").alias("topic"), F.col("_n_tokens").alias("n_tokens"), F.col("_weight").alias("weight"), F.col("_probability").alias("probability"), F.col("_kept").alias("kept"))
