"""Mixing sources to target weights by iterative proportional fitting.

1. Documents are counted into cells of source, language and topic class: tokens and documents. Classes are
   bounded by construction: a value with over 1 / CLASSES of all tokens is a class of its own (so there are
   at most CLASSES of them, however many values there are), any other value is in the class "other".
   Cells are therefore at most (CLASSES + 1) ** 2 * topics; they fit the driver.
2. Raking: the weights of all cells are scaled to the source, the language and the topic marginals in turn
   until all agree (Deming and Stephan, 1940). A cell may not be taken more than once: weights beyond what
   ``share`` allows are clipped and the rest raked on (bounded calibration).
3. Sampling: a document stays if a hash of its id, read as a number in [0, 1), is below its cell's
   probability; so a sample is the same whenever and wherever it is drawn.

Targets not given are tempered shares: (tokens of the class) ** alpha, normalised.

Defined results: null source or lang is the class "none"; null text counts as empty and has no tokens; an
empty document takes its cell's probability. Rows with null doc_id are never sampled out by id: they take the
hash of their text. Repeated rows stay or go together. Without tokens at all everything stays.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import save

CLASSES = 64
DIMENSIONS = ("source", "lang", "topic")


def topic(text: str = "text") -> Column:
    """A surface class of a text: its length, and whether it shouts or is full of digits."""
    t = F.coalesce(F.col(text), F.lit(""))
    n = F.length(t)
    return (
        F.when(F.length(F.translate(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "")) * 2 < n, "upper case")
        .when(F.length(F.translate(t, "0123456789", "")) * 10 < n * 9, "figures")
        .when(n < 1000, "short").when(n < 5000, "medium").otherwise("long")
    )


def n_tokens(text: str = "text") -> Column:
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))


def rake(tokens: np.ndarray, targets: list[np.ndarray], share: float, rounds: int = 200) -> np.ndarray:
    """The probability of each cell. tokens: an array with one axis per target marginal (shares, sum 1).

    Kept tokens are share * tokens.sum() as far as probabilities of at most 1 allow it.
    """
    total = tokens.sum()
    if not total:
        return np.ones_like(tokens)
    kept = np.where(tokens > 0, share * tokens, 0.0)
    for _ in range(rounds):
        before = kept.copy()
        for axis, target in enumerate(targets):
            sums = kept.sum(axis=tuple(i for i in range(kept.ndim) if i != axis))
            factor = np.divide(target * share * total, sums, out=np.ones_like(sums), where=sums > 0)
            kept = kept * factor.reshape([-1 if i == axis else 1 for i in range(kept.ndim)])
        kept = np.minimum(kept, tokens)
        if abs(kept - before).max() <= 1e-9 * total:
            break
    return np.divide(kept, tokens, out=np.full_like(kept, min(1.0, share)), where=tokens > 0)


def classes(docs: DataFrame, topics: Column) -> DataFrame:
    """row (a struct of all of docs' columns), c_source, c_lang, c_topic, c_tokens and u, a number in [0, 1) from the id."""
    own = {"c_source": F.coalesce(F.col("source"), F.lit("none")), "c_lang": F.coalesce(F.col("lang"), F.lit("none")), "c_topic": topics, "c_tokens": n_tokens()}
    u = F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.col("text"))), 11).cast("double") / float(1 << 53)
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *(c.alias(n) for n, c in own.items()), u.alias("u"))


def probabilities(docs: DataFrame, share: float = 0.75, alpha: float = 0.7, targets: dict[str, dict[str, float]] | None = None, topics: Column | None = None) -> tuple[DataFrame, dict[tuple[str, str, str], tuple[float, float]], dict[str, set[str]]]:
    """docs with class columns; probability and tokens of each cell; the classes of each dimension.

    targets: for "source", "lang" or "topic" the weight of each class. They need not sum to 1.
    """
    classed = classes(docs, topic() if topics is None else topics)
    cells, _ = save(classed.groupBy("c_source", "c_lang", "c_topic").agg(F.sum("c_tokens").alias("n")), "cells")
    total = cells.agg(F.sum("n")).head()[0] or 0
    own: dict[str, set[str]] = {}
    for d in DIMENSIONS:
        large = cells.groupBy(f"c_{d}").agg(F.sum("n").alias("n")).where(F.col("n") * CLASSES > total)
        own[d] = {r[0] for r in large.collect()} | set((targets or {}).get(d, {}))  # under CLASSES rows, and the given ones
    folded = cells.select(*(F.when(F.col(f"c_{d}").isin(*own[d]) if own[d] else F.lit(False), F.col(f"c_{d}")).otherwise("other").alias(d) for d in DIMENSIONS), "n").groupBy(*DIMENSIONS).agg(F.sum("n").alias("n"))
    rows = folded.collect()
    names = [sorted({r[i] for r in rows}) for i in range(3)]
    tokens = np.zeros([len(n) for n in names])
    for r in rows:
        tokens[tuple(names[i].index(r[i]) for i in range(3))] = r[3]
    goals = []
    for axis, d in enumerate(DIMENSIONS):
        sums = tokens.sum(axis=tuple(i for i in range(3) if i != axis))
        given = (targets or {}).get(d)
        weight = np.array([given.get(c, 0.0) for c in names[axis]]) if given else sums**alpha
        goals.append(weight / weight.sum() if weight.sum() else weight)
    p = rake(tokens, goals, share)
    found = {(names[0][i], names[1][j], names[2][k]): (float(p[i, j, k]), float(tokens[i, j, k])) for i, j, k in np.ndindex(*p.shape)}
    return classed, found, own


def _drawn(docs: DataFrame, **options) -> DataFrame:
    """row (a struct), u and p: the chance that its cell has. No name of docs' own can meet one of ours."""
    classed, cells, own = probabilities(docs, **options)
    if not cells:
        return classed.select("row", "u", F.lit(1.0).alias("p"))
    parts = [F.when(F.col(f"c_{d}").isin(*own[d]) if own[d] else F.lit(False), F.col(f"c_{d}")).otherwise("other") for d in DIMENSIONS]
    table = docs.sparkSession.createDataFrame([("\x1f".join(k), v[0]) for k, v in cells.items()], "c_cell string, c_p double")
    joined = classed.withColumn("c_cell", F.concat_ws("\x1f", *parts)).join(F.broadcast(table), "c_cell", "left")  # bounded, see above
    return joined.select("row", "u", F.coalesce("c_p", F.lit(1.0)).alias("p"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """docs' columns with p_keep, u and kept: kept if u, a number in [0, 1) from doc_id, is below p_keep.

    Columns of docs with those three names are replaced; sample() keeps all.
    """
    names = [f"row.`{c}`" for c in docs.columns if c not in ("p_keep", "u", "kept")]
    return _drawn(docs, **options).select(*names, F.col("p").alias("p_keep"), "u", (F.col("u") < F.col("p")).alias("kept"))


def sample(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that are kept, with all their columns as they were."""
    return _drawn(docs, **options).where(F.col("u") < F.col("p")).select("row.*")
