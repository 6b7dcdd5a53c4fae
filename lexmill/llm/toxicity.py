"""Toxic passages by maximum-scoring segments of token log-odds, with extreme-value calibration.

1. Weights. Each word carries features: its letter runs, their first and their last letters. A feature's
   log-odds between toxic and other training documents is smoothed by a Dirichlet prior, half a count and
   the feature's corpus rate (Monroe, Colaresi and Quinn, 2008); features beyond ``z_min`` standard errors form
   the lexicon; first or last letters are left out where one word accounts for most of them. A word scores its best feature less ``drift``; any other word, and one that
   only repeats the word before it, scores ``-drift``.
2. Segments. One linear scan a document lists every maximal scoring segment (Ruzzo and Tompa, 1999).
3. Calibration. lambda solves sum(p * exp(lambda * s)) = 1 over words outside toxic documents (Karlin and
   Altschul, 1990). A segment of score S among n words has the evidence lambda * S - ln(n), which is the
   negative logarithm of its expected number by chance with K at its bound 1; a document has the sum over
   its segments with positive evidence. A logistic curve in ln(1 + evidence), fitted to the training
   labels, gives the score.

Defined results: null text counts as empty; empty texts have no segment and get the lowest score. A label
row with null doc_id or null toxic is ignored; of several for one document the largest counts. Rows with
null doc_id are scored and never train. Repeated rows are scored alike. Without training rows of both
classes every score is 0. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import save
from .words import coded, parts, words

RUNS = re.compile(r"[^\W\d_]+")
HEADS, TAILS = (3, 4, 5, 6, 7, 8), (4, 5)


def features(word: str) -> set[str]:
    """The letter runs of a word, and their first and last letters where they have more than those."""
    found = set()
    for run in RUNS.findall(word.lower()):
        found.add(run)
        found |= {run[:n] + "-" for n in HEADS if len(run) > n}
        found |= {"-" + run[-n:] for n in TAILS if len(run) > n}
    return found


def again(codes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Which words stand right after the same word of their text. They count for nothing."""
    same = np.zeros(len(codes), bool)
    same[1:] = codes[1:] == codes[:-1]
    same[bounds[:-1][bounds[:-1] < len(codes)]] = False
    return same


def segments(at: list[int], value: list[float], drift: float) -> list[tuple[int, int, float]]:
    """Every maximal scoring segment (first word, past the last, score), in order.

    at, value: places and scores of the words that score above zero; all others score -drift. Each new
    segment looks back through a chain of ever lower left sums, so the scan takes linear time.
    """
    kept: list[tuple[int, int, float, float, int]] = []  # first, past, sum before, sum after, chain
    total, last = 0.0, 0
    for p, v in zip(at, value, strict=True):
        left = total - drift * (p - last)
        first, past, right = p, p + 1, left + v
        total, last = right, p + 1
        j = len(kept) - 1
        while True:
            while j >= 0 and kept[j][2] >= left:
                j = kept[j][4]
            if j < 0 or kept[j][3] >= right:
                kept.append((first, past, left, right, j))
                break
            first, left = kept[j][0], kept[j][2]
            chain = kept[j][4]
            del kept[j:]
            j = chain
    return [(a, b, r - l) for a, b, l, r, _ in kept]


@dataclass
class Model:
    """weight: feature to log-odds. Its size is bounded by the rows that train, so it is sent to every task."""

    weight: dict[str, float] = field(default_factory=dict)
    drift: float = 1.0
    decay: float = 1.0
    curve: tuple[float, float] | None = None

    def value(self, word: str) -> float:
        return max((self.weight[f] for f in features(word) if f in self.weight), default=0.0) - self.drift

    def passages(self, texts: pa.Array) -> Iterator[tuple[int, list[tuple[int, int, float]]]]:
        """Number of words and maximal segments of each text."""
        bounds, flat = words(texts)
        codes, names = coded(flat)
        by_name = np.array([self.value(w) for w in names]) if names else np.zeros(0)
        scores = by_name[codes] if len(codes) else by_name
        scores[again(codes, bounds)] = -self.drift
        hits = np.flatnonzero(scores > 0)
        cut = np.searchsorted(hits, bounds)
        for i in range(len(texts)):
            own = hits[cut[i] : cut[i + 1]]
            yield int(bounds[i + 1] - bounds[i]), segments((own - bounds[i]).tolist(), scores[own].tolist(), self.drift) if len(own) else []

    def evidence(self, n: int, found: list[tuple[int, int, float]]) -> float:
        floor = math.log(max(n, 1))
        return sum(max(0.0, self.decay * s - floor) for _, _, s in found)

    def score(self, evidence: float) -> float:
        if self.curve is None:
            return 0.0
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.curve[0] + self.curve[1] * math.log1p(evidence)))))


def _counts(df: DataFrame, within: frozenset[str] | None, least: int) -> DataFrame:
    """Rows (feature, times, docs) of the texts in df; feature null: all words. within: only these."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 0, 1_000_000):  # each distinct word has some ten features
            bounds, flat = words(batch.column(0))
            codes, names = coded(flat)
            if not names:
                continue
            counted = ~again(codes, bounds)
            owner, codes = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[counted], codes[counted]
            times = np.bincount(codes, minlength=len(names))
            docs = np.bincount(np.unique(owner * len(names) + codes) % len(names), minlength=len(names))
            total, seen = Counter(), Counter()
            for w, t, d in zip(names, times.tolist(), docs.tolist(), strict=True):
                for f in features(w):
                    if within is None or f in within:
                        total[f] += t
                        seen[f] += d
            yield pa.RecordBatch.from_arrays([pa.array([None, *total], pa.string()), pa.array([len(codes), *total.values()], pa.int64()), pa.array([0, *(seen[f] for f in total)], pa.int64())], ["feature", "times", "docs"])

    found = df.select("text").mapInArrow(count, "feature string, times long, docs long")
    return found.groupBy("feature").agg(F.sum("times").alias("times"), F.sum("docs").alias("docs")).where(F.col("feature").isNull() | (F.col("docs") >= least))


def _decay(rates: list[tuple[float, float]]) -> float:
    """The positive root lambda of sum(p * exp(lambda * s)) = 1, by bisection."""
    low, high = 1e-6, 8.0
    for _ in range(60):
        mid = (low + high) / 2
        if sum(p * math.exp(min(700.0, mid * s)) for s, p in rates) > 1:
            high = mid
        else:
            low = mid
    return max(low, 1e-3)


def _logistic(counts: list[tuple[float, int, int]]) -> tuple[float, float]:
    """Intercept and slope of a logistic curve with a weak normal prior. counts: (x, ones, zeros)."""
    x, ones, zeros = (np.array(v, float) for v in zip(*counts, strict=True))
    b = np.zeros(2)
    design = np.stack([np.ones_like(x), x], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ b, -30, 30)))
        gradient = design.T @ (ones - (ones + zeros) * p) - 0.05 * b
        step = np.linalg.solve(design.T @ (design * ((ones + zeros) * p * (1 - p))[:, None]) + 0.05 * np.eye(2), gradient)
        b += np.clip(step, -2, 2)
        if abs(step).max() < 1e-8:
            break
    return float(b[0]), float(max(b[1], 1e-3))


def train(docs: DataFrame, labels: DataFrame, train_on: Column, max_rows: int = 40_000, least_docs: int = 3, prior: float = 500.0, z_min: float = 2.4, drift: float = 1.0) -> Model:
    """Fits a Model to labelled rows of docs where train_on (a condition on doc_id) holds.

    max_rows bounds the labelled rows that are used: those with the smallest hash of doc_id.
    A feature must stand in least_docs toxic documents, since one document's repetitions prove nothing; there is no
    bound on their number but that of the rows.
    """
    marked = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic")).where(train_on)
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)  # at most max_rows rows of 9 bytes: small enough to broadcast
    rows, _ = save(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(F.coalesce("text", F.lit("")).alias("text"), "toxic"), "toxicity")
    bad = {r.feature: r.times for r in _counts(rows.where("toxic"), None, least_docs).collect()}
    n_bad = bad.pop(None, 0)
    good = {r.feature: r.times for r in _counts(rows.where("not toxic"), frozenset(bad), 0).collect()}
    n_good = good.pop(None, 0)
    if not n_bad or not n_good:
        return Model()
    model = Model(drift=drift)
    rates = []
    single: dict[str, int] = {}  # affixes by the count of the one word that has most of them
    for f, y in bad.items():
        if "-" not in f:
            for part in features(f) - {f}:
                single[part] = max(single.get(part, 0), y)
    for f, y in bad.items():
        if y < 1.5 * single.get(f, 0):
            continue  # the word itself tells as much
        x = good.get(f, 0)
        a = 0.5 + prior * (x + y) / (n_bad + n_good)
        odds = math.log((y + a) / (n_bad + prior - y - a + 1e-9)) - math.log((x + a) / (n_good + prior - x - a + 1e-9))
        if odds > drift and odds / math.sqrt(1 / (y + a) + 1 / (x + a)) >= z_min:
            model.weight[f] = odds
            rates.append((odds - drift, (x + 0.5) / (n_good + 1)))
    mean = min(0.5, sum(p for _, p in rates))
    model.decay = _decay([*rates, (-drift, 1 - mean)]) if rates else 1.0

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 0):
            x = [round(math.log1p(model.evidence(n, found)), 1) for n, found in model.passages(batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.float64()), batch.column(1)], ["x", "toxic"])

    bins = rows.select("text", "toxic").mapInArrow(weigh, "x double, toxic boolean").groupBy("x").agg(F.count_if("toxic").alias("ones"), F.count_if(~F.col("toxic")).alias("zeros"))
    model.curve = _logistic([tuple(r) for r in bins.orderBy("x").collect()])
    return model


def apply(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, evidence, and passages: arrays of first word, past the last word, segment score."""
    passage = pa.list_(pa.struct([("first", pa.int32()), ("past", pa.int32()), ("score", pa.float64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 1):
            score, evidence, spans = [], [], []
            for n, found in model.passages(batch.column(1)):
                evidence.append(e := model.evidence(n, found))
                score.append(model.score(e))
                spans.append([{"first": a, "past": b, "score": s} for a, b, s in found if model.decay * s > math.log(max(n, 1))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64()), pa.array(evidence, pa.float64()), pa.array(spans, passage)], ["doc_id", "score", "evidence", "passages"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {kind}, score double, evidence double, passages array<struct<first: int, past: int, score: double>>")


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """docs without the rows whose score is at least threshold, in one scan."""
    place = docs.columns.index("text")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, place):
            yield batch.filter(pa.array([model.score(model.evidence(n, found)) < threshold for n, found in model.passages(batch.column(place))], pa.bool_()))

    return docs.mapInArrow(scan, docs.schema)


def held_out(doc_id: str = "doc_id", parts: int = 3, which: int = 1) -> Column:
    """crc32 of the id's text leaves the remainder ``which``; false for null ids."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts == which, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **train_options) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, evidence, passages."""
    model = train(docs, labels, ~held_out(), **train_options)
    return apply(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "evidence", "passages")
