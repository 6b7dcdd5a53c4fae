"""A hidden Markov language model over whole documents.

1. Chunks. Texts become words and an end token; a chunk of documents keeps its distinct words (64-bit hashes,
   whose low byte is the word's class, told by its last two bytes) and each document's words as numbers.
2. Counts. Each chunk sends one record per distinct word to the owner of the hash's range; the owner sums the
   training counts of all chunks and answers each chunk with the counts of its own words. A word that a third
   of all tokens are is one record a chunk.
3. Symbols. Words with at least 1 / FREQUENT of all training tokens are symbols (so at most FREQUENT of them);
   any other word is emitted as its class, and within the class by (c + 1) / (N + V + 1) over its rare words.
4. Training. States start from anchor words that seldom share a document; then Baum-Welch: every partition
   runs scaled forward and backward recursions over its training documents, and expected counts are added up
   across partitions, a part of the model at a time.
5. Scores. The scaled forward recursion gives each text's exact likelihood under the model, end included.

Defined results: null text counts as empty and has one token, the end. Rows with null doc_id are training
rows. Repeated rows are scored alike and count as often as they stand there. Without training rows all counts
are 0, V and N are 0 and the score is the base score. Only doc_id (whole numbers) and text are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import drop, save, spread
from .words import coded, parts as split_parts, words

FREQUENT, CLASSES, TOP = 32_000, 256, 64
CHUNK_BYTES, BATCH_TOKENS, PARTS, RECORDS = 8_000_000, 400_000, 256, 4_000_000


def is_held_out(doc_id: int | None, parts: int, which: int) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % parts == which


def chunks(docs: DataFrame, parts: int, which: int) -> DataFrame:
    """g, doc_ids, held, bounds, ids, hashes (ascending), counts (training), n_train."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in split_parts(batches, 1, CHUNK_BYTES):
            doc_ids = batch.column(0).to_pylist()
            held = np.array([is_held_out(d, parts, which) for d in doc_ids])
            bounds, flat = words(batch.column(1))
            ids, names = coded(flat)
            encoded = [w.encode("utf-8", "surrogatepass") for w in names]
            own = np.fromiter(map(xxhash.xxh64_intdigest, encoded), np.uint64, len(encoded))
            kind = np.fromiter((zlib.crc32(w[-2:]) & 255 for w in encoded), np.uint64, len(encoded))
            hashes, ids_of = np.unique(own & ~np.uint64(255) | kind, return_inverse=True)
            ids = ids_of[ids] if len(ids) else np.zeros(0, np.int64)
            training = np.repeat(~held, np.diff(bounds))
            counts = np.bincount(ids[training], minlength=len(hashes))
            yield pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), pa.array([doc_ids], pa.list_(pa.int64())), *(pa.array([x.tobytes()], pa.binary()) for x in (held, bounds, ids.astype("<u4"), hashes.astype("<u8"), counts.astype("<i8"))), pa.array([int(training.sum() + (~held).sum())], pa.int64()), pa.array([len(hashes)], pa.int64())],
                ["g", "doc_ids", "held", "bounds", "ids", "hashes", "counts", "n_train", "n_words"],
            )
            number += 1

    return docs.select("doc_id", "text").mapInArrow(run, "g long, doc_ids array<long>, held binary, bounds binary, ids binary, hashes binary, counts binary, n_train long, n_words long")


def totals(packed: DataFrame, n_train: int, records: int) -> DataFrame:
    """Answers of the owners of hash ranges. kind 0: counts for chunk g; 1: words n and tokens of the class
    number; 2: a frequent word's hash and count."""
    n = max(spread(packed.sparkSession), -(-records // RECORDS))
    least = max(2, -(-n_train // FREQUENT))
    edges = np.array([(i << 64) // n for i in range(1, n)], np.uint64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for g, hashes, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                hashes, counts = np.frombuffer(hashes, "<u8"), np.frombuffer(counts, "<i8")
                cut = [0, *np.searchsorted(hashes, edges).tolist(), len(hashes)]
                own = [i for i in range(n) if cut[i] < cut[i + 1]]
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array([g] * len(own), pa.int64()), *(pa.array([x[cut[i] : cut[i + 1]].tobytes() for i in own], pa.binary()) for x in (hashes, counts.astype("<u4") if len(counts) == 0 or counts.max() < 1 << 32 else counts))], ["owner", "g", "hashes", "counts"])

    def add(table: pa.Table) -> pa.Table:
        gs = table.column("g").to_pylist()
        hashes = [np.frombuffer(x, "<u8") for x in table.column("hashes").to_pylist()]
        counts = [np.frombuffer(x, "<u4" if len(x) == 4 * len(h) else "<i8") for x, h in zip(table.column("counts").to_pylist(), hashes, strict=True)]
        known, place = np.unique(np.concatenate(hashes), return_inverse=True)
        total = np.bincount(place, np.concatenate(counts).astype(float), len(known)).astype(np.int64)
        kind = (known & np.uint64(255)).astype(np.int64)
        often, seen = total >= least, (total > 0) & (total < least)
        n_class, v_class = np.bincount(kind[seen], total[seen], CLASSES).astype(np.int64), np.bincount(kind[seen], minlength=CLASSES)
        answers, at = [], 0
        for h in hashes:
            answers.append(total[place[at : at + len(h)]].astype("<i8").tobytes())
            at += len(h)
        m, k = len(gs), int(often.sum())
        return pa.table({
            "kind": pa.array([0] * m + [1] * CLASSES + [2] * k, pa.int32()),
            "owner": pa.array([table.column("owner")[0].as_py()] * (m + CLASSES + k), pa.int32()),
            "number": pa.array([*gs, *range(CLASSES), *known[often].view(np.int64).tolist()], pa.int64()),
            "n": pa.array([0] * m + n_class.tolist() + total[often].tolist(), pa.int64()),
            "v": pa.array([0] * m + v_class.tolist() + [1] * k, pa.int64()),
            "answer": pa.array([*answers, *[None] * (CLASSES + k)], pa.binary()),
        })

    dealt = packed.select("g", "hashes", "counts").mapInArrow(deal, "owner int, g long, hashes binary, counts binary")
    return dealt.groupBy("owner").applyInArrow(add, "kind int, owner int, number long, n long, v long, answer binary")


class Symbols:
    """The model's alphabet: frequent words by hash, classes of rare ones, the end."""

    def __init__(self, frequent: list[tuple[int, int]], classes: list[tuple[int, int]], n_train: int, n_docs: int) -> None:
        own = sorted((h & (1 << 64) - 1, c) for h, c in frequent)
        self.hashes = np.array([h for h, _ in own], np.uint64)
        counts = [c for _, c in own]
        self.n_class, self.v_class = (np.array(x, np.int64) for x in zip(*classes, strict=True))
        self.end = len(own) + CLASSES
        self.n, self.n_docs = n_train, n_docs
        self.v = len(own) + int(self.v_class.sum()) + (n_docs > 0)
        self.unigram = np.array([*counts, *self.n_class.tolist(), n_docs], float) + 0.5
        self.unigram /= self.unigram.sum()

    def of(self, hashes: np.ndarray) -> np.ndarray:
        kind = len(self.hashes) + (hashes & np.uint64(255)).astype(np.int64)
        if not len(self.hashes):
            return kind
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, kind)


def encoded(packed: DataFrame, answers: DataFrame, symbols: Symbols) -> DataFrame:
    """g, doc_ids, held, bounds, syms (ends included), base, known, rare: a chunk a row."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {k: [] for k in ("syms", "bounds", "base", "known", "rare")}
        for r in left.to_pylist():
            hashes, ids, bounds = np.frombuffer(r["hashes"], "<u8"), np.frombuffer(r["ids"], "<u4").astype(np.int64), np.frombuffer(r["bounds"], "<i8")
            parts = sorted(zip(right.column("owner").to_pylist(), right.column("answer").to_pylist(), strict=True))
            count = np.frombuffer(b"".join(x for _, x in parts), "<i8")
            symbol = symbols.of(hashes)
            base = np.log10((count + 1) / (symbols.n + symbols.v + 1))
            kind = (hashes & np.uint64(255)).astype(np.int64)
            rare = np.where(symbol >= len(symbols.hashes), np.log10((count + 1) / (symbols.n_class[kind] + symbols.v_class[kind] + 1)), 0.0)
            n = np.diff(bounds)
            owner = np.repeat(np.arange(len(n)), n)
            syms = np.full(len(ids) + len(n), symbols.end, "<u2")
            syms[np.arange(len(ids)) + owner] = symbol[ids]
            out["syms"].append(syms.tobytes())
            out["bounds"].append((bounds + np.arange(len(bounds))).astype("<i8").tobytes())
            for name, x, at_end in (("base", base, np.log10((symbols.n_docs + 1) / (symbols.n + symbols.v + 1))), ("rare", rare, 0.0), ("known", (count > 0).astype(float), float(symbols.n_docs > 0))):
                out[name].append((np.bincount(owner, x[ids], len(n)) + at_end).astype("<f8").tobytes())
        return pa.table({"doc_ids": left.column("doc_ids"), "held": left.column("held"), **{k: pa.array(v, pa.binary()) for k, v in out.items()}})

    a, b = packed.select("g", "doc_ids", "held", "bounds", "ids", "hashes"), answers.where("kind = 0").select(F.col("number").alias("g"), "owner", "answer")
    return a.groupBy("g").cogroup(b.groupBy("g")).applyInArrow(run, "doc_ids array<long>, held binary, syms binary, bounds binary, base binary, known binary, rare binary")


class Model:
    """start: states; move: states by states; emit: symbols by states, columns sum to 1."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> None:
        self.start, self.move, self.emit = start, move, emit

    @staticmethod
    def groups(lengths: np.ndarray) -> Iterator[np.ndarray]:
        """Sequences of about equal length, longest first, of BATCH_TOKENS places at most (or one alone)."""
        order, at = np.argsort(-lengths, kind="stable"), 0
        while at < len(order):
            n = max(1, BATCH_TOKENS // max(1, int(lengths[order[at]])))
            yield order[at : at + n]
            at += n

    def _forward(self, syms: np.ndarray, bounds: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, ...]:
        length = np.diff(bounds)[own]
        steps, k = int(length[0]), len(self.start)
        table = np.zeros((steps, len(own)), np.int64)
        for i, d in enumerate(own):
            table[: length[i], i] = syms[bounds[d] : bounds[d + 1]]
        live = np.searchsorted(-length, -np.arange(steps), side="left")
        emit = self.emit[table]
        alpha, scale = np.zeros((steps, len(own), k)), np.ones((steps, len(own)))
        a = self.start * emit[0]
        for t in range(steps):
            if t:
                a = (a[: live[t]] @ self.move) * emit[t, : live[t]]
            c = a.sum(1)
            a = a / c[:, None]
            alpha[t, : live[t]], scale[t, : live[t]] = a, c
        return table, live, emit, alpha, scale

    def log_likelihood(self, syms: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Natural logarithm of the probability of each sequence."""
        out = np.zeros(len(bounds) - 1)
        for own in self.groups(np.diff(bounds)):
            out[own] = np.log(self._forward(syms, bounds, own)[4]).sum(0)
        return out

    def expected(self, syms: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Expected counts of starts, moves and emissions over all sequences, in one flat array."""
        k, m = len(self.start), len(self.emit)
        start, move, emit = np.zeros(k), np.zeros((k, k)), np.zeros((m, k))
        for own in self.groups(np.diff(bounds)):
            table, live, e, alpha, scale = self._forward(syms, bounds, own)
            steps = len(table)
            gamma, ahead = np.zeros_like(alpha), np.zeros_like(alpha)
            beta = np.ones((len(own), k))
            for t in range(steps - 1, -1, -1):
                n = live[t]
                if t + 1 < steps and live[t + 1]:
                    x = e[t + 1, : live[t + 1]] * beta[: live[t + 1]] / scale[t + 1, : live[t + 1], None]
                    ahead[t, : live[t + 1]] = x
                    beta[: live[t + 1]] = x @ self.move.T
                gamma[t, :n] = alpha[t, :n] * beta[:n]
            start += gamma[0].sum(0)
            move += self.move * (alpha.reshape(-1, k).T @ ahead.reshape(-1, k))
            valid = (np.arange(len(own)) < live[:, None]).ravel()
            flat, g = table.ravel()[valid], gamma.reshape(-1, k)[valid]
            for s in range(k):
                emit[:, s] += np.bincount(flat, g[:, s], m)
        return np.concatenate([start, move.ravel(), emit.ravel()])

    @classmethod
    def from_counts(cls, counts: np.ndarray, k: int, unigram: np.ndarray, weight: float = 200.0) -> Model:
        """Expected counts, smoothed by weight counts of the unigram distribution a state."""
        start, move, emit = np.split(counts, [k, k + k * k])
        move, emit = move.reshape(k, k) + 1.0, emit.reshape(-1, k) + weight * unigram[:, None]
        return cls((start + 1.0) / (start + 1.0).sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def _training(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Symbols and bounds of the training documents of each chunk."""
    for held, syms, bounds in zip(*(batch.column(n).to_pylist() for n in ("held", "syms", "bounds")), strict=True):
        keep, syms, bounds = ~np.frombuffer(held, bool), np.frombuffer(syms, "<u2").astype(np.int64), np.frombuffer(bounds, "<i8")
        length = np.diff(bounds)
        yield syms[np.repeat(keep, length)], np.concatenate([[0], np.cumsum(length[keep])])


def _summed(rows: DataFrame, count, size: int) -> np.ndarray:
    """The sum over all training chunks of count(symbols, bounds), an array of size numbers.

    Each task adds up its own chunks and sends PARTS pieces; the pieces of a part are added by its owner.
    """
    edges = [size * i // PARTS for i in range(PARTS + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for syms, bounds in _training(batch):
                if len(bounds) > 1:
                    total += count(syms, bounds)
        yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array([total[a:b].astype("<f8").tobytes() for a, b in zip(edges, edges[1:], strict=False)], pa.binary())], ["part", "piece"])

    def add(own: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": [own.part.iloc[0]], "piece": [sum(np.frombuffer(x, "<f8") for x in own.piece).tobytes()]})

    found = rows.select("held", "syms", "bounds").mapInArrow(run, "part int, piece binary").groupBy("part").applyInPandas(add, "part int, piece binary").collect()  # the model's size
    return np.concatenate([np.frombuffer(r.piece, "<f8") for r in sorted(found, key=lambda r: r.part)]) if found else np.zeros(size)


def train(rows: DataFrame, symbols: Symbols, states: int, rounds: int) -> Model:
    """Anchored start, then rounds of Baum-Welch over all training documents."""
    m = symbols.end + 1
    top = np.argsort(-symbols.unigram[: len(symbols.hashes)], kind="stable")[:TOP]
    if len(top) < 2:
        states = 1
    rank = np.full(m, -1)
    rank[top] = np.arange(len(top))

    def together(syms: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        r, n = rank[syms], len(bounds) - 1
        owner = np.repeat(np.arange(n), np.diff(bounds))
        present = np.zeros((n, len(top)))
        present[owner[r >= 0], r[r >= 0]] = 1
        return (present.T @ present).ravel()

    anchors = [0]
    if states > 1:
        both = _summed(rows, together, len(top) ** 2).reshape(len(top), len(top))
        alike = both / np.maximum(1, np.minimum.outer(both.diagonal(), both.diagonal()))
        while len(anchors) < min(states, len(top)):
            left = [i for i in range(len(top)) if i not in anchors]
            anchors.append(min(left, key=lambda i: (alike[i, anchors].max(), i)))
    k = len(anchors)
    anchor = np.full(m, -1)
    if len(top):
        anchor[top[anchors]] = np.arange(k)

    def near(syms: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        n, a = len(bounds) - 1, anchor[syms]
        owner = np.repeat(np.arange(n), np.diff(bounds))
        share = np.full((n, k), 0.1)
        np.add.at(share, (owner[a >= 0], a[a >= 0]), 1.0)
        share /= share.sum(1, keepdims=True)
        emit = np.stack([np.bincount(syms, share[owner, s], m) for s in range(k)], 1)
        return np.concatenate([share.sum(0), np.diag((emit.sum(0) * 20)).ravel() + emit.sum() / k, emit.ravel()])

    model = Model.from_counts(_summed(rows, near, k + k * k + m * k), k, symbols.unigram)
    for _ in range(rounds):
        model = Model.from_counts(_summed(rows, model.expected, k + k * k + m * k), k, symbols.unigram)
    return model


def score(docs: DataFrame, states: int = 6, rounds: int = 2, parts: int = 7, which: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every document."""
    spark = docs.sparkSession
    packed, packed_path = save(chunks(docs, parts, which), "hmm-chunks")
    n_train, records = (x or 0 for x in packed.agg(F.sum("n_train"), F.sum("n_words")).head())
    answers, answers_path = save(totals(packed, n_train, records), "hmm-counts")
    classes = {r.number: (r.n, r.v) for r in answers.where("kind = 1").groupBy("number").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()}
    frequent = [(r.number, r.n) for r in answers.where("kind = 2").select("number", "n").collect()]  # at most FREQUENT
    n_words = sum(n for n, _ in classes.values()) + sum(n for _, n in frequent)
    symbols = Symbols(frequent, [classes.get(i, (0, 0)) for i in range(CLASSES)], n_train, n_train - n_words)
    rows, _ = save(encoded(packed, answers, symbols), "hmm-symbols")
    drop(spark, packed_path, answers_path)
    model = train(rows, symbols, states, rounds) if n_train else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                bounds = np.frombuffer(r["bounds"], "<i8")
                base, known, rare = (np.frombuffer(r[n], "<f8") for n in ("base", "known", "rare"))
                own = model.log_likelihood(np.frombuffer(r["syms"], "<u2").astype(np.int64), bounds) / np.log(10) + rare if model else base
                columns = [pa.array(r["doc_ids"], pa.int64()), pa.array(np.frombuffer(r["held"], bool)), pa.array(np.diff(bounds)), pa.array(known.round().astype(np.int64)), pa.array([symbols.n] * len(base), pa.int64()), pa.array(base), pa.array(own)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return rows.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
